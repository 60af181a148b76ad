"""Scalar functions as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000  # microseconds

# Field agreement probabilities (match, non-match), thresholds, words and patterns.
FIELD_WEIGHTS = {"email": (0.97, 0.001), "phone": (0.95, 0.005), "name": (0.90, 0.01), "dob": (0.95, 0.01), "kyc_doc": (0.99, 0.0005)}
NAME_SIMILARITY = 0.90
MERGE_THRESHOLD = 2.0
NEGATIVE_WORDS = (
    "hospital", "hospitalized", "emergency", "refund", "complaint", "complain", "cancel", "cancelled", "canceled", "fee", "dispute", "angry", "terrible",
    "unacceptable", "frustrated", "frustrating", "broken", "failed", "denied", "overcharged", "fraud", "stolen", "scam", "income dropped", "lost my job",
    "layoff", "hardship", "payment plan",
)
INJECTION_MARKERS = ("ignore all rules", "ignore previous", "approve this", "override policy", "system prompt", "you are now", "disregard", "escalate this to approved")
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"(?:\+?\d[\d\s().-]{8,}\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
#: Java's classes are ASCII unless told otherwise; dates do not count as phones.
PII = {"email": f"(?U){EMAIL}", "phone": rf"(?U)(?!\d{{4}}-\d{{2}}-\d{{2}}){PHONE}", "ssn": f"(?U){SSN}"}
HALF_LIFE_DAYS, DECAY_FLOOR, RECENCY_PENALTY = 30.0, 0.10, 0.01


def canonical_email(email: Column) -> Column:
    """Trimmed and lower-cased; the empty string is null."""
    return F.when(F.length(email) > 0, F.lower(F.trim(email)))


def canonical_phone(phone: Column) -> Column:
    """Digits alone, without the leading 1 of eleven."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) > 0, digits)


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PII["email"], 0), F.lit(""))


def first_phone(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?U){PHONE}", 0), F.lit(""))


def pii_kinds(text: Column) -> Column:
    """Sorted kinds of personal data found."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in PII.items()]))


def redact(text: Column) -> Column:
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"[{kind.upper()}_REDACTED]")
    return text


def has_injection(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, INJECTION_MARKERS)), lambda m: F.contains(low, m)), F.lit(False))


def negative_words(text: Column) -> Column:
    """Sorted lexicon terms that are substrings of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, sorted(NEGATIVE_WORDS))), lambda w: F.contains(low, w))


def tokens(text: Column, limit: int = 512) -> Column:
    """Lower-case alphanumeric words, the first ``limit``, then their bigrams (the embedding's definition)."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, limit)

    def grams(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, limit), lambda a, b: F.concat_ws("_", a, b))
        return F.concat(w, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0))))

    return F.get(F.transform(F.array(words), grams), 0)


def bucket_of(token: Column, dims: int = 256) -> Column:
    """First byte of the token's MD5, as its dimension."""
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int") % dims


def sign_of(token: Column) -> Column:
    """Parity of the fifth byte of the token's MD5."""
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def cosine(a: Column, b: Column) -> Column:
    """0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def decay(confidence: Column, age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Half-life decay; a future age counts as 0."""
    if half_life <= 0:
        return confidence
    return confidence * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.70, "high").when(confidence >= 0.45, "medium").otherwise("low")


def log_ratio(agree: Column, field: str) -> Column:
    """Log-likelihood ratio of a field's agreement; null (a side is missing) counts nothing."""
    m, u = FIELD_WEIGHTS[field]
    return F.coalesce(F.when(agree, math.log(m / u)).when(~agree, math.log((1 - m) / (1 - u))), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, null if a side is null."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def chunk_text(text: Column, most: int = 600) -> Column:
    """Pieces of a text: one of up to ``most`` characters stays whole, a longer one is packed by words, none for null and blanks.

    A fold over the words: a word opens a piece where it and a space would fill the open one up to ``most``.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    none = F.array().cast("array<string>")

    def take(acc: Column, word: Column) -> Column:
        full = (F.length(acc["open"]) > 0) & (F.length(acc["open"]) + F.length(word) + 2 > most)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full | (acc["open"] == ""), word).otherwise(F.concat_ws(" ", acc["open"], word)).alias("open"))

    packed = F.aggregate(F.split(bare, r"(?U)\s+"), F.struct(none.alias("done"), F.lit("").alias("open")), take, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(bare == "", none).when(F.length(bare) <= most, F.array(bare)).otherwise(packed)


def age_seconds(since: Column, now: Column) -> Column:
    """Seconds from one moment (microseconds) to another, none for a future one."""
    return F.greatest(F.lit(0.0), (now - since) / 1e6)


def flag_summary(domain: Column, flags: Column) -> Column:
    """A finding in words: its flags with their confidence to two places, halves of the exact binary value to the even digit."""
    places = lambda x: F.translate(F.format_number(x, 2), ",", "")
    parts = F.array_join(F.transform(flags, lambda f: F.format_string("%s (conf %s)", f["type"], places(f["confidence"]))), "; ")
    return F.when(F.size(flags) == 0, F.concat(domain, F.lit(": no notable signals."))).otherwise(F.concat(domain, F.format_string(": %d flag(s): ", F.size(flags)), parts))


def path_get(state: Column, path: str) -> Column:
    """What a state, a map of dotted paths to JSON values, holds at a path: its value, or the map of what lies below."""
    below = F.map_filter(state, lambda k, _: k.startswith(path + "."))
    return F.coalesce(F.element_at(state, path), F.when(F.size(below) > 0, F.to_json(F.transform_keys(below, lambda k, _: F.substring(k, len(path) + 2, 10_000)))))


def path_set(state: Column, path: str, value: Column) -> Column:
    """The state with one path set: what lay below it, and a plain value above it, give way."""
    parts = path.split(".")
    above = [".".join(parts[:i]) for i in range(1, len(parts))]
    kept = F.map_filter(state, lambda k, _: ~(k.isin(path, *above) | k.startswith(path + ".")))
    return F.map_concat(kept, F.create_map(F.lit(path), value))


def self_contained(value: Column) -> Column:
    """True for a JSON object that carries its own provenance or confidence."""
    keys = F.json_object_keys(value)
    return F.coalesce(F.array_contains(keys, "provenance") | F.array_contains(keys, "confidence"), F.lit(False))


def redact_all(row: Column) -> Column:
    """A nested value as JSON with the personal data of all its strings redacted."""
    return redact(F.to_json(row))
