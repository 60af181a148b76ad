"""Language identification by Bayesian fusion of four kinds of evidence.

Text gives a likelihood from byte trigrams; the declared markup language, the
address suffix and the host give factors learnt from the corpus itself by
grouped aggregation of the text's posteriors. Host priors are smoothed
hierarchically: a host leans on its domain and a domain on the whole, each
without the row in question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, unit_hash, written

GRAMS = 1 << 15
#: A byte takes part in three trigrams, so their log likelihoods are divided by three.
TEMPER = 1 / 3
UNKNOWN = "und"
#: Labelled rows of each language on which the trigram model is fitted, on average; all of a language that has no more.
FIT_ROWS = 4000
#: Languages of the model: those with most labelled rows, ties to the first by name. A label beyond them counts as another language.
MOST_LANGUAGES = 256


def grams_of(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts of a batch and the number a text has (bytes less two); ASCII case is folded."""
    texts = batch.cast(pa.large_binary())
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    key = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    # trigrams that straddle two texts go
    ends = np.cumsum(sizes)
    inside = np.ones(len(low), bool)
    for back in (1, 2):
        at = ends - back
        inside[at[(at >= 0) & (sizes >= back)]] = False
    return bucket[inside[: len(bucket)]], np.maximum(sizes - 2, 0)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets: a column a language, uniform for unknown text."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Tempered log likelihoods, a row a text."""
        grams, counts = grams_of(texts)
        out = np.zeros((len(texts), self.logs.shape[1]))
        rows = np.flatnonzero(counts)
        if len(rows):
            starts = (np.cumsum(counts) - counts)[rows]
            for k in range(self.logs.shape[1]):
                out[rows, k] = np.add.reduceat(self.logs[grams, k], starts)
        return out * TEMPER


def fit_text_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES) -> TextModel:
    """Fit on some ``fit_rows`` labelled rows of every language, so no language is lost at any size.

    A language's rows are counted over all rows; those whose hash is within
    its share are taken, and always the least. The model has the
    ``most_languages`` with most rows, which bounds what reaches the driver, to
    as many times ``GRAMS``, whatever a dirty label column holds.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), unit_hash(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))).alias("u"))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("u").alias("least"))
    most = counted.orderBy(F.desc("rows"), "lang").limit(most_languages)
    upto = most.select("lang", F.greatest("least", fit_rows / F.col("rows")).alias("upto"))
    # at most a row for each language of the model
    sample = known.join(F.broadcast(upto), "lang").where(F.col("u") <= F.col("upto")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                own = batch.column("text").filter(pa.array([x == lang for x in langs]))
                grams, _ = grams_of(own)
                held[lang] = held.get(lang, 0) + np.bincount(grams, minlength=GRAMS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(lean(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    logs = np.zeros((GRAMS, len(languages) + 1), np.float32)
    logs[:, -1] = -np.log(GRAMS)
    for k, lang in enumerate(languages):
        n = np.zeros(GRAMS)
        own = counts[counts["lang"] == lang]
        n[own["gram"]] = own["n"]
        # numbers and addresses inside a text count little against its language: a floor just below chance
        logs[:, k] = np.maximum(np.log((n + 0.05) / (n.sum() + 0.05 * GRAMS)), -np.log(GRAMS) - 1.0)
    return TextModel(languages, logs)


#: Scripts, styles, comments and tags. One that is not closed goes to the end, as a reader takes it, so no part is read again and again.
_MARKUP = r"(?is)<(script|style)\b[^>]*(?:>(?:.*?</\1\s*+>|.*)|\z)|<!--(?:.*?-->|.*)|<[a-z/!?][^>]*(?:>|\z)"


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags, in time linear in the page."""
    bare = F.regexp_replace(html, _MARKUP, " ")
    return F.regexp_replace(bare, r"&[#a-zA-Z0-9]++;|\s+", " ")


def html_language(html: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of the root element, null if there is none."""
    root = F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1)
    found = F.lower(F.regexp_extract(root, r"(?i)\slang\s*+=\s*+[\"']?([a-zA-Z]+)", 1))
    return F.nullif(found, F.lit(""))


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit(""))


def identify(
    rows: DataFrame,
    model: TextModel,
    id_col: str,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    strength: float = 8.0,
    accept: float = 0.5,
) -> DataFrame:
    """``id_col, lang, posterior, text_lang, declared, host, accepted`` of every row.

    ``lang`` is the language of greatest posterior, ``und`` for text that no
    language explains better than chance and for rows without any evidence.
    A text of fewer than three bytes (null and empty ones too) is none; its
    declared language, suffix and host then decide alone, and ``text_lang`` is
    ``und``. A row is accepted if its language is known and its posterior is
    at least ``accept``. Missing
    evidence (null) is no evidence. Ties go to the first language by name.
    Repeated rows and null ids are kept as rows; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    names = (*model.languages, UNKNOWN)
    known = model.languages
    none = F.lit(None).cast("string")
    code = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)) if declared is not None else none
    code = F.when(code.isin(*model.languages), code).when(F.length(code) > 0, F.lit("other"))
    light = rows.select(F.col(id_col).alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), code.alias("declared"), (host if host is not None else none).alias("host"), (suffix if suffix is not None else none).alias("suffix"))
    id_type = light.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = np.log([0.98 / len(known)] * len(known) + [0.02])
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:  # slices of half a MB, or one long text
                base = ends[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(ends, base + (1 << 19), side="right")) - at))
                logs = model.score(part.column("text"))
                has = np.asarray(pc.greater(pc.binary_length(part.column("text")), 2))
                mass = softmax(logs + prior)[:, :-1] * has[:, None]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "declared", "host", "suffix")], pa.array(list(logs), pa.list_(pa.float64())), pa.array(list(mass), pa.list_(pa.float64())), pa.array(has)], ["id", "declared", "host", "suffix", "logs", "mass", "has_text"])
                at += part.num_rows

    scored = light.mapInArrow(lean(score), f"id {id_type}, declared string, host string, suffix string, logs array<double>, mass array<double>, has_text boolean")
    scored = written(scored.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "language-text")
    sums = F.array(*[F.sum(F.col("mass")[k]) for k in range(len(known))])
    # One row, and at most one a language and "other": bounded by the model.
    whole = np.array(scored.agg(sums.alias("m")).first()["m"], float) if not scored.isEmpty() else np.zeros(len(known))
    by_code = {r["declared"]: np.array(r["m"], float) for r in scored.where(F.col("declared").isNotNull()).groupBy("declared").agg(sums.alias("m")).collect()}
    out = scored
    for level in ("suffix", "domain", "host"):
        table = scored.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("__at")).agg(sums.alias(f"{level}_mass"))
        out = out.join(table, F.col(level) == F.col("__at"), "left").drop("__at")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(known)
        base = (whole + 1) / (whole + 1).sum()
        spread = sum(by_code.values(), np.zeros(n_lang)) + 0.5 * len(names)
        # a declaration counts as two texts of its language before any are seen
        own_code = lambda c: 2.0 * np.array([k == c for k in known])
        codes = {c: np.log((m + 0.5 + own_code(c)) / (spread + 2.0)) for c, m in by_code.items()}
        for batch in batches:
            rows = batch.num_rows
            cells = lambda c, n: np.array([x if x is not None else [0.0] * n for x in batch.column(c).to_pylist()], float).reshape(rows, n)  # noqa: B023, E731
            logs, own, has = cells("logs", n_lang + 1), cells("mass", n_lang), np.asarray(batch.column("has_text"))

            told = np.array([c in known for c in batch.column("declared").to_pylist()], bool).reshape(rows)
            for level in ("suffix", "domain", "host"):
                told |= (cells(f"{level}_mass", n_lang) - own).sum(axis=1) > 1e-6
            told |= has

            def smoothed(level: str, parent: np.ndarray) -> np.ndarray:
                m = np.maximum(cells(f"{level}_mass", n_lang) - own, 0)  # noqa: B023
                return (m + strength * parent) / (m.sum(axis=1, keepdims=True) + strength)

            fused = logs.copy()
            fused[:, :-1] += np.log(smoothed("host", smoothed("domain", base))) + np.log(smoothed("suffix", base) / base) + np.log(0.98)
            fused[:, :-1] += np.array([codes.get(c, np.zeros(n_lang)) for c in batch.column("declared").to_pylist()]).reshape(rows, n_lang)
            fused[:, -1] += np.log(0.02 / len(names))
            post = softmax(fused)
            text = softmax(logs + np.log([0.98 / n_lang] * n_lang + [0.02]))
            pick = lambda p, sure: pa.array([names[k] if h else UNKNOWN for k, h in zip(p.argmax(axis=1), sure, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pick(post, told), pa.array(np.where(told, post.max(axis=1), 0.0)), pick(text, has), batch.column("declared"), batch.column("host")], ["id", "lang", "posterior", "text_lang", "declared", "host"])

    told = out.mapInArrow(lean(fuse), f"id {id_type}, lang string, posterior double, text_lang string, declared string, host string")
    told = told.withColumnRenamed("id", id_col)
    return told.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= accept))


def softmax(logs: np.ndarray) -> np.ndarray:
    """Row by row."""
    each = np.exp(logs - logs.max(axis=1, keepdims=True))
    return each / each.sum(axis=1, keepdims=True)


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` over web pages: the root's language, the address's suffix and its host are evidence."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = url_host(F.col(url_col))
    return identify(pages, model, id_col, html_text(html), html_language(html), host, F.nullif(F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1), F.lit("")))


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``identify`` over documents: the language column is the declared language, the source stands for the host."""
    return identify(docs, model, id_col, F.col(text_col), F.col(lang_col), F.col(source_col))
