"""Lexical search, phrase mining and quality rules against plain Python, and odd inputs."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, lexical_search, quality_rules
from tidemark.llm.queries import op11_lexical_search, op12_collocations, op13_quality_rules

ODD = [None, "", " \n\t ", "\x0b\x0c", "a", "A b", "x" * 5000, "tie tie tie", "tie tie tie", "  two  spaces ", "日本語 テキスト\ttab", "é É ÀB nbsp x", "a\x00b", "it's 12 o'clock!!!\n\n  end", "?" * 300, "w " * 4000]
CLASH = ("row", "term", "terms", "n", "tf", "score", "rank", "block", "bits", "phrase", "f", "kept", "measure", "bucket", "_text", "ranges", "n_words")


def docs_of(spark, texts, langs=("en",), sources=("s", None)):
    rows = [(i if i % 7 else None, t, langs[i % len(langs)], sources[i % len(sources)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    d = docs_of(spark, ODD)
    return d.union(d.where("doc_id = 5"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "New", "york", "city", "großer", "Été", "x1", "a-b", "it's", "日本"] + [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    out += ["we like New york city, really. New york city!\nnew  york\tcity"] * 20 + ["a b c d e f; a b c d"] * 33
    return out + ODD


# --- 11 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, top):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in docs]
    N, L = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, asked in items.items():
        weight = {}
        for t in asked:
            df = sum(t in c for _, c in docs)
            weight[t] = math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))
        scores = []
        for (i, c), n in zip(docs, sizes, strict=True):
            m = 50 + (50 * n * N) // L if L else 0
            s = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, -1 if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_search_equals_brute_force(spark, texts):
    docs = docs_of(spark, texts)
    asked = [(1, "New YORK the w1 w1"), (2, "日本 it's 12"), (3, ""), (4, None), (None, "city"), (1, "w2"), (5, "nowhere_at_all zzz")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("term", F.lit("clash"))
    sets = collections.defaultdict(set)
    for i, t in asked:
        sets[i] |= set(terms(t))
    for top in (7, 50):
        got = [tuple(r) for r in lexical_search.search(docs, items, top).collect()]
        want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], sets, top)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_search_over_nothing(spark, odd):
    items = spark.createDataFrame([(1, "tie")], "item_id long, text string")
    assert lexical_search.search(odd.limit(0), items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0
    assert lexical_search.search(odd.where("text is null"), items).count() == 0
    assert lexical_search.search(odd, items).count() == 2  # both documents of equal text, each a row


def test_postings_hold_every_term(spark, odd):
    held = lexical_search.postings(lexical_search.counted(odd)).groupBy("term").agg(F.sum("tf").alias("tf")).collect()
    want = collections.Counter(t for r in odd.collect() for t in terms(r["text"]))
    assert {r["term"]: r["tf"] for r in held} == want


# --- 12 phrases


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, top, least):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        most = collections.Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * most[p] >= 80 * a:
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("least", [2, 30])
def test_phrases_equal_brute_force(spark, texts, least, monkeypatch):
    langs = ("en", "de", None, "und")
    docs = docs_of(spark, texts, langs).repartition(5)
    want = brute_phrases([(r["lang"], r["text"]) for r in docs.collect()], 40, least)
    assert least == 30 or len(want) > 100
    got = [tuple(r) for r in collocations.collocations(docs, 40, least=least).collect()]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(collocations, "SEGMENT_PHRASES", 64)  # many segments, and many small blocks
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 40, least=least).collect()) == sorted(want)


def test_a_full_sketch_loses_nothing():
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(0, 1 << collocations.CELL_BITS, 50_000).astype(np.uint32))
    assert (collocations.unpacked(collocations.packed(cells), len(cells)) == cells).all()
    true = rng.integers(1, 40, len(cells))
    rows = [np.zeros(1 << collocations.ROW_BITS, np.int64) for _ in range(2)]
    for row, at in zip(rows, collocations.rows_of(cells), strict=True):
        np.add.at(row, at, true)
    estimate = np.minimum(*[row[at] for row, at in zip(rows, collocations.rows_of(cells), strict=True)])
    assert (estimate >= true).all() and (estimate > true).mean() < 0.01


@pytest.mark.parametrize("bound", [1 << 20, 8])
def test_a_task_adds_up_its_blocks(monkeypatch, bound):
    monkeypatch.setattr(collocations, "HELD_ROWS", bound)
    raws = [b"a b a b\nc", b"a b d", b"a b c"]
    small = [pa.compress(x, codec="zstd", asbytes=True) for x in raws]
    known = [len(np.unique(collocations.Phrases("en", x, len(r), 2).hashes)) for x, r in zip(small, raws)]
    answers = [[{"segment": 0, "bits": np.packbits(np.ones(n, np.uint8)).tobytes()}] for n in known]
    batch = pa.table({"lang": ["en"] * 3, "text": pa.array(small, pa.binary()), "n_bytes": [len(x) for x in raws], "answers": answers}).to_batches()[0]
    rows = [tuple(r.values()) for b in collocations._count(0, 2)(iter([batch])) for r in b.to_pylist()]
    total = collections.Counter()
    for lang, words, phrase, f in rows:
        total[lang, words, phrase] += f
    assert total == {("en", 1, "a"): 4, ("en", 1, "b"): 4, ("en", 1, "c"): 2, ("en", 1, "d"): 1, ("en", 2, "a b"): 4, ("en", 2, "b a"): 1, ("en", 2, "b d"): 1, ("en", 2, "b c"): 1}
    assert bound < 10 or len(rows) == len(total)  # one row a phrase, where one row a phrase and block went out


def test_counts_go_out_by_segment(texts):
    """Rows follow tasks and segments, not phrases; segments add up to the counts of all tasks."""
    bits, rows, total = 3, [], collections.Counter()
    for part, lang in ((texts[:90], "en"), (texts[90:], "en"), (texts[:60], "und")):
        raw = b"\n".join(x for t in part if (x := collocations.pieces_of((t or "").encode())))
        small = pa.compress(raw, codec="zstd", asbytes=True)
        known = np.unique(collocations.Phrases(lang, small, len(raw), 4).hashes)
        sizes = np.bincount(collocations.segment_of(known, bits), minlength=1 << bits)
        answers = [[{"segment": k, "bits": np.packbits(np.ones(n, np.uint8)).tobytes()} for k, n in enumerate(sizes.tolist())]]
        batch = pa.table({"lang": [lang], "text": pa.array([small], pa.binary()), "n_bytes": [len(raw)], "answers": answers}).to_batches()[0]
        rows += collocations._count(bits, 4, collocations._by_segment)(iter([batch]))
        for line in raw.split(b"\n"):
            w = line.decode().split(" ")
            total.update((lang, m, " ".join(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    packed = pa.Table.from_batches(rows)
    assert packed.num_rows == 3 << bits < len(total) / 10
    for least in (1, 5):
        got = []
        for k in range(1 << bits):
            got += [tuple(r.values()) for r in collocations._add_up(least)(packed.filter(pa.array(np.asarray(packed.column("segment")) == k))).to_pylist()]
        assert sorted(got) == sorted((*p, f) for p, f in total.items() if f >= least)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1 << 21)
    text = (b"some words here, " * 400_000) + b"x " * 10
    parts = list(collocations.cut(text))
    assert b"".join(parts) == text and len(parts) > 2 and all(p.endswith(b",") for p in parts[:-1])
    assert list(collocations.cut(b"word " * 1_000_000)) == [b"word " * 1_000_000]


def test_phrases_of_nothing(spark, odd):
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.where("text is null")).count() == 0
    assert [tuple(r)[:4] for r in collocations.collocations(odd).collect()] == [("en", 1, "w w w w", 3997)]


# --- 13 quality rules


def brute_measures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_measures_equal_brute_force(spark, texts):
    rng = random.Random(9)
    more = ["\n".join(rng.choice(["a b c", "a b", "#x|y <z>", "  ", "b c a b c"]) for _ in range(30)) for _ in range(60)]
    docs = docs_of(spark, texts + more + [" ".join(map(str, range(300_000))) + " 1 2 3"])
    got = quality_rules.quality_verdicts(docs)
    assert got.count() == docs.count()
    rows = got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, rows)) == sorted(brute_measures(r["text"]) for r in docs.select("text").collect())
    assert not got.where("base_failed and kept or kept is null").count()


def test_sketches_merge_and_hold_their_error(spark):
    rng = np.random.default_rng(1)
    values = sorted(set(rng.integers(0, 3000, 500).tolist() + (10 ** rng.uniform(0, 12, 500)).astype(int).tolist()))
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    df = df.select("v", quality_rules.bucket_of(F.col("v")).alias("b"))
    rows = df.select("v", "b", quality_rules.bucket_low(F.col("b")).alias("low"), (quality_rules.bucket_low(F.col("b") + 1) - 1).alias("high")).orderBy("v").collect()
    assert all(r["low"] <= r["v"] <= r["high"] and r["high"] - r["low"] <= max(0, r["v"] / 32) for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_cutoffs_follow_language_and_source(spark):
    rng = random.Random(2)

    def text(symbols, upper=False):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) + symbols for _ in range(80))
        return t.upper() if upper else t

    rows = [("en", "prose", text("")) for _ in range(150)] + [("en", "code", text("$|")) for _ in range(150)]
    rows += [("en", "prose", text("$|"))] * 2 + [("en", "prose", text("", True)), ("en", "small", text("")), (None, None, text(""))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert kept == set(range(300)) | {303, 304}  # symbols are usual in one source and odd in the other
    stays = quality_rules.kept_documents(docs.withColumn("kept", F.lit("clash")))
    assert stays.columns == ["doc_id", "lang", "source", "text", "kept"] and {r["doc_id"] for r in stays.collect()} == kept


def test_rules_on_nothing(spark, odd):
    assert quality_rules.quality_verdicts(odd.limit(0)).count() == 0
    none = quality_rules.quality_verdicts(odd.where("text is null"))
    assert [r["kept"] for r in none.collect()] == [False]


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for q in (op11_lexical_search, op12_collocations, op13_quality_rules):
        got = q(spark, sf)
        want = con.execute(ORACLE_SQL[q.__name__]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.astype(object).itertuples(index=False)), key=str)


def test_no_python_in_the_rules(spark, sf):
    plan = quality_rules.measured(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
