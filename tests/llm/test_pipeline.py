"""The pipeline's stages, each on what the one before kept."""

import collections
import hashlib
import importlib.util
import re
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
_spec = importlib.util.spec_from_file_location("tidemark_llm_brute", Path(__file__).with_name("test_llm.py"))
_brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_brute)
brute_components, chunk = _brute.brute_components, _brute.chunk


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, f"test-{name}")
        kept[name] = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(kept[name]) <= set(start)
    assert len(kept["language_id"]) >= 0.97 * len(start)
    assert max(kept["ngram_join"].values()) == 1 and max(kept["source_mixing"].values()) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == sum(kept["source_mixing"].values()) and final.where(F.length("ids_sha256") != 64).count() == 0


def brute_runs(docs: dict, least: int = 50) -> dict:
    """Texts less the runs of lines of ``least`` words or more that came before, window by window."""
    places = collections.defaultdict(list)
    for i, text in docs.items():
        lines = (text or "").split("\n")
        words = [len([w for w in re.split(r"[ \t\r]+", x) if w]) for x in lines]
        full = [k for k, n in enumerate(words) if n]
        windows = set()
        for order in (full, full[::-1]):
            for k in range(len(order)):
                total, at = 0, k
                while at < len(order) and total < least:
                    total += words[order[at]]
                    at += 1
                if total >= least:
                    windows.add((min(order[k:at]), max(order[k:at])))
        for a, b in sorted(windows):
            key = tuple(lines[j] for j in full if a <= j <= b)
            places[key].append((i, a, b))
    gone = collections.defaultdict(set)
    for own in places.values():
        first = min(own)
        for i, a, b in own:
            if i != first[0] or a > first[2]:
                gone[i].update(range(a, b + 1))
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in docs.items()}


def brute_chunks(docs: dict) -> dict:
    owner, out = {}, {}
    for i in sorted(docs):
        kept = []
        for c, removable in chunk(docs[i] or "", 3, 50):
            if not (removable and c.strip(" ")) or owner.setdefault(c, (i, len(kept))) == (i, len(kept)):
                kept.append(c)
            else:
                kept.append(None)
        out[i] = None if docs[i] is None else "\n".join(c for c in kept if c is not None)
    return out


def test_stages_equal_brute_force(spark, sf):
    """Each stage on what the one before kept: languages by the operator's own decisions, all else by plain loops."""
    import public_tokenizers
    import tiktoken

    from tidemark.llm import bpe, language_id, mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    docs = corpus_pipeline.written(docs, "test-brute")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    told = language_id.identify_documents(docs, language_id.fit_text_model(spark.read.parquet(f"{sf}/documents.parquet")))
    want = {i: held[i] for i in (r["doc_id"] for r in told.where("accepted").collect())}
    docs = corpus_pipeline.written(steps["language_id"](spark, docs, sf), "test-brute")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    cut = brute_chunks(brute_runs(want))
    want = {i: t for i, t in cut.items() if t == want[i] or (t or "").strip(" ")}
    docs = corpus_pipeline.written(steps["line_dedup"](spark, docs, sf), "test-brute")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    ids = sorted(want)
    comp = brute_components(ids, [want[i] for i in ids], 5, 80)
    want = {i: want[i] for i in ids if comp[i][1] == i}
    docs = corpus_pipeline.written(steps["ngram_join"](spark, docs, sf), "test-brute")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    docs = corpus_pipeline.written(steps["source_mixing"](spark, docs, sf), "test-brute")
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == {i: n for i, n in copies.items() if n}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    for r in steps["byte_bpe"](spark, docs, sf).dropDuplicates(["doc_id"]).collect():
        ids = lib.encode_ordinary(want[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256((want[r["doc_id"]] or "").encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls everywhere, repeated rows, names that clash, and nothing at all."""
    text = "these are the words of a text that says what it has to say in plain English for all of us to read"
    d = spark.createDataFrame([(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, None, None, None, None), (None, text + " again", None, None, None), (None, text + " again", None, None, None), (3, "", "fr", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row_key", "row_copies", "run_lines", "again", "chunks", "removed_chunks", "id"):
        d = d.withColumn(c, F.lit("clash"))
    for start in (d, d.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == d.columns
            docs = corpus_pipeline.written(out, f"test-odd-{name}")
            assert docs.where("row_key <> 'clash' or run_lines <> 'clash'").isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_one_of_each_group_stays(spark, sf):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, "en", "s", 1), (2, text, "en", "s", 1), (9, text.replace("w40 ", "x "), "en", "s", 1), (7, "another text of its own", "en", "s", 1), (8, None, None, None, 0), (None, "no id", None, None, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.ngram_join(spark, d, sf).collect()} == {2, 7, 8, None}


def test_shared_runs_of_lines_go_whole(spark, sf):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    runs = {"two": [line("a", 25), line("b", 30)], "three": [line("c", 20), line("d", 20), line("e", 20)], "tail": [line("f", 40), line("g", 30), line("h", 5), line("i", 5)], "many": [line(f"m{k}x", 7) for k in range(20)]}
    short = [line("k", 20), line("l", 20)]
    rows, want = [], {}
    for k, (name, run) in enumerate(runs.items()):
        for j in range(3):
            head, foot = line(f"head{k}{j}x", 9), line(f"foot{k}{j}x", 4)
            own = [head, *run, foot]
            rows.append((10 * k + j if j < 2 else None, "\n".join(own), "en", "s", 0))
            want[head] = "\n".join(own if j == 0 else [head, foot])
    twice = [line("z", 9), *[line("y", 30)] * 4]
    rows += [(90, "\n".join(["x", short[0], "y", *runs["two"]]), "en", "s", 0), (91, "\n".join(short), "en", "s", 0), (92, None, "en", "s", 0), (93, "\n".join(twice), "en", "s", 0), (94, "\n".join(runs["two"]), "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from tidemark.llm.line_dedup import drop_repeated_runs

    got = drop_repeated_runs(d.withColumn("at", F.lit("clash"))).collect()
    texts = {(r["text"] or "").split("\n")[0]: r["text"] for r in got}
    assert len(got) == len(rows) and {h: texts[h] for h in want} == want and {r["at"] for r in got} == {"clash"}
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[90] == f"x\n{short[0]}\ny" and by_id[91] == "\n".join(short) and by_id[92] is None and by_id[93] == "\n".join(twice[:3]) and by_id[94] == ""
    assert drop_repeated_runs(d.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, d, sf).collect()}
    assert 94 not in kept and kept[1] == want[rows[1][1].split("\n")[0]]


def test_copies_keep_to_their_row(spark, sf):
    """Null and shared ids: every row comes as often as the mix of that row says, equal rows together."""
    from tidemark.llm.mixing import mix

    row = lambda i, k, n, lang="en": (i, " ".join(f"w{k}x{j}" for j in range(n)), lang, f"s{k % 3}", n)
    rows = [row(k if k % 2 else None, k, 3 + k % 17) for k in range(60)] + [row(1, 100 + k, 10) for k in range(9)] + [row(77, 300, 5)] * 4 + [row(5, 301, 6, "de"), row(5, 301, 6, "fr"), (6, None, "en", "s0", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mix(d, keep=("text", "lang")).collect()
    want = collections.Counter()
    for r in taken:
        want[r["doc_id"], r["text"], r["lang"]] += r["copies"]
    got = corpus_pipeline.source_mixing(spark, d, sf).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["lang"]) for r in got) == +want
    words = sum(len((r["text"] or "").split()) for r in got)
    assert words == sum(r["taken"] for r in taken) and max(want.values()) <= 8
