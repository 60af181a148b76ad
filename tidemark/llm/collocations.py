"""Phrase collocations: merged count-min sketches choose what a second pass counts exactly.

Texts are first brought into blocks of one language, a piece a line and one space
between words. The first pass hashes every contiguous phrase of one to four words;
a block's sketch is its ascending hash cells and their counts, cut into segments of
the hash space. Segments merge on their own: each adds its blocks' counts into two
rows of counters, and a phrase's estimate is the smaller of its two. An estimate is
never below the count, so every phrase as frequent as asked for survives. A segment
answers each block with one bit a cell. The second pass reads the blocks again and
keeps only surviving phrases, which a task adds up over its blocks, within a bound, and
sends on by segment and language, packed in one row. A segment's rows are added up by
text, which counts exactly. The number of
segments follows the number of words, so a segment's counters are as full at every
size, and no task holds more than a block or a segment.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, lean, released, text_of, written
from tidemark.llm.shingles import _byte_codes, _mixed, _power

U = np.uint64
LONGEST, LEAST = 4, 30
TOP = 2000
#: A longer phrase that occurs in this many of 100 occurrences takes a shorter one with it.
SUBSUMED = 80
BLOCK_BYTES, SLICE_BYTES = 1 << 22, 1 << 20
#: Blocks of all languages that a task holds open.
OPEN_BYTES = 1 << 24
#: Phrase occurrences to a segment, bits of a cell within it, and of a row of counters.
SEGMENT_PHRASES, CELL_BITS, ROW_BITS = 1 << 22, 25, 23
#: Counted phrases that a task adds up before it emits them.
HELD_ROWS = 1 << 20
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(10 if c in _SEPARATORS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces_of(text: bytes) -> bytes:
    """The pieces of a text with a word in them, one a line, A-Z lower-cased, one space between words."""
    lines = (b" ".join(p.split()) for p in text.translate(_CLEAN).split(b"\n"))
    return b"\n".join(p for p in lines if p)


def cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a block, cut where a piece ends."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = re.compile(b"[" + _SEPARATORS + b"]").search(text, at + BLOCK_BYTES)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32

    def block(lang: str) -> pa.RecordBatch:
        nonlocal number
        raw = b"\n".join(held.pop(lang))
        del size[lang]
        number += 1
        n = raw.count(b" ") + raw.count(b"\n") + 1
        small = pa.compress(raw, codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([small], pa.binary()), pa.array([len(raw)]), pa.array([n])], ["block", "lang", "text", "n_bytes", "n_words"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary()), strict=True):
            lang = lang.as_py()
            for part in cut(text.as_py()):
                clean = pieces_of(part)
                if not clean:
                    continue
                held.setdefault(lang, []).append(clean)
                size[lang] = size.get(lang, 0) + len(clean)
                if size[lang] >= BLOCK_BYTES:
                    yield block(lang)
                elif sum(size.values()) >= OPEN_BYTES:
                    yield block(max(size, key=size.get))
    for lang in list(held):
        yield block(lang)


def slices_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A block in parts that end where a piece ends, with their places."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end + 1


class Phrases:
    """Hashes of every phrase of a block and, with ``places``, where each begins and ends and its words."""

    def __init__(self, lang: str, text: bytes, n_bytes: int, longest: int, places: bool = False) -> None:
        self.text = pa.decompress(text, decompressed_size=n_bytes, codec="zstd", asbytes=True)
        seed = U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        hashes, begin, end, size = [], [], [], []
        for offset, part in slices_of(self.text):
            raw = np.frombuffer(part, np.uint8)
            edges = np.flatnonzero((raw == 32) | (raw == 10))
            starts, ends = np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(raw)]])
            piece = np.concatenate([[0], np.cumsum(raw[edges] == 10)])
            with np.errstate(over="ignore"):
                up, down = _power(len(raw) + 1)
                total = np.concatenate([np.zeros(1, U), np.cumsum(_byte_codes()[raw] * up[:-1], dtype=U)])
                words = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
                chain = np.full(len(words), seed, U)
                for n in range(1, min(longest, len(words)) + 1):
                    m = len(words) - n + 1
                    chain = _mixed(chain[:m] * U(0xD6E8FEB86659FD93) + words[n - 1 :] + U(n))
                    inside = np.flatnonzero(piece[:m] == piece[n - 1 :])
                    hashes.append(chain[inside])
                    if places:
                        begin.append((offset + starts[inside]).astype(np.int32))
                        end.append((offset + ends[inside + n - 1]).astype(np.int32))
                        size.append(np.full(len(inside), n, np.int8))
        self.hashes = np.concatenate(hashes)
        if places:
            self.begin, self.end, self.words = np.concatenate(begin), np.concatenate(end), np.concatenate(size)


def segment_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> U(63 - bits)) >> U(1)).astype(np.int64)


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> U(64 - bits - CELL_BITS)) & U((1 << CELL_BITS) - 1)).astype(np.uint32)


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as byte planes of their steps."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)


def _sketch(bits: int, longest: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *text in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "text", "n_bytes")), strict=True):
                hashes, counts = np.unique(Phrases(*text, longest).hashes, return_counts=True)
                segment = segment_of(hashes, bits)
                cells, counts = cells_of(hashes, bits), np.minimum(counts, least).astype(np.uint8)
                first = np.flatnonzero(np.diff(segment, prepend=-1))
                rows = list(zip(first, [*first[1:], len(hashes)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment[first]),
                        pa.array(np.full(len(rows), block)),
                        pa.array([int(b - a) for a, b in rows], pa.int64()),
                        pa.array([packed(cells[a:b]) for a, b in rows], pa.binary()),
                        pa.array([pa.compress(counts[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in rows], pa.binary()),
                    ],
                    ["segment", "block", "n", "cells", "counts"],
                )

    return lean(run)


def rows_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell's counter in each of the two rows."""
    return cells >> np.uint32(CELL_BITS - ROW_BITS), (cells * np.uint32(0x9E3779B1)) >> np.uint32(32 - ROW_BITS)


def _merge(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        sketch = [np.zeros(1 << ROW_BITS, np.int32) for _ in range(2)]
        parts = list(zip(*(table.column(c).to_pylist() for c in ("n", "cells", "counts")), strict=True))
        for n, cells, counts in parts:
            more = np.frombuffer(pa.decompress(counts, decompressed_size=n, codec="zstd", asbytes=True), np.uint8).astype(np.int32)
            for row, at in zip(sketch, rows_of(unpacked(cells, n)), strict=True):
                np.add.at(row, at, more)
        answers = []
        for n, cells, _ in parts:
            a, b = rows_of(unpacked(cells, n))
            answers.append(np.packbits(np.minimum(sketch[0][a], sketch[1][b]) >= least).tobytes())
        del sketch
        give_back()
        return pa.table({"block": table.column("block"), "segment": table.column("segment"), "bits": pa.array(answers, pa.binary())})

    return run


COUNTED, PACKED = ["lang", "words", "phrase", "f"], ["segment", "lang", "n_bytes", "n", "phrases", "counts"]


def _rows(counted: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row a phrase."""
    yield from counted.select(COUNTED).to_batches(1 << 16)


def _by_segment(counted: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row a segment and language: its phrases in order, a line each, and their counts."""
    one = counted.sort_by([(c, "ascending") for c in ("segment", "lang", "phrase")]).combine_chunks()
    segment, lang = np.asarray(one.column("segment")), one.column("lang").combine_chunks()
    code = np.asarray(lang.dictionary_encode().indices)
    first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (code[1:] != code[:-1])]))
    spans = list(zip(first.tolist(), [*first[1:].tolist(), one.num_rows], strict=True))
    phrase, f = one.column("phrase").cast(pa.binary()).to_pylist(), np.asarray(one.column("f")).astype("<i8")
    texts = [b"\n".join(phrase[a:b]) for a, b in spans]
    small = [pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in own], pa.binary()) for own in (texts, [f[a:b].tobytes() for a, b in spans])]
    sizes = [pa.array(x, pa.int64()) for x in ([len(x) for x in texts], [b - a for a, b in spans])]
    yield pa.RecordBatch.from_arrays([pa.array(segment[first]), lang.take(pa.array(first)), *sizes, *small], PACKED)


def _count(bits: int, longest: int, send: Callable[[pa.Table], Iterator[pa.RecordBatch]] = _rows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [*COUNTED, "segment"]
    keys = [n for n in names if n != "f"]
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        """What is held, a row a phrase; texts are compared, not hashes."""
        one = pa.concat_tables(held).group_by(keys).aggregate([("f", "sum")])
        held[:] = [one.select([*keys, "f_sum"]).rename_columns([*keys, "f"]).select(names)]
        return held[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        for batch in batches:
            for lang, text, n_bytes, answers in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "n_bytes", "answers")), strict=True):
                p = Phrases(lang, text, n_bytes, longest, places=True)
                known = np.unique(p.hashes)
                n = np.bincount(segment_of(known, bits), minlength=1)
                stays = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n[x["segment"]]) for x in sorted(answers, key=lambda x: x["segment"])])
                known = known[np.flatnonzero(stays)]
                if not len(known):
                    continue
                at = np.searchsorted(known, p.hashes)
                here = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == p.hashes)
                at = at[here]
                counts = np.bincount(at, minlength=len(known))
                first = np.empty(len(known), np.int64)
                first[at[::-1]] = here[::-1]
                begin, end, words = p.begin[first], p.end[first], p.words[first]
                found = [p.text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                held.append(pa.table([pa.array([lang] * len(found)), pa.array(words.astype(np.int32)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts), pa.array(segment_of(known, bits))], names))
                del p, found
                if sum(t.num_rows for t in held) >= HELD_ROWS and summed().num_rows >= HELD_ROWS // 2:
                    yield from send(held.pop())
        if held:
            yield from send(summed())
            held.clear()

    return lean(run)


def _add_up(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """A segment's phrases with ``least`` occurrences or more, added up by language and text."""
        parts = []
        for lang, n_bytes, n, phrases, counts in zip(*(table.column(c).to_pylist() for c in PACKED[1:]), strict=True):
            text = pa.array(pa.decompress(phrases, decompressed_size=n_bytes, codec="zstd", asbytes=True).split(b"\n"), pa.binary())
            f = np.frombuffer(pa.decompress(counts, decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")
            parts.append(pa.table([pa.array([lang] * n), text, pa.array(f)], ["lang", "phrase", "f"]))
        one = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        one = one.filter(pc.greater_equal(one.column("f_sum"), least))
        words = pc.add(pc.count_substring(one.column("phrase"), b" "), 1).cast(pa.int32())
        return pa.table([one.column("lang"), words, one.column("phrase").cast(pa.string()), one.column("f_sum")], COUNTED)

    return run


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to ``longest`` words with ``least`` occurrences in its language or more, and each language's number of words.

    ``lang, words, phrase, f`` (written) and ``lang, n``.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    blocks = written(rows.mapInArrow(lean(_blocks), "block long, lang string, text binary, n_bytes long, n_words long"), "phrases-blocks")
    sizes = written(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrases-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, longest * total / SEGMENT_PHRASES))))
    sketches = blocks.mapInArrow(_sketch(bits, longest, least), "segment long, block long, n long, cells binary, counts binary")
    answers = sketches.groupBy("segment").applyInArrow(_merge(least), "block long, segment long, bits binary")
    answers = written(answers.groupBy("block").agg(F.collect_list(F.struct("segment", "bits")).alias("answers")), "phrases-answers")
    met = blocks.join(answers, "block").select("lang", "text", "n_bytes", "answers")
    found = met.mapInArrow(_count(bits, longest, _by_segment), "segment long, lang string, n_bytes long, n long, phrases binary, counts binary")
    counts = written(found.groupBy("segment").applyInArrow(_add_up(least), "lang string, words int, phrase string, f long"), "phrases-counts")
    released(blocks, answers)
    return counts, sizes


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of phrases of two words or more, by their lowest-scoring cut."""
    many = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def subsumed(counts: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """``lang, phrase, most``: of phrases inside longer ones, how often the most frequent longer one occurs."""
    w = F.split("phrase", " ")
    longer = counts.where("words > 2").select("lang", "f", "words", w.alias("w"))
    spans = longer.select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    spans = spans.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    return spans.groupBy("lang", _part(F.col("w"), F.col("at"), F.col("n")).alias("phrase")).agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    Rows without a language are ``und``; a null text is empty; a text repeated in
    many rows counts each time, whatever the ids; a text of any length is cut into
    blocks only where a piece ends; an empty table, or one without frequent
    phrases, gives an empty result. Columns beyond language and text do not matter.
    """
    counts, sizes = frequent_phrases(docs, longest, least, lang, text)
    left = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left")
    left = left.where(F.col("most").isNull() | (F.lit(100).cast("decimal(19,0)") * F.col("most") < F.lit(SUBSUMED).cast("decimal(19,0)") * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = written(out, "phrases-ranked")
    released(counts, sizes)
    return out
