"""Token counts through a digest cache.

A text is known by the digest of its normalised content (null becomes the empty
text; nothing else may change, or the counts would) and a tokenizer by the
digest of its file, its options and its library's version. Counts live in an
append-only Parquet table keyed by both; a run joins its distinct digests to
it, encodes only the misses and appends them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, path_exists, text_of

#: What the segment shortcut relies on; part of the tokenizer digest.
COUNTER_VERSION = "segments-1"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer: file bytes, library version and counting options."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        body = hashlib.sha256(f.read())
    body.update(f"|{lib.__name__}|{lib.__version__}|{COUNTER_VERSION}".encode())
    return body.hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model.

    No piece of such a model joins a character to a following word mark, so
    merges never cross the start of a word: the count of a text is the sum over
    its segments (a run of spaces and what follows it), and equal segments of a
    batch are encoded once. Models with a piece that crosses, and texts holding
    the mark itself, are encoded whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = self.model.encode("a  b ", out_type=str)
        self.splits = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and "".join(probe) == f"{self.MARK}a{self.MARK * 2}b{self.MARK}"

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def counts(self, texts: pa.StringArray) -> pa.Array:
        import numpy as np

        out = np.zeros(len(texts), dtype=np.int64)
        plain = np.asarray(pc.invert(pc.match_substring(texts, self.MARK))) if self.splits else np.zeros(len(texts), bool)
        for i in np.flatnonzero(~plain):
            out[i] = self._encode([texts[i].as_py()])[0]
        rows = np.flatnonzero(plain & (np.asarray(pc.binary_length(texts)) > 0))
        if len(rows):
            # The dummy prefix stands for the space before each segment; runs of spaces stay with the next word.
            part = pc.split_pattern(texts.take(pa.array(rows)), " ")
            flat, starts = part.flatten(), np.asarray(part.offsets)[:-1] - part.offsets[0].as_py()
            coded = pc.dictionary_encode(flat)
            words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices)
            known = np.array(self._encode(words), dtype=np.int64) if words else np.zeros(0, np.int64)
            each = known[at]
            blank = np.asarray(pc.equal(pc.binary_length(flat), 0))
            hit = np.logical_or.reduceat(blank, starts)
            out[rows] = np.add.reduceat(each, starts)
            for i in rows[hit]:
                out[i] = self._runs(texts[i].as_py())
        return pa.array(out)

    def _runs(self, text: str) -> int:
        """A text with runs of spaces: a run belongs to the word after it."""
        import re

        found = re.findall(r" *[^ ]+| +", text)
        found = [found[0], *(x[1:] for x in found[1:])]
        lone = sum(not x for x in found)  # a single space at the end: the mark alone
        return sum(self._encode([x for x in found if x])) + lone * self._lone()

    @lru_cache(maxsize=1)  # noqa: B019
    def _lone(self) -> int:
        """Tokens of the bare word mark, seen as what a closing space adds."""
        return len(self.model.encode("a ")) - len(self.model.encode("a"))


class WholeCounter:
    """Counts of a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: pa.StringArray) -> pa.Array:
        return pa.array([len(x.ids) for x in self.model.encode_batch(texts.to_pylist(), add_special_tokens=False)], pa.int64())


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | WholeCounter:
    return PieceCounter(path) if path.endswith(".model") else WholeCounter(path)


def _encode_batches(path: str, step_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            digest, text = batch.column("digest"), batch.column("text").cast(pa.large_string())
            ends = np.cumsum(np.asarray(pc.binary_length(text)))
            at = 0
            while at < len(text):  # slices of a few MB, or one long text
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
                yield pa.RecordBatch.from_arrays([digest.slice(at, to - at), counter(path).counts(text.slice(at, to - at))], ["digest", "n_tokens"])
                at = to

    return run


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, cache_path: str | None = None, limit: int = 4096
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row, through the cache at ``cache_path``.

    Null and empty texts count as the empty text. Repeated rows, null ids and
    equal texts each keep their row; equal texts are encoded once. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    ``cache_path`` must be in shared storage; None means a cold cache of this run.
    """
    spark = docs.sparkSession
    model = model_path or default_model()
    cache = f"{(cache_path or fresh_path(spark, 'token-cache')).rstrip('/')}/tokenizer={tokenizer_digest(model)}"
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # One row a digest and task leaves the map side, so a text with any number of copies stays small.
    fresh = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if path_exists(spark, cache):
        fresh = fresh.join(_stored(docs, cache), "digest", "left_anti")
    fresh.mapInArrow(_encode_batches(model), "digest binary, n_tokens long").write.mode("append").parquet(cache)
    rows = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.join(_stored(docs, cache), "digest")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(docs: DataFrame, cache: str) -> DataFrame:
    """The cache with one count a digest, even if two runs raced to append it."""
    table = docs.sparkSession.read.schema("digest binary, n_tokens long").parquet(cache)
    return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
