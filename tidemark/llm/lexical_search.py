"""Ranked lexical search: integer scores over postings, summed by item and document.

Documents are read once. A task counts a document's terms in Python and leaves
one row a document: its number of terms and its terms with their counts. Those
rows are written; everything after them is DataFrame work. Postings are sorted
by term bucket inside a task, and those of terms that are asked for are dealt
out by document before they meet the items. So what is shuffled grows with the
postings and not with pairs of items and documents: a document's sums are
complete where it is, and of each item a task passes on its best alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, released, text_of, written
from tidemark.llm.shingles import sliced

#: Bytes outside terms become a space, A-Z their small letters; bytes of other letters stay.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
BUCKETS = 256
#: Bytes of items' terms that are sent to all tasks; more are joined by term.
SENT_BYTES = 16 << 20
TOP = 50


def terms_of(text: bytes) -> list[bytes]:
    """The maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sizes, ends, terms, counts = [], [0], [], []
        for text in batch.column("text").cast(pa.binary()):
            found = terms_of(text.as_py())
            tally = Counter(found)
            sizes.append(len(found))
            terms.extend(tally)
            counts.extend(tally.values())
            ends.append(len(terms))
        at = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
            ],
            ["doc_id", "n", "terms", "tfs"],
        )


def counted(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``row, doc_id, n, terms, tfs`` of every document, written; ``row`` tells repeated ids apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of("text").alias("text"))
    found = rows.mapInArrow(lean(_count), "doc_id long, n long, terms array<string>, tfs array<long>")
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "search-counted")


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(documents: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``bucket, term, row, doc_id, n, tf`` of documents from ``counted``, all terms or only those of ``asked(term)``."""
    flat = documents.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    flat = flat.select(bucket("p.terms").alias("bucket"), F.col("p.terms").alias("term"), "row", "doc_id", "n", F.col("p.tfs").alias("tf"))
    if asked is not None:
        flat = flat.join(asked.select(bucket("term").alias("bucket"), "term"), ["bucket", "term"], "left_semi")
    return written(flat.sortWithinPartitions("bucket", "term", "row"), "search-postings")


def weighed(items: DataFrame, found: DataFrame, totals: DataFrame) -> DataFrame:
    """``bucket, term, item_id, w`` of every item's terms; a term that no document holds goes."""
    df = found.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    ratio = (2 * F.col("docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    w = F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")
    wide = df.crossJoin(F.broadcast(totals)).select("bucket", "term", w.alias("w"))  # one row
    return items.join(wide, ["bucket", "term"]).select("bucket", "term", "item_id", "w")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item, of those with a score above 0.

    Each row of ``docs`` is a document, also where ids repeat or are null (a null
    id comes before others of its score); items that share an id, null included,
    are one item with the terms of all. Items without terms, and terms that no
    document holds, find nothing; a null text has no terms; empty tables on
    either side give an empty result. Columns beyond ids and texts do not matter.
    """
    asked = items.select(F.col(item_col).alias("item_id"), text_of("text").alias("text"))
    ask = asked.select("text", "item_id").mapInArrow(_item_terms, f"item_id {asked.schema['item_id'].dataType.simpleString()}, term string")
    ask = written(ask.distinct().select("item_id", "term", bucket("term").alias("bucket")), "search-items")
    documents = counted(docs, id_col)
    totals = documents.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    totals = written(totals, "search-totals")
    held = postings(documents, ask.select("term").distinct())
    weights = table = written(weighed(ask, held, totals), "search-weights")
    if (weights.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0) <= SENT_BYTES:
        weights = F.broadcast(weights)
    m = F.expr("50 + ((50 * n * docs) div words)")
    each = held.crossJoin(F.broadcast(totals)).select("bucket", "term", "row", "doc_id", "tf", m.alias("m"))
    each = each.select("bucket", "term", "row", "doc_id", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("s")).repartition("row")
    met = each.join(weights, ["bucket", "term"]).groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    ranked = met.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = written(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-ranked")
    released(ask, documents, totals, held, table)
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, terms = [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            mine = set(terms_of(text.as_py()))
            terms.extend(mine)
            at.extend([i] * len(mine))
        ids = batch.column("item_id").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary()).cast(pa.string())], ["item_id", "term"])
