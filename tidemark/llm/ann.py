"""Approximate nearest neighbours by collision counting.

A shard of rows keeps one sorted array for each random projection of its unit
vectors. A query opens a window around its own value in every array; the
windows grow with a radius that is raised step by step (virtual rehashing: the
arrays stay as they are). A row that lies in at least ``threshold`` windows is
verified by its exact cosine. The search of a shard ends when the k best
verified rows lie within the radius: at that point a row within it has missed
the threshold with probability ``miss`` at most, which bounds the loss of
recall. The last radius covers all rows, so short shards are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import matrix, usable

RADII = (0.3, 0.7, 0.95, 1.06, 1.13, 1.2, 1.27, 1.35, 1.5, 2.0, math.inf)

#: Query blocks that one task compares with its shard.
BLOCKS_A_TASK = 8


@dataclass(frozen=True)
class Collisions:
    """``projections`` arrays, windows of ``width`` times the radius to either side, and the miss rate."""

    projections: int = 64
    width: float = 1.0
    miss: float = 0.04
    shard_rows: int = 4096
    query_rows: int = 512
    seed: int = 5

    @property
    def threshold(self) -> int:
        """Most collisions that a row at the radius reaches with probability 1 - miss."""
        p, below, n = math.erf(self.width / math.sqrt(2)), 0.0, self.projections
        for count in range(n + 1):
            below += math.comb(n, count) * p**count * (1 - p) ** (n - count)
            if below > self.miss:
                return count
        return n

    def directions(self, dim: int) -> np.ndarray:
        return _directions(dim, self.projections, self.seed)


@lru_cache(maxsize=8)
def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _pack(conf: Collisions, rows: int, index: bool):
    """Batches to rows of packed vectors of one length each, with sorted arrays if it is an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = np.asarray(batch.column("id").cast(pa.int64())), batch.column("vec")
            dims = np.asarray(vecs.value_lengths())
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), rows):
                    part = own[at : at + rows]
                    x = matrix(vecs.take(pa.array(part)), int(dim))
                    order = values = b""
                    if index:
                        h = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ conf.directions(int(dim))
                        rank = np.argsort(h, axis=0, kind="stable")
                        order, values = rank.T.astype("<i4").tobytes(), np.take_along_axis(h, rank, 0).T.astype("<f8").tobytes()
                    cells = [int(dim), len(part), ids[part].astype("<i8").tobytes(), x.astype("<f8").tobytes(), order, values]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, PACKED.values(), strict=True)], list(PACKED))

    return run


PACKED = {"dim": pa.int32(), "n": pa.int32(), "ids": pa.binary(), "vecs": pa.binary(), "order": pa.binary(), "values": pa.binary()}
PACKED_SQL = "dim int, n int, ids binary, vecs binary, order binary, values binary"


class Shard:
    """Rows of one length with their sorted projection arrays."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, order: np.ndarray, values: np.ndarray):
        self.ids, self.vecs, self.order, self.values = ids, vecs, order, values
        self.norms = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
        #: rows that share an id take one place between them
        self.repeated = len(np.unique(ids)) < len(ids)

    def windows(self, queries: np.ndarray, conf: Collisions) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of every query's window, by radius and projection."""
        h = (queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]) @ conf.directions(queries.shape[1])
        reach = conf.width * np.array(RADII[:-1])
        low = np.empty((len(queries), len(reach), len(self.order)), np.int32)
        high = np.empty_like(low)
        for j, row in enumerate(self.values):
            low[:, :, j] = np.searchsorted(row, h[:, j, None] - reach)
            high[:, :, j] = np.searchsorted(row, h[:, j, None] + reach, side="right")
        return low, high

    def search(self, query: np.ndarray, own_id: int, low: np.ndarray, high: np.ndarray, k: int, conf: Collisions) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of a query's nearest rows, nearest first."""
        m, n = self.order.shape
        counts = np.zeros(n, np.int64)
        checked = self.ids == own_id
        norm = math.sqrt(float((query * query).sum()))
        at, score = np.zeros(0, np.int64), np.zeros(0)
        was_low = was_high = None
        for step, radius in enumerate(RADII):
            if math.isinf(radius):
                fresh = np.flatnonzero(~checked)
            else:
                now_low, now_high = low[step].tolist(), high[step].tolist()
                if was_low is None:
                    grown = [self.order[j, now_low[j] : now_high[j]] for j in range(m)]
                else:
                    grown = [self.order[j, now_low[j] : was_low[j]] for j in range(m)] + [self.order[j, was_high[j] : now_high[j]] for j in range(m)]
                counts += np.bincount(np.concatenate(grown), minlength=n)
                was_low, was_high = now_low, now_high
                fresh = np.flatnonzero((counts >= conf.threshold) & ~checked)
            if len(fresh):
                checked[fresh] = True
                cos = np.einsum("ij,j->i", self.vecs[fresh], query) / (self.norms[fresh] * norm)
                at, score = np.concatenate([at, fresh]), np.concatenate([score, cos])
                if len(at) > k and not self.repeated:
                    front = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    at, score = at[front], score[front]
                best = np.lexsort((self.ids[at], -score))
                if self.repeated:
                    best = best[np.sort(np.unique(self.ids[at[best]], return_index=True)[1])]
                at, score = at[best[:k]], score[best[:k]]
            if len(at) >= k and 2 - 2 * score[-1] <= radius * radius:
                break
        return at, score


def _search_sorted(k: int, conf: Collisions):
    """Rows in order of (shard, g, kind): a shard, then the query blocks that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                n, dim = cell("n"), cell("dim")
                ids, vecs = np.frombuffer(cell("ids"), "<i8"), np.frombuffer(cell("vecs"), "<f8").reshape(n, dim)
                if cell("kind") == 0:
                    at = (cell("shard"), cell("g"))
                    shard = Shard(ids, vecs, np.frombuffer(cell("order"), "<i4").reshape(-1, n), np.frombuffer(cell("values"), "<f8").reshape(-1, n))
                    continue
                if (cell("shard"), cell("g")) != at:
                    raise ValueError("a query block came without its shard")
                low, high = shard.windows(vecs, conf)
                out: list[tuple] = []
                for i, (q, vec) in enumerate(zip(ids, vecs, strict=True)):
                    best, score = shard.search(vec, q, low[i], high[i], k, conf)
                    out.append((np.full(len(best), q), shard.ids[best], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, conf: Collisions = Collisions()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest rows by cosine, nearest first, ties to the smaller id.

    Queries are the rows where ``is_query``; rows with a query's id are its own
    and no candidates. Rows with a null id, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part; vectors compare
    with those of their own length. Rows that share an id take one place
    between them, with the best score of any; so do queries that share one. Other columns are
    ignored, whatever their names; an empty table gives an empty result.

    Query blocks are sent to the shards, a few blocks a task: a shard is held
    once and its blocks stream past it, whatever the table's size.
    """
    fine = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = fine.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    shards = rows.mapInArrow(_pack(conf, conf.shard_rows, True), PACKED_SQL)
    shards = written(shards.withColumn("shard", F.monotonically_increasing_id()), "ann-shards")
    asked = fine.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    n_asked = asked.count()
    groups = max(1, math.ceil(n_asked / (conf.query_rows * BLOCKS_A_TASK)))
    blocks = asked.repartition(max(1, math.ceil(n_asked / conf.query_rows)), "id").mapInArrow(_pack(conf, conf.query_rows, False), PACKED_SQL)
    blocks = written(blocks.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")), "ann-queries")
    cols = ["shard", "g", "kind", *PACKED]
    homes = shards.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(0)).select(*cols)
    visits = blocks.join(shards.select("shard", "dim"), "dim").withColumn("kind", F.lit(1)).select(*cols)
    met = homes.unionByName(visits).repartition("shard", "g").sortWithinPartitions("shard", "g", "kind")
    found = written(met.mapInArrow(_search_sorted(k, conf), "query_id long, vec_id long, score double"), "ann-found")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
