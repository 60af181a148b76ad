"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation
the space is cut into parts, each part has its own random code words, and a
direction picks one word a part. A vector list-decodes to every direction whose
inner product exceeds the cap's height, found by scanning each part's words in
descending order. Vectors of a label meet in the filters they share and are
verified by their exact cosine; a pair counts in the first filter it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, released, written
from tidemark.llm.vectors import matrix, usable

#: Rows of a filter that one task compares with each other; larger filters are cut into blocks, and block meets block.
BLOCK = 2048
#: Bits of the signature that screens rows before their vectors are sent. For a cosine of 0.98 a pair differs in 8 of
#: them on average and in more than ``APART`` with a probability below 1e-10; unrelated pairs differ in 64.
SIGNS, APART = 128, 34

#: The least angle of a cap, as a multiple of the angle of a link.
WIDE = 2.5


@dataclass(frozen=True)
class Caps:
    """``words`` code words in each of two parts; caps that catch ``mean`` filters a vector on average.

    Product codes leave some vectors few filters, so ``rounds`` codes, each with
    its own rotation, are used side by side, and every vector has at least its
    ``fewest`` best directions of each code. In few dimensions caps that hold
    ``mean`` filters would be narrower than the angle of a link; there fewer
    words keep them ``WIDE`` times as wide, and filters hold more vectors.
    """

    words: int
    mean: float = 14.0
    rounds: int = 3
    seed: int = 9
    fewest: int = 6
    least: float = 0.98

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that each unit vector exceeds, ascending."""
        rounds = [self._decode(unit, r) for r in range(self.rounds)]
        return [np.concatenate(x) for x in zip(*rounds, strict=True)]

    def _decode(self, unit: np.ndarray, r: int) -> list[np.ndarray]:
        dim = unit.shape[1]
        widest = math.cos(min(math.pi / 2, WIDE * math.acos(max(-1.0, min(1.0, self.least)))))
        words = min(self.words, max(8, math.ceil(math.sqrt(self.mean / max(cap_share(dim, widest), 1e-300)))))
        turn, first, second = _code(dim, words, self.seed + r)
        x = unit @ turn
        half = (dim + 1) // 2
        a, b = x[:, :half] @ first, x[:, half:] @ second
        need = cap_height(dim, min(0.5, self.mean / (first.shape[1] * second.shape[1])))
        order = np.argsort(-b, axis=1, kind="stable")
        # the best sums are among the best few of each part
        few = min(self.fewest, first.shape[1] * second.shape[1])
        top = np.argsort(-a, axis=1, kind="stable")[:, :few]
        out = []
        for i in range(len(unit)):
            down = b[i, order[i]]
            reach = np.searchsorted(-down, -(need - a[i]), side="right")
            if reach.sum() >= few:
                own = np.concatenate([w * self.words + order[i, : reach[w]] for w in np.flatnonzero(reach)])
            else:
                sums = (a[i, top[i]][:, None] + down[:few][None, :]).ravel()
                best = np.argsort(-sums, kind="stable")[:few]
                width = len(down[:few])
                own = top[i, best // width] * self.words + order[i, best % width]
            out.append(np.sort(own) + r * self.words**2)
        return out


@lru_cache(maxsize=64)
def _caps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles to a direction up to a right one, and the share of all unit vectors of ``dim`` dimensions within each."""
    angle = np.linspace(0, math.pi / 2, 1 << 16)
    density = np.sin(angle) ** (dim - 2.0) if dim > 2 else np.ones(len(angle))
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return angle, mass / (2 * mass[-1])


def cap_height(dim: int, share: float) -> float:
    """The inner product with a fixed direction that ``share`` of all unit vectors of ``dim`` dimensions exceed."""
    angle, within = _caps(dim)
    return float(np.cos(np.interp(share, within, angle))) if dim > 1 else 0.0


def cap_share(dim: int, height: float) -> float:
    angle, within = _caps(dim)
    return float(np.interp(math.acos(height), angle, within)) if dim > 1 else 0.5


def signature(unit: np.ndarray) -> np.ndarray:
    """128 signs of random projections, packed in 16 bytes a row."""
    planes = np.random.default_rng([4, unit.shape[1]]).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1)


@lru_cache(maxsize=8)
def _code(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, words])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = (dim + 1) // 2
    parts = []
    for size in (half, dim - half):
        c = rng.standard_normal((max(size, 0), words))
        c = np.unique(np.sign(c), axis=1) if size == 1 else c[:, :1] if size == 0 else c  # a line has two directions
        norm = np.sqrt((c * c).sum(axis=0, keepdims=True))
        parts.append(c / np.where(norm > 0, norm, 1) * math.sqrt(size / dim))
    return turn, parts[0], parts[1]


def _decode(caps: Caps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            dims = np.asarray(vecs.value_lengths())
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                x = matrix(vecs.take(own), int(dim))
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                filters = pa.array([f.astype(np.int32) for f in caps.decode(unit)], pa.list_(pa.int32()))
                signs = pa.array([r.tobytes() for r in signature(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in ("ck", "label", "size", "vec")], filters, signs], ["ck", "label", "size", "vec", "filters", "signs"])

    return run


def linked_matrix(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``; those close to it are decided by the plain sum."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    cos = (a @ b.T) / (na[:, None] * nb[None, :])
    hit = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
        hit[i, j] = float((a[i] * b[j]).sum()) / (na[i] * nb[j]) >= least
    return hit


def _compare(rows: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Within one filter or pair of its blocks: link weights by row, and edges of a spanning forest."""
    side, f = rows["side"], rows["filter"]
    same = rows["same"]
    a = np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    x = rows["x"]
    hit = linked_matrix(x[a], x[b], least)
    if same:
        np.fill_diagonal(hit, False)
    if hit.any():
        # pairs that already met in an earlier filter are left to it
        earlier = [fs[fs < f] for fs in rows["filters"]]
        names, flat = np.unique(np.concatenate(earlier) if earlier else np.zeros(0, np.int64), return_inverse=True)
        if len(names):
            member = np.zeros((len(x), len(names)), np.float32)
            member[np.repeat(np.arange(len(x)), [len(e) for e in earlier]), flat] = 1
            hit &= (member[a] @ member[b].T) < 0.5
    weight = np.zeros(len(x), np.int64)
    np.add.at(weight, a, hit @ rows["size"][b])
    if not same:
        np.add.at(weight, b, hit.T @ rows["size"][a])
    pair_a, pair_b = (a[v] for v in np.nonzero(hit)) if same else (lambda p: (a[p[0]], b[p[1]]))(np.nonzero(hit))
    root = np.arange(len(x))
    while True:  # least label over the links, with jumps
        low = root.copy()
        np.minimum.at(low, pair_a, root[pair_b])
        np.minimum.at(low, pair_b, root[pair_a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    tail = np.flatnonzero(root != np.arange(len(x)))
    return np.flatnonzero(weight), weight, tail, root


GROUP = ("label_key", "dim", "filter", "bi", "bj")


def _by_group(handle):
    """Runs ``handle(rows of a group, dim, filter) -> RecordBatch or None`` over sorted rows; groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def walk(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            keys = [np.asarray(table.column(c)) for c in GROUP]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts, stops = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [table.num_rows]]).astype(int)
            whole = len(starts) if last else len(starts) - 1
            out = [handle(table.slice(s, e - s).combine_chunks(), int(keys[1][s]), int(keys[2][s])) for s, e in zip(starts[:whole], stops[:whole], strict=True) if e - s > 1]
            return [x for x in out if x is not None], None if last else table.slice(starts[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, held = walk(table if held is None else pa.concat_tables([held, table]), False)
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        if held is not None and held.num_rows:
            out, _ = walk(held, True)
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run


def _screen(rows: pa.Table, _dim: int, _filter: int) -> pa.RecordBatch | None:
    """Rows of a group that have another row within ``APART`` signs."""
    bits = np.unpackbits(np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)
    signs = bits.astype(np.float32) * 2 - 1
    near = signs @ signs.T >= SIGNS - 2 * APART
    np.fill_diagonal(near, False)
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return None
    return rows.drop_columns(["signs"]).take(pa.array(at)).combine_chunks().to_batches()[0]


def _verify(least: float):
    """Groups to ``(ck, links, other)``: link weights, and edges where ``other`` is set."""

    def handle(rows: pa.Table, dim: int, number: int) -> pa.RecordBatch | None:
        fs = rows.column("filters").combine_chunks()
        offsets, flat = np.asarray(fs.offsets), np.asarray(fs.values)
        ck = np.asarray(rows.column("ck"))
        x = matrix(rows.column("vec").combine_chunks(), dim)
        own = {"side": np.asarray(rows.column("side")), "same": rows.column("bi")[0] == rows.column("bj")[0], "filter": number, "size": np.asarray(rows.column("size")), "x": x, "filters": [flat[offsets[i] : offsets[i + 1]] for i in range(len(ck))]}
        at, weight, tail, root = _compare(own, least)
        if not len(at):
            return None
        others = np.concatenate([np.full(len(at), None, object), ck[root[tail]].astype(object)])
        cells = [pa.array(np.concatenate([ck[at], ck[tail]])), pa.array(np.concatenate([weight[at], np.zeros(len(tail), np.int64)])), pa.array(others, pa.int64())]
        return pa.RecordBatch.from_arrays(cells, ["ck", "links", "other"])

    return _by_group(handle)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, mean: float = 14.0, target: int = 32) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row.

    Rows link when their labels are equal and not null and their cosine is at
    least ``least``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different
    length. Equal vectors of a label form one class first, so copies never
    multiply; repeated rows are rows and link with each other. A row with a
    null id takes part, and its component is the least id that is not null.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result. Links come from shared filters: recall is measured in the
    tests, precision is exact.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    usable_row = usable(F.col("vec")) & F.col("label").isNotNull()
    for salt in range(8):
        keyed = rows.withColumn("ck", F.when(usable_row, F.xxhash64(F.lit(salt), "label", "vec")))
        classes = keyed.where(F.col("ck").isNotNull()).groupBy("ck").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("label", "vec")).alias("one"), F.max(F.struct("label", "vec")).alias("last"))
        classes = classes.select("ck", "size", "one.label", "one.vec", (F.col("one") != F.col("last")).alias("two"))
        classes = written(classes, "caps-classes")
        if classes.where("two").isEmpty():  # else two vectors have one key: new keys
            break
        released(classes)
    else:
        raise RuntimeError("different vectors shared a key eight times")
    classes = classes.drop("two")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    caps = Caps(words=max(8, math.ceil(math.sqrt(n * mean / target))), mean=mean, least=least)
    vec_type, label_type = (classes.schema[c].dataType.simpleString() for c in ("vec", "label"))
    decoded = classes.mapInArrow(_decode(caps), f"ck long, label {label_type}, size long, vec {vec_type}, filters array<int>, signs binary")
    decoded = written(decoded.withColumn("label_key", F.xxhash64("label")).withColumn("dim", F.size("vec")).drop("label"), "caps-filters")
    posted = decoded.select("ck", "label_key", "dim", "signs", F.explode("filters").alias("filter"))
    key = ["label_key", "dim", "filter"]
    large = posted.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / (BLOCK / 2)).cast("int").alias("blocks"))
    posted = posted.join(large, key, "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("ck", F.lit(3)), "blocks").cast("int")))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("own", o).alias("bi"), F.greatest("own", o).alias("bj"), (F.col("own") > o).cast("int").alias("side")),
    )
    alone = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side")))
    posted = posted.withColumn("m", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)))
    posted = posted.select("ck", "signs", *key, "m.bi", "m.bj", "m.side")
    screened = posted.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_by_group(_screen), "ck long, label_key long, dim int, filter int, bi int, bj int, side int")
    paid = screened.join(decoded.select("ck", "size", "vec", "filters"), "ck")
    checked = paid.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_verify(least), "ck long, links long, other long")
    checked = written(checked, "caps-links")
    links = checked.where("other is null").groupBy("ck").agg(F.sum("links").alias("links"))
    edges = checked.where("other is not null").select(F.col("ck").alias("a"), F.col("other").alias("b"))
    comp = components(edges, "caps").withColumnRenamed("node", "ck")
    of_class = classes.select("ck", "size").join(links, "ck", "left").join(comp, "ck", "left")
    of_class = of_class.select("ck", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "ck").alias("component"))
    placed = keyed.select("id", "ck").join(of_class, "ck", "left")
    least_id = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(least_id, "component", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
