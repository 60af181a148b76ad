"""N-gram Jaccard join by adaptive multi-match prefixes.

Shingles are put in one global order, rare first. A pair that reaches the
threshold shares at least ``l`` shingles of both documents' prefixes of
``n - ceil(t n) + l``; each document picks the ``l`` of least estimated cost
(reading its postings, and verifying the candidates that can share ``l`` of
them), so frequent prefixes get longer and stricter. Candidates that share
enough, and whose parity sketches leave room for a link, are verified on their
whole sets.

The order comes from a count sketch of fixed size over all documents: counts
only steer the cost, any order keeps the join exact. Equal sets are one class
throughout. Of a shingle's postings, a short list gives its pairs, which count
the prefix shingles they share; the pairs that share as many as one of them
asks for are candidates. In a long list the class of least key is the hub; the
lists of one hub are one group, so the hundred lists that near copies share
cost them one comparison of parities and not a hundred. Candidates of both
kinds make bundles, each class in one, and its whole set is sent there alone.
Groups and bundles are cut into blocks, block meets block, and what leaves a
task is a spanning forest of the links found there: rows in proportion to the
block, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, contracted, give_back, lean, released, text_of, written
from tidemark.llm.shingles import shingle_sets, sliced

SKETCH_BITS, SKETCH_PARTS = 20, 16
MOST_MATCHES = 8
VERIFY_COST = 20.0
#: Of the documents that share a prefix shingle by chance, the part that shares one more.
BY_CHANCE = 0.2
SHORT_LIST = 16
#: Most rows and shingles of a block, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
FILTER_BITS = 1 << 24
LEAST_PARITY = 256


def needed(n: int, percent: int) -> int:
    """ceil(n * percent / 100): the overlap that a set of ``n`` owes a partner."""
    return -(-n * percent // 100)


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets([x.as_py() for x in batch.column("text").cast(pa.binary())], width)


def class_key(shingles: np.ndarray, salt: int) -> tuple[int, int]:
    """Key of a set and a check of it: equal sets are one class, and a key with two checks is a collision."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each of ``b`` hash values, a power of two of ``n`` at least: whether an odd number of shingles has it.

    Where two sets differ in d shingles their parities differ in at most d
    bits, so the difference bounds d from below and rules pairs out safely.
    A parity of ``2 b`` bits folds to one of ``b`` by exclusive or of its halves.
    """
    bits = max(LEAST_PARITY, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _count(width: int, salt: int):
    """Per document its class and parity (kind 0), per task its part of the sketch (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in sliced(batches):
            sets = _sets(batch, width)
            for s in sets:
                np.add.at(sketch, _bucket(s), 1)
            n = len(sets)
            keys = [class_key(s, salt) if len(s) else (None, None) for s in sets]
            cells = [pa.array([0] * n, pa.int32()), batch.column("id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([parity(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32())], COUNTED)
        parts = sketch.reshape(SKETCH_PARTS, -1)
        live = [p for p in range(SKETCH_PARTS) if parts[p].any()]
        n = len(live)
        cells = [pa.array([1] * n, pa.int32()), *[pa.nulls(n, pa.int64())] * 4, pa.array([parts[p].astype("<i8").tobytes() for p in live], pa.binary()), pa.array(live, pa.int32())]
        yield pa.RecordBatch.from_arrays(cells, COUNTED)

    return run


COUNTED = ["kind", "id", "ck", "proof", "n", "body", "part"]
COUNTED_SQL = "kind int, id long, ck long, proof long, n long, body binary, part int"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts of a partition as they come."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
            held[part] = held.get(part, 0) + np.frombuffer(counts.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], ["part", "body"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums as ``_add`` does, a part as compressed 32-bit counts."""
    for batch in _add(batches):
        bodies = [np.minimum(np.frombuffer(x.as_py(), "<i8"), 2**31 - 1).astype("<i4").tobytes() for x in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in bodies], pa.binary())], ["part", "body"])


def sketch_parts(first: DataFrame) -> DataFrame:
    """``part, body``: the tasks' sketches added up, one packed row a part, so that the driver gets no more at any number of tasks."""
    parts = first.where("kind = 1").select("part", "body").repartition(SKETCH_PARTS * 4, "part", F.spark_partition_id() % 4).mapInArrow(_add, "part int, body binary")
    return parts.repartition(SKETCH_PARTS, "part").mapInArrow(_pack, "part int, body binary")


def prefix_of(shingles: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order and the number of matches it asks for."""
    seen = sketch[_bucket(shingles)]
    n = len(shingles)
    base = n - needed(n, percent)
    most = min(MOST_MATCHES, n - base)
    front = np.arange(n)
    if n > 4 * (base + most):
        front = np.flatnonzero(seen <= np.partition(seen, base + most - 1)[base + most - 1])
    order = front[np.lexsort((shingles[front], seen[front]))[: base + most]]
    # what the noise of the sketch hides is a small list, too
    lists = np.maximum(seen[order] - noise, 0.0) + BY_CHANCE * max(0.0, 1 - 1 / max(noise, 1.0))
    read = np.cumsum(lists)[base:]
    matches = np.arange(1, most + 1)
    cost = read + VERIFY_COST * read * BY_CHANCE ** (matches - 1.0) + matches
    best = int(np.argmin(cost)) + 1
    return shingles[order[: base + best]], best


class Order:
    """The global order of shingles, by the sketch of their counts."""

    def __init__(self, sketch: np.ndarray, percent: int):
        self.sketch, self.percent = sketch, percent
        self.noise = float(np.median(sketch)) + 3 * float(np.sqrt(np.median(sketch)))

    def __getstate__(self) -> dict:
        """Tasks get the sketch compressed."""
        return self.__dict__ | {"sketch": pa.compress(self.sketch.astype("<i4").tobytes(), codec="zstd", asbytes=True), "size": len(self.sketch)}

    def __setstate__(self, held: dict) -> None:
        size = held.pop("size")
        self.__dict__ |= held | {"sketch": np.frombuffer(pa.decompress(held["sketch"], decompressed_size=4 * size, codec="zstd", asbytes=True), "<i4")}

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        return prefix_of(shingles, self.sketch, self.noise, self.percent)


def _post(width: int, salt: int, order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in sliced(batches):
            tok, ck, ask = [], [], []
            for s in _sets(batch, width):
                if len(s) and (key := class_key(s, salt)[0]) not in sent:
                    sent.add(key)
                    prefix, matches = order.prefix(s)
                    tok.append(prefix)
                    ck.append(np.full(len(prefix), key))
                    ask.append(np.full(len(prefix), matches, np.int32))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(ck)), pa.array(np.concatenate(ask))], ["tok", "ck", "ask"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of (tok, ck): the pairs of short lists (kind 0), each class of a long one with its hub (kind 1).

    A list streams by: its rows are held until it is known to be long.
    """
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    going: tuple | None = None  # token, hub and last class of a long list of which rows may follow

    def emit(kind: int, a: np.ndarray, b: np.ndarray, ask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(ask.astype(np.int32))], ["kind", "a", "b", "ask"])

    def walk(cols: tuple[np.ndarray, ...], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal going, held
        tok, ck, ask = cols
        if not len(tok):
            return
        keep = np.concatenate([[True], (tok[1:] != tok[:-1]) | (ck[1:] != ck[:-1])])  # a class that several tasks have sent
        if going is not None and tok[0] == going[0] and ck[0] == going[2]:
            keep[0] = False
        tok, ck, ask = tok[keep], ck[keep], ask[keep]
        if not len(tok):
            return
        starts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1])
        size = np.diff(np.concatenate([starts, [len(tok)]]))
        long, hub = size > SHORT_LIST, ck[starts]
        goes_on = going is not None and tok[0] == going[0]
        if goes_on:
            long[0], hub[0] = True, going[1]
        held, short = (tok[:0], ck[:0], ask[:0]), ~long & (size > 1)
        if not last:
            going = (tok[-1], hub[-1], ck[-1]) if long[-1] else None
            if not long[-1]:
                held = tuple(c[starts[-1] :] for c in (tok, ck, ask))
                short[-1] = False
        if long.any():
            rows = np.repeat(long, size)
            rows[starts[1:] if goes_on else starts] = False  # the hub's own row
            yield emit(1, np.repeat(hub, size)[rows], ck[rows], ask[rows])
        for m in np.unique(size[short]):
            first = starts[short & (size == m)]
            i, j = np.triu_indices(m, 1)
            x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            yield emit(0, ck[x], ck[y], np.minimum(ask[x], ask[y]))

    for batch in batches:
        own = tuple(np.asarray(batch.column(c)) for c in ("tok", "ck", "ask"))
        yield from walk(tuple(np.concatenate(x) for x in zip(held, own, strict=True)), False)
    yield from walk(held, True)


class Seen:
    """A Bloom filter of fixed size for 64-bit keys: what it lets through besides only costs."""

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return np.stack([((x * np.uint64(m)) >> np.uint64(40)) & np.uint64(FILTER_BITS - 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]).astype(np.int64)

    @staticmethod
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            held[Seen.bits(np.asarray(batch.column(0).drop_null())).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["bits"])

    @staticmethod
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for bits in batch.column("bits"):
                held |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])

    def __init__(self, keys: DataFrame):
        parts = keys.coalesce(8).mapInArrow(self.gather, "bits binary").coalesce(1).mapInArrow(self.merge, "bits binary").collect()
        self.held = np.frombuffer(parts[0]["bits"], np.uint8) if parts else np.zeros(FILTER_BITS // 8, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.bits(keys)
        return ((self.held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _fetch(width: int, salt: int, wanted: Seen):
    """Whole sets of the documents in the filter, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            own = batch.filter(pa.array(wanted.has(np.asarray(batch.column("id")))))
            for part in sliced(iter([own])):
                rows = [(k, s.tobytes()) for s in _sets(part, width) if len(s) and (k := class_key(s, salt)[0]) not in sent and not sent.add(k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["ck", "body"])

    return run


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = shared(a, b)
    return 100 * same >= percent * (len(a) + len(b) - same)


def possible(n_a: np.ndarray, n_b: np.ndarray, p_a: list[bytes], p_b: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the pairs whose sizes and parities leave room for a link, and in how many bits they differ, some rows at a time."""

    def folded(p: bytes, words: int) -> np.ndarray:
        x = np.frombuffer(p, "<u8")
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    lens_a, lens_b = np.array([len(p) for p in p_a]) // 8, np.array([len(p) for p in p_b]) // 8
    for wa in np.unique(lens_a):
        for wb in np.unique(lens_b):
            if max(wa, wb) > 2 * min(wa, wb) and min(wa, wb) * 64 > LEAST_PARITY:
                continue  # sizes of a pair that links are within a factor of two
            words = int(min(wa, wb))
            ia, ib = np.flatnonzero(lens_a == wa), np.flatnonzero(lens_b == wb)
            x, y = (np.stack([folded(p[k], words) for k in i]) for p, i in ((p_a, ia), (p_b, ib)))
            step = max(1, (1 << 20) // (len(ib) * words))
            for at in range(0, len(ia), step):
                own = ia[at : at + step]
                differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                total = n_a[own][:, None] + n_b[ib][None, :]
                differ = np.maximum(differ, np.abs(n_a[own][:, None] - n_b[ib][None, :]))
                # 100 i >= p u with i = (total - d) / 2 and u = (total + d) / 2
                i, j = np.nonzero(100 * (total - differ) >= percent * (total + differ))
                yield own[i], ib[j], differ[i, j]


def _pairs(percent: int):
    """The pairs whose sizes and parities leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            fits = [any(len(i) for i, _, _ in possible(n_a[k : k + 1], n_b[k : k + 1], [x.as_py()], [y.as_py()], percent)) for k, (x, y) in enumerate(zip(batch.column("pa"), batch.column("pb"), strict=True))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


GROUP = ("grp", "bi", "bj")


def _by_group(handle, names: list[str]):
    """Runs ``handle(rows of a group) -> columns`` over rows in order of GROUP; groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in handle(own)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(c)) for c in GROUP]
            cut = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if held and any(held[-1].column(c)[0].as_py() != k[s] for c, k in zip(GROUP, keys, strict=True)):
                    yield done()
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    return run


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = np.asarray(rows.column("side"))
    same = rows.column("bi")[0] == rows.column("bj")[0]
    a = np.flatnonzero(side == 0)
    return a, (a if same else np.flatnonzero(side == 1)), same


class Roots:
    """A union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    def join(self, i: int, j: int) -> bool:
        """True if the two were apart."""
        x, y = self.find(i), self.find(j)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def all(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.up))])


def _screen(percent: int):
    """The members of a long list's group to a spanning forest of their possible links."""

    def handle(rows: pa.Table) -> list:
        a, b, same = _sides(rows)
        if not len(a) or not len(b):
            return [[], []]
        ck, n, p = np.asarray(rows.column("ck")), np.asarray(rows.column("n")), rows.column("parity").to_pylist()
        roots, edges = Roots(rows.num_rows), []
        for i, j, _ in possible(n[a], n[b], [p[k] for k in a], [p[k] for k in b], percent):
            pairs = np.stack([a[i], b[j]], axis=1)[i < j if same else slice(None)]
            while len(pairs):  # those still apart, one a row at a time
                top = roots.all()
                pairs = pairs[top[pairs[:, 0]] != top[pairs[:, 1]]]
                _, first = np.unique(pairs[:, 0], return_index=True)
                edges += [e for e in pairs[first].tolist() if roots.join(*e)]
        return [ck[[e[0] for e in edges]], ck[[e[1] for e in edges]]] if edges else [[], []]

    return _by_group(handle, ["a", "b"])


def forest(sets: list[np.ndarray], pairs: np.ndarray, order: Order) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``pairs`` (rows of two places and a difference, nearest first).

    In each round every row tries its nearest partners in other components,
    twice as many as in the round before; a pair counts after its prefixes
    share as much as one of them asks for.
    """
    prefixes: dict[int, tuple[np.ndarray, int]] = {}

    def prefix(k: int) -> tuple[np.ndarray, int]:
        if k not in prefixes:
            tok, ask = order.prefix(sets[k])
            prefixes[k] = np.sort(tok), ask
        return prefixes[k]

    roots, edges, tries = Roots(len(sets)), [], 1
    while len(pairs):
        top = roots.all()
        pairs = pairs[top[pairs[:, 0]] != top[pairs[:, 1]]]
        if not len(pairs):
            break
        chosen = np.zeros(len(pairs), bool)
        for side in (0, 1):  # the first few of each row, as the pairs come nearest first
            by_row = np.argsort(pairs[:, side], kind="stable")
            own = pairs[by_row, side]
            begin = np.concatenate([[True], own[1:] != own[:-1]])
            rank = np.arange(len(own)) - np.maximum.accumulate(np.where(begin, np.arange(len(own)), 0))
            chosen[by_row[rank < tries]] = True
        for i, j in pairs[chosen, :2].tolist():
            if roots.find(i) == roots.find(j):
                continue
            (p, k), (q, m) = prefix(i), prefix(j)
            if shared(p, q) >= min(k, m) and linked(sets[i], sets[j], order.percent):
                roots.join(i, j)
                edges.append((i, j))
        pairs, tries = pairs[~chosen], tries * 2
    return edges


def _verify(order: Order):
    """Bundles with whole sets to the links of a spanning forest, as stars where the bundle is of one block: ``whole`` is 1."""

    def handle(rows: pa.Table) -> list:
        a, b, same = _sides(rows)
        if not len(a) or not len(b):
            return [[], [], []]
        ck = np.asarray(rows.column("ck"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("body")]
        p, n = [parity(s) for s in sets], np.array([len(s) for s in sets])
        found = [np.zeros((0, 3), np.int64)]
        for i, j, differ in possible(n[a], n[b], [p[k] for k in a], [p[k] for k in b], order.percent):
            keep = i < j if same else np.ones(len(i), bool)
            found.append(np.stack([a[i[keep]], b[j[keep]], differ[keep]], axis=1))
        pairs = np.concatenate(found)
        edges = forest(sets, pairs[np.argsort(pairs[:, 2], kind="stable")], order)
        links = ck[np.array(edges, int).reshape(-1, 2)]
        one = rows.column("blocks")[0].as_py() is None
        links = contracted(links) if one and len(links) else links
        return [links[:, 0], links[:, 1], np.full(len(links), int(one))]

    return _by_group(handle, ["a", "b", "whole"])


def _dealt(members: DataFrame) -> DataFrame:
    """``members(grp, ck, n, ...)`` to pairs of blocks of their group: adds ``blocks`` (null for one block) and ``bi, bj, side``."""
    large = members.groupBy("grp").agg(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES).alias("blocks")).where("blocks > 1")
    placed = members.join(large.select("grp", F.ceil("blocks").cast("int").alias("blocks")), "grp", "left")
    placed = placed.withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("ck", F.lit(3)), "blocks").cast("int")))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("own", o).alias("bi"), F.greatest("own", o).alias("bj"), (F.col("own") > o).cast("int").alias("side")),
    )
    alone = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side")))
    spread = placed.withColumn("m", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)))
    return spread.select(*members.columns, "blocks", "m.bi", "m.bj", "m.side")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row.

    Documents link when ``100 * intersection >= percent * union`` of their sets
    of ``width``-word shingles. Null texts and texts without words have the
    empty set and link with nothing; a text of fewer words than ``width`` is
    one shingle. Equal sets link, whatever their rows, so repeated rows do. A
    row with a null id takes part, and a component's id is its least id that is
    not null. Other columns are ignored, whatever their names; an empty table
    gives an empty result. Texts are read whole. Shingles are told apart by 64
    bits, sets by their shingles and 128 bits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    for salt in range(8):
        first = written(rows.mapInArrow(lean(_count(width, salt)), COUNTED_SQL), "ngram-sets", "kind")
        sets = first.where("kind = 0")
        signs = sets.where("ck is not null").groupBy("ck").agg(F.min("n").alias("n"), F.min("body").alias("parity"), F.min("id").alias("rep"), (F.min("proof") != F.max("proof")).alias("two"))
        signs = written(signs, "ngram-classes")
        if signs.where("two").isEmpty():  # else two sets have one key: new keys
            break
        released(first, signs)
    else:
        raise RuntimeError("sets of different shingles shared a key eight times")
    size = (1 << SKETCH_BITS) // SKETCH_PARTS
    sketch = np.zeros((SKETCH_PARTS, size), np.int32)
    for r in sketch_parts(first).collect():  # one row a part, of bounded size
        sketch[r["part"]] = np.frombuffer(pa.decompress(bytes(r["body"]), decompressed_size=4 * size, codec="zstd", asbytes=True), "<i4")
    order = Order(sketch.ravel(), percent)
    del sketch

    posted = rows.mapInArrow(lean(_post(width, salt, order)), "tok long, ck long, ask int")
    lists = posted.repartition("tok").sortWithinPartitions("tok", "ck").mapInArrow(lean(_lists), "kind int, a long, b long, ask int")
    lists = written(lists, "ngram-lists", "kind")
    counted = lists.where("kind = 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("ask").alias("ask"))
    told_a, told_b = signs.select(F.col("ck").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), signs.select(F.col("ck").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    pairs = counted.where("shared >= ask").select("a", "b")
    pairs = pairs.join(told_a, "a").join(told_b, "b").mapInArrow(lean(_pairs(percent)), "a long, b long")
    long = lists.where("kind = 1").select(F.col("a").alias("grp"), F.col("b").alias("ck"))
    long = long.union(long.select("grp", F.col("grp").alias("ck"))).distinct()
    light = written(long.join(signs.select("ck", "n", "parity"), "ck"), "ngram-members")
    found = _sorted(_dealt(light)).mapInArrow(lean(_screen(percent)), "a long, b long")
    possible_links = written(pairs.union(found), "ngram-possible")
    released(lists, light)
    bundles = components(possible_links, "ngram-bundles")
    members = written(bundles.toDF("ck", "grp").join(signs.select("ck", "n", "rep"), "ck"), "ngram-dealt")
    wanted = Seen(members.select(F.coalesce("rep", F.lit(-1)).alias("id")))
    source = rows.select(F.coalesce("id", F.lit(-1)).alias("id"), "text")
    bodies = source.mapInArrow(lean(_fetch(width, salt, wanted)), "ck long, body binary").join(members.select("ck"), "ck", "left_semi")
    bodies = written(bodies.groupBy("ck").agg(F.first("body").alias("body")), "ngram-whole")
    paid = _sorted(_dealt(members.drop("rep")).select("ck", *GROUP, "blocks", "side").join(bodies, "ck"))
    edges = written(paid.mapInArrow(lean(_verify(order)), "a long, b long, whole long"), "ngram-edges")
    released(possible_links, members, bodies)
    # most bundles are of one block and settled where they were verified; only the links of the others have yet to meet
    stars = edges.where("whole = 1")
    comp = stars.select(F.col("b").alias("ck"), F.col("a").alias("component"))
    if not (open_links := edges.where("whole = 0").select("a", "b")).isEmpty():
        comp = comp.union(components(open_links, "ngram"))
    placed = signs.select("ck", "rep").join(comp, "ck", "left").select("ck", "rep", F.coalesce("component", "ck").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(least, "component").select("ck", "component_id")
    told = sets.select("id", "ck", "n").join(of_class, "ck", "left")
    told = told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("ck").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    told = written(told, "ngram-told")
    released(first, signs, edges)
    give_back()
    return told
