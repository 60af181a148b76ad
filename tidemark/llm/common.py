"""What the training-data operators share: shared storage, null-safe inputs, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; on a
    cluster there is no folder to fall back on, and this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path if the session still lives; at exit it may be gone already."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway closes before or after this hook
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: While a table is written: its shuffle files go when it stands, batches sent to Python stay small in bytes too, and
#: the driver keeps no long descriptions of plans.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.maxPlanStringLength": "4096",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with settings(spark, WRITING):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t.written_path)


ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: ArrowMap) -> ArrowMap:
    """A function for ``mapInArrow`` after which the worker, which later tasks use again, holds no freed memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def text_of(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def unit_hash(*cols: Column) -> Column:
    """A uniform number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def contracted(pairs: np.ndarray) -> np.ndarray:
    """The same components as ``pairs`` (two columns) in fewer and flatter edges: a star around each least node."""
    names, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    low = np.arange(len(names))
    while True:  # least label over the edges, with jumps
        was = low
        low = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, was[a])
        low = low[low]
        if (low == was).all():
            break
    apart = np.flatnonzero(low != np.arange(len(names)))
    return np.stack([names[low[apart]], names[apart]], axis=1)


#: Edges that a task contracts at once.
CONTRACT_ROWS = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def done() -> pa.RecordBatch:
        stars = contracted(np.concatenate(held)) if held else np.zeros((0, 2), np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(c)) for c in ("a", "b")], axis=1))
        if sum(map(len, held)) >= CONTRACT_ROWS:
            yield done()
    yield done()


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``.

    Tasks first contract the edges that they read to stars. Each round then
    replaces a node's label by the smallest label around it and that by its
    label's label, so the rounds grow with the logarithm of the longest chain.
    Every round is written to the shared folder and the graph is contracted to
    edges between different labels, so a hub's edges vanish once its neighbours
    carry its label. Only the question whether an edge is open comes to the driver.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").mapInArrow(_contract, "a long, b long").distinct()
    live = written(live, f"{name}-edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    label = written(nodes.select("node", F.col("node").alias("component")), f"{name}-labels")
    for _ in range(max_rounds):
        if live.isEmpty():
            released(live)
            return label
        flat = live.mapInArrow(_contract, "a long, b long")
        both = flat.union(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("component")).agg(F.min("b").alias("near"))
        best = best.select("component", F.least("component", "near").alias("up"))
        # one pointer jump: where my smallest neighbour itself moves to
        jump = best.select(F.col("component").alias("up"), F.col("up").alias("up2"))
        best = best.join(jump, "up", "left").select("component", F.coalesce("up2", "up").alias("up"))
        best = written(best, f"{name}-moves")
        moved = label.join(best, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        old, label = (label, live), written(moved, f"{name}-labels")
        to_a = best.select(F.col("component").alias("a"), F.col("up").alias("ua"))
        to_b = best.select(F.col("component").alias("b"), F.col("up").alias("ub"))
        live = flat.join(to_a, "a", "left").join(to_b, "b", "left")
        live = live.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        live = live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        live = written(live, f"{name}-edges")
        released(*old, best)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
