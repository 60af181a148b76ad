"""Shared storage and components for the library's own plans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of its own for a session in one process, and an error on a cluster."""
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


def fresh(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def freed(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Edges with the components of ``pairs``: from each least node to the others."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at, least = at.reshape(-1, 2), np.arange(len(nodes))
    while True:
        near = least[at].min(axis=1)
        now = least.copy()
        for side in (0, 1):
            np.minimum.at(now, at[:, side], near)
        now = now[now]
        if (now == least).all():
            break
        least = now
    others = least < np.arange(len(nodes))
    return np.stack([nodes[least[others]], nodes[others]], axis=1)


#: Edges that a task contracts at once.
AT_ONCE = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")], axis=1))
        n += len(held[-1])
        if n >= AT_ONCE:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _stars(np.concatenate(held)).T)), ["a", "b"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _stars(np.concatenate(held)).T)), ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``, long, by least label with a pointer jump a round; the graph shrinks as labels merge.

    Tasks contract the edges that they write to stars. Once these are stars all together, they are
    the components: a small graph, whose edges adaptive execution leaves to one task, needs no round.
    """
    ordered = lambda e, a, b: e.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct().mapInArrow(_contract, "a long, b long")
    live, label = stored(ordered(edges, "a", "b"), "edges"), None
    for _ in range(max_rounds):
        near = live.select(F.col("b").alias("node"), F.col("a").alias("component")).union(live.select("a", "a"))
        near = near.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("most"))
        settled = near.where("component < most").isEmpty()
        up = near.select(F.col("node").alias("component"), F.col("component").alias("up"))
        if settled and label is None:
            done = up.toDF("node", "component")
            done.stored_path = live.stored_path
            return done
        if not settled:
            up = up.join(up.toDF("up", "up2"), "up").select("component", F.col("up2").alias("up"))
        up, old = stored(up, "moves"), [live]
        if label is None:  # a node is its own label before the first round
            label, now = up, up.toDF("node", "component")
            now.stored_path = up.stored_path
        else:
            now = stored(label.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
            old += [label, up]
        if not settled:
            live = stored(ordered(live.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b"), "ua", "ub"), "edges")
        label = now
        freed(*old)
        if settled:
            return label
    raise RuntimeError("components did not settle")
