"""The state board as an append-only log: supersede chains, as-of views, conflicts, rings of interventions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.functions.scalars import DAY, DECAY_FLOOR, HALF_LIFE_DAYS, decay

PATH = ("customer_id", "field_path")


def chain(log: DataFrame) -> DataFrame:
    """``valid_to``, ``superseded_by`` and the customer's ``state_version`` of every write ``(…, t, episode_id)``."""
    w = Window.partitionBy(*PATH).orderBy("t", "episode_id")
    v = Window.partitionBy("customer_id").orderBy("episode_id")
    return log.withColumns({"valid_to": F.lead("t").over(w), "superseded_by": F.lead("episode_id").over(w), "state_version": F.row_number().over(v)})


def as_of(log: DataFrame, moment: Column) -> DataFrame:
    """The latest write of each path up to a moment, ties to the later write: one partial aggregate."""
    last = log.where(F.col("t") <= moment).groupBy(*PATH).agg(F.max(F.struct("t", "episode_id", "value", "confidence", "agent")).alias("w"))
    return last.select(*PATH, "w.value", "w.confidence", "w.agent", "w.t", "w.episode_id")


#: Writes and moments of paths that a task sorts, on average.
TASK_ROWS = 1 << 20


def as_of_moments(log: DataFrame, moments: DataFrame, run: int = 30 * DAY) -> DataFrame:
    """``customer_id, moment, field_path, value, confidence, agent, t, episode_id``: the state at every moment of ``moments(customer_id, moment)``.

    Each path of a customer meets the customer's moments; writes and moments stand
    in one order and a running maximum carries the latest write forward, ties to
    the later one. The order is split into runs of time: what was last written
    before a run stands at its beginning as one row a path and run, so a customer
    with very many writes or moments is not sorted in one task. Rows are sorted
    once, in as many tasks as their number asks for. A path that nothing was
    written to by a moment gives no row; repeated moments give one.
    """
    write = F.struct("t", "episode_id", "value", "confidence", "agent")
    run_of = lambda at: F.floor(F.col(at) / run).alias("run")
    log = log.where("field_path is not null and t is not null")
    paths, moments = log.select(*PATH).distinct(), moments.where("moment is not null").select("customer_id", "moment").distinct()
    met = moments.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(paths.groupBy("customer_id").agg(F.count(F.lit(1)).alias("m")), "customer_id")
    total = met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    writes = log.select(*PATH, run_of("t"), F.col("t").alias("at"), write.alias("w"))
    nothing = F.lit(None).cast(writes.schema["w"].dataType).alias("w")
    probes = moments.join(paths, "customer_id").select(*PATH, run_of("moment"), F.col("moment").alias("at"), nothing)
    asked = moments.select("customer_id", run_of("moment")).distinct().join(paths, "customer_id").select(*PATH, "run", nothing)
    last = writes.select(*PATH, "run", "w").unionByName(asked).groupBy(*PATH, "run").agg(F.max("w").alias("last"))
    before = Window.partitionBy(*PATH).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*PATH, "run", F.max("last").over(before).alias("w")).where("w is not null").select(*PATH, "run", F.col("w.t").alias("at"), "w")
    within = Window.partitionBy(*PATH, "run").orderBy("at", F.col("w").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = writes.unionByName(probes).unionByName(carried).repartition(tasks, *PATH, "run")
    held = rows.withColumn("held", F.max("w").over(within)).where("w is null and held is not null")
    return held.select("customer_id", F.col("at").alias("moment"), "field_path", "held.value", "held.confidence", "held.agent", "held.t", "held.episode_id")


def decayed(current: DataFrame, now: Column, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> DataFrame:
    """Confidence at ``now``; what fell below the floor is gone."""
    aged = current.withColumn("confidence", decay(F.col("confidence"), (now - F.col("t")) / DAY, half_life))
    return aged.where(F.col("confidence") >= floor).withColumn("confidence", F.round("confidence", 4))


def conflicts(log: DataFrame, within: int) -> DataFrame:
    """Writes of one path by another agent with another value within a time of the one before, with both values in order."""
    w = Window.partitionBy(*PATH).orderBy("t", "episode_id")
    rows = log.withColumns({"prev_agent": F.lag("agent").over(w), "prev_value": F.lag("value").over(w), "prev_t": F.lag("t").over(w)})
    clash = (F.col("prev_agent") != F.col("agent")) & (F.col("prev_value") != F.col("value")) & (F.col("t") - F.col("prev_t") <= within)
    rows = rows.where(clash)
    return rows.select(F.col("episode_id").alias("conflict_id"), *PATH, F.array("prev_agent", "agent").alias("agents"), F.array("prev_value", "value").alias("values"))


def arbitrate(pending: DataFrame) -> DataFrame:
    """The second value wins."""
    return pending.withColumn("resolution", F.try_element_at("values", F.lit(2))).withColumn("resolved_by", F.lit("critique"))


def unresolved(conflict_log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts without a resolution, in order of their ids."""
    return conflict_log.join(resolutions.select("conflict_id"), "conflict_id", "left_anti").orderBy("conflict_id")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key: the last row of each wins."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def append_new(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """First write wins: rows whose key the table lacks, one each."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def merge_by_type(entries: DataFrame) -> DataFrame:
    """Risks or opportunities a customer and type: earliest opening, latest confidence."""
    return entries.groupBy("customer_id", "type").agg(F.min("opened_at").alias("opened_at"), F.max(F.struct("opened_at", "confidence"))["confidence"].alias("confidence"))


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ok`` and ``actual`` of writes that come by customer and in order; nothing is held but the customer at hand."""
    customer, version, begun = None, 0, False
    for batch in batches:
        ok, actual = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("customer_id", "expected", "start")), strict=True)
        for who, expected, start in rows:
            if not begun or who != customer:
                customer, version, begun = who, start, True
            actual.append(version)
            ok.append(expected is None or expected == version)
            version += ok[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(actual, pa.int64())], [*batch.schema.names, "ok", "actual"])


def versioned(writes: DataFrame, versions: DataFrame) -> DataFrame:
    """``writes(customer_id, episode_id, …, expected)`` with ``ok`` and the version ``actual`` that each met.

    Writes of a customer are taken in order of ``episode_id``. One that expects a
    version (not null) other than the customer's at that point is refused; one
    that is taken raises the version by one. ``versions`` holds ``customer_id,
    state_version``; a customer without one starts at 0. Rows are sorted by
    customer and order and folded as a stream, so a task holds one batch,
    however many writes a customer has.
    """
    met = writes.join(versions.select("customer_id", F.col("state_version").cast("long").alias("start")), "customer_id", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    schema = StructType([*met.schema.fields, StructField("ok", BooleanType()), StructField("actual", LongType())])
    return met.repartition("customer_id").sortWithinPartitions("customer_id", "episode_id").mapInArrow(_versions, schema).drop("start")


def update_field(log: DataFrame, writes: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(log with the accepted writes, refused writes with the version they met)`` of ``writes(…, expected)``, in order (``versioned``)."""
    met = versioned(writes, versions)
    taken = log.unionByName(met.where("ok").select(*log.columns))
    return taken, met.where("not ok").select(*log.columns, "expected", "actual")


def write_conflicts(log: DataFrame, accepted: DataFrame) -> DataFrame:
    """Conflicts of accepted writes that name another agent (``conflict_with``) where the path held another value.

    The value held is that of the write before on the path, in ``log`` or among
    the accepted ones; a path without one, or with null, conflicts with nothing.
    """
    cols = ["episode_id", *PATH, "agent", "value"]
    rows = log.select(*cols, F.lit(None).cast("string").alias("conflict_with")).unionByName(accepted.select(*cols, "conflict_with"))
    rows = rows.withColumn("held", F.lag("value").over(Window.partitionBy(*PATH).orderBy("episode_id")))
    clash = rows.where(F.col("conflict_with").isNotNull() & F.col("held").isNotNull() & ~F.col("held").eqNullSafe(F.col("value")))
    return clash.select(F.col("episode_id").alias("conflict_id"), *PATH, F.array("conflict_with", "agent").alias("agents"), F.array("held", "value").alias("values"))


def record_finding(findings: DataFrame) -> DataFrame:
    """Findings ``(episode_id, customer_id, domain, value, confidence, agent, t)`` as writes of ``findings.<domain>``."""
    path = F.concat(F.lit("findings."), F.col("domain")).alias("field_path")
    return findings.select("episode_id", "customer_id", path, "value", "confidence", "agent", "t")


def at_checkpoints(log: DataFrame, start: int, end: int, step: int, grace: int = 2 * DAY, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> DataFrame:
    """``cp, customer_id, field_path, value, confidence``: every customer's decayed state at each step after ``start`` and before ``end``.

    A write holds from the first checkpoint that sees it (``grace`` after it
    counts) up to the one that sees its successor, so it is exploded to those
    alone; the rows are those of the result before the floor.
    """
    n = max(0, -(-(end - start) // step) - 1)
    w = Window.partitionBy(*PATH).orderBy("t", "episode_id")
    sees = lambda t: F.greatest(F.lit(1), F.ceil((t - grace - start) / step)).cast("long")
    held = log.withColumn("lo", sees(F.col("t"))).withColumn("hi", F.least(F.coalesce(F.lead("lo").over(w) - 1, F.lit(n)), F.lit(n)))
    at = held.where("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi"))).withColumn("cp", F.lit(start) + F.col("i") * step)
    return decayed(at, F.col("cp"), half_life, floor).select("cp", *PATH, "value", "confidence")
