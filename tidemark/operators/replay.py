"""Replay with impairments, drawn from a hash of the event and a seed so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 28 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def impair(events: DataFrame, late_rate: float, duplicate_rate: float, late_by: int, seed: int = 42) -> DataFrame:
    """Late events get a later ingestion time, duplicates a second row (``copy`` = 1)."""
    late = chance(F.col("event_id"), f"late{seed}") < late_rate
    twice = chance(F.col("event_id"), f"dup{seed}") < duplicate_rate
    rows = events.withColumn("is_late", late).withColumn("it", F.coalesce("it", "t") + F.when(late, late_by).otherwise(0))
    return rows.withColumn("copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def report(impaired: DataFrame) -> DataFrame:
    return impaired.agg(F.count(F.lit(1)).alias("published"), F.count_if(F.col("copy") == 1).alias("duplicates"), F.count_if(F.col("is_late") & (F.col("copy") == 0)).alias("late"))


def swap_pairs(events: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """``emit_seq``: drawn events are held back behind the next one of their customer.

    In a run of drawn events every second one is held, so pairs never overlap.
    """
    drawn = chance(F.col("event_id"), f"ooo{seed}") < rate
    w = Window.partitionBy("customer_id").orderBy("arrival_seq")
    rows = events.withColumn("drawn", drawn).withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("run", F.col("n") - F.max(F.when(~F.col("drawn"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.coalesce("run", "n"))
    held = F.col("drawn") & (F.col("run") % 2 == 1) & F.lead("n").over(w).isNotNull()
    rows = rows.withColumn("held", held)
    after = F.coalesce(F.lag("held").over(w), F.lit(False))
    return rows.withColumn("emit_n", F.col("n") + F.when(F.col("held"), 1).when(after, -1).otherwise(0)).drop("drawn", "run")
