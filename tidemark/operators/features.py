"""Event-time window features and sampled baselines, each one conditional-aggregate pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY
from tidemark.sources.events import TRANSACTIONS


@dataclass(frozen=True)
class WindowSpec:
    """A rolling feature over the ``days`` up to and including a moment."""

    name: str
    days: float
    sources: tuple[str, ...]
    types: tuple[str, ...] | None = None
    aggregate: str = "count"
    field: str | None = None


SPECS = (
    WindowSpec("txn_count_30d", 30, TRANSACTIONS),
    WindowSpec("txn_amount_sum_30d", 30, TRANSACTIONS, aggregate="sum", field="amount"),
    WindowSpec("decline_count_24h", 1, ("card_payments",), ("decline",)),
    WindowSpec("large_withdrawal_count_7d", 7, ("core_banking_ledger",), ("withdrawal",)),
    WindowSpec("login_count_7d", 7, ("web_app_events",), ("login",)),
    WindowSpec("search_count_7d", 7, ("web_app_events",), ("search_query",)),
    WindowSpec("support_ticket_count_30d", 30, ("support_logs",), ("ticket_created",)),
)


def of_kind(spec: WindowSpec) -> Column:
    kind = F.col("source_system").isin(*spec.sources)
    return kind & F.col("event_type").isin(*spec.types) if spec.types else kind


def in_window(spec: WindowSpec, as_of: Column) -> Column:
    """Both ends count."""
    return of_kind(spec) & F.col("t").between(as_of - int(spec.days * DAY), as_of)


def feature(spec: WindowSpec, as_of: Column) -> Column:
    """Counts of nothing are 0, sums and maxima of nothing are null."""
    member = in_window(spec, as_of)
    if spec.aggregate == "count":
        out = F.count_if(member).cast("double")
    else:
        out = (F.sum if spec.aggregate == "sum" else F.max)(F.when(member, F.col(spec.field)))
    return out.alias(spec.name)


def window_features(events: DataFrame, as_of: Column, specs: tuple[WindowSpec, ...] = SPECS) -> DataFrame:
    """A row a customer: every feature as of one moment, in one pass.

    What no window can reach is filtered at the scan but customers stay: only
    the aggregates look at it.
    """
    return events.groupBy("customer_id").agg(*[feature(s, as_of) for s in specs])


def baselines(events: DataFrame, end: Column, specs: tuple[WindowSpec, ...] = SPECS, step_days: int = 7) -> DataFrame:
    """``customer_id, feature, mean, std`` sampled at equal steps between the first event of all and ``end``.

    An event falls into a bounded run of samples (its window over the step), so
    it is exploded to those alone; empty samples of counts and sums enter as
    zeros through their number, those of maxima not at all.
    """
    span = events.agg(F.min("t").alias("start"), F.max(end).alias("end"))
    span = span.withColumn("n", F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / (step_days * DAY))).cast("long"))
    span = span.withColumn("step", (F.col("end") - F.col("start")) / F.col("n"))
    joined = events.crossJoin(F.broadcast(span))  # one row
    meets = []
    for s in specs:
        lo = F.greatest(F.lit(1), F.ceil((F.col("t") - F.col("start")) / F.col("step"))).cast("long")
        hi = F.least(F.col("n"), F.floor((F.col("t") - F.col("start") + int(s.days * DAY)) / F.col("step"))).cast("long")
        value = F.lit(1.0) if s.field is None else F.col(s.field).cast("double")
        meets.append(F.when(of_kind(s) & (lo <= hi), F.struct(F.lit(s.name).alias("feature"), lo.alias("lo"), hi.alias("hi"), value.alias("value"))))
    largest = F.col("feature").isin([s.name for s in specs if s.aggregate == "max"])
    hit = joined.select("customer_id", "n", F.explode(F.array_compact(F.array(*meets))).alias("h")).select("customer_id", "n", "h.feature", "h.value", F.explode(F.sequence("h.lo", "h.hi")).alias("i"))
    each = hit.groupBy("customer_id", "feature", "n", "i").agg(F.sum("value").alias("all"), F.max("value").alias("top"))
    each = each.select("customer_id", "feature", F.when(largest, F.col("top")).otherwise(F.col("all")).alias("v"))
    sums = each.groupBy("customer_id", "feature").agg(F.count("v").cast("double").alias("met"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    every = joined.select("customer_id", F.col("n").cast("double").alias("n")).distinct().withColumn("feature", F.explode(F.array(*[F.lit(s.name) for s in specs])))
    sums = every.join(sums, ["customer_id", "feature"], "left").where(~largest | F.col("met").isNotNull())
    zero = lambda c: F.when(largest, F.col(c)).otherwise(F.coalesce(c, F.lit(0.0)))
    sums = sums.select("customer_id", "feature", F.when(largest, F.col("met")).otherwise(F.col("n")).alias("m"), zero("s1").alias("s1"), zero("s2").alias("s2"))
    var = F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / F.col("m")) / (F.col("m") - 1), F.lit(0.0))
    return sums.select("customer_id", "feature", F.round(F.col("s1") / F.col("m"), 4).alias("mean"), F.round(F.when(F.col("m") > 1, F.sqrt(var)).otherwise(0.0), 4).alias("std"))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)
