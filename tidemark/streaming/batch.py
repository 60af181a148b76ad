"""The stream's semantics over a batch of arrivals: dedup, lateness, recompute, watermarks, rings, triggers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.operators.features import SPECS, in_window

LATENESS, OUT_OF_ORDER, IDLE = 900_000_000, 30_000_000, 5_000_000  # microseconds
RING = 50
#: Rows whose rings a task builds at once: a ring is fifty references, and a batch may hold ten thousand rows.
RING_ROWS = 1024
#: Arrival numbers in a run of ``classify``.
RUN = 1 << 18
REFRESH, COOLDOWN = 15 * 60_000_000, 30 * 60_000_000


def first_arrivals(events: DataFrame, *key: str) -> DataFrame:
    """The first row of each key in order of arrival."""
    w = Window.partitionBy(*key).orderBy("arrival_seq")
    return events.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def classify(events: DataFrame, lateness: int = LATENESS, slack: int = OUT_OF_ORDER, marks: DataFrame | None = None) -> DataFrame:
    """``outcome`` of deduplicated arrivals against their source's running maximum.

    Rows that are too late lie below the maximum and cannot raise it, so the
    maximum over all rows is that over accepted ones. A source is split into
    runs of arrivals: the maximum of the runs before comes from one row a source
    and run, so no task sorts a whole source. ``marks(source_system, top)`` are
    maxima from before these arrivals.
    """
    run = F.floor(F.col("arrival_seq") / RUN)
    per_run = events.groupBy("source_system", run.alias("__run")).agg(F.max("t").alias("__m"))
    if marks is not None:
        per_run = per_run.union(marks.select("source_system", F.lit(-1).cast("long"), "top"))
    before = Window.partitionBy("source_system").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_run.select("source_system", "__run", F.max("__m").over(before).alias("__carried"))
    within = Window.partitionBy("source_system", "__run").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("__run", run).join(carried, ["source_system", "__run"]).withColumn("prev_max", F.greatest("__carried", F.max("t").over(within)))
    behind = F.col("prev_max") - F.col("t")
    outcome = F.when(behind > lateness, "too_late_dropped").when(behind > slack, "late_recomputed").otherwise("emitted")
    return rows.withColumn("outcome", outcome).drop("__run", "__carried")


def late_recompute(classified: DataFrame, specs=SPECS, horizon: Column | None = None) -> DataFrame:
    """Features of each late row's customer over what had been accepted by then, as of the batch's latest accepted event or a given ``horizon``.

    The moment is one for all, so a row's part in a feature does not depend on
    the late row that asks: running sums in order of arrival answer all of them.
    """
    taken = classified.where("outcome <> 'too_late_dropped'")
    # one row
    rows = taken.crossJoin(F.broadcast(taken.agg(F.max("t").alias("horizon")))) if horizon is None else taken.withColumn("horizon", horizon)
    upto = Window.partitionBy("customer_id").orderBy("arrival_seq")

    def running(s) -> Column:
        member = in_window(s, F.col("horizon"))
        if s.aggregate == "count":
            return F.count_if(member).over(upto).cast("double")
        return (F.sum if s.aggregate == "sum" else F.max)(F.when(member, F.col(s.field))).over(upto)

    done = rows.withColumns({s.name: running(s) for s in specs}).where("outcome = 'late_recomputed'")
    return done.select("customer_id", F.col("event_id").alias("late_id"), *[s.name for s in specs])


def baseline_writeback(recomputed: DataFrame, specs=SPECS) -> DataFrame:
    """What a customer's recomputed features write to the state: ``customer_id, field_path, value, seq``, a later late row over an earlier."""
    last = recomputed.groupBy("customer_id").agg(F.max(F.struct("seq", *[s.name for s in specs])).alias("w"))
    pair = F.explode(F.array(*[F.struct(F.lit(f"historical_baseline.{s.name}").alias("path"), F.col(f"w.{s.name}").cast("double").alias("value")) for s in specs])).alias("p")
    return last.select("customer_id", "w.seq", pair).where("p.value is not null").select("customer_id", F.col("p.path").alias("field_path"), F.col("p.value").alias("value"), "seq")


def watermarks(accepted: DataFrame, now: Column, idle: int = IDLE) -> DataFrame:
    """A row a source: its greatest event time, when it was last heard and whether it is idle."""
    w = accepted.groupBy("source_system").agg(F.max("t").alias("max_event_time"), F.max("it").alias("last_seen"), F.max(now).alias("__now"))
    return w.withColumn("is_idle", F.col("last_seen") < F.col("__now") - idle).drop("__now")


def global_watermark(marks: DataFrame, slack: int = OUT_OF_ORDER) -> DataFrame:
    """Least live maximum less the slack (null: nothing is live) and the lag between live sources."""
    live = marks.where(~F.col("is_idle"))
    return live.agg((F.min("max_event_time") - slack).alias("watermark"), (F.max("max_event_time") - F.min("max_event_time") + slack).alias("lag"), F.count(F.lit(1)).alias("live_sources"))


RING_REF = ("event_id", "source_system", "event_type", "t")


def _rings(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rings of rows that come by customer and in order of arrival; only the last customer's ring is carried on."""

    def windows(ids: list, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of each ring from row ``first`` on, and its end: of an id that repeats the last place counts."""
        n = len(ids)
        if len(set(ids)) == n:
            begin = np.maximum(np.arange(first, n) - size, 0)
            lengths = np.arange(first, n) - begin
            ends = np.cumsum(lengths)
            return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - begin, lengths), ends
        held: dict = {}
        at, ends = [], []
        for k, x in enumerate(ids):
            if k >= first:
                at += held.values()
                ends.append(len(at))
            held.pop(x, None)
            held[x] = k
            if len(held) > size:
                del held[next(iter(held))]
        return np.array(at, np.int64), np.array(ends, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, whose = None, None
        for batch in (b.slice(k, RING_ROWS) for b in batches for k in range(0, b.num_rows, RING_ROWS)):
            names = batch.schema.names
            refs = pa.StructArray.from_arrays([batch.column(f"__{c}") for c in RING_REF], list(RING_REF))
            customers = batch.column("__key").to_pylist()
            starts = [0, *(i for i in range(1, len(customers)) if customers[i] != customers[i - 1]), len(customers)]
            parts, ends = [], [np.zeros(1, np.int64)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                mine = refs.slice(a, b - a)
                first = 0
                if carry is not None and a == 0 and customers[0] == whose:
                    first, mine = len(carry), pa.concat_arrays([carry, mine])
                ids = mine.field("event_id").to_pylist()
                at, upto = windows(ids, first)
                parts.append(mine.take(pa.array(at)))
                ends.append(upto + ends[-1][-1])
                if b == len(customers):
                    last = list({x: None for x in reversed(ids)})[:size]
                    place = {x: k for k, x in enumerate(ids)}
                    carry, whose = mine.take(pa.array(sorted(place[x] for x in last), pa.int64())), customers[-1]
            if customers:
                ring = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.concat_arrays(parts))
                kept = [c for c in names if not c.startswith("__")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ring], [*kept, "ring"])

    return run


def rings(events: DataFrame, size: int = RING) -> DataFrame:
    """``ring``: references of the last ``size`` events of the customer before this one, in order of arrival.

    An event that arrives again is in the ring once, at its latest place. Rows are
    sorted by customer and arrival and pass as a stream, so a customer with very
    many events costs a task its last ``size`` of them.
    """
    schema = StructType([*events.schema.fields, StructField("ring", ArrayType(StructType([events.schema[c] for c in RING_REF])))])
    rows = events.select("*", F.col("customer_id").alias("__key"), *[F.col(c).alias(f"__{c}") for c in RING_REF])
    return rows.repartition("customer_id").sortWithinPartitions("customer_id", "arrival_seq").mapInArrow(_rings(size), schema)


class Correlation:
    """What a customer's trigger holds: the latest finding of each domain, the domains that were fresh before, and when it last fired."""

    def __init__(self, cooldown: int, refresh: int, severe: float, latest: dict | None = None, last: int | None = None, before: frozenset | None = None) -> None:
        self.cooldown, self.refresh, self.severe = cooldown, refresh, severe
        self.latest: dict[str, tuple[int, float, bool]] = dict(latest or {})
        self.last, self.before = last, before

    def step(self, t: int, domain: str, confidence: float, watchlist: bool) -> str | None:
        """The reason for which a finding fires, if it does. A watchlist hit counts until its domain's next finding."""
        self.latest[domain] = (t, confidence, bool(watchlist))
        fresh = frozenset(d for d, (at, _, _) in self.latest.items() if t - at <= self.refresh)
        reason = None
        if any(listed for _, _, listed in self.latest.values()):
            reason = "watchlist"
        elif max(c for _, c, _ in self.latest.values()) >= self.severe:
            reason = "high_severity"
        elif len(fresh) > 1:
            reason = "domains"
        elif fresh == self.before:
            reason = "repeated"
        self.before = fresh
        if reason is None or (self.last is not None and t - self.last < self.cooldown):
            return None
        self.last = t
        return reason


FINDING = "customer_id string, seq long, t long, domain string, confidence double, watchlist boolean"


def _fire(cooldown: int, refresh: int, severe: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, state = None, None
        for batch in batches:
            reasons = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("customer_id", "t", "domain", "confidence", "watchlist")), strict=True)
            for customer, *finding in rows:
                if state is None or customer != whose:
                    whose, state = customer, Correlation(cooldown, refresh, severe)
                reasons.append(state.step(*finding))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r is not None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], [*batch.schema.names, "fired", "reason"])

    return run


def triggers(findings: DataFrame, cooldown: int = COOLDOWN, refresh: int = REFRESH, severe: float = 0.75) -> DataFrame:
    """``fired`` and ``reason`` of every finding ``(customer_id, seq, t, domain, confidence, watchlist)``; greedy a customer, in order of time.

    Rows pass as a stream by customer and time; a task holds one customer's latest findings.
    """
    rows = findings.select("customer_id", "seq", "t", "domain", "confidence", "watchlist").repartition("customer_id").sortWithinPartitions("customer_id", "t", "seq")
    return rows.mapInArrow(_fire(cooldown, refresh, severe), f"{FINDING}, fired boolean, reason string")
