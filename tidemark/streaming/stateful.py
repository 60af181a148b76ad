"""Live forms with state of their own: triggers, rings, source watermarks and their global minimum.

State is kept by key in the RocksDB store, so it spills to disk and comes back
from the checkpoint. A key's rows of a micro-batch are put in order first; across
micro-batches they are taken as they come, which is the live order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.batch import COOLDOWN, FINDING, IDLE, OUT_OF_ORDER, REFRESH, RING, RING_REF, Correlation

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """State variables need the RocksDB store; call before a stream of this module starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Triggers(StatefulProcessor):
    """Findings of one customer: the latest of each domain in a map, when it last fired and what was fresh in a value."""

    def __init__(self, cooldown: int, refresh: int, severe: float, ttl_ms: int | None) -> None:
        self.rule = (cooldown, refresh, severe)
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "domain string", "t long, confidence double, watchlist boolean", self.ttl)
        self.fired = handle.getValueState("fired", "last long, before string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = {d[0]: tuple(v) for d, v in self.latest.iterator()}
        last, before = self.fired.get() if self.fired.exists() else (None, None)
        now = Correlation(*self.rule, held, last, None if before is None else frozenset(before.split(",")))
        for r in sorted(rows, key=lambda r: (r["t"], r["seq"])):
            reason = now.step(r["t"], r["domain"], r["confidence"], r["watchlist"])
            yield Row(customer_id=key[0], seq=r["seq"], t=r["t"], domain=r["domain"], confidence=r["confidence"], watchlist=r["watchlist"], fired=reason is not None, reason=reason)
        for d, v in now.latest.items():
            if held.get(d) != v:
                self.latest.updateValue((d,), v)
        self.fired.update((now.last, ",".join(sorted(now.before))))

    def close(self) -> None:
        pass


def trigger_stream(findings: DataFrame, cooldown: int = COOLDOWN, refresh: int = REFRESH, severe: float = 0.75, ttl_ms: int | None = None) -> DataFrame:
    """``batch.triggers`` over a stream of findings; ``ttl_ms`` lets a silent customer's state go."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return findings.groupBy("customer_id").transformWithState(Triggers(cooldown, refresh, severe, ttl_ms), f"{FINDING}, fired boolean, reason string", "Append", mode)


class Rings(StatefulProcessor):
    """The last references of one customer, as a list; an event that comes again moves to its end."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("ring", "event_id string, source_system string, event_type string, t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ring = {r[0]: tuple(r) for r in self.held.get()}
        for r in sorted(rows, key=lambda r: r["arrival_seq"]):
            yield Row(customer_id=key[0], event_id=r["event_id"], arrival_seq=r["arrival_seq"], ring=list(ring.values()))
            ring.pop(r["event_id"], None)
            ring[r["event_id"]] = tuple(r[c] for c in RING_REF)
            if len(ring) > self.size:
                del ring[next(iter(ring))]
        self.held.put(list(ring.values()))

    def close(self) -> None:
        pass


def ring_stream(events: DataFrame, size: int = RING) -> DataFrame:
    """``customer_id, event_id, arrival_seq, ring`` of a stream of events, as ``batch.rings``."""
    ref = "struct<event_id: string, source_system: string, event_type: string, t: bigint>"
    rows = events.select("customer_id", "event_id", "arrival_seq", "source_system", "event_type", "t")
    return rows.groupBy("customer_id").transformWithState(Rings(size), f"customer_id string, event_id string, arrival_seq long, ring array<{ref}>", "Append", "None")


class SourceMarks(StatefulProcessor):
    """A source's greatest event time and when it was last heard; a timer marks it idle."""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "max_event_time long, last_seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        top = max(r["t"] for r in rows)
        if self.mark.exists():
            top = max(top, self.mark.get()[0])
        self.mark.update((top, now))
        self.handle.registerTimer(now + self.idle)
        yield Row(source_system=key[0], max_event_time=top, last_seen=now * 1000, is_idle=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        top, seen = self.mark.get()
        # a timer of an older batch says nothing once the source was heard again
        if timerValues.getCurrentProcessingTimeInMs() >= seen + self.idle:
            yield Row(source_system=key[0], max_event_time=top, last_seen=seen * 1000, is_idle=True)

    def close(self) -> None:
        pass


def watermark_stream(accepted: DataFrame, idle_ms: int = IDLE // 1000) -> DataFrame:
    """A row ``source_system, max_event_time, last_seen, is_idle`` whenever a source is heard, and one when it falls silent.

    A task first leaves one maximum a source and Arrow batch, so the rows of a
    source do not meet in one task.
    """
    tops = accepted.select("source_system", "t").mapInArrow(_maxima, "source_system string, t long")
    return tops.groupBy("source_system").transformWithState(SourceMarks(idle_ms), "source_system string, max_event_time long, last_seen long, is_idle boolean", "Append", "ProcessingTime")


def _maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        top = pa.Table.from_batches([batch]).group_by("source_system").aggregate([("t", "max")]).rename_columns({"t_max": "t"})
        yield from top.select(["source_system", "t"]).to_batches()


class GlobalMark(StatefulProcessor):
    """The sources' latest marks in a map; after each change the least live one."""

    def __init__(self, slack: int) -> None:
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "source_system string", "max_event_time long, last_seen long, is_idle boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: r["last_seen"]):
            self.marks.updateValue((r["source_system"],), (r["max_event_time"], r["last_seen"], r["is_idle"]))
        live = [v[0] for _, v in self.marks.iterator() if not v[2]]
        low, high = (min(live), max(live)) if live else (None, None)
        yield Row(at=timerValues.getCurrentProcessingTimeInMs(), watermark=low - self.slack if live else None, lag=high - low + self.slack if live else None, live_sources=len(live))

    def close(self) -> None:
        pass


def global_watermark_stream(marks: DataFrame, slack: int = OUT_OF_ORDER) -> DataFrame:
    """``at, watermark, lag, live_sources`` after each micro-batch of a stream of ``watermark_stream``'s rows: a few a source, so one key holds them."""
    keyed = marks.withColumn("all", F.lit(0))
    return keyed.groupBy("all").transformWithState(GlobalMark(slack), "at long, watermark long, lag long, live_sources long", "Append", "ProcessingTime")
