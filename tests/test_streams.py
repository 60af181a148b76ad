"""Streams with state against their batch forms: split anywhere, stopped in the middle, silent sources."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.sources import events as E
from tidemark.streaming import batch, stateful

MINUTE = 60_000_000
RINGS = "customer_id string, event_id string, source_system string, event_type string, t long, arrival_seq long"


@pytest.fixture(autouse=True)
def state(spark):
    stateful.with_state(spark)


class Live:
    """A folder that grows, and a query over it that ends when it is dry; each run starts a new query from the checkpoint."""

    def __init__(self, spark, path, schema, build, **trigger):
        self.spark, self.at, self.schema, self.build = spark, f"file://{path}", schema, build
        self.trigger = trigger or {"availableNow": True}

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")

    def run(self):
        stream = self.build(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/log").trigger(**self.trigger).start()
        q.awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(f"{self.at}/out")


def findings(seed, n=200):
    rng = random.Random(seed)
    t = 0
    out = []
    for seq in range(n):
        t += rng.randrange(0, 9) * MINUTE
        domain = rng.choice(["transaction", "usage", "support", "kyc"])
        out.append((f"C{rng.randrange(4)}", seq, t, domain, rng.choice([0.3, 0.6, 0.74, 0.8]) if rng.random() < 0.2 else 0.3, domain == "kyc" and rng.random() < 0.2))
    return out


@pytest.mark.parametrize("cuts", [(200,), (1, 60, 61, 200)])
def test_triggers_live_equal_batch(spark, tmp_path, cuts):
    rows = findings(len(cuts))
    live = Live(spark, tmp_path, batch.FINDING, stateful.trigger_stream)
    for low, high in zip((0, *cuts), cuts):
        live.put(rows[low:high])
        got = live.run()  # every run is a restart
    want = batch.triggers(spark.createDataFrame(rows, batch.FINDING))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert {r["reason"] for r in got.collect()} == {None, "watchlist", "high_severity", "domains", "repeated"}


def test_a_clean_finding_ends_a_watchlist(spark):
    hour = 60 * MINUTE
    rows = [("C", 0, 0, "kyc", 0.3, True), ("C", 1, hour, "usage", 0.3, False), ("C", 2, 2 * hour, "kyc", 0.3, False), ("C", 3, 3 * hour, "usage", 0.3, False)]
    got = batch.triggers(spark.createDataFrame(rows, batch.FINDING)).orderBy("seq").collect()
    assert [r["reason"] for r in got] == ["watchlist", "watchlist", None, None]


def brute_rings(rows, size):
    held, out = {}, {}
    for c, e, s, k, t, n in sorted(rows, key=lambda r: r[5]):
        ring = held.setdefault(c, [])
        out[n] = [x for x in ring]
        ring[:] = [x for x in ring if x != e] + [e]
        del ring[:-size]
    return out


def arrivals(n, customers, ids, seed):
    rng = random.Random(seed)
    return [(rng.choice(customers), f"E{rng.randrange(ids)}", "s", "k", i, i) for i in range(n)]


def test_rings_with_repeats(spark, tmp_path):
    rows = arrivals(600, ["A", "B", None], 90, 1) + [("Z", f"E{i}", "s", "k", i, 1000 + i) for i in range(300)]
    want = brute_rings(rows, 50)
    df = spark.createDataFrame(rows, RINGS)
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)  # customers span batches
        got = {r["arrival_seq"]: [x["event_id"] for x in r["ring"]] for r in batch.rings(df).collect()}
        assert got == want
    assert batch.rings(df).columns == [*df.columns, "ring"]
    live = Live(spark, tmp_path, RINGS, stateful.ring_stream)
    for low, high in ((0, 200), (200, 599), (599, 900)):
        live.put(rows[low:high])
        got = live.run()
    assert {r["arrival_seq"]: [x["event_id"] for x in r["ring"]] for r in got.collect()} == want


def test_rings_are_built_a_part_of_a_batch_at_a_time():
    n = 5000
    cols = {"customer_id": ["A"] * n, "__key": ["A"] * n, "__event_id": [f"E{i}" for i in range(n)], "__source_system": ["s"] * n, "__event_type": ["k"] * n, "__t": list(range(n))}
    out = list(batch._rings(50)(iter(pa.table(cols).to_batches())))
    assert max(b.num_rows for b in out) <= batch.RING_ROWS and sum(b.num_rows for b in out) == n
    rings = [[x["event_id"] for x in r] for b in out for r in b.column("ring").to_pylist()]
    assert rings == [[f"E{i}" for i in range(max(0, k - 50), k)] for k in range(n)]


def test_rings_of_nothing(spark):
    assert batch.rings(spark.createDataFrame([], RINGS)).count() == 0


def test_prior_counts_read_the_ring(spark):
    rows = [("A", f"E{i}", "card_payments", "decline", i * MINUTE, i) for i in range(4)]
    p = rules.prior_counts(batch.rings(spark.createDataFrame(rows, RINGS)).withColumn("amount", F.lit(1.0)))
    assert p.count() == 4


def test_a_silent_source_lets_the_minimum_go(spark, tmp_path):
    idle = 1500
    live = Live(spark, tmp_path, "source_system string, t long", lambda s: stateful.global_watermark_stream(stateful.watermark_stream(s, idle), 10), once=True)

    def latest():
        return live.run().orderBy(F.desc("at")).first()

    live.put([("a", 1000), ("b", 2000), ("c", 500), ("c", 400)])
    r = latest()
    assert (r["watermark"], r["lag"], r["live_sources"]) == (490, 1510, 3)
    time.sleep(idle / 1000 + 0.2)
    live.put([("a", 900), ("b", 2500)])  # a's older event does not lower its mark; c says nothing
    r = latest()
    assert (r["watermark"], r["lag"], r["live_sources"]) == (990, 1510, 2)
    live.put([("c", 700)])
    r = latest()
    assert r["watermark"] == 690 or r["live_sources"] == 1  # c is back; a and b may be silent by now


@pytest.mark.parametrize("cuts", [(300,), (1, 2, 150, 300)])
def test_late_rows_live(spark, tmp_path, cuts, monkeypatch):
    """Outcomes of any split are the batch's; features are those of the batch so far; a stopped batch is run again."""
    from tidemark.streaming import live

    rng = random.Random(len(cuts))
    kinds = [("card_payments", "purchase"), ("web_app_events", "login"), ("core_banking_ledger", "withdrawal")]
    rows = [(f"E{i}", f"C{rng.randrange(3)}", *rng.choice(kinds), float(i), i * 200 * MINUTE - rng.choice([0, 0, 0, 2, 900]) * MINUTE, i) for i in range(300)]
    at = f"file://{tmp_path}"
    tables = live.LateTables(spark, f"{at}/t", lateness=60 * MINUTE, slack=MINUTE)
    rows = [(*r[:5], r[5], r[6]) for r in rows]
    # every fourth event comes right after the one before it, a little behind
    rows = [(*r[:5], rows[k - 1][5] - 5 * MINUTE if k % 4 == 3 else r[5], r[6]) for k, r in enumerate(rows)]
    rows = [(r[0], r[1], "card_payments" if k % 2 else r[2], "purchase" if k % 2 else r[3], *r[4:]) for k, r in enumerate(rows)]
    for low, high in zip((0, *cuts), cuts):
        spark.createDataFrame(rows[low:high], live.EVENT).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(live.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    if len(cuts) > 1:
        whole, calls = live.late_recompute, []

        def stop(*a, **k):
            calls.append(1)
            if len(calls) == 3:
                raise RuntimeError("killed")
            return whole(*a, **k)

        monkeypatch.setattr(live, "late_recompute", stop)
        with pytest.raises(Exception, match="killed"):
            tables.start(stream).awaitTermination()
    tables.start(stream).awaitTermination()
    every = batch.classify(spark.createDataFrame(rows, live.EVENT), 60 * MINUTE, MINUTE).cache()
    want = every.select("event_id", "outcome").collect()
    assert sorted(tables.outcomes().select("event_id", "outcome").collect()) == sorted(want) and {r["outcome"] for r in want} == {"emitted", "late_recomputed", "too_late_dropped"}
    expect = []
    for low, high in zip((0, *cuts), cuts):
        so_far = batch.late_recompute(every.where(F.col("arrival_seq") < high))
        new = every.where(f"arrival_seq >= {low}").select(F.col("event_id").alias("late_id"))
        expect += so_far.join(new, "late_id", "left_semi").collect()
    got = tables.features().drop("seq").select(*batch.late_recompute(every).columns).collect()
    order = lambda rs: sorted((tuple(r.asDict()[c] for c in sorted(r.asDict())) for r in rs), key=str)
    assert len(got) > 10 and order(got) == order(expect)
    assert tables.writeback().count() > 0


def test_the_memory_sink_leaves_rows_to_the_tasks(spark, tmp_path):
    spark.range(1000).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # a name may be drained into again
        got = E.memory_sink(stream.where("id % 2 = 0"), "drained")
        assert sorted(r["id"] for r in got.collect()) == list(range(0, 1000, 2)) and spark.table("drained").count() == 500
        assert "MemoryPlan" not in got._jdf.queryExecution().toString() and got.inputFiles()
    assert E.memory_sink(stream.where("id < 0"), "drained").count() == 0
