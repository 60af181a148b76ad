"""Persisted state: a batch is applied once, whole or not at all; the state at many moments."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans.state_tables import SCHEMAS, WRITE, StateTables

ROWS = f"{WRITE}, expected long, conflict_with string"


def writes(n=60, seed=4):
    rng = random.Random(seed)
    return [(i, f"C{rng.randrange(3)}", rng.choice("pq"), rng.choice(["a", "b", None]), 0.5, "w", i, rng.choice([None, None, i // 6, 1, 2]), rng.choice([None, "other"])) for i in range(n)]


def tables(t):
    return {n: sorted(t.read(n).collect(), key=str) if n != "versions" else sorted(t.versions().collect()) for n in SCHEMAS}


@pytest.fixture
def whole(spark, tmp_path):
    t = StateTables(spark, f"file://{tmp_path}/whole")
    assert t.apply(spark.createDataFrame(writes(), ROWS), 0)
    return t


def test_batches_add_up_to_the_whole(spark, tmp_path, whole):
    rows, parts = writes(), StateTables(spark, f"file://{tmp_path}/parts")
    for k, (a, b) in enumerate(((0, 1), (1, 30), (30, 30), (30, 60))):
        df = spark.createDataFrame(rows[a:b], ROWS)
        assert parts.apply(df, k) and not parts.apply(df, k)
    assert tables(parts) == tables(whole)
    assert tables(whole)["conflicts"] and whole.refused().count()
    parts.compact()
    assert tables(parts) == tables(whole) and len(parts.manifest()["folders"]["writes"]) == 1
    one, refused = state.update_field(spark.createDataFrame([], WRITE), spark.createDataFrame(rows, ROWS), whole.versions().limit(0))
    assert sorted(one.collect(), key=str) == sorted(whole.log().collect(), key=str) and refused.count() == whole.refused().count()


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_batch_is_run_again(spark, tmp_path, whole, when, monkeypatch):
    """Stopped between write and publish, or between publish and the stream's own commit."""
    rows = writes()
    for a, b in ((0, 20), (20, 40), (40, 60)):
        spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    t = StateTables(spark, f"file://{tmp_path}/t")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    def stop(at):
        if at == 1:
            raise RuntimeError("killed")

    publish = t.publish
    if when == "before":
        monkeypatch.setattr(t, "publish", lambda m: stop(m["version"] - 1) or publish(m))
    with pytest.raises(Exception, match="killed"):
        t.sink(stream, f"file://{tmp_path}/log", after=stop if when == "after" else None).awaitTermination()
    monkeypatch.setattr(t, "publish", publish)
    assert t.manifest()["version"] == (1 if when == "before" else 2)
    t.sink(stream, f"file://{tmp_path}/log").awaitTermination()
    assert tables(t) == tables(whole) and t.manifest()["version"] == 3


def test_empty_tables(spark, tmp_path):
    t = StateTables(spark, f"file://{tmp_path}/none")
    assert t.log().count() == t.refused().count() == t.versions().count() == 0
    assert t.apply(spark.createDataFrame([], ROWS), 0) and t.versions().count() == 0


def test_state_at_many_moments(spark):
    rng = random.Random(8)
    log = [(i, rng.choice(["A", "B"]), rng.choice("pqr"), rng.choice(["x", "y", None]), 0.5, "w", rng.randrange(-40, 200)) for i in range(120)]
    moments = [(c, m) for c in ("A", "B", "Z") for m in range(-50, 260, 7)] * 2
    want = set()
    for c, m in moments:
        for p in "pqr":
            last = max(((t, i, v) for i, k, f, v, _, _, t in log if (k, f) == (c, p) and t <= m), key=lambda x: x[:2], default=None)
            if last:
                want.add((c, m, p, last[2], last[1]))
    df, at = spark.createDataFrame(log, WRITE), spark.createDataFrame(moments, "customer_id string, moment long")
    for run in (1, 25, 10**6):
        got = state.as_of_moments(df, at, run).select("customer_id", "moment", "field_path", "value", "episode_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert state.as_of_moments(df, at.limit(0)).count() == 0
    one = state.as_of(df, F.lit(100)).select("customer_id", "field_path", "value", "episode_id")
    many = state.as_of_moments(df, spark.createDataFrame([("A", 100), ("B", 100)], "customer_id string, moment long"))
    assert sorted(one.collect(), key=str) == sorted(many.select(*one.columns).collect(), key=str)


def test_tasks_follow_the_rows_of_states_at_moments(spark, monkeypatch):
    """Rows are sorted once, in tasks that their number asks for; a write, path or moment that is missing gives no row."""
    log = [(i, "A", "pq"[i % 2], str(i), 0.5, "w", 3 * i) for i in range(50)] + [(90, "A", None, "n", 0.5, "w", 5), (91, "A", "p", "n", 0.5, "w", None)]
    moments = [("A", m) for m in range(-5, 150)] + [("A", None), (None, 7)]
    df, at = spark.createDataFrame(log, WRITE), spark.createDataFrame(moments, "customer_id string, moment long")
    monkeypatch.setattr(state, "TASK_ROWS", 10)
    out = state.as_of_moments(df, at, 40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 31" in plan  # 155 moments of two paths
    assert out.rdd.getNumPartitions() == 31
    got = {tuple(r) for r in out.select("moment", "field_path", "episode_id").collect()}
    assert got == {(m, p, max(i for i in range(k, 50, 2) if 3 * i <= m)) for m in range(-5, 150) for k, p in enumerate("pq") if m >= 3 * k}
