"""Evaluation of a file of emitted checkpoints: ``python -m tidemark.plans.report --inferred FILE [--ground-truth FILE] [--out FILE]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, rules

#: A checkpoint as it is emitted and as the truth expects it; both files are JSON, plain lists or under ``checkpoints``.
SCHEMA = "array<struct<as_of_time:string,inferred_state:string,confidence_band:string,action:string,hitl_status:string,evidence_refs:array<string>,expected_inferred_state:string,expected_confidence_band:string,expected_action:string,expected_hitl_status:string>>"


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """``pos, t, state, band, action, hitl, refs`` of a file of emitted or expected checkpoints."""
    either = lambda name, c: F.coalesce(f"c.{name}", f"c.expected_{name}").alias(c)
    raw = spark.read.text(path, wholetext=True)
    inside = F.coalesce(F.get_json_object("value", "$.checkpoints"), F.col("value"))
    rows = raw.select(F.posexplode(F.from_json(inside, SCHEMA)).alias("pos", "c"))
    named = [either(n, c) for n, c in (("inferred_state", "state"), ("confidence_band", "band"), ("action", "action"), ("hitl_status", "hitl"))]
    return rows.select(F.col("pos").cast("long").alias("pos"), F.unix_micros(F.to_timestamp("c.as_of_time")).alias("t"), *named, F.coalesce("c.evidence_refs", F.array().cast("array<string>")).alias("refs"))


def run_report(spark: SparkSession, inferred: str, truth: str | None) -> DataFrame:
    got = read_checkpoints(spark, inferred)
    none = spark.createDataFrame([], "event_id string")
    if truth is None:
        return evaluation.report(got.withColumnRenamed("t", "as_of"), none, none, rules.ACTIONS, evaluation.STATES)
    whole = spark.read.text(truth, wholetext=True)
    events = lambda k: whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>")).alias("event_id"))
    want = read_checkpoints(spark, truth)
    one = lambda df: df.withColumn("scenario_id", F.lit("run"))
    met = evaluation.match_checkpoints(one(got), one(want)).where("expected_pos is not null")
    side = lambda df, name: df.select(F.col("pos").alias(f"{name}_pos"), *[F.col(c).alias(f"{name}_{c}") for c in ("state", "band", "action", "hitl")])
    pairs = met.join(side(got, "inferred"), "inferred_pos").join(side(want, "expected"), "expected_pos")
    red = events("red_herring_events")
    return evaluation.report(got.withColumnRenamed("t", "as_of"), events("signal_events").union(red), red, rules.ACTIONS, evaluation.STATES, pairs)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--inferred", required=True)
    parser.add_argument("--ground-truth")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = run_report(spark, args.inferred, args.ground_truth).collect()  # a row a metric
    text = json.dumps({s: {r["metric"]: r["value"] for r in rows if r["stage"] == s} for s in dict.fromkeys(r["stage"] for r in rows)}, indent=2)
    print(text)
    if args.out:
        with open(args.out, "w") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
