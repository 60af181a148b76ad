"""Metrics of emitted checkpoints against ground truth."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands and states that a checkpoint may name.
BANDS = ("low", "medium", "high")
STATES = (
    "no_signal", "new_child_life_event", "marriage_or_relationship_change", "job_change_or_promotion", "job_loss_or_income_disruption", "medical_hardship", "financial_distress_general",
    "relocation", "retirement_transition", "wealth_growth_or_windfall", "potential_fraud_or_takeover", "elder_vulnerability_or_scam_risk", "churn_risk", "small_business_cashflow_event",
)


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Zero-safe precision, recall and F1, to four places."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1")]


def accuracy(rows: DataFrame, inferred: str, expected: str) -> DataFrame:
    return rows.agg(_share(F.count_if(F.col(inferred) == F.col(expected)), F.count(expected)).alias("accuracy"))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: bins are closed below, the last on both sides; what is outside [0, 1] only counts in the total."""
    c = F.col(confidence)
    b = F.when((c >= 0) & (c <= 1), F.least(F.floor(c * bins), F.lit(bins - 1)))
    per = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    total = F.sum("n")
    return per.agg(F.coalesce(F.round(F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("acc")) * F.col("n"))) / total, 4), F.lit(1.0)).alias("ece"))


def grounding(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Share of evidence references ``ref`` that exist; 0 without any."""
    hit = refs.join(known.select(F.col("event_id").alias("ref"), F.lit(1).alias("hit")).distinct(), "ref", "left")
    return hit.agg(_share(F.count("hit"), F.count(F.lit(1))).alias("grounding"))


def herrings(checks: DataFrame, actions: DataFrame) -> DataFrame:
    """Share of red herrings ``event_id`` that no action cites; 1 without any."""
    clean = checks.join(actions.select(F.col("ref").alias("event_id"), F.lit(1).alias("hit")).distinct(), "event_id", "left")
    return clean.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("hit").isNull()), F.count(F.lit(1))), F.lit(1.0)), 4).alias("herring_clean"))


def false_positives(checks: DataFrame, events: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that a check forbids within its hours after its event (an interval join on the customer)."""
    at = checks.join(events.select("event_id", "customer_id", "t"), "event_id")
    a = actions.select("customer_id", F.col("t").alias("action_t"), "action")
    met = at.join(a, "customer_id").where((F.col("action_t") >= F.col("t")) & (F.col("action_t") <= F.col("t") + F.col("window_hours") * 3_600_000_000) & F.array_contains("must_not_trigger_action", F.col("action")))
    return met.select("event_id", "customer_id", "action", "action_t")


def no_action_counts(pairs: DataFrame) -> DataFrame:
    """Both say no action: hit; only the inferred says so: miss (fn); only the expected: false alarm (fp)."""
    i, e = F.col("inferred_action") == "no_action", F.col("expected_action") == "no_action"
    n = pairs.agg(F.count_if(i & e).alias("tp"), F.count_if(~i & e).alias("fp"), F.count_if(i & ~e).alias("fn"))
    return n.select("tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def _nearest(expected: list[tuple]) -> Callable:
    """Takes the position of the nearest unused one of ``expected(t, pos)`` to a time, ties to the smaller position; None when all are used.

    Times stand in order, each with its positions; links lead past used ones, so
    each taking costs about the logarithm of their number.
    """
    times, places = [], []
    for t, pos in sorted(expected, reverse=True):
        if not times or times[-1] != t:
            times.append(t)
            places.append([])
        places[-1].append(pos)  # the smallest last
    times, places = times[::-1], places[::-1]
    after, before = list(range(len(times) + 1)), list(range(len(times) + 1))  # the next unused time from here on; one more than the last unused one below

    def live(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def take(t):
        i = bisect_left(times, t)
        near = [(abs(t - times[k]), places[k][-1], k) for k in (live(before, i) - 1, live(after, i)) if 0 <= k < len(times)]
        if not near:
            return None
        _, pos, k = min(near)
        places[k].pop()
        if not places[k]:
            after[k], before[k + 1] = k + 1, k
        return pos

    return take


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of rows that come by scenario, expected ones first; nothing is held but the expected ones of the scenario at hand."""
    whose, expected, take, begun = None, [], None, False
    for batch in batches:
        out = []
        for scenario, inferred, pos, t in zip(*(batch.column(c).to_pylist() for c in ("scenario_id", "inferred", "pos", "t")), strict=True):
            if not begun or scenario != whose:
                whose, expected, take, begun = scenario, [], None, True
            if inferred:
                take = take or _nearest(expected)
                out.append((scenario, pos, None if t is None else take(t)))
            elif t is not None:
                expected.append((t, pos))
        cols = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["scenario_id", "inferred_pos", "expected_pos"])


def match_checkpoints(inferred: DataFrame, expected: DataFrame) -> DataFrame:
    """Each inferred checkpoint in order takes the nearest unused expected one of its scenario, ties to the first.

    Rows are sorted by scenario and pass as a stream, so a scenario costs its
    rows and no call of its own. A checkpoint without a time matches none.
    """
    side = lambda df, mine: df.select("scenario_id", F.lit(mine).alias("inferred"), F.col("pos").cast("long").alias("pos"), "t")
    both = side(inferred, True).union(side(expected, False))
    rows = both.repartition("scenario_id").sortWithinPartitions("scenario_id", "inferred", "pos", "t")
    return rows.mapInArrow(_matched, "scenario_id string, inferred_pos long, expected_pos long")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Weighted agreement of a matched pair; no expected approval status agrees with any."""
    eq = lambda n: F.coalesce(F.col(f"inferred_{n}") == F.col(f"expected_{n}"), F.lit(False)).cast("double")
    hitl = F.coalesce(F.col("inferred_hitl") == F.col("expected_hitl"), F.col("expected_hitl").isNull()).cast("double")
    out = pairs.withColumns({"state_ok": eq("state"), "band_ok": eq("band"), "action_ok": eq("action"), "hitl_ok": hitl})
    return out.withColumn("score", F.round(0.40 * F.col("state_ok") + 0.25 * F.col("band_ok") + 0.25 * F.col("action_ok") + 0.10 * F.col("hitl_ok"), 4))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("matched"), *[F.round(F.avg(c), 4).alias(n) for c, n in (("state_ok", "state_accuracy"), ("band_ok", "band_accuracy"), ("action_ok", "action_accuracy"), ("hitl_ok", "hitl_accuracy"), ("score", "mean_score"))])


def checkpoint_errors(actions: tuple[str, ...], states: tuple[str, ...]) -> Column:
    """Which of a checkpoint's enumerations are off."""
    return F.array_compact(F.array(
        F.when(F.col("as_of").isNull(), F.lit("as_of")), F.when(~F.coalesce(F.col("state").isin(*states), F.lit(False)), F.lit("state")),
        F.when(~F.coalesce(F.col("band").isin(*BANDS), F.lit(False)), F.lit("band")), F.when(~F.coalesce(F.col("action").isin(*actions), F.lit(False)), F.lit("action")),
    ))


def report(checkpoints: DataFrame, known: DataFrame, red: DataFrame, actions: tuple[str, ...], states: tuple[str, ...], pairs: DataFrame | None = None) -> DataFrame:
    """``stage, metric, value``: consistency of emitted checkpoints always, inference and action against matched pairs if there are any.

    ``checkpoints(as_of, state, band, action, refs)``; ``known(event_id)`` and
    ``red(event_id)`` hold existing and misleading events.
    """
    bad = checkpoints.agg(F.count_if(F.size(checkpoint_errors(actions, states)) > 0).cast("double").alias("value"))
    refs = checkpoints.select(F.explode("refs").alias("ref")).distinct()
    row = lambda df, stage, metric, col: df.select(F.lit(stage).alias("stage"), F.lit(metric).alias("metric"), F.col(col).cast("double").alias("value"))
    out = row(bad, "consistency", "schema_errors", "value").union(row(grounding(refs, known), "consistency", "evidence_grounding", "grounding"))
    out = out.union(row(herrings(red, refs), "consistency", "red_herring_filtering", "herring_clean"))
    if pairs is None:
        return out
    s = summary(pair_scores(pairs))
    for stage, metric in (("inference", "matched"), ("inference", "state_accuracy"), ("inference", "band_accuracy"), ("action", "action_accuracy"), ("action", "hitl_accuracy"), ("action", "mean_score")):
        out = out.union(row(s, stage, metric, metric))
    return out
