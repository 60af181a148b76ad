"""Hand-computed cases of the operators."""

import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation, features, identity, replay, retrieval, rules, state
from tidemark.plans import storage
from tidemark.sources import events as E
from tidemark.streaming import batch

T0 = 1_777_626_000_000_000
DAY = S.DAY
HOUR = DAY // 24
EVENT = "event_id string, customer_id string, source_system string, event_type string, t long, it long, amount double, arrival_seq long"


def ev(spark, *rows):
    """Rows of (source, type, offset from T0, amount)."""
    return spark.createDataFrame([(f"e{i}", "C", s, k, T0 + dt, T0 + dt, a, i) for i, (s, k, dt, a) in enumerate(rows)], EVENT)


def test_window_boundaries(spark):
    e = ev(spark, ("card_payments", "decline", 0, None), ("card_payments", "decline", -DAY, None), ("card_payments", "decline", -DAY - 1_000_000, None), ("card_payments", "purchase", 0, 1.0))
    assert features.window_features(e, F.lit(T0)).first()["decline_count_24h"] == 2.0


def test_features_ignore_arrival_order(spark):
    data = [("core_banking_ledger", "deposit", -i * HOUR, 10.0) for i in range(30)] + [("web_app_events", "login", -i * HOUR, None) for i in range(30)]
    shuffled = data[:]
    random.Random(7).shuffle(shuffled)
    assert features.window_features(ev(spark, *data), F.lit(T0)).collect() == features.window_features(ev(spark, *shuffled), F.lit(T0)).collect()


def test_empty_sum_is_null_and_empty_count_zero(spark):
    r = features.window_features(ev(spark, ("web_app_events", "login", 0, None)), F.lit(T0)).first()
    assert r["txn_amount_sum_30d"] is None and r["txn_count_30d"] == 0.0 and r["login_count_7d"] == 1.0


def test_late_event_is_recomputed(spark):
    e = ev(spark, ("core_banking_ledger", "deposit", 0, 100.0), ("core_banking_ledger", "deposit", 5 * DAY, 200.0), ("core_banking_ledger", "deposit", 5 * DAY - 30 * 60_000_000, 300.0))
    c = batch.classify(e, lateness=3_600_000_000)
    assert [r["outcome"] for r in c.orderBy("arrival_seq").collect()] == ["emitted", "emitted", "late_recomputed"]
    r = batch.late_recompute(c).first()
    assert (r["txn_count_30d"], r["txn_amount_sum_30d"]) == (3.0, 600.0)


def test_too_late_is_dropped(spark):
    c = batch.classify(ev(spark, ("core_banking_ledger", "deposit", 10 * DAY, 1.0), ("core_banking_ledger", "deposit", -DAY, 1.0)), lateness=3_600_000_000)
    assert [r["outcome"] for r in c.orderBy("arrival_seq").collect()] == ["emitted", "too_late_dropped"]


def test_idle_sources_leave_no_watermark(spark):
    m = batch.watermarks(ev(spark, ("core_banking_ledger", "deposit", 0, 1.0)), F.lit(T0 + 10_000_000))
    assert m.first()["is_idle"] and batch.global_watermark(m).first()["watermark"] is None


def test_ring_excludes_the_current_event(spark):
    r = batch.rings(ev(spark, *[("web_app_events", "login", i, None) for i in range(60)])).orderBy("arrival_seq").collect()
    assert r[0]["ring"] == [] and len(r[59]["ring"]) == 50 and r[59]["ring"][-1]["event_id"] == "e58"


def test_trigger_cooldown(spark):
    rows = [("C", i, T0 + i * 180_000_000, "usage", 0.6, False) for i in range(10)] + [("C", 10, T0 + 34 * 60_000_000, "usage", 0.6, False), ("D", 0, T0, "usage", 0.5, False)]
    f = batch.triggers(spark.createDataFrame(rows, "customer_id string, seq long, t long, domain string, confidence double, watchlist boolean"))
    fired = {(r["customer_id"], r["seq"]) for r in f.where("fired").collect()}
    assert len([s for c, s in fired if c == "C" and s < 10]) == 1 and ("C", 10) in fired and ("D", 0) not in fired


def test_decline_burst_and_large_amount(spark):
    e = ev(spark, *[("card_payments", "decline", -m * 60_000_000, None) for m in (90, 60, 30)], ("card_payments", "decline", 0, None), ("ach_wire", "outbound_transfer", 2 * DAY, 12000.0))
    extra = {"category": F.lit(None).cast("string"), "raw_text": F.lit(None).cast("string"), "subtype": F.lit(None).cast("string"), **{f"{a}_{b}": F.lit(None).cast("double") for a in ("withdrawal", "login") for b in ("mean", "std")}}
    r = rules.flags(rules.prior_counts(batch.rings(e)).withColumns(extra)).orderBy("arrival_seq").collect()
    assert [f["type"] for f in r[3]["flags"]] == ["decline_burst"] and [f["type"] for f in r[4]["flags"]] == ["large_amount"] and r[2]["flags"] == []


@pytest.mark.parametrize(("flags", "state_"), [(["watchlist_hit"], "potential_fraud_or_takeover"), (["address_change_recent", "large_amount"], "potential_fraud_or_takeover"), (["decline_burst"], "financial_distress_general"), (["engagement_drop", "repeated_contact"], "churn_risk"), (["household_change"], "new_child_life_event"), ([], "no_signal")])
def test_inference(spark, flags, state_):
    assert spark.range(1).select(rules.infer(F.array(*map(F.lit, flags)).cast("array<string>"))["state"].alias("s")).first()["s"] == state_


@pytest.mark.parametrize(("args", "action", "confidence"), [
    (("new_child_life_event", 0.9, "high", ["watchlist_hit"], None, None), "compliance_fraud_hold", 0.9), (("potential_fraud_or_takeover", 0.7, "mid", [], None, None), "compliance_fraud_hold", 0.8), (("potential_fraud_or_takeover", 0.2, "mid", [], None, None), "no_action", 0.2),
    (("elder_vulnerability_or_scam_risk", 0.6, "mid", [], None, None), "compliance_fraud_hold", 0.8), (("churn_risk", 0.8, "high", [], None, None), "relationship_manager_escalation", 0.8), (("churn_risk", 0.6, "mid", [], None, None), "proactive_retention_outreach", 0.6),
    (("churn_risk", 0.1, "mid", [], None, None), "no_action", 0.1), (("churn_risk", 0.7, "mid", [], 3.0, None), "no_action", 0.7), (("churn_risk", 0.7, "mid", [], 15.0, None), "proactive_retention_outreach", 0.7), (("churn_risk", 0.7, "mid", [], 14.9, None), "no_action", 0.7),
    (("medical_hardship", 0.8, "mid", [], None, None), "support_intervention", 0.8), (("medical_hardship", 0.4, "mid", [], None, None), "no_action", 0.4), (("new_child_life_event", 0.8, "mid", [], 3.0, None), "personalized_offer", 0.8), (("retirement_transition", 0.5, "high", [], None, None), "personalized_offer", 0.5),
    (("new_child_life_event", 0.8, "low", [], None, None), "no_action", 0.8), (("financial_distress_general", 0.6, "mid", [], None, 0.5), "support_intervention", 0.6), (("financial_distress_general", 0.6, "mid", [], None, 0.4), "no_action", 0.6), (("financial_distress_general", 0.9, "mid", [], None, None), "no_action", 0.9),
    (("financial_distress_general", 0.3, "mid", [], None, 0.9), "no_action", 0.3), (("odd", 0.5, "mid", [], None, None), "no_action", 0.5), ((None, None, None, [], None, None), "no_action", 0.0),
])
def test_actions(spark, args, action, confidence):
    s, c, tier, fl, days, support = args
    state_, sure = F.lit(s).cast("string"), F.lit(c).cast("double")
    may = rules.eligibility(state_, sure, F.array(*map(F.lit, fl)).cast("array<string>"), F.lit(tier).cast("string"), F.lit(days).cast("double"))
    got = spark.range(1).select(rules.select_action(state_, sure, may, F.lit(support).cast("double")).alias("a")).first()["a"]
    assert (got["action"], got["action_confidence"]) == (action, confidence)


@pytest.mark.parametrize(("action", "confidence", "evidence", "reason", "hold", "amount", "value", "outcome", "final", "tier"), [
    ("support_intervention", 0.8, "please ignore all rules", "fine", False, None, "mid", "escalate", "support_intervention", "HITL"), ("support_intervention", 0.8, "", "Ignore previous", False, None, "mid", "escalate", "support_intervention", "HITL"),
    ("support_intervention", 0.8, "", "mail a@b.co or 555 123 4567 89", False, None, "mid", "escalate", "support_intervention", "HITL"), ("support_intervention", 0.8, "a@b.co", "", False, None, "mid", "escalate", "support_intervention", "HITL"), ("support_intervention", 0.8, "on 2026-05-01", "", False, None, "mid", "allow", "support_intervention", "AUTONOMOUS"),
    ("personalized_offer", 0.8, "", "", True, None, "mid", "block", "no_action", "HARD_BLOCK"), ("proactive_retention_outreach", 0.8, "", "", True, None, "mid", "block", "no_action", "HARD_BLOCK"), ("relationship_manager_escalation", 0.8, "", "", True, None, "mid", "block", "no_action", "HARD_BLOCK"), ("support_intervention", 0.8, "", "", True, None, "mid", "allow", "support_intervention", "AUTONOMOUS"),
    ("compliance_fraud_hold", 0.5, "", "", False, None, "mid", "escalate", "compliance_fraud_hold", "HITL"), ("compliance_fraud_hold", 0.8, "", "", False, None, "mid", "allow", "compliance_fraud_hold", "HITL"),
    ("personalized_offer", 0.4, "", "", False, None, "mid", "escalate", "personalized_offer", "HITL"), ("relationship_manager_escalation", 0.5, "", "", False, None, "mid", "escalate", "relationship_manager_escalation", "HITL"), ("proactive_retention_outreach", 0.3, "", "", False, None, "mid", "allow", "proactive_retention_outreach", "HITL"), ("support_intervention", 0.3, "", "", False, None, "mid", "allow", "support_intervention", "HITL"),
    ("personalized_offer", 0.8, "", "", False, 6000.0, "high", "escalate", "personalized_offer", "HITL"), ("personalized_offer", 0.8, "", "", False, 6000.0, "mid", "allow", "personalized_offer", "AUTONOMOUS"), ("personalized_offer", 0.8, "", "", False, 4000.0, "high", "allow", "personalized_offer", "HITL"),
    ("no_action", 0.1, "", "", False, None, "mid", "allow", "no_action", "AUTONOMOUS"), (None, None, "", "", False, None, "mid", "escalate", "no_action", "HITL"), ("launch", 0.9, "", "", False, None, "mid", "escalate", "no_action", "HITL"), ("no_action", None, "", "", False, None, "mid", "escalate", "no_action", "HITL"),
])
def test_guardrails(spark, action, confidence, evidence, reason, hold, amount, value, outcome, final, tier):
    may = F.struct(F.lit(hold).alias("compliance_hold"), F.lit(value).alias("customer_value_tier"))
    g = rules.guard(F.lit(action).cast("string"), F.lit(confidence).cast("double"), may, F.lit(evidence), F.lit(reason), F.lit(amount).cast("double"))
    r = spark.range(1).select(g.alias("g")).first()["g"]
    assert (r["outcome"], r["final_action"], r["tier"]) == (outcome, final, tier)


def test_bands_and_decay(spark):
    got = spark.createDataFrame([(x,) for x in (0.9, 0.7, 0.5, 0.45, 0.2)], "c double").select(S.band(F.col("c")).alias("b")).collect()
    assert [r["b"] for r in got] == ["high", "high", "medium", "medium", "low"]
    d = spark.range(1).select(S.decay(F.lit(0.8), F.lit(30.0), 30).alias("a"), S.decay(F.lit(0.8), F.lit(28.0), 14).alias("b"), S.decay(F.lit(0.8), F.lit(-5.0), 14).alias("c")).first()
    assert math.isclose(d["a"], 0.4) and math.isclose(d["b"], 0.2) and d["c"] == 0.8


def test_contacts(spark):
    r = spark.range(1).select(S.canonical_email(F.lit("  Marcus@x.COM ")).alias("e"), S.canonical_phone(F.lit("+1 (555) 123-4567")).alias("p"), S.redact(F.lit("on 2026-05-01 mail a@b.co")).alias("r")).first()
    assert (r["e"], r["p"], r["r"]) == ("marcus@x.com", "5551234567", "on 2026-05-01 mail [EMAIL_REDACTED]")


def test_linkage(spark):
    schema = "record_id long, source_customer_id string, source_system string, full_name string, email string, phone string, dob string, kyc_doc_number string"
    rows = [(1, "a", "s", "Ann Lee", "Ann@x.com", "+1 (555) 123-4567", None, None), (2, "b", "s", "A. Lee", " ann@x.com ", None, None, None), (3, "c", "s", "Bo Day", None, "5551234567", None, None), (4, "d", "s", "John Smith", "j@x.com", "1112223333", None, None), (5, "e", "s", "John Smith", "k@x.com", "9998887777", None, None)]
    r = identity.canonical(spark.createDataFrame(rows, schema))
    m = identity.scored(r, identity.candidates(r))
    assert {(x["a"], x["b"]): x["method"] for x in m.where("matched").collect()} == {(1, 2): "exact_email", (1, 3): "exact_phone"}
    assert {x["record_id"]: x["canonical_id"] for x in identity.resolve(r, m).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_supersede_and_reconstruct(spark):
    log = spark.createDataFrame([(1, "C", "p", "stable", 0.6, "a", T0), (2, "C", "p", "distress", 0.9, "b", T0 + 10 * DAY)], "episode_id long, customer_id string, field_path string, value string, confidence double, agent string, t long")
    c = state.chain(log).orderBy("episode_id").collect()
    assert c[0]["superseded_by"] == 2 and c[0]["valid_to"] == T0 + 10 * DAY and c[1]["valid_to"] is None
    at = lambda d: state.as_of(log, F.lit(T0 + d * DAY)).first()["value"]
    assert (at(5), at(20)) == ("stable", "distress")
    assert state.decayed(log.where("episode_id = 1"), F.lit(T0 + 200 * DAY)).count() == 0


def test_scope_is_mandatory(spark):
    for bad in (None, "", "  "):
        with pytest.raises(ValueError, match="scope"):
            retrieval.scope(bad)
    rows = spark.createDataFrame([(1, "A", "refund please", T0), (2, "B", "refund please", T0), (3, None, "refund policy", T0), (4, "A", "refund please", T0 - 90 * DAY)], "chunk_id long, customer_id string, text string, t long")
    got = retrieval.search(rows, "refund please", retrieval.scope("A"), F.lit(T0)).collect()
    assert [r["chunk_id"] for r in got] == [1, 3, 4] or {r["chunk_id"] for r in got} == {1, 3, 4}
    assert got[0]["chunk_id"] == 1 and 2 not in {r["chunk_id"] for r in got}


def test_chunking(spark):
    text = " ".join(["word"] * 400)
    parts = [r["chunk_text"] for r in retrieval.chunks(spark.createDataFrame([(1, text), (2, " short "), (3, None)], "id long, text string"), "id", "text", "s").orderBy("id", "chunk_no").collect()]
    assert parts[-1] == "short" and " ".join(parts[:-1]) == text and all(len(p) <= 600 for p in parts)


def test_metrics(spark):
    r = spark.range(1).select(*evaluation.precision_recall(F.lit(8), F.lit(2), F.lit(2))).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.8, 0.8, 0.8)
    r = spark.range(1).select(*evaluation.precision_recall(F.lit(0), F.lit(5), F.lit(5))).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    for conf, ok, ece in (([0.9, 0.9, 0.1], [1, 1, 0], 0.1), ([1.0, 1.0, 0.0], [1, 1, 0], 0.0), ([0.9, 0.9], [0, 0], 0.9)):
        assert evaluation.calibration(spark.createDataFrame(list(zip(conf, ok, strict=True)), "c double, ok int"), "c", "ok").first()["ece"] == ece


def test_matching_takes_the_nearest_unused(spark):
    f = lambda *ts: spark.createDataFrame([("s", i, t) for i, t in enumerate(ts)], "scenario_id string, pos long, t long")
    got = {r["inferred_pos"]: r["expected_pos"] for r in evaluation.match_checkpoints(f(10, 11, 100), f(12, 9)).collect()}
    assert got == {0: 1, 1: 0, 2: None} or got == {0: 0, 1: 1, 2: None}


def test_matching_of_many_and_of_large_scenarios(spark):
    """Against a scan of all unused ones, without a call of Python a scenario and without a scan of a large one a row."""
    rng = random.Random(3)
    side = lambda: [(f"s{k}" if k else None, i, rng.randrange(6) if k % 2 else rng.randrange(900)) for k in range(40) for i in range(rng.randrange(8))]
    a, b = side(), side()
    a += [("large", i, rng.randrange(10**6)) for i in range(20_000)]
    b += [("large", i, rng.randrange(10**6)) for i in range(20_000)]
    want = {}
    for s in {r[0] for r in a} - {"large"}:
        free = {p: t for x, p, t in b if x == s}
        for _, p, t in sorted(r for r in a if r[0] == s):
            want[s, p] = min(free, key=lambda k: (abs(free[k] - t), k), default=None)
            free.pop(want[s, p], None)
    schema = "scenario_id string, pos long, t long"
    matched = evaluation.match_checkpoints(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert "FlatMapGroupsInPandas" not in matched._jdf.queryExecution().toString()
    got = {(r[0], r[1]): r[2] for r in matched.collect()}
    assert {k: v for k, v in got.items() if k[0] != "large"} == want
    assert sorted(v for k, v in got.items() if k[0] == "large") == list(range(20_000))


def test_replay_is_deterministic(spark):
    e = ev(spark, *[("core_banking_ledger", "deposit", i * HOUR, 1.0) for i in range(20)])
    assert replay.report(replay.impair(e, 0, 0, HOUR)).first().asDict() == {"published": 20, "duplicates": 0, "late": 0}
    twice = [replay.report(replay.impair(e, 0.3, 0.3, HOUR)).first() for _ in range(2)]
    assert twice[0] == twice[1]
    swapped = replay.swap_pairs(e, 0.5)
    assert sorted(r["emit_n"] for r in swapped.collect()) == list(range(1, 21))
    full = replay.swap_pairs(e, 1.0).where("held").count()
    assert full == 10


def test_parse_rejects(spark):
    good = '{"event_id":"1","event_time":"2026-05-01T00:00:00Z","customer_id":"C","source_system":"card_payments","event_type":"purchase","payload":{"amount":1}}'
    cases = {good: None, good.replace("purchase", "login"): "event_type", good.replace("card_payments", "nope"): "source_system", good.replace('"amount":1', '"x":1'): "amount", good.replace(":1}", ":-1}"): "amount", good[:-1] + ',"odd":1}': "extra_field", "not json": "event_id"}
    got = E.parse_events(spark.createDataFrame([(k,) for k in cases], "value string")).select("value", "reject_reason").collect()
    assert {r["value"]: r["reject_reason"] for r in got} == cases


def test_jsonl_and_checkpoints(spark, tmp_path):
    p = tmp_path / "s1"
    p.mkdir()
    line = '{"event_id":"%d","event_time":"2026-05-01T00:00:00Z","customer_id":"C","source_system":"web_app_events","event_type":"login","payload":{}}'
    for n in ("live_stream", "history_seed"):
        (p / f"{n}.jsonl").write_text("\n\n".join(line % i for i in range(3)) + "\n")
    (p / "entities.json").write_text('{"customers": []}')
    assert E.available_scenarios(spark, f"file://{tmp_path}") == ["s1"]
    s = E.load_scenario(spark, f"file://{tmp_path}", "s1")
    assert s["live"].count() == 3 and s["history"].first()["scenario_id"] == "s1"
    E.write_checkpoints(s["live"].select("event_id"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3


@pytest.mark.parametrize("kind", ["fraud_like", "ambiguous", "conflicting_signals", "no_action_stable"])
def test_generated_ids_are_distinct(spark, kind):
    assert E.generate_scenario(spark, kind, 40).select("event_id").distinct().count() == 40


def test_late_runs_count_what_was_accepted_by_then(spark):
    e = ev(spark, ("card_payments", "purchase", 0, 10.0), ("card_payments", "purchase", DAY, 20.0), ("card_payments", "purchase", DAY - 60_000_000, 5.0), ("card_payments", "purchase", DAY + 1, 7.0))
    got = batch.late_recompute(batch.classify(e)).collect()
    assert [(r["late_id"], r["txn_count_30d"], r["txn_amount_sum_30d"]) for r in got] == [("e2", 3.0, 35.0)]


def test_stale_versions_are_refused(spark):
    schema = "episode_id long, customer_id string, field_path string, value string, confidence double, agent string, t long"
    log = spark.createDataFrame([(1, "C", "p", "a", 0.6, "a", T0), (2, "C", "p", "b", 0.9, "b", T0)], schema)
    writes = spark.createDataFrame([(k, c, "p", "v", 0.5, "a", T0, x) for k, c, x in ((3, "C", 2), (4, "C", 2), (5, "C", 1), (6, "C", None), (7, "D", 0))], f"{schema}, expected long")
    taken, refused = state.update_field(log, writes, spark.createDataFrame([("C", 2)], "customer_id string, state_version long"))
    assert {r["episode_id"] for r in taken.collect()} == {1, 2, 3, 6, 7} and {(r["episode_id"], r["actual"]) for r in refused.collect()} == {(4, 3), (5, 3)}


def test_writes_are_checked_in_order(spark):
    """A write without expectation raises the version, so the next that expects the old one is refused."""
    schema = "episode_id long, customer_id string, field_path string, value string, confidence double, agent string, t long"
    log = spark.createDataFrame([], schema)
    rows = [(1, None), (2, 0), (3, 1), (4, 0), (5, 2), (6, None), (7, 4)]
    writes = spark.createDataFrame([(i, c, "p", f"v{i // 3}", 0.5, "a", T0, x) for i, x in rows for c in ("C", "D", None)], f"{schema}, expected long")
    versions = spark.createDataFrame([("D", 0), ("E", 9)], "customer_id string, state_version long")
    for n in (1, 5):
        taken, refused = state.update_field(log, writes.repartition(n), versions)
        assert sorted((r["episode_id"], str(r["customer_id"])) for r in taken.collect()) == [(i, c) for i in (1, 3, 5, 6, 7) for c in ("C", "D", "None")]
        assert {(r["episode_id"], r["actual"]) for r in refused.collect()} == {(2, 1), (4, 2)}


def test_a_named_conflict_keeps_both_values(spark):
    schema = "episode_id long, customer_id string, field_path string, value string, confidence double, agent string, t long"
    log = spark.createDataFrame([(1, "C", "p", "stable", 0.6, "a", T0), (2, "C", "q", None, 0.6, "a", T0)], schema)
    more = [(3, "p", "distress", "a"), (4, "p", "distress", "b"), (5, "p", "x", None), (6, "q", "y", "a"), (7, "r", "z", "a")]
    writes = spark.createDataFrame([(i, "C", p, v, 0.5, "w", T0, c) for i, p, v, c in more], f"{schema}, conflict_with string")
    got = state.write_conflicts(log, writes).collect()
    assert [(r["conflict_id"], r["agents"], r["values"]) for r in got] == [(3, ["a", "w"], ["stable", "distress"])]


def test_halves_of_a_summary(spark):
    flags = F.array(*[F.struct(F.lit("x").alias("type"), F.lit(c).alias("confidence")) for c in (0.625, 0.715, 0.705, 0.375, 1.0, 1234.5)])
    want = "; ".join(f"x (conf {c:.2f})" for c in (0.625, 0.715, 0.705, 0.375, 1.0, 1234.5))
    assert spark.range(1).select(S.flag_summary(F.lit("u"), flags).alias("s")).first()["s"] == f"u: 6 flag(s): {want}"


def test_paths_and_summaries(spark):
    m = F.create_map(*[F.lit(x) for x in ("a", "1", "b.c", "2", "b.d", "3")])
    r = spark.range(1).select(S.path_get(m, "b.c").alias("x"), S.path_get(m, "b").alias("b"), S.path_get(m, "z").alias("z"), S.path_set(m, "a.k", F.lit("9")).alias("s"), S.path_set(m, "b", F.lit("0")).alias("t")).first()
    assert (r["x"], r["b"], r["z"], r["s"], r["t"]) == ("2", '{"c":"2","d":"3"}', None, {"b.c": "2", "b.d": "3", "a.k": "9"}, {"a": "1", "b": "0"})
    flags = F.array(F.struct(F.lit("x").alias("type"), F.lit(0.7).alias("confidence")))
    r = spark.range(1).select(S.flag_summary(F.lit("usage"), flags).alias("s"), S.flag_summary(F.lit("usage"), F.slice(flags, 1, 0)).alias("n"), S.redact_all(F.struct(F.array(F.lit("a@b.co")).alias("x"))).alias("r")).first()
    assert (r["s"], r["n"], r["r"]) == ("usage: 1 flag(s): x (conf 0.70)", "usage: no notable signals.", '{"x":["[EMAIL_REDACTED]"]}')


def test_report_of_files(spark, tmp_path):
    import json

    from tidemark.plans import report

    at = lambda d: f"2026-05-0{d}T00:00:00+00:00"
    cp = lambda d, s, a, refs: {"as_of_time": at(d), "inferred_state": s, "confidence_band": "low", "action": a, "hitl_status": "auto_approved", "evidence_refs": refs}
    want = lambda d: {"as_of_time": at(d), "expected_inferred_state": "no_signal", "expected_confidence_band": "low", "expected_action": "no_action"}
    (tmp_path / "got.json").write_text(json.dumps([cp(1, "no_signal", "no_action", ["E1", "E9"]), cp(5, "churn_risk", "launch", [])], indent=1))
    (tmp_path / "truth.json").write_text(json.dumps({"checkpoints": [want(1), want(5)], "signal_events": ["E1"], "red_herring_events": ["E2"]}))
    got = {r["metric"]: r["value"] for r in report.run_report(spark, f"file://{tmp_path}/got.json", f"file://{tmp_path}/truth.json").collect()}
    assert got == {"schema_errors": 1.0, "evidence_grounding": 0.5, "red_herring_filtering": 1.0, "matched": 2.0, "state_accuracy": 0.5, "band_accuracy": 1.0, "action_accuracy": 0.5, "hitl_accuracy": 1.0, "mean_score": 0.675}
    alone = report.run_report(spark, f"file://{tmp_path}/got.json", None).collect()
    assert {r["stage"] for r in alone} == {"consistency"}
    assert report.main(["--inferred", f"file://{tmp_path}/got.json", "--out", str(tmp_path / "out.json")]) == 0 and json.loads((tmp_path / "out.json").read_text())["consistency"]["schema_errors"] == 1.0


RECORD = "record_id long, source_customer_id string, source_system string, full_name string, email string, phone string, dob string, kyc_doc_number string"


def test_a_common_name_does_not_make_all_pairs(spark):
    r = identity.canonical(spark.createDataFrame([(i, str(i), "s", "Ann Lee", None, None, None, None) for i in range(300)], RECORD))
    c = identity.candidates(r)
    assert 299 <= c.count() <= 2 * 300
    assert identity.resolve(r, identity.scored(r, c)).select("canonical_id").distinct().count() == 1


def _people(n, seed, names, values, filled):
    rng = random.Random(seed)
    some = lambda kind, k: f"{kind}{rng.randrange(k)}" if rng.random() < filled else None
    return [(i, str(i), "s", rng.choice(names), f"{e}@x.com" if (e := some("u", values)) else None, f"555000{1000 + rng.randrange(values)}" if rng.random() < filled else None, some("D", 3), some("K", values)) for i in range(n)]


@pytest.mark.parametrize(("n", "values", "filled"), [(150, 12, 0.4), (150, 60, 0.8), (120, 4, 0.6), (100, 1000, 1.0)])
def test_large_blocks_lose_nothing(spark, n, values, filled):
    """Components and best candidates are those of all pairs, whatever is missing or shared."""
    r = identity.canonical(spark.createDataFrame(_people(n, n + values, ["Ann Lee", "Bo Day", "ann lee"], values, filled), RECORD)).cache()
    every, few = (identity.scored(r, identity.candidates(r, bound)) for bound in (10**6, 4))
    assert few.exceptAll(every).count() == 0  # pairs of its own, and the same scores
    assert sorted(identity.resolve(r, few).collect()) == sorted(identity.resolve(r, every).collect())
    assert sorted(identity.best_candidates(few).collect()) == sorted(identity.best_candidates(every).collect())


def test_a_block_of_a_thousand_with_one_pair(spark):
    """Different e-mails keep apart all but the two records that share a birth date."""
    rows = [(i, str(i), "s", "Ann Lee", f"u{i}@x.com", None, "D1" if i in (3, 998) else None, None) for i in range(1000)]
    r = identity.canonical(spark.createDataFrame(rows, RECORD))
    c = identity.candidates(r)
    assert c.count() <= 26 * 1000
    m = identity.scored(r, c).where("matched").collect()
    assert [(x["a"], x["b"], x["score"]) for x in m] == [(3, 998, 5.5481)]


def test_the_order_of_keys_decides_what_a_name_links():
    assert identity.links_by_name(0, 7, False) and identity.links_by_name(3, 3, True) and not identity.links_by_name(1, 1, False) and not identity.links_by_name(5, 5, True)


def test_components_by_increments(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(100)]
    labels, up = spark.createDataFrame([], "node long, component long"), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k in range(10):
        batch_edges = edges[k * 10 : (k + 1) * 10]
        for a, b in batch_edges:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        rows = identity.update_components(labels, spark.createDataFrame(batch_edges, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in rows} == {n: root(n) for n in up} and len(rows) == len(up)
        labels = spark.createDataFrame(rows, "node long, component long")
    again = identity.update_components(labels, spark.createDataFrame([], "a long, b long"))
    assert sorted(again.collect()) == sorted(labels.collect())


def _written(monkeypatch):
    """The names of the tables that ``stored`` writes from now on."""
    names, real = [], storage.stored
    for module in (storage, identity):
        monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or real(df, name))
    return names


def test_a_small_batch_of_edges_takes_two_tables(spark, monkeypatch):
    names = _written(monkeypatch)
    labels = spark.createDataFrame([(n, n - n % 3) for n in range(90)], "node long, component long")
    edges = spark.createDataFrame([(n, n + 3) for n in range(0, 57, 3)] + [(61, 200), (200, 89), (7, 7)], "a long, b long")
    got = identity.update_components(labels, edges)
    want = {n: 0 if n < 60 else n - n % 3 for n in range(90)} | {87: 60, 88: 60, 89: 60, 200: 60}
    assert sorted(got.collect()) == sorted(want.items()) and names == ["edges", "labels"]


def test_components_of_short_numbers(spark):
    got = storage.connected_components(spark.createDataFrame([(3, 2), (2, 9)], "a int, b int"))
    assert sorted(got.collect()) == [(2, 2), (3, 2), (9, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_whose_edges_lie_in_many_tasks(spark, monkeypatch, seed):
    names, rng = _written(monkeypatch), random.Random(seed)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order, order[1:100])) + [(order[100], x) for x in order[100:200]] + [(x, rng.choice(order[200:])) for x in order[200:]]
    up = {n: n for n in order}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges[k : k + 50]]) for k in range(0, 300, 50)]
    monkeypatch.setattr(storage, "AT_ONCE", 120)
    stars = [(x["a"], x["b"]) for batch_ in storage._contract(batches) for x in batch_.to_pylist()]
    assert {x for s in stars for x in s} == touched and all(a < b and root(a) == root(b) for a, b in stars)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = storage.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8))
        assert sorted(got.collect()) == sorted((n, root(n)) for n in touched)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "moves" in names


def test_equal_names_are_as_similar_as_can_be(spark):
    names = ["", "a", "aabab", "person aa family1", "öö ö"]
    assert all(S._jaro_winkler(n, n) == 1.0 for n in names)
    rows = spark.createDataFrame([(n, n) for n in names] + [("ab", "ba"), (None, None)], "a string, b string").select(S.jaro_winkler("a", "b").alias("s")).collect()
    assert [r["s"] for r in rows] == [1.0] * 5 + [S._jaro_winkler("ab", "ba"), None]


def test_a_bad_line_is_named(spark, tmp_path):
    good = '{"event_id":"E%d","event_time":"2026-05-01T00:00:00+00:00","ingestion_time":"2026-05-01T00:00:00+00:00","customer_id":"C","source_system":"web_app_events","event_type":"login","payload":{}}'
    lines = [good % i for i in range(4000)]
    lines[17], lines[2500], lines[3999] = "  ", "{not json", good.replace('"customer_id":"C"', '"customer_id":""') % 1
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_text("\n\n[1]\n" + good % 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # a file in several blocks
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = E.read_lines(spark, f"file://{tmp_path}/*.jsonl", "envelope")
        got = {(r["place"].rsplit("/", 1)[-1], r["reason"]) for r in E.rejects(read).collect()}
        assert got == {("x.jsonl:2501", "json"), ("x.jsonl:4000", "customer_id"), ("y.jsonl:3", "json")}
        assert read.where("reject_reason is null").count() == 3998
        assert sorted(r["line"] for r in E.numbered_lines(spark, f"file://{tmp_path}/x.jsonl").collect()) == list(range(1, 4001))
        with pytest.raises(ValueError, match=r"y\.jsonl:3: invalid event: json"):
            E.read_jsonl(spark, f"file://{tmp_path}/y.jsonl")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scenarios_of_both_bases(spark, tmp_path):
    line = '{"event_id":"E1","event_time":"2026-05-01T00:00:00+00:00","ingestion_time":"2026-05-01T00:00:00+00:00","customer_id":"C","source_system":"web_app_events","event_type":"login","payload":{}}\n'
    for base, name in (("dataset", "s2"), ("dataset", "s1"), ("scenarios", "g1"), ("scenarios", "s1")):
        at = tmp_path / base / name
        at.mkdir(parents=True)
        (at / "entities.json").write_text(json.dumps({"profile": {"name": base}} | ({"scenario_id": "own"} if name == "g1" else {})))
        (at / "history_seed.jsonl").write_text(line)
        (at / "live_stream.jsonl").write_text(line * 2)
        (at / "replay_config.json").write_text('{"pace": 2}')
    (tmp_path / "dataset/s1/ground_truth.json").write_text('{"signal_events": ["E1"]}')
    (tmp_path / "dataset/s1/instructions.md").write_text("read me\ntwice")
    root = f"file://{tmp_path}"
    assert E.available_scenarios(spark, root) == ["s1", "s2", "g1", "s1"]
    s, g = E.load_scenario(spark, root, "s1"), E.load_scenario(spark, root, "g1")
    assert s["entities"].first()["profile"]["name"] == "dataset" and s["instructions"] == "read me\ntwice" and s["ground_truth"].first()["signal_events"] == ["E1"]
    assert g["ground_truth"] is None and g["instructions"] is None and g["replay_config"].first()["pace"] == 2 and {r["scenario_id"] for r in g["live"].collect()} == {"own"}
    with pytest.raises(LookupError):
        E.load_scenario(spark, root, "nowhere")


def test_many_searches_equal_single_ones(spark):
    """Queries with and without matches, shared and own rows, ties and empty texts."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, rng.choice([None, "A", "B"]), text(rng.randrange(0, 30)) if i % 9 else None, rng.randrange(0, 30) * DAY) for i in range(400)]
    rows += [(1000 + i, None, "the same words here", 29 * DAY) for i in range(8)]
    df = spark.createDataFrame(rows, "chunk_id long, customer_id string, text string, t long")
    asks = [(1, "A", text(4)), (2, None, text(6)), (3, "B", "the same words here"), (4, "B", "nothing of this occurs"), (5, "A", ""), (6, "Z", rows[20][2] or "w1"), (7, "A", rows[31][2])]
    queries = spark.createDataFrame(asks, "query_id long, customer_id string, text string")
    lists = retrieval.Lists(df, F.lit(30 * DAY))
    for k in (3, 50):
        got = retrieval.search_many(lists, queries, k).collect()
        for q, who, said in asks:
            one = retrieval.search(df, said, retrieval.scope(who) if who else retrieval.scope(everyone=True), F.lit(30 * DAY), k=k).collect()
            many = sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])
            assert [(r["final_score"], r["vec_score"], r["lex_score"]) for r in many] == [(r["final_score"], r["vec_score"], r["lex_score"]) for r in sorted(one, key=lambda r: (-r["final_score"], r["chunk_id"]))]
            assert [r["id"] for r in many] == sorted((r["id"] for r in many), key=lambda i: next((-x["final_score"], i) for x in many if x["id"] == i))
    asked = retrieval._asked(queries, "query_id")
    told = queries.toDF("q", "scope", "text").drop("text")
    reach = {r["q"]: r["count"] for r in retrieval.within_reach(lists, told, asked, 3).groupBy("q").count().collect()}
    seen = {q: sum(r[1] in (None, who) for r in rows) for q, who, _ in asks}
    assert reach[3] < seen[3] / 2 and reach[5] == seen[5]  # few can reach a near match; without any word, all are scored
    assert retrieval.search_many(lists, queries.limit(0)).count() == 0
    lists.free()


def test_many_searches_score_few_rows(spark, monkeypatch):
    """Common words and full vectors, where bounds of lists rule nothing out; several shards and blocks."""
    monkeypatch.setattr(retrieval, "SHARD", 100)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, rng.choice([None, "A", "B"]), text(80), 0) for i in range(700)] + [(800, None, None, 0), (801, "A", "", 0)]
    df = spark.createDataFrame(rows, "chunk_id long, customer_id string, text string, t long")
    asks = [(i, rng.choice([None, "A", "B", "Z"]), text(80)) for i in range(10)] + [(10, "A", "")]
    queries = spark.createDataFrame(asks, "query_id long, customer_id string, text string")
    lists = retrieval.Lists(df, F.lit(0))
    told = queries.toDF("q", "scope", "text").drop("text")
    asked = retrieval._asked(queries, "query_id")
    near = {r["q"]: r["count"] for r in retrieval.nearest(lists, told, asked, 5).groupBy("q").count().collect()}
    assert all(5 <= near[q] <= 10 for q in range(10)) and near[10] == sum(r[1] in (None, "A") for r in rows)
    got = retrieval.search_many(lists, queries, 5).collect()
    for q, who, said in asks[::3]:
        one = retrieval.search(df, said, retrieval.scope(who) if who else retrieval.scope(everyone=True), F.lit(0), k=5).collect()
        assert [(r["id"], r["final_score"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [(r["chunk_id"], r["final_score"]) for r in one]
    lists.free()
