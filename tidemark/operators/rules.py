"""Signal flags, inferred state, action, guardrails and approval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY, has_injection, negative_words, pii_kinds
from tidemark.operators.features import zscore
from tidemark.sources.events import TRANSACTIONS

# Actions, states, the kinds of KYC facts and the limits of the guardrails.
ACTIONS = ("no_action", "proactive_retention_outreach", "relationship_manager_escalation", "personalized_offer", "support_intervention", "compliance_fraud_hold")
OFFER_STATES = ("new_child_life_event", "wealth_growth_or_windfall", "retirement_transition", "marriage_or_relationship_change")
FRAUD_STATES = ("potential_fraud_or_takeover", "elder_vulnerability_or_scam_risk")
STATES = (*FRAUD_STATES, "financial_distress_general", "churn_risk", "medical_hardship", *OFFER_STATES, "no_signal")
HOUSEHOLD = ("marital_status_change", "dependents_change")
WATCHLIST = ("watchlist_hit", "pep_hit", "sanctions_hit")
RECENT_DAYS, LEAST_FACING, LEAST_FRAUD, MOST_OFFER = 14, 0.55, 0.7, 5000.0


def prior_counts(events: DataFrame) -> DataFrame:
    """What the rules count before the current event, from the ring of the customer's last 50 events.

    Windows look both ways, as late arrivals may precede what the ring holds.
    """
    def count(source: str | None, kind: str, days: int) -> Column:
        hit = lambda r: (r["event_type"] == kind) & (F.abs(r["t"] - F.col("t")) <= days * DAY) & ((r["source_system"] == source) if source else F.lit(True))
        return F.size(F.filter("ring", hit))

    return events.withColumns({
        "declines_24h": count("card_payments", "decline", 1), "withdrawals_7d": count("core_banking_ledger", "withdrawal", 7), "logins_7d": count("web_app_events", "login", 7),
        "searches_7d": count("web_app_events", "search_query", 7), "tickets_30d": count("support_logs", "ticket_created", 30),
    })


def flags(rows: DataFrame) -> DataFrame:
    """``flags array<struct<type, confidence>>`` of every event.

    Needs the prior counts, ``amount``, ``category``, ``raw_text``, ``subtype``
    and the baselines ``withdrawal_mean/std`` and ``login_mean/std``; a null
    baseline is none.
    """
    source, kind = F.col("source_system"), F.col("event_type")
    txn = source.isin(*TRANSACTIONS)
    wz = zscore(F.col("withdrawals_7d") + 1, F.col("withdrawal_mean"), F.col("withdrawal_std"))
    lz = zscore(F.col("logins_7d") + 1, F.col("login_mean"), F.col("login_std"))
    words = negative_words(F.col("raw_text"))
    ticket = (source == "support_logs") & (kind == "ticket_created")
    kyc = source == "loan_kyc"
    subtype = F.coalesce("subtype", kind)
    cap = lambda top, x: F.least(F.lit(top), x)
    rules = [
        ("decline_burst", txn & (F.col("declines_24h") >= 3), cap(0.95, 0.6 + 0.1 * (F.col("declines_24h") - 3))),
        ("accelerated_withdrawals", (kind == "withdrawal") & (wz >= 2.0), cap(0.9, 0.5 + 0.1 * wz)),
        ("large_amount", txn & (F.col("amount") >= 5000), F.lit(0.7)),
        ("engagement_drop", (kind == "login") & (lz <= -2.0), cap(0.85, 0.5 + 0.1 * F.abs(lz))),
        ("search_spike", (kind == "search_query") & (F.col("searches_7d") + 1 >= 3), F.lit(0.6)),
        ("negative_sentiment", (source == "support_logs") & ((F.size(words) > 0) | (ticket & F.col("category").isin("complaint", "dispute", "fee_issue"))), cap(0.9, 0.55 + 0.08 * F.size(words))),
        ("repeated_contact", ticket & (F.col("tickets_30d") + 1 >= 2), F.lit(0.65)),
        ("household_change", kyc & kind.isin(*HOUSEHOLD), F.lit(1.0)),
        ("address_change_recent", kyc & ((kind == "address_change") | (subtype == "address_change")), F.lit(1.0)),
        ("kyc_update", kyc & (kind == "kyc_update"), F.lit(1.0)),
        ("loan_activity", kyc & kind.isin("loan_application", "loan_disbursed"), F.lit(1.0)),
        ("watchlist_hit", kyc & subtype.isin(*WATCHLIST), F.lit(1.0)),
    ]
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("type"), F.round(x.cast("double"), 4).alias("confidence"))) for n, c, x in rules]
    return rows.withColumn("flags", F.array_compact(F.array(*found)))


def finding_confidence(flag_array: Column) -> Column:
    """The greatest flag confidence, 0.3 without flags."""
    return F.coalesce(F.array_max(F.transform(flag_array, lambda f: f["confidence"])), F.lit(0.3))


def domain_of(source: Column) -> Column:
    return F.when(source.isin(*TRANSACTIONS), "transaction").when(source == "web_app_events", "usage").when(source == "support_logs", "support").when(source == "loan_kyc", "kyc")


def infer(types: Column) -> Column:
    """``struct<state, confidence>`` from the set of a customer's flags: the first rule that holds."""
    has = lambda t: F.array_contains(types, t)
    rules = [
        (has("watchlist_hit"), "potential_fraud_or_takeover", 0.85),
        (has("address_change_recent") & (has("large_amount") | has("decline_burst")), "potential_fraud_or_takeover", 0.7),
        (has("decline_burst") | has("accelerated_withdrawals"), "financial_distress_general", 0.6),
        ((has("negative_sentiment") | has("repeated_contact")) & has("engagement_drop"), "churn_risk", 0.6),
        (has("household_change"), "new_child_life_event", 0.7),
    ]
    out = F.struct(F.lit("no_signal").alias("state"), F.lit(0.3).alias("confidence"))
    for cond, state, confidence in reversed(rules):
        out = F.when(cond, F.struct(F.lit(state).alias("state"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def disagreement(usage: Column, txn: Column) -> Column:
    """Usage shows something, transactions show distress and usage does not."""
    distress = F.array(F.lit("decline_burst"), F.lit("accelerated_withdrawals"))
    return (F.size(usage) > 0) & F.arrays_overlap(txn, distress) & ~F.arrays_overlap(usage, distress)


def eligibility(state: Column, confidence: Column, types: Column, tier: Column, days_since_intervention: Column) -> Column:
    """What a customer may be offered, from the inferred state, the compliance flags, the tier and the last closed intervention."""
    sure = F.coalesce(confidence, F.lit(0.0))
    hold = (state.isin(*FRAUD_STATES) & (sure >= 0.6)) | F.array_contains(types, "watchlist_hit")
    hold = F.coalesce(hold, F.lit(False))
    recent = F.coalesce(F.floor(days_since_intervention) <= RECENT_DAYS, F.lit(False))
    tier = F.coalesce(tier, F.lit("mid"))
    offer = ~hold & state.isin(*OFFER_STATES) & (sure >= 0.5) & (tier != "low")
    outreach = (state == "churn_risk") & (sure >= 0.5) & ~recent
    return F.struct(
        hold.alias("compliance_hold"), F.coalesce(offer, F.lit(False)).alias("personalized_offer"), F.coalesce(outreach, F.lit(False)).alias("retention_outreach"), tier.alias("customer_value_tier"), recent.alias("recent_intervention")
    )


def select_action(state: Column, confidence: Column, may: Column, support_confidence: Column) -> Column:
    """``struct<action, action_confidence>``: the first rule that holds; doing nothing is an action, with the state's confidence.

    ``support_confidence`` is that of the customer's support finding, null without one.
    """
    sure = F.coalesce(confidence, F.lit(0.0))
    act = lambda a, c=sure: F.struct(F.lit(a).alias("action"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4).alias("action_confidence"))
    churn = F.when(~may["retention_outreach"], act("no_action")).when(may["customer_value_tier"] == "high", act("relationship_manager_escalation")).otherwise(act("proactive_retention_outreach"))
    distress = F.when(support_confidence >= 0.5, act("support_intervention")).otherwise(act("no_action"))
    return (
        F.when(may["compliance_hold"] | ((state == "potential_fraud_or_takeover") & (sure >= 0.6)), act("compliance_fraud_hold", F.greatest(sure, F.lit(0.8))))
        .when((state == "medical_hardship") & (sure >= 0.5), act("support_intervention"))
        .when((state == "churn_risk") & (sure >= 0.5), churn)
        .when(state.isin(*OFFER_STATES) & may["personalized_offer"], act("personalized_offer"))
        .when((state == "financial_distress_general") & (sure >= 0.6), distress)
        .otherwise(act("no_action"))
    )


def guard(action: Column, confidence: Column, may: Column, evidence: Column, reasoning: Column, offer_amount: Column) -> Column:
    """``struct<outcome, final_action, reasons, tier, pii_masked>`` of a proposed action.

    Reasoning and evidence are both searched for injection markers and for
    personal data; either escalates and neither changes the proposal. An action
    or a confidence that is missing, or an action that is none, fails closed:
    it escalates to no action.
    """
    text = F.concat_ws(" ", reasoning, evidence)
    kinds = pii_kinds(text)
    value = may["customer_value_tier"]
    offer, fraud = action == "personalized_offer", action == "compliance_fraud_hold"
    facing = action.isin("personalized_offer", "relationship_manager_escalation")
    unknown = action.isNull() | confidence.isNull() | ~action.isin(*ACTIONS)
    block = may["compliance_hold"] & (facing | (action == "proactive_retention_outreach"))
    # of these the first that holds ends the evaluation
    ends = (
        F.when(unknown, "fail_closed").when(block, "R3_compliance").when(fraud & (confidence < LEAST_FRAUD), "R4_fraud_confidence")
        .when(facing & (confidence < LEAST_FACING), "R5_uncertainty").when(offer & (value == "high") & F.coalesce(offer_amount > MOST_OFFER, F.lit(False)), "R6_cost")
    )
    found = F.array_compact(F.concat(F.array(F.when(has_injection(text), F.lit("R1_injection"))), F.transform(kinds, lambda k: F.concat(F.lit("R2_pii_"), k)), F.array(ends)))
    reasons = F.when(unknown, F.array(F.lit("fail_closed"))).otherwise(found)
    unsure = confidence < LEAST_FACING
    human = fraud | (facing & ((value == "high") | unsure)) | (action.isin("proactive_retention_outreach", "support_intervention") & unsure)
    stopped = ~unknown & block
    outcome = F.when(stopped, "block").when(F.size(reasons) > 0, "escalate").otherwise("allow")
    tier = F.when(stopped, "HARD_BLOCK").when((F.size(reasons) > 0) | human, "HITL").otherwise("AUTONOMOUS")
    final = F.when(unknown | stopped, F.lit("no_action")).otherwise(action)
    return F.struct(outcome.alias("outcome"), final.alias("final_action"), reasons.alias("reasons"), tier.alias("tier"), (~unknown & (F.size(kinds) > 0)).alias("pii_masked"))


def route(outcome: Column, final: Column) -> Column:
    """``struct<status, final_action>``: a pending decision has none yet."""
    status = F.when(outcome == "block", "blocked").when(outcome == "escalate", "pending_approval").otherwise("allowed")
    return F.struct(status.alias("status"), F.when(status != "pending_approval", final).alias("final_action"))


def submit_approvals(decisions: DataFrame) -> DataFrame:
    """Pending approvals of escalated ``decisions(decision_id, customer_id, proposed_action, submitted_at, …)``; the id hashes the decision's."""
    rest = [c for c in decisions.columns if c not in ("decision_id", "customer_id", "proposed_action", "submitted_at")]
    payload = F.to_json(F.struct(*sorted(rest))) if rest else F.lit("{}")
    key = F.concat(F.lit("apr_"), F.substring(F.md5(F.col("decision_id").cast("string")), 1, 12))
    return decisions.select(key.alias("approval_id"), "customer_id", "decision_id", "proposed_action", payload.alias("decision_payload"), F.lit("pending_approval").alias("status"), "submitted_at")


def pending_approvals(approvals: DataFrame) -> DataFrame:
    """Those still pending, oldest first."""
    return approvals.where(F.col("status") == "pending_approval").orderBy("submitted_at", "approval_id")


def get_approval(approvals: DataFrame, approval_id: str) -> DataFrame:
    return approvals.where(F.col("approval_id") == approval_id)


def resolve_approvals(pending: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The first resolution of each pending approval: approve keeps the proposal, reject takes no action, modify replaces it."""
    w = Window.partitionBy("approval_id").orderBy("resolved_at", "reviewer")
    first = resolutions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    out = pending.join(first, "approval_id", "left")
    final = F.when(F.col("decision") == "approve", F.col("proposed_action")).when(F.col("decision") == "reject", F.lit("no_action")).when(F.col("decision") == "modify", F.col("new_action"))
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "modify", "modified").otherwise("pending_approval")
    return out.select("approval_id", "proposed_action", status.alias("status"), final.alias("final_action"))


def explain(decisions: DataFrame) -> DataFrame:
    """A decision's explanation as JSON with its keys in order."""
    cols = sorted(c for c in decisions.columns if c != "decision_id")
    return decisions.select("decision_id", F.to_json(F.struct(*cols)).alias("explanation"))

