"""The four projections of the case log as keyed states of one stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.projections import VERDICTS, is_type
from .keyed import Ordered, Reduced

STATES = {"ApplicationSubmitted": "SUBMITTED", "ApplicationApproved": "FINAL_APPROVED", "ApplicationDeclined": "FINAL_DECLINED"}
WAITING = {"APPROVE": "APPROVED_PENDING_HUMAN", "DECLINE": "DECLINED_PENDING_HUMAN"}

#: What each projection reads of an event besides its ids, position and time.
COLUMNS = {
    "applications": ("event_type", "recommendation", "approved_amount"),
    "clients": ("event_type",),
    "agents": ("event_type", "agent_id", "model_version", "orchestrator", "decision_model", "reviewer", "override", "confidence"),
    "compliance": ("event_type", "rule_id", "mandatory", "overall_verdict"),
}


def _said():
    return F.upper(F.coalesce("recommendation", F.lit("")))


def _mapped(column, values: dict, otherwise=None):
    out = F.when(F.lit(False), F.lit(""))
    for key, value in values.items():
        out = out.when(column == key, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def applications() -> Reduced:
    """State, recommendation, decision and amount of each application."""
    decided = is_type("DecisionGenerated")
    state = F.when(decided, _mapped(_said(), WAITING, "PENDING_DECISION")).otherwise(_mapped(F.col("event_type"), STATES))
    return Reduced("applications", F.col("application_id"), {
        "seen": ("count", F.lit(1), "long"),
        "current_state": ("last", state, "string"),
        "decision_recommendation": ("last", F.when(decided, _said()), "string"),
        "final_decision": ("last", _mapped(F.col("event_type"), {"ApplicationApproved": "APPROVE", "ApplicationDeclined": "DECLINE"}), "string"),
        "approved_amount": ("last", F.when(is_type("ApplicationApproved"), F.col("approved_amount")), "double"),
    })


def clients() -> Reduced:
    """When an application came, was decided upon and ended, and how."""
    final = is_type("ApplicationApproved", "ApplicationDeclined")
    at = F.col("recorded_at").cast("string")
    # Of several times the earliest holds; texts of one format order as times do.
    return Reduced("clients", F.col("application_id"), {
        "submitted_at": ("first", F.when(is_type("ApplicationSubmitted"), at), "string"),
        "decision_generated_at": ("first", F.when(is_type("DecisionGenerated"), at), "string"),
        "finalized_at": ("first", F.when(final, at), "string"),
        "final_decision": ("first", _mapped(F.col("event_type"), {"ApplicationApproved": "APPROVED", "ApplicationDeclined": "DECLINED"}), "string"),
    })


def agents(salts: int = 4) -> Reduced:
    """Counters of each agent and model, which any share of all events may concern."""
    worker = is_type("AgentContextLoaded", "CreditAnalysisCompleted", "FraudScreeningCompleted")
    decides, reviews = is_type("DecisionGenerated"), is_type("HumanReviewCompleted")
    agent = F.when(worker, F.col("agent_id")).when(decides, F.col("orchestrator")).when(reviews, F.col("reviewer"))
    model = F.when(worker, F.col("model_version")).when(decides, F.coalesce("decision_model", F.lit("unknown"))).when(reviews, F.lit("human-review"))
    named = (F.coalesce(agent, F.lit("")) != "") & (F.coalesce(model, F.lit("")) != "")
    sampled = is_type("CreditAnalysisCompleted", "DecisionGenerated") & F.col("confidence").between(0, 1)
    of = lambda name: ("count", F.when(is_type(name), F.lit(1)), "long")
    return Reduced("agents", F.when(named, F.to_json(F.struct(agent.alias("agent_id"), model.alias("model_version")))), {
        "sessions_started": of("AgentContextLoaded"), "analyses_completed": of("CreditAnalysisCompleted"),
        "fraud_screenings_completed": of("FraudScreeningCompleted"), "decisions_recorded": of("DecisionGenerated"),
        "human_reviews_completed": of("HumanReviewCompleted"), "overrides_recorded": ("count", F.when(reviews & F.col("override"), F.lit(1)), "long"),
        "confidence_samples": ("count", F.when(sampled, F.lit(1)), "long"),
        "cents": ("sum", F.when(sampled, F.round(F.col("confidence") * 100).cast("long")), "long"),
        "last_global_position": ("max", F.when(worker | decides | reviews, F.col("global_position")), "long"),
    }, salts)


def compliance_step(state: dict, event: dict) -> None:
    """A request opens an epoch and forgets the rules before it; of a rule the last word counts."""
    kind, rule = event["event_type"], event.get("rule_id")
    if kind == "ComplianceCheckRequested":
        state["checks"], state["rules"] = event.get("mandatory") or [], {}
    elif kind in ("ComplianceRulePassed", "ComplianceRuleFailed") and rule:
        state.setdefault("rules", {})[rule] = kind == "ComplianceRulePassed"
    said = (event.get("overall_verdict") or "").upper()
    checks, rules = state.get("checks") or [], state.get("rules") or {}
    if kind == "ComplianceCheckCompleted" and said in VERDICTS:
        state["status"] = said
    elif not all(rules.values()):
        state["status"] = "FAILED"
    elif not checks:
        state["status"] = "NOT_STARTED"
    else:
        state["status"] = "CLEARED" if all(rules.get(c) for c in checks) else "PENDING"
    state["last_global_position"] = event["position"]


def compliance() -> Ordered:
    """Status of each application's compliance after its last event."""
    concerns = is_type("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed", "ComplianceCheckCompleted")
    inputs = {"event_type": F.when(concerns, F.col("event_type"))} | {c: F.when(concerns, F.col(c)) for c in ("rule_id", "mandatory", "overall_verdict")}
    return Ordered("compliance", F.col("application_id"), inputs, compliance_step, {"status": "string", "last_global_position": "long"})


def agent_view(rows):
    """The agents' states with their ratios."""
    ratio = lambda a, b: F.when(F.col(b) > 0, a.cast("double") / F.col(b)).otherwise(F.lit(0.0))
    out = rows.withColumn("k", F.from_json("key", "agent_id string, model_version string")).select("k.*", *[c for c in rows.columns if c != "key"])
    mean = F.when(F.col("confidence_samples") > 0, F.col("cents").cast("double") / (F.col("confidence_samples") * 100)).otherwise(F.lit(0.0))
    return out.withColumn("avg_confidence", mean).withColumn("override_rate", ratio(F.col("overrides_recorded"), "human_reviews_completed")).drop("cents")
