"""Lineage view of an application's events: actor, phase, coverage (C-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import bound
from .projections import is_type

#: The event types that a complete ledger has.
EXPECTED = (
    "ApplicationSubmitted", "CreditAnalysisRequested", "AgentContextLoaded", "CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckRequested", "ComplianceRulePassed",
    "ComplianceRuleFailed", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined", "AuditIntegrityCheckRun", "DocumentUploadRequested", "DocumentUploaded",
    "FraudScreeningRequested", "DecisionRequested", "HumanReviewRequested", "ComplianceCheckCompleted", "AgentSessionStarted", "AgentSessionRecovered", "PackageCreated", "DocumentAdded",
    "DocumentFormatValidated", "ExtractionStarted", "ExtractionCompleted", "QualityAssessmentCompleted", "PackageReadyForAnalysis",
)


def phase() -> Column:
    return (
        F.when(is_type("ApplicationSubmitted"), "intake").when(is_type("CreditAnalysisCompleted", "FraudScreeningCompleted"), "analysis")
        .when(F.startswith("event_type", F.lit("Compliance")), "compliance").when(is_type("DecisionGenerated"), "decision").otherwise("outcome")
    )


def lineage(log: DataFrame) -> DataFrame:
    """Events with their actor and phase (F-35)."""
    actor = F.coalesce("agent_id", "orchestrator", "reviewer", F.when(F.startswith("event_type", F.lit("Compliance")), "compliance"), F.lit("system"))
    return log.select("application_id", "global_position", "event_type", "recorded_at", actor.alias("actor"), phase().alias("phase"))


def phase_groups(log: DataFrame) -> DataFrame:
    """Runs of consecutive events of one phase (W-09): gaps and islands."""
    order = Window.partitionBy("application_id").orderBy("global_position")
    rows = lineage(log).withColumn("new", F.coalesce((F.lag("phase").over(order) != F.col("phase")).cast("long"), F.lit(1)))
    rows = rows.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("application_id", "group").agg(F.first("phase").alias("phase"), F.count("*").alias("events"), F.min("global_position").alias("first_position"), F.max("global_position").alias("last_position"))


def latest_by_actor(log: DataFrame) -> DataFrame:
    """The last event of each actor (W-10)."""
    return lineage(log).groupBy("actor").agg(F.max("global_position").alias("global_position"), F.max_by("event_type", "global_position").alias("event_type"))


def coverage(log: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """Event types that are missing or unexpected (U-03)."""
    wanted = log.sparkSession.createDataFrame([(x,) for x in expected], "event_type string")
    seen = log.select("event_type").distinct()
    missing = wanted.join(seen, "event_type", "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(seen.join(wanted, "event_type", "left_anti").withColumn("finding", F.lit("unexpected")))


def narrowed(rows: DataFrame, now: str, event_type: str | None = None, actor: str | None = None, hours: int | None = None) -> DataFrame:
    """Lineage rows of a type, an actor and the hours up to ``now``; None leaves a test out (P-07, P-08)."""
    if event_type is not None:
        rows = rows.filter(F.col("event_type") == event_type)
    if actor is not None:
        rows = rows.filter(F.col("actor") == actor)
    if hours is not None:
        end = F.lit(now).cast("timestamp_ntz")
        rows = rows.filter((F.col("recorded_at") <= end) & (F.col("recorded_at") >= end - F.make_dt_interval(hours=F.lit(hours))))
    return rows


#: Lane, checkpoint and phase of event types; a name that ends in a star stands for all that begin so.
LANES = {
    "ApplicationSubmitted": "Intake", "DocumentUploadRequested": "Document Intake", "DocumentUploaded": "Document Intake", "AgentSessionStarted": "Agent Session",
    "AgentSessionRecovered": "Agent Session", "AgentContextLoaded": "Agent Session", "Credit*": "CreditAnalysis", "Fraud*": "FraudDetection", "Compliance*": "ComplianceAgent",
    "DecisionRequested": "DecisionOrchestrator", "DecisionGenerated": "DecisionOrchestrator", "HumanReviewRequested": "DecisionOrchestrator", "HumanReviewCompleted": "Human Review",
    "ApplicationApproved": "Final Decision", "ApplicationDeclined": "Final Decision", "AuditIntegrityCheckRun": "Integrity", "*": "Ledger",
}
CHECKPOINTS = {
    "DecisionRequested": "Machine checkpoint", "DecisionGenerated": "Machine checkpoint", "HumanReviewRequested": "Awaiting binding review", "HumanReviewCompleted": "Binding review",
    "ApplicationApproved": "Final disposition", "ApplicationDeclined": "Final disposition", "Compliance*": "Regulatory evidence", "AuditIntegrityCheckRun": "Hash-chain attestation",
    "*": "Operational event",
}
PHASES = {
    "ApplicationSubmitted": "Intake", "Document*": "Intake", "Credit*": "Analysis", "Fraud*": "Analysis", "AgentSession*": "Analysis", "AgentContextLoaded": "Analysis",
    "Compliance*": "Compliance", "DecisionRequested": "Decision", "DecisionGenerated": "Decision", "HumanReviewRequested": "Decision", "*": "Final Outcome",
}
#: The payload keys that name an event's actor, in turn, and the name where none does.
ACTORS = {
    "DocumentUploadRequested": ("requested_by", "uploaded_by", "=Document Intake"), "DocumentUploaded": ("requested_by", "uploaded_by", "=Document Intake"), "Compliance*": ("=ComplianceAgent",),
    "AgentSessionStarted": ("agent_id", "=Agent Session"), "AgentSessionRecovered": ("agent_id", "=Agent Session"), "AgentContextLoaded": ("agent_id", "=Agent Session"),
    "Credit*": ("agent_id", "assigned_agent_id", "=CreditAnalysis"), "Fraud*": ("agent_id", "assigned_agent_id", "=FraudDetection"),
    "DecisionRequested": ("requested_by", "=DecisionOrchestrator"), "DecisionGenerated": ("orchestrator_agent_id", "=DecisionOrchestrator"),
    "HumanReviewRequested": ("requested_by", "=DecisionOrchestrator"), "HumanReviewCompleted": ("reviewer_id", "=Loan Officer"), "ApplicationApproved": ("approved_by", "=Loan Officer"),
    "ApplicationDeclined": ("declined_by", "=Loan Officer"), "ApplicationSubmitted": ("=Loan Intake",), "AuditIntegrityCheckRun": ("=Compliance Service",), "*": ("=Ledger Control",),
}
#: Parts of a text that set its tone, the first tone that has one.
TONES = {
    "critical": ("critical", "failed", "decline", "denied"), "warning": ("warning", "pending", "lag", "review", "refer"), "info": ("live", "progress", "requested", "running", "sync"),
    "ok": ("ok", "healthy", "cleared", "approve", "verified"),
}


def _by_type(values: dict[str, Column | str]) -> Column:
    """The value of the first name that fits the row's type."""
    out = None
    for name, value in values.items():
        fits = F.startswith("event_type", F.lit(name[:-1])) if name.endswith("*") else F.col("event_type") == name
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tone(text: Column) -> Column:
    """How a word reads: critical, warning, info, ok or neutral (F-35)."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("neutral")
    for name, parts in reversed(TONES.items()):
        has = F.lit(False)
        for part in parts:
            has = has | F.contains(low, F.lit(part))
        out = F.when(has, name).otherwise(out)
    return out


def annotated(log: DataFrame) -> DataFrame:
    """Events with actor, lane, checkpoint, phase and tone (F-35, C-22).

    ``log`` has payload and metadata as JSON texts; an actor in the metadata goes before those that
    the payload names.  Blank names count as none.
    """
    read = lambda column, key: bound(F.get_json_object(column, f"$.{key}"), lambda x: F.when(F.trim(x) != "", x))
    named = {t: F.coalesce(*[F.lit(k[1:]) if k.startswith("=") else read("payload", k) for k in keys]) for t, keys in ACTORS.items()}
    return log.withColumns({
        "actor": F.coalesce(read("metadata", "actor_id"), _by_type(named)), "lane": _by_type(LANES), "checkpoint": _by_type(CHECKPOINTS), "phase": _by_type(PHASES), "tone": tone(F.col("event_type")),
    })
