"""Materialized views of the case log as closed forms: no fold over rows.

``last(v)`` below is the value of v at the greatest position where v is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import large

COMPLIANCE = ("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed", "ComplianceCheckCompleted")
VERDICTS = ("CLEARED", "FAILED", "PENDING", "NOT_STARTED")
#: Event types that an application's summary takes notice of, apart from compliance.
SUMMARY = ("ApplicationSubmitted", "CreditAnalysisRequested", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined")
TOUCHES = ("CreditAnalysisCompleted", "FraudScreeningRequested", "FraudScreeningCompleted", "DecisionRequested", "HumanReviewRequested", "DocumentUploadRequested", "DocumentUploaded")


def last(value: Column, order: str = "global_position", where: Column | None = None) -> Column:
    """The last non-null value by position, among the rows where a condition holds."""
    keep = value.isNotNull() if where is None else value.isNotNull() & where
    return F.max_by(F.when(keep, value), F.when(keep, F.col(order)))


def first(value: Column, order: str = "global_position", where: Column | None = None) -> Column:
    keep = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min_by(F.when(keep, value), F.when(keep, F.col(order)))


def is_type(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def column_of(log: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in log.columns else F.lit(None).cast(kind)


def application_summary(log: DataFrame) -> DataFrame:
    """State, decision, amounts and compliance status of each application (A-16)."""
    rows = log.filter(F.col("application_id").isNotNull() & is_type(*SUMMARY, *COMPLIANCE, *TOUCHES))
    said = F.upper(F.coalesce("recommendation", F.lit("")))
    state = (
        F.when(is_type("ApplicationSubmitted"), "SUBMITTED").when(is_type("CreditAnalysisRequested"), "AWAITING_ANALYSIS")
        .when(is_type("DecisionGenerated"), F.when(said == "APPROVE", "APPROVED_PENDING_HUMAN").when(said == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("PENDING_DECISION"))
        .when(is_type("ApplicationApproved"), "FINAL_APPROVED").when(is_type("ApplicationDeclined"), "FINAL_DECLINED")
    )
    review = F.upper("final_decision")
    final = F.when(is_type("ApplicationApproved"), "APPROVE").when(is_type("ApplicationDeclined"), "DECLINE").when(is_type("HumanReviewCompleted") & (review != ""), review)
    verdict = F.upper(column_of(log, "overall_verdict"))
    status = (
        F.when(is_type("DecisionGenerated"), column_of(log, "compliance_status")).when(is_type("ComplianceCheckRequested", "ComplianceRulePassed"), "PENDING")
        .when(is_type("ComplianceRuleFailed"), "FAILED").when(is_type("ComplianceCheckCompleted"), F.when(verdict.isin(*VERDICTS), verdict).otherwise("PENDING"))
    )
    return rows.groupBy("application_id").agg(
        F.coalesce(last(state), F.lit("SUBMITTED")).alias("current_state"),
        last(said, where=is_type("DecisionGenerated")).alias("decision_recommendation"),
        last(final).alias("final_decision"),
        last(F.col("requested_amount"), where=is_type("ApplicationSubmitted")).alias("requested_amount"),
        last(F.col("approved_amount"), where=is_type("ApplicationApproved")).alias("approved_amount"),
        last(status).alias("compliance_status"),
        F.max_by("event_type", "global_position").alias("last_event_type"),
        F.max("global_position").alias("last_global_position"),
        F.max_by("recorded_at", "global_position").alias("updated_at"),
    )


def state_histogram(summary: DataFrame) -> DataFrame:
    return summary.groupBy("current_state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "current_state")


def agent_performance(log: DataFrame) -> DataFrame:
    """Counters and ratios of each (agent, model) (A-17); confidences are summed as whole hundredths.

    A decision's model is that of its orchestrator, ``unknown`` where it names none.
    """
    worker = is_type("AgentContextLoaded", "CreditAnalysisCompleted", "FraudScreeningCompleted")
    decides, reviews = is_type("DecisionGenerated"), is_type("HumanReviewCompleted")
    agent = F.when(worker, F.col("agent_id")).when(decides, F.col("orchestrator")).when(reviews, F.col("reviewer"))
    decided_by = F.coalesce(column_of(log, "decision_model"), F.lit("unknown"))
    model = F.when(worker, F.col("model_version")).when(decides, decided_by).when(reviews, F.lit("human-review"))
    sampled = is_type("CreditAnalysisCompleted", "DecisionGenerated") & F.col("confidence").between(0, 1)
    cents = F.when(sampled, F.round(F.col("confidence") * 100).cast("long"))
    rows = log.select(agent.alias("agent_id"), model.alias("model_version"), cents.alias("cents"), "event_type", "override", "global_position")
    rows = rows.filter("nullif(agent_id, '') is not null and nullif(model_version, '') is not null")
    of = lambda name: F.count_if(is_type(name)).cast("long")
    out = rows.groupBy("agent_id", "model_version").agg(
        of("AgentContextLoaded").alias("sessions_started"),
        of("CreditAnalysisCompleted").alias("analyses_completed"),
        of("FraudScreeningCompleted").alias("fraud_screenings_completed"),
        of("DecisionGenerated").alias("decisions_recorded"),
        of("HumanReviewCompleted").alias("human_reviews_completed"),
        F.count_if(reviews & F.col("override")).cast("long").alias("overrides_recorded"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.count("cents").alias("confidence_samples"),
        F.max("global_position").alias("last_global_position"),
    )
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    out = out.withColumn("avg_confidence", ratio(F.col("cents"), F.col("confidence_samples") * 100))
    return out.withColumn("override_rate", ratio(F.col("overrides_recorded"), F.col("human_reviews_completed"))).drop("cents")


def client_analytics(log: DataFrame) -> DataFrame:
    """Earliest times, amounts, first final decision and hours of each application (A-18)."""
    rows = log.filter(is_type("ApplicationSubmitted", "DecisionGenerated", "ApplicationApproved", "ApplicationDeclined"))
    at = lambda *names: F.min(F.when(is_type(*names), F.col("recorded_at")))
    final = is_type("ApplicationApproved", "ApplicationDeclined")
    out = rows.groupBy("application_id").agg(
        at("ApplicationSubmitted").alias("submitted_at"), at("ApplicationApproved", "ApplicationDeclined").alias("finalized_at"), at("DecisionGenerated").alias("decision_generated_at"),
        first(F.when(is_type("ApplicationApproved"), "APPROVED").otherwise("DECLINED"), where=final).alias("final_decision"),
        last(F.col("requested_amount"), where=is_type("ApplicationSubmitted")).alias("requested_amount"), last(F.col("approved_amount"), where=is_type("ApplicationApproved")).alias("approved_amount"),
        last(F.nullif(F.col("orchestrator"), F.lit("")), where=is_type("DecisionGenerated")).alias("decision_agent_id"), F.max("global_position").alias("last_global_position"),
    )
    hours = F.expr("timestampdiff(MICROSECOND, submitted_at, finalized_at)") / 3600e6
    return out.withColumn("processing_hours", F.when(hours >= 0, F.round(hours, 4)))


def _status(failed: Column, passed: Column, mandatory: Column) -> Column:
    return F.when(failed > 0, "FAILED").when((mandatory > 0) & (passed == mandatory), "CLEARED").when(mandatory > 0, "PENDING").otherwise("NOT_STARTED")


def compliance_timeline(log: DataFrame) -> DataFrame:
    """Compliance status after every compliance event (W-02, W-03), by running sums of changes."""
    rows = log.filter(is_type(*COMPLIANCE))
    requested = is_type("ComplianceCheckRequested")
    ruled = is_type("ComplianceRulePassed", "ComplianceRuleFailed") & (F.coalesce("rule_id", F.lit("")) != "")
    state = F.when(ruled, F.when(is_type("ComplianceRuleFailed"), "F").otherwise("P"))
    # A row without a rule has a partition of its own, so that it never is another row's predecessor.
    rule = F.when(ruled, F.col("rule_id")).otherwise(F.concat(F.lit("#"), F.col("global_position")))
    rows = rows.withColumn("state", state).withColumn("rule", rule)
    # All windows but this one have one order, and an epoch is told from its start, so that rows are sorted twice only.
    of_rule = Window.partitionBy("application_id", "rule").orderBy("global_position")
    rows = rows.withColumn("before", F.lag(F.struct("state", "global_position")).over(of_rule))
    so_far = Window.partitionBy("application_id").orderBy("global_position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("epoch", F.sum(requested.cast("long")).over(so_far)).withColumn("start", F.max(F.when(requested, F.col("global_position"))).over(so_far))
    named = F.when(F.col("mandatory").isNotNull(), F.struct((-F.col("epoch")).alias("epoch"), "global_position", "mandatory"))
    rows = rows.withColumn("named", F.min(named).over(so_far))
    checks = F.coalesce(F.when(F.col("named.epoch") == -F.col("epoch"), F.col("named.mandatory")), F.array().cast("array<string>"))
    rows = rows.withColumn("checks", checks).withColumn("was", F.when(F.col("start").isNull() | (F.col("before.global_position") >= F.col("start")), F.col("before.state")))
    flag = lambda column, value: F.coalesce(F.col(column) == value, F.lit(False)).cast("long")
    needed = F.array_contains("checks", F.col("rule")).cast("long")
    changes = {"failed": flag("state", "F") - flag("was", "F"), "passed": (flag("state", "P") - flag("was", "P")) * needed}
    for name, change in changes.items():
        rows = rows.withColumn(name, F.sum(F.when(F.col("state").isNotNull(), change).otherwise(0)).over(so_far))
    for name in changes:
        at_start = F.last(F.when(requested, F.col(name)), ignorenulls=True).over(so_far)
        rows = rows.withColumn(f"{name}_before", F.coalesce(at_start, F.lit(0)))
    rows = rows.select("*", *[(F.col(n) - F.col(f"{n}_before")).alias(f"{n}_now") for n in changes]).drop(*changes).withColumnsRenamed({f"{n}_now": n for n in changes})
    status = _status(F.col("failed"), F.col("passed"), F.size("checks"))
    if "overall_verdict" in log.columns:
        verdict = F.upper("overall_verdict")
        status = F.when(is_type("ComplianceCheckCompleted") & verdict.isin(*VERDICTS), verdict).otherwise(status)
    return rows.select("application_id", "global_position", "event_type", "recorded_at", "epoch", "rule_id", "failed", "passed", status.alias("status"))


def compliance_state(log: DataFrame) -> DataFrame:
    """Current compliance of each application: status, passed and failed rules of the last epoch."""
    timeline = compliance_timeline(log)
    now = timeline.groupBy("application_id").agg(F.max_by("status", "global_position").alias("status"), F.max("epoch").alias("epoch"), F.max("global_position").alias("last_global_position"))
    ruled = log.filter(is_type("ComplianceRulePassed", "ComplianceRuleFailed") & (F.coalesce("rule_id", F.lit("")) != "")).select("application_id", "global_position", "event_type", "rule_id", "failure_reason")
    ruled = ruled.join(large(timeline.select("application_id", "global_position", "epoch")), ["application_id", "global_position"])
    rules = ruled.groupBy("application_id", "epoch", "rule_id").agg(F.max_by("event_type", "global_position").alias("state"), F.max_by("failure_reason", "global_position").alias("reason"))
    passed = F.array_sort(F.collect_list(F.when(F.col("state") == "ComplianceRulePassed", F.col("rule_id"))))
    failed = F.array_sort(F.collect_list(F.when(F.col("state") == "ComplianceRuleFailed", F.concat_ws("=", "rule_id", "reason"))))
    lists = rules.groupBy("application_id", "epoch").agg(F.array_join(passed, ",").alias("passed_checks"), F.array_join(failed, ",").alias("failed_checks"))
    out = now.join(large(lists), ["application_id", "epoch"], "left")
    return out.select("application_id", "status", F.coalesce("passed_checks", F.lit("")).alias("passed_checks"), F.coalesce("failed_checks", F.lit("")).alias("failed_checks"), "last_global_position")


def as_of(timeline: DataFrame, moments: DataFrame, key: str = "application_id", at: str = "as_of") -> DataFrame:
    """For each (key, moment) the latest timeline row at or before it, ties to the greater position (J-07).

    Timeline and moments are sorted together once; nothing is paired that isn't kept.
    """
    kept = [c for c in timeline.columns if c != key]
    row = F.struct(*kept)
    both = timeline.select(key, F.col("recorded_at").alias(at), F.col("global_position").alias("tie"), row.alias("row")).unionByName(
        moments.select(key, at, F.lit(None).cast("long").alias("tie"), F.lit(None).cast(timeline.select(row.alias("r")).schema["r"].dataType).alias("row"))
    )
    window = Window.partitionBy(key).orderBy(F.col(at), F.col("tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("row", ignorenulls=True).over(window)).filter("row is null").select(key, at, "found.*")
