"""Folds of an application's, a session's or an audit stream's events, as closed forms.

No event is visited in a loop: what a fold would hold at its end is the value at the
greatest position where it was set, and a strict fold's first error is the least
position at which a condition on earlier events fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import large
from .projections import column_of, is_type, last

OUTPUTS = ("CreditAnalysisCompleted", "FraudScreeningCompleted")


def application_fold(log: DataFrame, key: str = "application_id") -> DataFrame:
    """State, recommendation, decision and amount after these events (A-20); the state of an application without any is UNKNOWN."""
    said = F.upper(F.coalesce("recommendation", F.lit("")))
    state = (
        F.when(is_type("ApplicationSubmitted"), "SUBMITTED")
        .when(is_type("DecisionGenerated"), F.when(said == "APPROVE", "APPROVED_PENDING_HUMAN").when(said == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("PENDING_DECISION"))
        .when(is_type("ApplicationApproved"), "FINAL_APPROVED")
        .when(is_type("ApplicationDeclined"), "FINAL_DECLINED")
    )
    final = F.when(is_type("ApplicationApproved"), "APPROVE").when(is_type("ApplicationDeclined"), "DECLINE")
    amount = F.when(is_type("ApplicationApproved"), F.col("approved_amount"))
    return log.groupBy(key).agg(
        F.coalesce(last(state), F.lit("UNKNOWN")).alias("current_state"),
        last(said, where=is_type("DecisionGenerated")).alias("decision_recommendation"),
        last(final).alias("final_decision"),
        last(amount).alias("approved_amount"),
    )


def compliance_fold(log: DataFrame, key: str = "application_id") -> DataFrame:
    """Compliance after these events, whatever a completed check says (A-21): rules of the last request's epoch."""
    by = Window.partitionBy(key).orderBy("global_position").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.filter(is_type("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed"))
    rows = rows.withColumn("epoch", F.sum(is_type("ComplianceCheckRequested").cast("long")).over(by))
    latest = F.max("epoch").over(Window.partitionBy(key))
    rows = rows.withColumn("latest", latest).filter("epoch = latest")
    none = F.array().cast("array<string>")
    checks = rows.groupBy(key).agg(F.coalesce(F.first("mandatory", ignorenulls=True), none).alias("checks"))
    named = rows.filter(~is_type("ComplianceCheckRequested") & (F.coalesce("rule_id", F.lit("")) != ""))
    rules = named.groupBy(key, "rule_id").agg(F.max_by("event_type", "global_position").alias("said"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("said") == kind, F.col("rule_id"))))
    rules = rules.groupBy(key).agg(of("ComplianceRulePassed").alias("passed"), of("ComplianceRuleFailed").alias("failed"))
    joined = checks.join(large(rules), key, "left").withColumns({"passed": F.coalesce("passed", none), "failed": F.coalesce("failed", none)})
    missing = F.size(F.array_except("checks", "passed"))
    status = F.when(F.size("failed") > 0, "FAILED").when(F.size("checks") == 0, "NOT_STARTED").when(missing == 0, "CLEARED").otherwise("PENDING")
    listed = lambda c: F.array_join(c, ",").alias(c)
    return joined.select(key, status.alias("compliance"), listed("passed"), listed("failed"))


def agent_fold(log: DataFrame, key: str = "application_id") -> DataFrame:
    """Analyses, screenings and mean confidence of each agent and model in an application (A-22)."""
    name = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    cents = F.when(is_type("CreditAnalysisCompleted"), F.round(F.col("confidence") * 100).cast("long"))
    rows = log.filter(is_type(*OUTPUTS)).select(key, name("agent_id"), name("model_version"), "event_type", cents.alias("cents"))
    count = lambda kind: F.count_if(is_type(kind)).cast("long")
    mean = F.when(F.count("cents") > 0, F.sum("cents") / (F.count("cents") * 100)).otherwise(F.lit(0.0))
    return rows.groupBy(key, "agent_id", "model_version").agg(count(OUTPUTS[0]).alias("credit_analyses"), count(OUTPUTS[1]).alias("fraud_screenings"), mean.alias("avg_confidence"))


#: What ``outcomes`` reads of an event besides its key and position.
OUTCOME_FIELDS = ("event_type", "recommendation", "approved_amount", "mandatory", "rule_id", "agent_id", "model_version")


def outcome(log: DataFrame, key: str = "application_id") -> DataFrame:
    """The three folds of each application in one row; its agents are a text in order."""
    return outcomes(log, {"": F.lit(True)}, key)


def outcomes(log: DataFrame, sides: dict[str, Column], key: str = "application_id", order: str = "global_position", more: dict[str, Column] | None = None) -> DataFrame:
    """``application_fold``, ``compliance_fold`` and ``agent_fold`` of several choices of a log's events by one pass over it.

    ``sides`` are conditions by the prefix of their columns, ``more`` counts of rows by name.  An event is
    reduced within its rule, or its agent and model, and those within the application: a log that
    is dealt out by application is not moved, and no two folds are joined.
    """
    at, more = F.col(order), more or {}
    asks, ruled, gives = is_type("ComplianceCheckRequested"), is_type("ComplianceRulePassed", "ComplianceRuleFailed"), is_type(*OUTPUTS)
    named = ruled & (F.coalesce("rule_id", F.lit("")) != "")
    said = F.upper(F.coalesce("recommendation", F.lit("")))
    waits = F.when(said == "APPROVE", "APPROVED_PENDING_HUMAN").when(said == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("PENDING_DECISION")
    fold = {
        "current_state": F.when(is_type("ApplicationSubmitted"), "SUBMITTED").when(is_type("DecisionGenerated"), waits).when(is_type("ApplicationApproved"), "FINAL_APPROVED").when(is_type("ApplicationDeclined"), "FINAL_DECLINED"),
        "decision_recommendation": F.when(is_type("DecisionGenerated"), said),
        "final_decision": F.when(is_type("ApplicationApproved"), "APPROVE").when(is_type("ApplicationDeclined"), "DECLINE"),
        "approved_amount": F.when(is_type("ApplicationApproved"), F.col("approved_amount")),
    }
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    part = F.when(named, 1).when(gives, 2).otherwise(0)
    rows = log.select(key, at.alias("o"), "event_type", "mandatory", part.alias("part"), F.when(named, F.col("rule_id")).when(gives, known("agent_id")).alias("a"), F.when(gives, known("model_version")).alias("b"),
                      *[v.alias(f"v_{n}") for n, v in fold.items()], *[c.alias(f"on_{i}") for i, c in enumerate(sides.values())], *[c.alias(f"n_{n}") for n, c in more.items()])
    # The last request of each side opens the epoch whose rules count.
    of = range(len(sides))
    rows = rows.withColumns({f"at_{i}": F.max(F.when(F.col(f"on_{i}") & asks, F.col("o"))).over(Window.partitionBy(key)) for i in of})
    seen = lambda i, c, v: F.when(F.col(f"on_{i}") & c, F.struct("o", v.alias("v")))
    since = lambda i: F.col(f"at_{i}").isNull() | (F.col("o") >= F.col(f"at_{i}"))
    reduced = []
    for i in of:
        reduced += [F.max(seen(i, F.col(f"v_{n}").isNotNull(), F.col(f"v_{n}"))).alias(f"{n}_{i}") for n in fold]
        reduced += [F.max(seen(i, (F.col("part") == 1) & since(i), F.col("event_type"))).alias(f"said_{i}"), F.min(seen(i, (asks | ruled) & since(i) & F.col("mandatory").isNotNull(), F.col("mandatory"))).alias(f"checks_{i}")]
        reduced += [F.count_if(F.col(f"on_{i}") & is_type(kind)).alias(f"{kind}_{i}") for kind in OUTPUTS]
    inner = rows.groupBy(key, "part", "a", "b").agg(*reduced, *[F.count_if(f"n_{n}").alias(f"n_{n}") for n in more])
    none = F.array().cast("array<string>")
    whole = []
    for i in of:
        whole += [F.max(f"{n}_{i}")["v"].alias(f"{n}_{i}") for n in fold]
        credit, fraud = (F.col(f"{kind}_{i}") for kind in OUTPUTS)
        shown = F.when((F.col("part") == 2) & (credit + fraud > 0), F.concat_ws(":", "a", "b", credit, fraud))
        whole += [F.array_join(F.array_sort(F.collect_list(shown)), ",").alias(f"agents_{i}"), F.count_if(F.col(f"said_{i}")["v"] == "ComplianceRuleFailed").alias(f"failed_{i}")]
        whole += [F.collect_list(F.when(F.col(f"said_{i}")["v"] == "ComplianceRulePassed", F.col("a"))).alias(f"passed_{i}"), F.coalesce(F.min(f"checks_{i}")["v"], none).alias(f"checks_{i}")]
    out = inner.groupBy(key).agg(*whole, *[F.sum(f"n_{n}").cast("long").alias(n) for n in more])
    columns = []
    for i, name in enumerate(sides):
        missing = F.size(F.array_except(f"checks_{i}", f"passed_{i}"))
        status = F.when(F.col(f"failed_{i}") > 0, "FAILED").when(F.size(f"checks_{i}") == 0, "NOT_STARTED").when(missing == 0, "CLEARED").otherwise("PENDING")
        prefix = f"{name}_" if name else ""
        columns += [F.coalesce(f"current_state_{i}", F.lit("UNKNOWN")).alias(f"{prefix}current_state"), *[F.col(f"{n}_{i}").alias(f"{prefix}{n}") for n in list(fold)[1:]]]
        columns += [status.alias(f"{prefix}compliance"), F.col(f"agents_{i}").alias(f"{prefix}agents")]
    return out.select(key, *columns, *more)


def agent_sessions(log: DataFrame, stream: str = "stream_id", position: str = "stream_position") -> DataFrame:
    """Strict replay of session streams (M-02): one context, outputs after it and of its model.

    ``outputs`` counts those before the first error; a stream without a context has no model.
    """
    order = Window.partitionBy(stream).orderBy(position)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    loads = is_type("AgentContextLoaded")
    model = F.trim(F.coalesce("model_version", F.lit("")))
    rows = log.withColumn("loaded", F.coalesce(F.sum(loads.cast("int")).over(before), F.lit(0)) > 0)
    rows = rows.withColumn("expected", F.first(F.when(loads, model), ignorenulls=True).over(before)).withColumn("model", model)
    gives = is_type(*OUTPUTS)
    error = (
        F.when(loads & F.col("loaded"), "context loaded twice")
        .when(loads & (F.col("model") == ""), "context without a model")
        .when(gives & ~F.col("loaded"), "output before the context")
        .when(gives & (F.col("model") == ""), "output without a model")
        .when(gives & (F.col("model") != F.col("expected")), "another model than the context's")
    )
    rows = rows.withColumn("error", error)
    rows = rows.withColumn("failed_before", F.coalesce(F.count("error").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > 0)
    at = F.when(F.col("error").isNotNull(), F.col(position))
    return rows.groupBy(stream).agg(
        F.bool_or(loads & ~F.col("failed_before")).alias("context_loaded"),
        F.min_by(F.when(loads & ~F.col("failed_before"), F.col("model")), F.when(loads & ~F.col("failed_before"), F.col(position))).alias("model_version"),
        F.count_if(gives & ~F.col("failed_before")).cast("long").alias("outputs"),
        F.min_by("error", at).alias("first_error"),
        F.min(at).alias("error_position"),
    )


def audit_ledger(log: DataFrame, stream: str = "stream_id", position: str = "stream_position") -> DataFrame:
    """Audit events with the first rule that each breaks, or null (M-04).

    A correlation is required; a cause must be an earlier event of the same stream; the
    number of events verified isn't negative and a hash is there.
    """
    known = log.groupBy(F.col(stream).alias("s"), F.col("event_id").alias("known")).agg(F.min(position).alias("at"))
    joined = log.join(large(known), (F.col(stream) == F.col("s")) & (F.col("causation_id") == F.col("known")), "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(empty("correlation_id"), "a correlation is required")
        .when(~empty("causation_id") & (F.col("at").isNull() | (F.col("at") >= F.col(position))), "the cause is no earlier event of the stream")
        .when(F.coalesce(F.col("events_verified") < 0, F.lit(True)), "a count of verified events is required")
        .when(empty("integrity_hash"), "a hash is required")
    )
    return joined.select(stream, position, "event_id", reason.alias("reason"))


def contributing_sessions(decisions: DataFrame, log: DataFrame, sessions: str = "sessions", key: str = "application_id") -> DataFrame:
    """Each decision with the first fault of its sessions, or null (J-11).

    A decision names at least one session and none twice; each exists, has loaded its
    context, and has an output for this application.
    """
    named = decisions.select(key, F.posexplode_outer(sessions).alias("turn", "stream_id"))
    streams = log.groupBy("stream_id").agg(F.bool_or(is_type("AgentContextLoaded")).alias("context"))
    outputs = log.filter(is_type(*OUTPUTS)).select("stream_id", F.col(key).alias("for")).distinct().withColumn("output", F.lit(True))
    joined = named.join(large(streams), "stream_id", "left").join(large(outputs), (named["stream_id"] == outputs["stream_id"]) & (F.col(key) == F.col("for")), "left")
    joined = joined.select(key, "turn", named["stream_id"], "context", "output")
    fault: Column = (
        F.when(F.col("stream_id").isNull(), "no session")
        .when(F.col("context").isNull(), "session does not exist")
        .when(~F.col("context"), "session without a context")
        .when(F.col("output").isNull(), "session without an output")
    )
    found = joined.withColumn("fault", fault).groupBy(key).agg(
        F.count("stream_id").alias("sessions"), F.countDistinct("stream_id").alias("distinct_sessions"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.coalesce("turn", F.lit(0)))).alias("fault")
    )
    twice = F.when(F.col("distinct_sessions") < F.col("sessions"), "sessions repeat")
    return found.select(key, "sessions", F.coalesce(twice, "fault").alias("fault"))
