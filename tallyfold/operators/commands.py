"""Batch command processing: commands meet the state of their streams and become events or refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import large

RECOMMENDATIONS = ("APPROVE", "DECLINE", "REFER")
LEAST_CONFIDENCE = 0.6


def case_state(log: DataFrame, summary: DataFrame, compliance: DataFrame) -> DataFrame:
    """What decisions depend on: state, compliance status, and the largest limit any analysis gave (A-23)."""
    limits = log.filter(F.col("event_type") == "CreditAnalysisCompleted").groupBy("application_id").agg(F.max("limit_amount").alias("assessed_limit"))
    state = summary.select("application_id", "current_state")
    return state.join(large(compliance.select("application_id", F.col("status").alias("compliance"))), "application_id", "left").join(large(limits), "application_id", "left")


def _with_reasons(joined: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """Adds the first reason that holds; null conditions don't."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(out)
    return joined.withColumn("reason", out)


def decide(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Decision commands (command_id, application_id, recommendation, confidence) as events or refusals (M-05).

    A confidence under 0.6 turns the recommendation into REFER before the rules apply.
    """
    joined = commands.join(large(state), "application_id", "left")
    said = F.upper("recommendation")
    joined = joined.withColumn("said", F.when(F.col("confidence") < LEAST_CONFIDENCE, "REFER").otherwise(said))
    approve = F.col("said") == "APPROVE"
    ruled = _with_reasons(
        joined,
        [
            (F.col("current_state").isNull(), "application does not exist"), (F.startswith("current_state", F.lit("FINAL_")), "application is final"),
            (~F.coalesce(said.isin(*RECOMMENDATIONS), F.lit(False)), "unknown recommendation"), (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range"),
            (F.coalesce("compliance", F.lit("NOT_STARTED")).isin("NOT_STARTED", "PENDING"), "compliance is incomplete"),
            (approve & (F.col("compliance") != "CLEARED"), "compliance is not cleared"), (approve & F.col("assessed_limit").isNull(), "no analysis result"),
        ],
    )
    accepted = F.col("reason").isNull()
    return ruled.select("command_id", "application_id", F.when(accepted, "DecisionGenerated").alias("event_type"), F.when(accepted, F.col("said")).alias("recommendation"), F.when(accepted, F.col("assessed_limit")).alias("assessed_limit"), "reason")


def review(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Reviews (command_id, application_id, final_decision, override, override_reason, approved_amount) as one or two events, or a refusal."""
    joined = commands.join(large(state), "application_id", "left").withColumn("said", F.upper("final_decision"))
    approve = F.col("said") == "APPROVE"
    ruled = _with_reasons(
        joined,
        [
            (F.col("current_state").isNull(), "application does not exist"), (F.startswith("current_state", F.lit("FINAL_")), "application is final"),
            (~F.coalesce(F.col("said").isin("APPROVE", "DECLINE"), F.lit(False)), "unknown decision"), (F.col("override") & (F.coalesce("override_reason", F.lit("")) == ""), "override needs a reason"),
            (approve & F.col("approved_amount").isNull(), "approval needs an amount"), (approve & (F.coalesce("compliance", F.lit("NOT_STARTED")) != "CLEARED"), "compliance is not cleared"),
            (approve & (F.col("approved_amount") > F.col("assessed_limit")), "amount exceeds the assessed limit"),
        ],
    )
    final = F.when(approve, "ApplicationApproved").otherwise("ApplicationDeclined")
    kinds = F.when(F.col("reason").isNull(), F.array(F.lit("HumanReviewCompleted"), final)).otherwise(F.array(F.lit(None).cast("string")))
    return ruled.select("command_id", "application_id", F.posexplode(kinds).alias("turn", "event_type"), "reason")


def submit(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Submissions (command_id, application_id, requested_amount, documents) as events in order, or a refusal (M-05).

    Each document is asked for and uploaded; analysis and screening are asked for at the end.
    """
    joined = commands.join(large(state.select("application_id", "current_state")), "application_id", "left")
    ruled = _with_reasons(
        joined,
        [(F.col("current_state").isNotNull(), "application exists"), (~F.coalesce(F.col("requested_amount") > 0, F.lit(False)), "requested amount must be positive")],
    )
    event = lambda kind, document=None: F.struct(F.lit(kind).alias("event_type"), (F.lit(None) if document is None else document).cast("string").alias("document"))
    paths = F.array_distinct(F.coalesce("documents", F.array().cast("array<string>")))
    uploads = F.flatten(F.transform(paths, lambda p: F.array(event("DocumentUploadRequested", p), event("DocumentUploaded", p))))
    events = F.concat(F.array(event("ApplicationSubmitted")), uploads, F.array(event("CreditAnalysisRequested"), event("FraudScreeningRequested")))
    return _emitted(ruled, events, "application_id", ["document"])


def _emitted(ruled: DataFrame, events: Column, key: str, payload: list[str]) -> DataFrame:
    """One row an event of an accepted command, one row with the reason of a refused one."""
    rows = ruled.select("command_id", key, "reason", F.posexplode_outer(F.when(F.col("reason").isNull(), events)).alias("turn", "e"))
    return rows.select("command_id", key, "turn", "e.event_type", *[F.col(f"e.{c}") for c in payload], "reason")


def start_session(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session starts (command_id, stream_id, model_version, context_source, context_tokens) as events, or a refusal.

    A context that replays an earlier session is a recovery as well.
    """
    joined = commands.join(large(sessions.select("stream_id", "context_loaded")), "stream_id", "left")
    ruled = _with_reasons(joined, [(F.col("context_loaded"), "session has its context"), (~F.coalesce(F.col("context_tokens") > 0, F.lit(False)), "a context has tokens")])
    source = F.trim(F.regexp_extract(F.coalesce("context_source", F.lit("")), "^prior_session_replay:(.*)$", 1))
    event = lambda kind, origin: F.struct(F.lit(kind).alias("event_type"), origin.cast("string").alias("recovered_from"))
    none = F.lit(None)
    recovered = F.when(source != "", F.array(event("AgentSessionRecovered", source))).otherwise(F.array().cast("array<struct<event_type:string,recovered_from:string>>"))
    events = F.concat(F.array(event("AgentSessionStarted", none)), recovered, F.array(event("AgentContextLoaded", none)))
    return _emitted(ruled, events, "stream_id", ["recovered_from"])


def record_output(commands: DataFrame, state: DataFrame, sessions: DataFrame, kind: str = "CreditAnalysisCompleted") -> DataFrame:
    """Analyses or screenings as events, or a refusal.

    Commands have command_id, application_id, stream_id (the session's), model_version, score,
    input_hash and, for analyses, limit_amount and duration_ms.
    """
    loaded = sessions.select("stream_id", "context_loaded", F.col("model_version").alias("expected_model"))
    joined = commands.join(large(state.select("application_id", "current_state")), "application_id", "left").join(large(loaded), "stream_id", "left")
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    rules = [
        (F.col("current_state").isNull(), "application does not exist"),
        (F.startswith("current_state", F.lit("FINAL_")), "application is final"),
        (~F.coalesce("context_loaded", F.lit(False)), "session has no context"),
        (absent("model_version"), "a model is required"),
        (F.col("model_version") != F.col("expected_model"), "another model than the context's"),
        (~F.coalesce(F.col("score").between(0, 1), F.lit(False)), "score out of range"),
    ]
    if kind == "CreditAnalysisCompleted":
        rules += [(~positive("limit_amount"), "limit must be positive"), (~positive("duration_ms"), "duration must be positive")]
    ruled = _with_reasons(joined, [*rules, (absent("input_hash"), "an input hash is required")])
    return ruled.select("command_id", "application_id", F.when(F.col("reason").isNull(), kind).alias("event_type"), "reason")


def check(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Compliance checks as events, or a refusal.

    Commands have command_id, application_id, regulation_set, checks, rule_id, rule_version,
    passed and failure_reason; ``state`` the application's status, regulation_set, mandatory,
    passed and failed rules (arrays).  The first check asks for the rules, and one that
    settles the matter completes it.
    """
    of = lambda name: F.col(name).alias(f"s_{name}")
    known = state.select("application_id", *[of(c) for c in ("status", "regulation_set", "mandatory", "passed", "failed")])
    joined = commands.join(large(known), "application_id", "left").withColumn("s_status", F.coalesce("s_status", F.lit("NOT_STARTED")))
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    new = F.col("s_status") == "NOT_STARTED"
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    ruled = _with_reasons(
        joined,
        [
            (absent("rule_version"), "a rule version is required"),
            (new & (F.size(listed("checks")) == 0), "checks are required at first"),
            (F.col("s_regulation_set") != F.col("regulation_set"), "another regulation set"),
            (~F.col("passed") & absent("failure_reason"), "a failure has a reason"),
        ],
    )
    mandatory = F.when(new, listed("checks")).otherwise(listed("s_mandatory"))
    rule = F.array("rule_id")
    passed = F.when(F.col("passed"), F.array_union(listed("s_passed"), rule)).otherwise(F.array_except(listed("s_passed"), rule))
    failed = F.when(F.col("passed"), listed("s_failed")).otherwise(F.array_union(listed("s_failed"), rule))
    status = F.when(F.size(failed) > 0, "FAILED").when((F.size(mandatory) > 0) & (F.size(F.array_except(mandatory, passed)) == 0), "CLEARED").otherwise("PENDING")
    ends = status.isin("FAILED", "CLEARED") & (status != F.col("s_status"))
    event = lambda kind, verdict: F.struct(kind.alias("event_type"), verdict.cast("string").alias("overall_verdict"))
    none = F.lit(None)
    nothing = F.array().cast("array<struct<event_type:string,overall_verdict:string>>")
    events = F.concat(
        F.when(new, F.array(event(F.lit("ComplianceCheckRequested"), none))).otherwise(nothing),
        F.array(event(F.when(F.col("passed"), "ComplianceRulePassed").otherwise("ComplianceRuleFailed"), none)),
        F.when(ends, F.array(event(F.lit("ComplianceCheckCompleted"), status))).otherwise(nothing),
    )
    return _emitted(ruled, events, "application_id", ["overall_verdict"])


def integrity_runs(commands: DataFrame, verified: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """Integrity checks (command_id, entity, last_run) as audit events with the chain's state, or a refusal (M-06).

    ``verified`` has entity, events_verified, chain_valid and final_hash; an entity is checked once in ``seconds``.
    """
    joined = commands.join(large(verified), "entity", "left")
    gap = F.timestamp_diff("SECOND", F.col("last_run"), F.lit(now).cast("timestamp_ntz"))
    ruled = _with_reasons(joined, [(F.col("events_verified").isNull(), "entity has no events"), (gap < seconds, "checked a moment ago")])
    ok = F.col("reason").isNull()
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("events_verified", "chain_valid", "final_hash")]
    return ruled.select("command_id", "entity", F.when(ok, "AuditIntegrityCheckRun").alias("event_type"), *kept, "reason")
