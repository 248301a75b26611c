"""Replay state machines and batch commands.

A strict replay stops at its first error.  Up to there every event was valid, so that what the
machine holds before an event is the last value that an earlier one set: running windows over
a stream find each event's error as if none came before, and the least position with one is
the stream's.  No stream stands in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import large
from .projections import is_type

OPEN = ("AWAITING_ANALYSIS", "PENDING_DECISION", "APPROVED_PENDING_HUMAN", "DECLINED_PENDING_HUMAN")
REVIEWABLE = OPEN[1:]


def _strict(rows: DataFrame, key: str, error: Column, before: Column, after: Column, start: str) -> DataFrame:
    """(key, end_state, first_error, error_position) from each row's error and its states before and after."""
    rows = rows.withColumns({"_error": error, "_before": before, "_after": after})
    at = F.when(F.col("_error").isNotNull(), F.col("global_position"))
    out = rows.groupBy(key).agg(
        F.min_by("_error", at).alias("first_error"), F.min(at).alias("error_position"), F.min_by("_before", at).alias("stopped"), F.max_by("_after", "global_position").alias("ended"),
    )
    state = F.coalesce(F.when(F.col("error_position").isNotNull(), F.col("stopped")).otherwise(F.col("ended")), F.lit(start))
    return out.select(key, state.alias("end_state"), "first_error", "error_position")


def loan_lifecycle(log: DataFrame, key: str = "application_id", decide_from: tuple[str, ...] = OPEN) -> DataFrame:
    """End state and first violation of each application's strict replay (M-01).

    ``decide_from`` are the states in which a decision may come.  Types that the machine
    does not know are skipped.  The rules on compliance, on the assessed limit and on
    overrides are held to where the log has columns for them.
    """
    known = is_type("ApplicationSubmitted", "CreditAnalysisRequested", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined")
    has = {c: c in log.columns for c in ("compliance_status", "limit_amount", "override_reason")}
    rows, said = log.filter(known), F.upper("recommendation")
    earlier = Window.partitionBy(key).orderBy("global_position").rowsBetween(Window.unboundedPreceding, -1)
    decides, reviews = is_type("DecisionGenerated"), is_type("HumanReviewCompleted")
    approves, final = is_type("ApplicationApproved"), is_type("ApplicationApproved", "ApplicationDeclined")
    sets = (
        F.when(is_type("ApplicationSubmitted"), "SUBMITTED").when(is_type("CreditAnalysisRequested"), "AWAITING_ANALYSIS")
        .when(decides, F.when(said == "APPROVE", "APPROVED_PENDING_HUMAN").when(said == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("PENDING_DECISION"))
        .when(approves, "FINAL_APPROVED").when(final, "FINAL_DECLINED")
    )
    rows = rows.withColumn("sets", sets)
    held = {"state": F.coalesce(F.last("sets", ignorenulls=True).over(earlier), F.lit("EMPTY")), "reviewed": F.coalesce(F.max(reviews).over(earlier), F.lit(False))}
    named = F.when(decides, F.nullif(F.upper("compliance_status"), F.lit(""))) if has["compliance_status"] else None
    if named is not None:
        rows = rows.withColumn("named", named)
        held["cleared"] = F.coalesce(F.last("named", ignorenulls=True).over(earlier) == "CLEARED", F.lit(False))
    if has["limit_amount"]:
        rows = rows.withColumn("decided_limit", F.when(decides, F.col("limit_amount")))
        held["limit"] = F.last("decided_limit", ignorenulls=True).over(earlier)
    rows = rows.withColumns(held)
    state = F.col("state")
    allowed = (
        F.when(is_type("ApplicationSubmitted"), state == "EMPTY").when(is_type("CreditAnalysisRequested"), state.isin("SUBMITTED", "AWAITING_ANALYSIS"))
        .when(decides, state.isin(*decide_from)).otherwise(state.isin(*REVIEWABLE))
    )
    error = (
        F.when(~allowed, F.concat("event_type", F.lit(" invalid in "), state))
        .when(is_type("ApplicationSubmitted") & ~F.coalesce(F.col("requested_amount") > 0, F.lit(False)), "requested amount must be positive")
        .when(decides & ~F.coalesce(said.isin("APPROVE", "DECLINE", "REFER"), F.lit(False)), "unknown recommendation")
        .when(decides & (F.col("confidence") < 0.6) & (said != "REFER"), "low confidence must refer")
    )
    if named is not None:
        error = error.when(decides & (said == "APPROVE") & ~F.coalesce(F.col("named") == "CLEARED", F.col("cleared")), "approval needs cleared compliance")
    if has["override_reason"]:
        error = error.when(reviews & F.coalesce("override", F.lit(False)) & (F.coalesce("override_reason", F.lit("")) == ""), "override needs a reason")
    error = error.when(final & ~F.col("reviewed"), "no human review before final event")
    if named is not None:
        error = error.when(approves & ~F.col("cleared"), "compliance is not cleared")
    if has["limit_amount"]:
        error = error.when(approves & (F.col("approved_amount") > F.col("limit")), "amount exceeds the assessed limit")
    return _strict(rows, key, error, state, F.coalesce("sets", state), "EMPTY")


def compliance_record(log: DataFrame, key: str = "application_id") -> DataFrame:
    """Strict compliance replay (M-03): requested once, mandatory rules only, no pass after a failure."""
    rows = log.filter(is_type("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed")).select(key, "global_position", "event_type", "mandatory", "rule_id")
    request, passes, fails = (is_type(t) for t in ("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed"))
    earlier = Window.partitionBy(key).orderBy("global_position").rowsBetween(Window.unboundedPreceding, -1)
    of_rule = Window.partitionBy(key, "rule_id").orderBy("global_position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("failed_before", F.coalesce(F.max(fails).over(of_rule), F.lit(False)))
    rows = rows.withColumn("checks", F.first(F.when(request, F.coalesce("mandatory", F.array().cast("array<string>"))), ignorenulls=True).over(earlier))
    error = (
        F.when(request & F.col("checks").isNotNull(), "check requested twice").when(request & (F.coalesce(F.size("mandatory"), F.lit(0)) <= 0), "no checks required")
        .when(~request & F.col("checks").isNull(), "stream not initialized")
        .when(~request & ~F.coalesce(F.array_contains("checks", F.col("rule_id")), F.lit(False)), "rule is not mandatory")
        .when(passes & F.col("failed_before"), "rule has failed already")
    )
    rows = rows.withColumn("error", error)
    at = F.when(F.col("error").isNotNull(), F.col("global_position"))
    ends = rows.groupBy(key).agg(F.min_by("error", at).alias("first_error"), F.min(at).alias("error_position"))
    # What came before the first error: a rule that has failed has not passed.
    valid = rows.join(large(ends), key).filter(F.col("error_position").isNull() | (F.col("global_position") < F.col("error_position")))
    rules = valid.groupBy(key, "rule_id").agg(F.max(fails).alias("failed"), F.max(passes).alias("passed"), F.max(F.when(request, F.size(F.array_distinct("mandatory")))).alias("wanted"))
    counts = rules.groupBy(key).agg(
        F.count_if("failed").cast("int").alias("failed"), F.count_if(F.col("passed") & ~F.col("failed")).cast("int").alias("passed"), F.max("wanted").alias("wanted"),
    )
    out = ends.join(large(counts), key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("failed", "passed")})
    status = F.when(F.col("wanted").isNull(), "NOT_STARTED").when(F.col("failed") > 0, "FAILED").when(F.col("passed") == F.col("wanted"), "CLEARED").otherwise("PENDING")
    return out.select(key, status.alias("status"), "passed", "failed", "first_error", "error_position")


def accepted_commands(commands: DataFrame, heads: DataFrame, key: str = "stream_id") -> DataFrame:
    """Optimistic concurrency over a batch (K-01): of the commands that expect a stream's
    version the first wins and the others, like those that expect another, are conflicts.

    ``commands`` have command_id, the key and expected_version; ``heads`` the key and
    version.  -1 and 0 both mean a new stream.
    """
    version = F.coalesce("version", F.lit(0)).cast("long")
    joined = commands.join(large(heads), key, "left").withColumn("actual_version", version)
    expected = F.greatest(F.col("expected_version"), F.lit(0))
    fits = expected == F.col("actual_version")
    turn = F.row_number().over(Window.partitionBy(key, fits).orderBy("command_id"))
    won = fits & (turn == 1)
    return joined.withColumn("won", won).select("command_id", key, "expected_version", "actual_version", F.when(F.col("won"), "ACCEPTED").otherwise("CONFLICT").alias("outcome"), F.when(F.col("won"), F.col("actual_version") + 1).alias("new_version"))


def rate_limited(calls: DataFrame, key: str, at: str = "recorded_at", order: str = "global_position", seconds: int = 60) -> DataFrame:
    """Calls with ``allowed``: none within ``seconds`` after the last allowed call of its key (M-06).

    A refused call opens no window.  A call that comes a window or more after the one before it is
    allowed whatever was before, so that runs between such calls are judged side by side,
    a hot key's too; within a run one ordered pass carries the last allowed call.
    Calls without a key or time are refused; ties go by ``order``.
    """
    turn = Window.partitionBy(key).orderBy(at, order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    apart = micros - F.lag(micros).over(turn) >= seconds * 1_000_000
    rows = calls.withColumn("_at", micros).withColumn("_run", F.sum(F.coalesce(apart, F.lit(False)).cast("long")).over(turn))
    names = [key, "_run", "_at", order]
    rows = rows.repartition(key, "_run").sortWithinPartitions(*names)
    window = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, None
        for batch in batches:
            keys, runs = (batch.column(c).to_pylist() for c in names[:2])
            allowed = np.zeros(batch.num_rows, bool)
            for i, (name, part, time) in enumerate(zip(keys, runs, batch.column("_at").to_pylist())):
                if name is None or time is None:
                    continue
                if (name, part) != now:
                    now, until = (name, part), time
                if time >= until:
                    allowed[i], until = True, time + window
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed)], names=[*batch.schema.names, "allowed"])

    shape = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])
    return rows.mapInArrow(run, shape).drop("_at", "_run")


def session_readiness(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each decision whether its analyses exist and came before it (J-11, M-02)."""
    analyses = log.filter(is_type("CreditAnalysisCompleted")).groupBy("application_id").agg(F.count("*").alias("analyses"), F.max("limit_amount").alias("assessed_limit"), F.max("global_position").alias("last_analysis"))
    joined = decisions.join(large(analyses), "application_id", "left")
    return joined.select("application_id", F.coalesce("analyses", F.lit(0)).alias("analyses"), "assessed_limit", (F.coalesce(F.col("last_analysis") < F.col("global_position"), F.lit(False))).alias("ready"))
