"""Windowed analytics of the case log.  ``as_of`` is always a parameter, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .projections import is_type
from .quantiles import continuous

WINDOWS = (7, 30, 90)


def _bounds(as_of: dt.datetime, days: int) -> tuple[Column, Column]:
    if days not in WINDOWS:
        raise ValueError(f"a window of {', '.join(map(str, WINDOWS))} days is needed")
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")


def recent(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Events of the trailing window up to ``as_of`` (P-03)."""
    low, high = _bounds(as_of, days)
    return log.filter((F.col("recorded_at") >= low) & (F.col("recorded_at") <= high))


def calendar(frame: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """The days of the window, the last that of ``as_of`` (S-17)."""
    first = as_of.date() - dt.timedelta(days=days - 1)
    return frame.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(as_of.date()))).alias("day"))


def percentage(a: Column, b: Column, empty: float | None = None) -> Column:
    return F.when(b > 0, F.round(100.0 * a / b, 2)).otherwise(F.lit(empty).cast("double"))


def _count(*names: str) -> Column:
    return F.count_if(is_type(*names)).cast("long")


def _cents(column: str, *names: str) -> Column:
    """An exact sum of amounts in hundredths, as units."""
    return F.coalesce(F.sum(F.when(is_type(*names), F.round(F.col(column) * 100).cast("long"))), F.lit(0)) / 100.0


def approval_trend(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Submitted, approved and declined a day, zero-filled (J-01, A-13): one scan, one join with the calendar."""
    low = F.lit(as_of.date() - dt.timedelta(days=days - 1))
    day = F.col("recorded_at").cast("date")
    counts = log.filter((day >= low) & (day <= F.lit(as_of.date()))).groupBy(day.alias("day")).agg(
        _count("ApplicationSubmitted").alias("submitted"), _count("ApplicationApproved").alias("approved"), _count("ApplicationDeclined").alias("declined")
    )
    names = ("submitted", "approved", "declined")
    return calendar(log, as_of, days).join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def kpi_summary(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Counts and amounts of the window and the approval rate (A-02)."""
    row = recent(log, as_of, days).agg(
        _count("ApplicationSubmitted").alias("submitted"), _count("ApplicationApproved").alias("approved"), _count("ApplicationDeclined").alias("declined"),
        _cents("requested_amount", "ApplicationSubmitted").alias("requested_total"), _cents("approved_amount", "ApplicationApproved").alias("approved_total"),
    )
    return row.withColumn("approval_rate", percentage(F.col("approved"), F.col("approved") + F.col("declined")))


def turnaround(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Number, mean and continuous median of hours from submission to final decision (A-03).

    The window restricts submissions, not decisions.
    """
    final = log.filter(is_type("ApplicationApproved", "ApplicationDeclined")).groupBy("application_id").agg(F.min("recorded_at").alias("decided_at"))
    asked = recent(log, as_of, days).filter(is_type("ApplicationSubmitted")).groupBy("application_id").agg(F.min("recorded_at").alias("submitted_at"))
    pairs = asked.join(final, "application_id").filter("decided_at >= submitted_at").select(F.expr("timestampdiff(SECOND, submitted_at, decided_at)").alias("s"))
    pairs = kept(pairs)
    (median,) = continuous(pairs, "s", [0.5])
    mean = F.round(F.sum("s") / F.count("s") / 3600.0, 4)
    return pairs.agg(F.count("*").alias("n"), mean.alias("mean_hours"), F.round(F.lit(median).cast("double") / 3600.0, 4).alias("median_hours"))


def funnel(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Applications that reached each stage, counted apart (A-04); (application, stage) is made distinct first."""
    stage = F.when(is_type("ApplicationSubmitted"), "submitted").when(is_type("CreditAnalysisCompleted"), "analysed").when(is_type("ComplianceRulePassed", "ComplianceRuleFailed"), "checked").when(is_type("DecisionGenerated"), "decided").when(is_type("ApplicationApproved", "ApplicationDeclined"), "finalized")
    once = recent(log, as_of, days).select("application_id", stage.alias("stage")).filter("stage is not null").distinct()
    return once.agg(*[F.count_if(F.col("stage") == s).cast("long").alias(s) for s in ("submitted", "analysed", "checked", "decided", "finalized")])


def compliance_counters(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    row = recent(log, as_of, days).agg(_count("ComplianceCheckRequested").alias("requested"), _count("ComplianceRulePassed").alias("passed"), _count("ComplianceRuleFailed").alias("failed"))
    return row.withColumn("pass_rate", percentage(F.col("passed"), F.col("passed") + F.col("failed")))


def top_failed_rules(log: DataFrame, as_of: dt.datetime, days: int, k: int = 5, keys: tuple[str, str] = ("rule_id", "rule_version")) -> DataFrame:
    """The k rules and versions that failed most (A-06, O-03); ties in order of the keys."""
    failed = recent(log, as_of, days).filter(is_type("ComplianceRuleFailed"))
    return failed.groupBy(*keys).agg(F.count("*").alias("failures"), F.countDistinct("application_id").alias("applications")).orderBy(F.desc("failures"), *keys).limit(k)


def override_rate(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    row = recent(log, as_of, days).filter(is_type("HumanReviewCompleted")).agg(F.count("*").alias("reviews"), F.count_if("override").cast("long").alias("overrides"))
    return row.withColumn("override_rate", percentage(F.col("overrides"), F.col("reviews")))


def outcomes(log: DataFrame) -> DataFrame:
    """APPROVED or DECLINED of each application with a final event; approval wins (A-08)."""
    final = log.filter(is_type("ApplicationApproved", "ApplicationDeclined")).groupBy("application_id").agg(F.bool_or(is_type("ApplicationApproved")).alias("approved"))
    return final.select("application_id", F.when(F.col("approved"), "APPROVED").otherwise("DECLINED").alias("outcome"))


def agent_leaderboard(log: DataFrame, as_of: dt.datetime, days: int, k: int = 6) -> DataFrame:
    """Decisions of each orchestrator with their mean confidence and outcomes (A-09, J-03)."""
    agent = F.coalesce(F.nullif(F.col("orchestrator"), F.lit("")), F.lit("unknown"))
    decisions = recent(log, as_of, days).filter(is_type("DecisionGenerated")).select("application_id", agent.alias("agent_id"), F.round(F.col("confidence") * 1e6).cast("long").alias("c"))
    of = lambda name: F.count_if(F.col("outcome") == name).cast("long")
    out = decisions.join(outcomes(log), "application_id", "left").groupBy("agent_id").agg(
        F.count("*").alias("decisions"), (F.sum("c") / F.count("c") / 1e6).alias("avg_confidence"), of("APPROVED").alias("approved"), of("DECLINED").alias("declined")
    )
    rate = percentage(F.col("approved"), F.col("approved") + F.col("declined"))
    return out.withColumn("approval_rate", rate).orderBy(F.desc("decisions"), "agent_id").limit(k)


def trailing(trend: DataFrame, rows: int = 7, day: str = "day") -> DataFrame:
    """The last rows of a trend (W-12)."""
    return trend.orderBy(F.desc(day)).limit(rows)


def metrics_summary(clients: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Counts and hours from the client view (A-12); empty rates are 0."""
    low, high = _bounds(as_of, days)
    inside = lambda c: (F.col(c) >= low) & (F.col(c) <= high)
    final, seconds = inside("finalized_at"), F.expr("timestampdiff(SECOND, submitted_at, finalized_at)")
    row = clients.agg(
        F.count_if(inside("submitted_at")).cast("long").alias("submitted"), F.count_if(final & (F.col("final_decision") == "APPROVED")).cast("long").alias("approved"),
        F.count_if(final & (F.col("final_decision") == "DECLINED")).cast("long").alias("declined"), F.count_if(F.col("finalized_at").isNull()).cast("long").alias("open"),
        F.coalesce(F.round(F.avg(F.when(final & (seconds >= 0), seconds)), 2), F.lit(0.0)).alias("mean_seconds"),
    )
    return row.withColumn("approval_rate", percentage(F.col("approved"), F.col("approved") + F.col("declined"), 0.0))


def metrics_daily(clients: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Submitted and finalized a day with mean seconds to decide, zero-filled (A-13)."""
    low = F.lit(as_of.date() - dt.timedelta(days=days - 1))
    part = lambda c: clients.filter((F.col(c).cast("date") >= low) & (F.col(c).cast("date") <= F.lit(as_of.date())))
    submitted = part("submitted_at").groupBy(F.col("submitted_at").cast("date").alias("day")).agg(F.count("*").alias("submitted"))
    seconds = F.expr("timestampdiff(SECOND, submitted_at, finalized_at)")
    final = part("finalized_at").groupBy(F.col("finalized_at").cast("date").alias("day")).agg(
        F.count_if(F.col("final_decision") == "APPROVED").cast("long").alias("approved"), F.count_if(F.col("final_decision") == "DECLINED").cast("long").alias("declined"),
        F.sum(seconds).alias("s"), F.count(seconds).alias("c"),
    )
    joined = calendar(clients, as_of, days).join(submitted, "day", "left").join(final, "day", "left")
    return joined.select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("submitted", "approved", "declined")], F.coalesce(F.round(F.col("s") / F.col("c"), 2), F.lit(0.0)).alias("mean_seconds"))


def metrics_agents(log: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Activity of every agent merged with its decisions and their outcomes (A-14, A-15, J-06, O-04)."""
    rows = recent(log, as_of, days)
    agent = F.when(is_type("CreditAnalysisCompleted"), F.col("agent_id")).when(is_type("DecisionGenerated"), F.col("orchestrator")).when(is_type("HumanReviewCompleted"), F.col("reviewer"))
    activity = rows.select(F.nullif(agent, F.lit("")).alias("agent_id")).filter("agent_id is not null").groupBy("agent_id").agg(F.count("*").alias("activity"))
    decisions = rows.filter(is_type("DecisionGenerated")).select("application_id", F.col("orchestrator").alias("agent_id")).join(outcomes(log), "application_id", "left")
    decisions = decisions.groupBy("agent_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("outcome") == "APPROVED").cast("long").alias("approved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    merged = activity.join(decisions, "agent_id", "full_outer").select("agent_id", zero("activity"), zero("decisions"), zero("approved"))
    return merged.withColumn("approved_share", percentage(F.col("approved"), F.col("decisions"), 0.0)).orderBy(F.desc("activity"), F.desc("decisions"), "agent_id")
