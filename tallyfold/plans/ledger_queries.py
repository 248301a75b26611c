"""Scans, projections and analytics over the case log, each with its DuckDB text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import projections as pj
from ..sources.ledger import ACTIVITY_SQL, CASE_SQL, activity_log, case_log

AS_OF = dt.datetime(1998, 1, 1)
DAYS = 90
_AT = "TIMESTAMP '1998-01-01 00:00:00'"
_IN = f"recorded_at >= {_AT} - INTERVAL 90 DAY AND recorded_at <= {_AT}"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, log: str = CASE_SQL):
    """Registers a function of (spark, sf_dir) under its name with its SQL after the log's views."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = f"WITH {log}{sql}" if log else sql
        return function

    return add


SUMMARY_SQL = """, summary AS (
  SELECT application_id,
    coalesce(max_by(state, global_position) FILTER (WHERE state IS NOT NULL), 'SUBMITTED') AS current_state,
    max_by(upper(coalesce(recommendation, '')), global_position) FILTER (WHERE event_type = 'DecisionGenerated') AS decision_recommendation,
    max_by(fin, global_position) FILTER (WHERE fin IS NOT NULL) AS final_decision,
    max_by(requested_amount, global_position) FILTER (WHERE requested_amount IS NOT NULL) AS requested_amount,
    max_by(approved_amount, global_position) FILTER (WHERE approved_amount IS NOT NULL) AS approved_amount,
    max_by(cs, global_position) FILTER (WHERE cs IS NOT NULL) AS compliance_status,
    max_by(event_type, global_position) AS last_event_type, max(global_position) AS last_global_position, max_by(recorded_at, global_position) AS updated_at
  FROM (SELECT *,
      CASE event_type WHEN 'ApplicationSubmitted' THEN 'SUBMITTED' WHEN 'DecisionGenerated' THEN CASE recommendation WHEN 'APPROVE' THEN 'APPROVED_PENDING_HUMAN' WHEN 'DECLINE' THEN 'DECLINED_PENDING_HUMAN' ELSE 'PENDING_DECISION' END
        WHEN 'ApplicationApproved' THEN 'FINAL_APPROVED' WHEN 'ApplicationDeclined' THEN 'FINAL_DECLINED' END AS state,
      CASE event_type WHEN 'ApplicationApproved' THEN 'APPROVE' WHEN 'ApplicationDeclined' THEN 'DECLINE' WHEN 'HumanReviewCompleted' THEN final_decision END AS fin,
      CASE event_type WHEN 'ComplianceCheckRequested' THEN 'PENDING' WHEN 'ComplianceRulePassed' THEN 'PENDING' WHEN 'ComplianceRuleFailed' THEN 'FAILED' END AS cs
    FROM log)
  GROUP BY application_id
)"""

TIMELINE_SQL = """, checks AS (
  SELECT application_id, mandatory FROM log WHERE event_type = 'ComplianceCheckRequested'
), ruled AS (
  SELECT l.application_id, l.global_position, l.event_type, l.recorded_at, l.rule_id, l.failure_reason, c.mandatory,
    CASE l.event_type WHEN 'ComplianceRuleFailed' THEN 'F' WHEN 'ComplianceRulePassed' THEN 'P' END AS st
  FROM log l JOIN checks c USING (application_id) WHERE l.event_type LIKE 'Compliance%'
), lagged AS (
  SELECT *, CASE WHEN st IS NOT NULL THEN lag(st) OVER (PARTITION BY application_id, coalesce(rule_id, '#') ORDER BY global_position) END AS was FROM ruled
), running AS (
  SELECT *, CAST(sum(coalesce(CAST(st = 'F' AS INT), 0) - coalesce(CAST(was = 'F' AS INT), 0)) OVER w AS BIGINT) AS failed,
    CAST(sum((coalesce(CAST(st = 'P' AS INT), 0) - coalesce(CAST(was = 'P' AS INT), 0)) * CAST(coalesce(list_contains(mandatory, rule_id), false) AS INT)) OVER w AS BIGINT) AS passed
  FROM lagged WINDOW w AS (PARTITION BY application_id ORDER BY global_position ROWS UNBOUNDED PRECEDING)
), timeline AS (
  SELECT application_id, global_position, event_type, recorded_at, CAST(1 AS BIGINT) AS epoch, rule_id, failed, passed,
    CASE WHEN failed > 0 THEN 'FAILED' WHEN len(mandatory) > 0 AND passed = len(mandatory) THEN 'CLEARED' WHEN len(mandatory) > 0 THEN 'PENDING' ELSE 'NOT_STARTED' END AS status
  FROM running
)"""


# ------------------------------------------------------------------ scans


@query(" SELECT stream_id, stream_position, global_position, event_type, recorded_at FROM log WHERE stream_id = 'loan-7' AND stream_position BETWEEN 2 AND 6 ORDER BY stream_position LIMIT 4")
def stream_scan(spark, sf_dir):
    rows = case_log(spark, sf_dir).filter((F.col("application_id") == 7) & F.col("stream_position").between(2, 6))
    return rows.select("stream_id", "stream_position", "global_position", "event_type", "recorded_at").orderBy("stream_position").limit(4)


@query(" SELECT global_position, stream_id, event_type FROM log WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined') AND global_position > 500000")
def global_scan_by_type(spark, sf_dir):
    return case_log(spark, sf_dir).filter(pj.is_type("ApplicationApproved", "ApplicationDeclined") & (F.col("global_position") > 500000)).select("global_position", "stream_id", "event_type")


@query(" SELECT global_position, stream_id, event_type, payload FROM activity ORDER BY global_position DESC LIMIT 50", ACTIVITY_SQL)
def recent_events(spark, sf_dir):
    return activity_log(spark, sf_dir).select("global_position", "stream_id", "event_type", "payload").orderBy(F.desc("global_position")).limit(50)


@query(" SELECT stream_id, max(stream_position) AS version FROM activity GROUP BY stream_id", ACTIVITY_SQL)
def stream_versions(spark, sf_dir):
    return activity_log(spark, sf_dir).groupBy("stream_id").agg(F.max("stream_position").alias("version"))


@query(" SELECT DISTINCT stream_id FROM activity WHERE starts_with(stream_id, 'user-1') ORDER BY 1", ACTIVITY_SQL)
def streams_by_prefix(spark, sf_dir):
    return activity_log(spark, sf_dir).filter(F.startswith("stream_id", F.lit("user-1"))).select("stream_id").distinct().orderBy("stream_id")


@query(""" SELECT l.global_position, l.stream_id, l.event_type FROM log l
WHERE l.application_id IN (SELECT DISTINCT application_id FROM log WHERE agent_id = 'agent-3') OR (l.requested_amount > 400000)""")
def case_events_scope(spark, sf_dir):
    log = case_log(spark, sf_dir)
    # Whether an application is meant is told by one window over the rows as the log sorts them; no log is made for it.
    meant = F.max(F.col("agent_id") == "agent-3").over(Window.partitionBy("application_id"))
    return log.withColumn("meant", meant).filter("meant or requested_amount > 400000").select("global_position", "stream_id", "event_type")


# ------------------------------------------------------------ projections


@query(SUMMARY_SQL + " SELECT * FROM summary")
def application_summary(spark, sf_dir):
    return pj.application_summary(case_log(spark, sf_dir))


@query(SUMMARY_SQL + " SELECT current_state, count(*) AS n FROM summary GROUP BY 1")
def state_histogram(spark, sf_dir):
    return pj.state_histogram(pj.application_summary(case_log(spark, sf_dir)))


@query(SUMMARY_SQL + " SELECT application_id, current_state, updated_at FROM summary WHERE current_state = 'FINAL_APPROVED' ORDER BY updated_at DESC, application_id LIMIT 25 OFFSET 50")
def applications_page(spark, sf_dir):
    rows = pj.application_summary(case_log(spark, sf_dir)).filter("current_state = 'FINAL_APPROVED'")
    return rows.select("application_id", "current_state", "updated_at").orderBy(F.desc("updated_at"), "application_id").offset(50).limit(25)


@query(""" SELECT agent_id, model_version, CAST(0 AS BIGINT) AS sessions_started, CAST(0 AS BIGINT) AS fraud_screenings_completed,
  count(*) FILTER (WHERE event_type = 'CreditAnalysisCompleted') AS analyses_completed, count(*) FILTER (WHERE event_type = 'DecisionGenerated') AS decisions_recorded,
  count(*) FILTER (WHERE event_type = 'HumanReviewCompleted') AS human_reviews_completed, count(*) FILTER (WHERE event_type = 'HumanReviewCompleted' AND override) AS overrides_recorded,
  count(cents) AS confidence_samples, max(global_position) AS last_global_position,
  CASE WHEN count(cents) > 0 THEN CAST(sum(cents) AS DOUBLE) / (count(cents) * 100) ELSE 0 END AS avg_confidence,
  CASE WHEN count(*) FILTER (WHERE event_type = 'HumanReviewCompleted') > 0 THEN CAST(count(*) FILTER (WHERE event_type = 'HumanReviewCompleted' AND override) AS DOUBLE) / count(*) FILTER (WHERE event_type = 'HumanReviewCompleted') ELSE 0 END AS override_rate
FROM (SELECT event_type, override, global_position,
  CASE event_type WHEN 'CreditAnalysisCompleted' THEN agent_id WHEN 'DecisionGenerated' THEN orchestrator WHEN 'HumanReviewCompleted' THEN reviewer END AS agent_id,
  CASE event_type WHEN 'CreditAnalysisCompleted' THEN model_version WHEN 'DecisionGenerated' THEN 'unknown' WHEN 'HumanReviewCompleted' THEN 'human-review' END AS model_version,
  CASE WHEN confidence BETWEEN 0 AND 1 THEN CAST(round(confidence * 100) AS BIGINT) END AS cents FROM log)
WHERE agent_id IS NOT NULL GROUP BY agent_id, model_version""")
def agent_performance(spark, sf_dir):
    return pj.agent_performance(case_log(spark, sf_dir))


CLIENT_SQL = """, clients AS (
  SELECT *, CASE WHEN finalized_at >= submitted_at THEN round(date_diff('microsecond', submitted_at, finalized_at) / 3600e6, 4) END AS processing_hours FROM (
    SELECT application_id, min(recorded_at) FILTER (WHERE event_type = 'ApplicationSubmitted') AS submitted_at, min(recorded_at) FILTER (WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined')) AS finalized_at,
      min(recorded_at) FILTER (WHERE event_type = 'DecisionGenerated') AS decision_generated_at,
      min_by(CASE event_type WHEN 'ApplicationApproved' THEN 'APPROVED' ELSE 'DECLINED' END, global_position) FILTER (WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined')) AS final_decision,
      max_by(requested_amount, global_position) FILTER (WHERE requested_amount IS NOT NULL) AS requested_amount, max_by(approved_amount, global_position) FILTER (WHERE approved_amount IS NOT NULL) AS approved_amount,
      max_by(orchestrator, global_position) FILTER (WHERE orchestrator <> '') AS decision_agent_id, max(global_position) AS last_global_position
    FROM log WHERE event_type IN ('ApplicationSubmitted', 'DecisionGenerated', 'ApplicationApproved', 'ApplicationDeclined') GROUP BY application_id)
)"""


@query(CLIENT_SQL + " SELECT * FROM clients")
def client_analytics(spark, sf_dir):
    return pj.client_analytics(case_log(spark, sf_dir))


@query(TIMELINE_SQL + " SELECT * FROM timeline")
def compliance_timeline(spark, sf_dir):
    return pj.compliance_timeline(case_log(spark, sf_dir))


@query(TIMELINE_SQL + """, rules AS (
  SELECT application_id, rule_id, max_by(st, global_position) AS st, max_by(failure_reason, global_position) FILTER (WHERE failure_reason IS NOT NULL) AS any_reason,
    max_by(coalesce(failure_reason, ''), global_position) AS reason FROM ruled WHERE st IS NOT NULL GROUP BY ALL
), lists AS (
  SELECT application_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE st = 'P'), '') AS passed_checks,
    coalesce(string_agg(rule_id || '=' || reason, ',' ORDER BY rule_id) FILTER (WHERE st = 'F'), '') AS failed_checks FROM rules GROUP BY application_id
)
SELECT t.application_id, max_by(t.status, t.global_position) AS status, coalesce(any_value(passed_checks), '') AS passed_checks, coalesce(any_value(failed_checks), '') AS failed_checks, max(t.global_position) AS last_global_position
FROM timeline t LEFT JOIN lists USING (application_id) GROUP BY t.application_id""")
def compliance_state(spark, sf_dir):
    return pj.compliance_state(case_log(spark, sf_dir))


@query(TIMELINE_SQL + """, moments AS (
  SELECT o_orderkey AS application_id, o_orderdate + INTERVAL 30 DAY AS as_of FROM orders
)
SELECT m.application_id, m.as_of, t.global_position, t.status FROM moments m ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id, recorded_at ORDER BY global_position DESC) AS r FROM timeline) WHERE r = 1) t
ON m.application_id = t.application_id AND m.as_of >= t.recorded_at""")
def compliance_as_of(spark, sf_dir):
    moments = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("application_id"), (F.col("o_orderdate") + F.expr("interval '30' day")).alias("as_of"))
    timeline = pj.compliance_timeline(case_log(spark, sf_dir)).select("application_id", "recorded_at", "global_position", "status")
    return pj.as_of(timeline, moments).select("application_id", "as_of", "global_position", "status")


@query(SUMMARY_SQL + " SELECT count(*) AS open_issues FROM summary WHERE compliance_status IS NOT NULL AND compliance_status <> 'CLEARED'")
def open_compliance_issues(spark, sf_dir):
    return pj.application_summary(case_log(spark, sf_dir)).filter("compliance_status is not null and compliance_status <> 'CLEARED'").agg(F.count("*").alias("open_issues"))


# -------------------------------------------------------------- analytics

_DAYS = f"days AS (SELECT CAST(unnest(generate_series({_AT} - INTERVAL 89 DAY, {_AT}, INTERVAL 1 DAY)) AS DATE) AS day)"


@query(f""", {_DAYS}, per AS (
  SELECT CAST(recorded_at AS DATE) AS day, count(*) FILTER (WHERE event_type = 'ApplicationSubmitted') AS submitted, count(*) FILTER (WHERE event_type = 'ApplicationApproved') AS approved, count(*) FILTER (WHERE event_type = 'ApplicationDeclined') AS declined FROM log GROUP BY 1
) SELECT day, coalesce(submitted, 0) AS submitted, coalesce(approved, 0) AS approved, coalesce(declined, 0) AS declined FROM days LEFT JOIN per USING (day)""")
def approval_trend(spark, sf_dir):
    return an.approval_trend(case_log(spark, sf_dir), AS_OF, DAYS)


@query(f""" SELECT *, CASE WHEN approved + declined > 0 THEN round(100.0 * approved / (approved + declined), 2) END AS approval_rate FROM (
SELECT count(*) FILTER (WHERE event_type = 'ApplicationSubmitted') AS submitted, count(*) FILTER (WHERE event_type = 'ApplicationApproved') AS approved, count(*) FILTER (WHERE event_type = 'ApplicationDeclined') AS declined,
  CAST(coalesce(sum(CAST(round(requested_amount * 100) AS BIGINT)), 0) AS DOUBLE) / 100 AS requested_total, CAST(coalesce(sum(CAST(round(approved_amount * 100) AS BIGINT)), 0) AS DOUBLE) / 100 AS approved_total
FROM log WHERE {_IN})""")
def kpi_summary(spark, sf_dir):
    return an.kpi_summary(case_log(spark, sf_dir), AS_OF, DAYS)


@query(f""" SELECT count(*) AS n, round(CAST(sum(s) AS DOUBLE) / count(*) / 3600, 4) AS mean_hours, round(quantile_cont(s, 0.5) / 3600, 4) AS median_hours FROM (
  SELECT date_diff('second', submitted_at, decided_at) AS s FROM (SELECT application_id, min(recorded_at) AS submitted_at FROM log WHERE event_type = 'ApplicationSubmitted' AND {_IN} GROUP BY 1)
  JOIN (SELECT application_id, min(recorded_at) AS decided_at FROM log WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined') GROUP BY 1) USING (application_id) WHERE decided_at >= submitted_at)""")
def turnaround(spark, sf_dir):
    return an.turnaround(case_log(spark, sf_dir), AS_OF, DAYS)


@query(f""" SELECT count(DISTINCT application_id) FILTER (WHERE event_type = 'ApplicationSubmitted') AS submitted, count(DISTINCT application_id) FILTER (WHERE event_type = 'CreditAnalysisCompleted') AS analysed,
  count(DISTINCT application_id) FILTER (WHERE event_type IN ('ComplianceRulePassed', 'ComplianceRuleFailed')) AS checked, count(DISTINCT application_id) FILTER (WHERE event_type = 'DecisionGenerated') AS decided,
  count(DISTINCT application_id) FILTER (WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined')) AS finalized FROM log WHERE {_IN}""")
def funnel(spark, sf_dir):
    return an.funnel(case_log(spark, sf_dir), AS_OF, DAYS)


@query(f""" SELECT *, CASE WHEN passed + failed > 0 THEN round(100.0 * passed / (passed + failed), 2) END AS pass_rate FROM (
  SELECT count(*) FILTER (WHERE event_type = 'ComplianceCheckRequested') AS requested, count(*) FILTER (WHERE event_type = 'ComplianceRulePassed') AS passed, count(*) FILTER (WHERE event_type = 'ComplianceRuleFailed') AS failed FROM log WHERE {_IN})""")
def compliance_counters(spark, sf_dir):
    return an.compliance_counters(case_log(spark, sf_dir), AS_OF, DAYS)


@query(f" SELECT rule_id, failure_reason, count(*) AS failures, count(DISTINCT application_id) AS applications FROM log WHERE event_type = 'ComplianceRuleFailed' AND {_IN} GROUP BY 1, 2 ORDER BY failures DESC, rule_id, failure_reason LIMIT 5")
def top_failed_rules(spark, sf_dir):
    """The log has no rule versions; the reason stands in as the second key."""
    return an.top_failed_rules(case_log(spark, sf_dir), AS_OF, DAYS, keys=("rule_id", "failure_reason"))


@query(f" SELECT count(*) AS reviews, count(*) FILTER (WHERE override) AS overrides, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE override) / count(*), 2) END AS override_rate FROM log WHERE event_type = 'HumanReviewCompleted' AND {_IN}")
def override_rate(spark, sf_dir):
    return an.override_rate(case_log(spark, sf_dir), AS_OF, DAYS)


_OUTCOMES = """, outcomes AS (
  SELECT application_id, CASE WHEN bool_or(event_type = 'ApplicationApproved') THEN 'APPROVED' ELSE 'DECLINED' END AS outcome FROM log WHERE event_type IN ('ApplicationApproved', 'ApplicationDeclined') GROUP BY 1
)"""


@query(_OUTCOMES + f""" SELECT *, CASE WHEN approved + declined > 0 THEN round(100.0 * approved / (approved + declined), 2) END AS approval_rate FROM (
  SELECT orchestrator AS agent_id, count(*) AS decisions, NULL::DOUBLE AS avg_confidence, count(*) FILTER (WHERE outcome = 'APPROVED') AS approved, count(*) FILTER (WHERE outcome = 'DECLINED') AS declined
  FROM log LEFT JOIN outcomes USING (application_id) WHERE event_type = 'DecisionGenerated' AND {_IN} GROUP BY 1) ORDER BY decisions DESC, agent_id LIMIT 6""")
def agent_leaderboard(spark, sf_dir):
    return an.agent_leaderboard(case_log(spark, sf_dir), AS_OF, DAYS)


_INSIDE = "BETWEEN " + _AT + " - INTERVAL 90 DAY AND " + _AT


@query(CLIENT_SQL + f""" SELECT *, CASE WHEN approved + declined > 0 THEN round(100.0 * approved / (approved + declined), 2) ELSE 0 END AS approval_rate FROM (
  SELECT count(*) FILTER (WHERE submitted_at {_INSIDE}) AS submitted, count(*) FILTER (WHERE finalized_at {_INSIDE} AND final_decision = 'APPROVED') AS approved,
    count(*) FILTER (WHERE finalized_at {_INSIDE} AND final_decision = 'DECLINED') AS declined, count(*) FILTER (WHERE finalized_at IS NULL) AS open,
    coalesce(round(CAST(sum(date_diff('second', submitted_at, finalized_at)) FILTER (WHERE finalized_at {_INSIDE} AND finalized_at >= submitted_at) AS DOUBLE) / count(*) FILTER (WHERE finalized_at {_INSIDE} AND finalized_at >= submitted_at), 2), 0) AS mean_seconds FROM clients)""")
def metrics_summary(spark, sf_dir):
    return an.metrics_summary(pj.client_analytics(case_log(spark, sf_dir)), AS_OF, DAYS)


@query(CLIENT_SQL + f""", {_DAYS}, sub AS (SELECT CAST(submitted_at AS DATE) AS day, count(*) AS submitted FROM clients GROUP BY 1
), fin AS (SELECT CAST(finalized_at AS DATE) AS day, count(*) FILTER (WHERE final_decision = 'APPROVED') AS approved, count(*) FILTER (WHERE final_decision = 'DECLINED') AS declined,
  round(CAST(sum(date_diff('second', submitted_at, finalized_at)) AS DOUBLE) / count(*), 2) AS mean_seconds FROM clients WHERE finalized_at IS NOT NULL GROUP BY 1
) SELECT day, coalesce(submitted, 0) AS submitted, coalesce(approved, 0) AS approved, coalesce(declined, 0) AS declined, coalesce(mean_seconds, 0) AS mean_seconds FROM days LEFT JOIN sub USING (day) LEFT JOIN fin USING (day)""")
def metrics_daily(spark, sf_dir):
    return an.metrics_daily(pj.client_analytics(case_log(spark, sf_dir)), AS_OF, DAYS)


@query(_OUTCOMES + f""", act AS (
  SELECT agent_id, count(*) AS activity FROM (
    SELECT agent_id FROM log WHERE event_type = 'CreditAnalysisCompleted' AND {_IN}
    UNION ALL SELECT orchestrator FROM log WHERE event_type = 'DecisionGenerated' AND {_IN}
    UNION ALL SELECT reviewer FROM log WHERE event_type = 'HumanReviewCompleted' AND {_IN}) GROUP BY 1
), dec AS (
  SELECT orchestrator AS agent_id, count(*) AS decisions, count(*) FILTER (WHERE outcome = 'APPROVED') AS approved FROM log LEFT JOIN outcomes USING (application_id) WHERE event_type = 'DecisionGenerated' AND {_IN} GROUP BY 1
) SELECT agent_id, coalesce(activity, 0) AS activity, coalesce(decisions, 0) AS decisions, coalesce(approved, 0) AS approved, CASE WHEN decisions > 0 THEN round(100.0 * approved / decisions, 2) ELSE 0 END AS approved_share
FROM act FULL OUTER JOIN dec USING (agent_id)""")
def metrics_agents(spark, sf_dir):
    return an.metrics_agents(case_log(spark, sf_dir), AS_OF, DAYS)
