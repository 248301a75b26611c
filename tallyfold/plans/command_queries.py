"""Command, delivery and provenance queries, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as cm
from ..operators import lineage, outbox, scans
from ..operators import projections as pj
from ..operators import refinery as rf
from ..sources.dossier import DOSSIER_SQL, dossier_log
from ..sources.ledger import ACTIVITY_SQL, CASE_SQL, activity_log, case_log
from .ledger_queries import SUMMARY_SQL, TIMELINE_SQL, query
from .refinery_queries import _REPORTS, _reports
from .replay_queries import _LINEAGE

_STATE_SQL = TIMELINE_SQL + SUMMARY_SQL + """, st AS (
  SELECT s.application_id, current_state, (SELECT max_by(status, global_position) FROM timeline t WHERE t.application_id = s.application_id) AS compliance,
    (SELECT max(limit_amount) FROM log l WHERE l.application_id = s.application_id) AS assessed_limit FROM summary s
)"""


def _state(spark, sf_dir):
    log = case_log(spark, sf_dir)
    return cm.case_state(log, pj.application_summary(log), pj.compliance_state(log))


@query(_STATE_SQL + """, cmd AS (SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS application_id, CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'DECLINE' WHEN 2 THEN 'refer' ELSE 'MAYBE' END AS rec, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS confidence FROM orders
), j AS (SELECT *, CASE WHEN confidence < 0.6 THEN 'REFER' ELSE upper(rec) END AS said FROM cmd LEFT JOIN st USING (application_id)
), r AS (SELECT *, CASE WHEN current_state IS NULL THEN 'application does not exist' WHEN starts_with(current_state, 'FINAL_') THEN 'application is final' WHEN upper(rec) NOT IN ('APPROVE', 'DECLINE', 'REFER') THEN 'unknown recommendation'
  WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN compliance IN ('NOT_STARTED', 'PENDING') THEN 'compliance is incomplete' WHEN said = 'APPROVE' AND compliance <> 'CLEARED' THEN 'compliance is not cleared' WHEN said = 'APPROVE' AND assessed_limit IS NULL THEN 'no analysis result' END AS reason FROM j)
SELECT command_id, application_id, CASE WHEN reason IS NULL THEN 'DecisionGenerated' END AS event_type, CASE WHEN reason IS NULL THEN said END AS recommendation, CASE WHEN reason IS NULL THEN assessed_limit END AS assessed_limit, reason FROM r""")
def command_decisions(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.when(key % 4 == 0, "approve").when(key % 4 == 1, "DECLINE").when(key % 4 == 2, "refer").otherwise("MAYBE")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return cm.decide(orders.select(key.alias("command_id"), F.when(key % 10 == 0, -key - 1).otherwise(key).alias("application_id"), said.alias("recommendation"), ((key % 13).cast("double") / 10).alias("confidence")), _state(spark, sf_dir))


@query(_STATE_SQL + """, cmd AS (SELECT o_orderkey AS command_id, o_orderkey AS application_id, CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'DECLINE' ELSE 'HOLD' END AS d, o_orderkey % 5 = 0 AS override, CASE WHEN o_orderkey % 2 = 0 THEN 'seen' END AS override_reason, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS approved_amount FROM orders
), r AS (SELECT *, CASE WHEN starts_with(current_state, 'FINAL_') THEN 'application is final' WHEN upper(d) NOT IN ('APPROVE', 'DECLINE') THEN 'unknown decision' WHEN override AND override_reason IS NULL THEN 'override needs a reason' WHEN upper(d) = 'APPROVE' AND approved_amount IS NULL THEN 'approval needs an amount'
  WHEN upper(d) = 'APPROVE' AND compliance <> 'CLEARED' THEN 'compliance is not cleared' WHEN upper(d) = 'APPROVE' AND approved_amount > assessed_limit THEN 'amount exceeds the assessed limit' END AS reason FROM cmd JOIN st USING (application_id))
SELECT command_id, application_id, CAST(turn AS INTEGER) AS turn, CASE WHEN reason IS NOT NULL THEN NULL WHEN turn = 0 THEN 'HumanReviewCompleted' WHEN upper(d) = 'APPROVE' THEN 'ApplicationApproved' ELSE 'ApplicationDeclined' END AS event_type, reason
FROM r, (SELECT unnest([0, 1]) AS turn) WHERE turn = 0 OR reason IS NULL""")
def command_reviews(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, "approve").when(key % 3 == 1, "DECLINE").otherwise("HOLD")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    given = orders.select(key.alias("command_id"), key.alias("application_id"), said.alias("final_decision"), (key % 5 == 0).alias("override"), F.when(key % 2 == 0, "seen").alias("override_reason"), F.when(key % 7 > 0, F.col("o_totalprice")).alias("approved_amount"))
    return cm.review(given, _state(spark, sf_dir))


@query(""" SELECT global_position AS outbox_id, stream_id AS key, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","global_position":' || global_position || ',"payload":' || replace(payload, ' ', '') || ',"stream_id":"' || stream_id || '"}' AS value, CAST(2 AS INTEGER) AS n_headers FROM activity""", ACTIVITY_SQL)
def outbox_messages(spark, sf_dir):
    return outbox.messages(activity_log(spark, sf_dir)).select("outbox_id", "key", "value", F.size("headers").alias("n_headers"))


@query(" SELECT DISTINCT global_position // 2 AS outbox_id FROM activity WHERE global_position // 2 NOT IN (SELECT user_id FROM activity)", ACTIVITY_SQL)
def delivered_once(spark, sf_dir):
    """Messages come twice each; those that the sink has are the users' numbers."""
    log = activity_log(spark, sf_dir)
    sink = log.select(F.col("user_id").alias("outbox_id")).distinct()
    return outbox.delivered_once(sink, log.select(F.floor(F.col("global_position") / 2).cast("long").alias("outbox_id")))


@query(_LINEAGE + " SELECT * FROM lin WHERE event_type = 'CreditAnalysisCompleted' AND actor = 'agent-5' AND recorded_at BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 17520 HOUR AND TIMESTAMP '1998-01-01'", CASE_SQL)
def lineage_filtered(spark, sf_dir):
    return lineage.narrowed(lineage.lineage(case_log(spark, sf_dir)), "1998-01-01 00:00:00", "CreditAnalysisCompleted", "agent-5", 17520)


@query(_REPORTS.replace("WITH reports", "WITH reports", 1) + " SELECT f.doc_id, 'doc:r' || f.doc_id AS source_chunk_id, metric_name, substr(content, 1, 180) AS excerpt FROM facts f JOIN reports USING (doc_id)", "")
def fact_provenance(spark, sf_dir):
    reports = _reports(spark, sf_dir).withColumn("chunk_id", F.concat(F.lit("r"), "doc_id"))
    found = rf.facts(reports).withColumn("source_chunk_id", F.concat(F.lit("doc:"), "source_chunk_id"))
    return rf.provenance(found, reports).select("doc_id", "source_chunk_id", "metric_name", "excerpt")


_LANE_SQL = """ CASE WHEN event_type = 'ApplicationSubmitted' THEN 'Intake' WHEN event_type = 'AgentContextLoaded' THEN 'Agent Session' WHEN event_type LIKE 'Credit%' THEN 'CreditAnalysis'
    WHEN event_type LIKE 'Fraud%' THEN 'FraudDetection' WHEN event_type LIKE 'Compliance%' THEN 'ComplianceAgent' WHEN event_type = 'DecisionGenerated' THEN 'DecisionOrchestrator'
    WHEN event_type = 'HumanReviewCompleted' THEN 'Human Review' ELSE 'Final Decision' END AS lane,
  CASE WHEN event_type LIKE 'Compliance%' THEN 'Regulatory evidence' WHEN event_type = 'DecisionGenerated' THEN 'Machine checkpoint' WHEN event_type = 'HumanReviewCompleted' THEN 'Binding review'
    WHEN event_type IN ('ApplicationApproved', 'ApplicationDeclined') THEN 'Final disposition' ELSE 'Operational event' END AS checkpoint,
  CASE WHEN event_type = 'ApplicationSubmitted' THEN 'Intake' WHEN event_type LIKE 'Credit%' OR event_type LIKE 'Fraud%' OR event_type = 'AgentContextLoaded' THEN 'Analysis'
    WHEN event_type LIKE 'Compliance%' THEN 'Compliance' WHEN event_type = 'DecisionGenerated' THEN 'Decision' ELSE 'Final Outcome' END AS phase,
  CASE WHEN event_type IN ('ComplianceRuleFailed', 'ApplicationDeclined') THEN 'critical' WHEN event_type LIKE '%Review%' THEN 'warning' WHEN event_type LIKE '%Requested' THEN 'info'
    WHEN event_type = 'ApplicationApproved' THEN 'ok' ELSE 'neutral' END AS tone"""


@query(
    f""" SELECT event_id, CASE WHEN application_id % 6 = 0 THEN 'clerk' WHEN event_type LIKE 'Compliance%' THEN 'ComplianceAgent' WHEN event_type = 'ApplicationSubmitted' THEN 'Loan Intake'
    WHEN event_type = 'DecisionGenerated' THEN orchestrator WHEN event_type = 'HumanReviewCompleted' THEN reviewer WHEN event_type IN ('ApplicationApproved', 'ApplicationDeclined') THEN 'Loan Officer'
    WHEN event_type = 'CreditAnalysisRequested' THEN 'CreditAnalysis' ELSE agent_id END AS actor, {_LANE_SQL} FROM log""",
    DOSSIER_SQL,
)
def lineage_annotated(spark, sf_dir):
    """Every event with who acted, its lane, checkpoint, phase and tone; some carry their actor in the metadata, some a blank one."""
    log = dossier_log(spark, sf_dir)
    payload = F.to_json(F.struct("agent_id", F.col("orchestrator").alias("orchestrator_agent_id"), F.col("reviewer").alias("reviewer_id")))
    metadata = F.when(F.col("application_id") % 6 == 0, '{"actor_id":"clerk"}').when(F.col("application_id") % 6 == 1, '{"actor_id":" "}').otherwise("{}")
    rows = lineage.annotated(log.select("event_id", "event_type", payload.alias("payload"), metadata.alias("metadata")))
    return rows.select("event_id", "actor", "lane", "checkpoint", "phase", "tone")


def _versioned(spark, sf_dir):
    """The dossier log with analyses of the first version, whose payload lacks what the second has."""
    log = dossier_log(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("application_id").cast("string").alias("application_id"), "agent_id", F.col("confidence").alias("confidence_score")))
    return log.select("stream_id", "stream_position", "global_position", "event_type", F.lit(1).alias("event_version"), "recorded_at", payload.alias("payload"), F.lit("{}").alias("metadata"))


_UPCAST_SQL = """CASE WHEN event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated') THEN 2 ELSE 1 END AS event_version,
  CASE WHEN event_type = 'CreditAnalysisCompleted' THEN 'credit-v1' END AS model, CASE WHEN event_type = 'DecisionGenerated' THEN 'LEGACY_EVENT_NO_SUMMARY' END AS summary"""


def _shown(rows):
    of = lambda k: F.get_json_object("payload", f"$.{k}")
    return rows.select("stream_id", "stream_position", "global_position", "event_type", "event_version", of("model_version").alias("model"), of("decision_basis_summary").alias("summary"))


@query(f" SELECT stream_id, stream_position, global_position, event_type, {_UPCAST_SQL} FROM log WHERE stream_id = 'loan-7' AND stream_position BETWEEN 2 AND 9 ORDER BY stream_position LIMIT 3", DOSSIER_SQL)
def stream_scan_latest(spark, sf_dir):
    """A stream within bounds, as the latest versions of its types say."""
    return _shown(scans.stream(_versioned(spark, sf_dir), "loan-7", 2, 9, 3))


@query(
    f""" SELECT stream_id, stream_position, global_position, event_type, {_UPCAST_SQL} FROM log WHERE global_position > 30000 AND event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated', 'ApplicationApproved')
ORDER BY global_position LIMIT 500""",
    DOSSIER_SQL,
)
def global_scan_latest(spark, sf_dir):
    """Events behind a position of three types, as their latest versions say."""
    return _shown(scans.after(_versioned(spark, sf_dir), 30000, ["CreditAnalysisCompleted", "DecisionGenerated", "ApplicationApproved"], 500))
