"""A second ledger view of the orders, with sessions, fraud screens, resets, verdicts and causes.

Each order gives one row an event in the streams ``loan-``, ``agent-`` and ``compliance-``;
the share of each irregular case follows from the order's key.  Events of a row are made
by one explode of their numbers.  The texts below are scalar SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payload columns and their types in both dialects.
FIELDS = {
    "requested_amount": "double", "approved_amount": "double", "agent_id": "string", "model_version": "string", "confidence": "double", "limit_amount": "double",
    "fraud_score": "double", "mandatory": "string", "rule_id": "string", "failure_reason": "string", "overall_verdict": "string", "recommendation": "string",
    "orchestrator": "string", "decision_model": "string", "compliance_status": "string", "reviewer": "string", "override": "boolean", "override_reason": "string",
    "final_decision": "string",
}
_K = "o_orderkey"
_FINAL = "o_orderstatus IN ('F', 'O')"
_CLEAR = f"({_K} % 4 <> 0 OR {_K} % 8 = 0)"
_LOAN, _AGENT, _CHECK = f"'loan-' || {_K}", f"'agent-a' || ({_K} % 7) || '-s' || {_K}", f"'compliance-' || {_K}"

#: (sequence number, type, stream, where it occurs, number of its cause, payload).
EVENTS = [
    (10, "ApplicationSubmitted", _LOAN, "true", None, {"requested_amount": f"CASE WHEN {_K} % 41 = 0 THEN -1.0 ELSE o_totalprice END"}),
    (11, "CreditAnalysisRequested", _LOAN, f"{_K} % 23 <> 0", 10, {}),
    (20, "AgentContextLoaded", _AGENT, f"{_K} % 11 <> 0", None, {"agent_id": f"'a' || ({_K} % 7)", "model_version": f"'m' || ({_K} % 3)"}),
    (21, "CreditAnalysisCompleted", _AGENT, "true", 10, {
        "agent_id": f"'a' || ({_K} % 7)", "model_version": f"CASE WHEN {_K} % 13 = 0 THEN 'mx' ELSE 'm' || ({_K} % 3) END",
        "confidence": f"CASE WHEN {_K} % 10 < 9 THEN ({_K} % 10) / 10.0 END", "limit_amount": f"CASE WHEN {_K} % 3 = 0 THEN o_totalprice * 0.5 ELSE o_totalprice * 1.5 END"}),
    (22, "FraudScreeningCompleted", _AGENT, f"{_K} % 5 <> 0", 10, {"agent_id": f"'a' || ({_K} % 7)", "model_version": f"'m' || ({_K} % 3)", "fraud_score": f"({_K} % 20) / 20.0"}),
    (30, "ComplianceCheckRequested", _CHECK, "true", 10, {"mandatory": "'a,b'"}),
    (31, "ComplianceRulePassed", _CHECK, "true", 30, {"rule_id": "'a'"}),
    (32, "ComplianceRulePassed", _CHECK, f"{_K} % 4 <> 0", 30, {"rule_id": "'b'"}),
    (33, "ComplianceRuleFailed", _CHECK, f"{_K} % 4 = 0", 30, {"rule_id": "'b'", "failure_reason": "'over the limit'"}),
    (40, "ComplianceCheckRequested", _CHECK, f"{_K} % 8 = 0", 30, {"mandatory": "'a,b'"}),
    (41, "ComplianceRulePassed", _CHECK, f"{_K} % 8 = 0", 40, {"rule_id": "'a'"}),
    (42, "ComplianceRulePassed", _CHECK, f"{_K} % 16 = 0", 40, {"rule_id": "'b'"}),
    (43, "ComplianceCheckCompleted", _CHECK, f"{_K} % 6 < 2", 30, {"overall_verdict": f"CASE WHEN {_K} % 6 = 0 THEN 'FAILED' ELSE 'cleared' END"}),
    (50, "DecisionGenerated", _LOAN, "true", 21, {
        "recommendation": "CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'O' THEN 'DECLINE' ELSE 'refer' END", "confidence": f"({_K} % 9) / 8.0", "orchestrator": f"'o' || ({_K} % 4)",
        "decision_model": f"CASE WHEN {_K} % 7 <> 0 THEN 'om' || ({_K} % 2) END", "compliance_status": f"CASE WHEN {_CLEAR} THEN 'CLEARED' ELSE 'FAILED' END",
        "limit_amount": f"CASE WHEN {_K} % 3 = 0 THEN o_totalprice * 0.5 ELSE o_totalprice * 1.5 END"}),
    (60, "HumanReviewCompleted", _LOAN, f"{_FINAL} AND {_K} % 17 <> 0", 50, {
        "reviewer": f"'r' || ({_K} % 5)", "override": f"{_K} % 19 = 0", "override_reason": f"CASE WHEN {_K} % 38 = 0 THEN 'seen' END",
        "final_decision": "CASE o_orderstatus WHEN 'F' THEN 'APPROVE' ELSE 'DECLINE' END"}),
    (70, "ApplicationApproved", _LOAN, "o_orderstatus = 'F'", 60, {"approved_amount": "o_totalprice"}),
    (71, "ApplicationDeclined", _LOAN, "o_orderstatus = 'O'", 60, {}),
]


def _values(event: tuple) -> list[tuple[str, str]]:
    seq, kind, stream, where, cause, payload = event
    cause_id = "CAST(NULL AS STRING)" if cause is None else f"'d' || ({_K} * 100 + {cause})"
    head = [("seq", str(seq)), ("event_type", f"'{kind}'"), ("stream_id", stream), ("event_id", f"'d' || ({_K} * 100 + {seq})"), ("causation_id", cause_id), ("occurs", where)]
    return head + [(n, f"CAST({payload.get(n, 'NULL')} AS {t.upper()})") for n, t in FIELDS.items()]


def _by_seq(values: dict[int, str], kind: str) -> str:
    """The value of the row's event, by its sequence number; a value of several numbers stands there once."""
    groups: dict[str, list[str]] = {}
    for seq, v in values.items():
        groups.setdefault(v, []).append(str(seq))
    cases = " ".join(f"WHEN seq IN ({', '.join(seqs)}) THEN {v}" for v, seqs in groups.items())
    return f"CAST(CASE {cases} END AS {kind.upper()})" if values else f"CAST(NULL AS {kind.upper()})"


def dossier_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes with payload columns; ``mandatory`` is an array.

    Orders are dealt out by their key before anything is made of them, so that an application's
    events lie in one task and no event moves by application or stream.  Only sequence numbers are
    exploded and placed.  All else is a column of its own behind that, so that a query that reads
    few columns computes few, in generated code whose methods the machine compiles.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").repartition(parts, _K)
    turns = ", ".join(f"CASE WHEN {where} THEN {seq} END" for seq, _, _, where, _, _ in EVENTS)
    rows = orders.select("*", F.explode(F.expr(f"array({turns})")).alias("seq")).filter("seq IS NOT NULL")
    streams = {s: str(i) for i, s in enumerate(dict.fromkeys(e[2] for e in EVENTS))}
    rows = rows.withColumn("stream", F.expr(_by_seq({e[0]: streams[e[2]] for e in EVENTS}, "int")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(_K, "stream").orderBy("seq")).cast("long"))
    own = {n: {e[0]: e[5][n] for e in EVENTS if n in e[5]} for n in FIELDS}
    rows = rows.select(
        F.col(_K).alias("application_id"), F.expr(_by_seq({e[0]: e[2] for e in EVENTS}, "string")).alias("stream_id"), F.col("place").alias("stream_position"),
        F.expr(f"{_K} * 100 + seq").alias("global_position"), F.expr(f"'d' || ({_K} * 100 + seq)").alias("event_id"),
        F.expr(f"'d' || ({_K} * 100 + {_by_seq({e[0]: str(e[4]) for e in EVENTS if e[4] is not None}, 'int')})").alias("causation_id"),
        F.expr(_by_seq({e[0]: f"'{e[1]}'" for e in EVENTS}, "string")).alias("event_type"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("seq"))).alias("recorded_at"), "seq",
        *[F.expr(_by_seq(own[n], t)).alias(n) for n, t in FIELDS.items()],
    )
    return rows.withColumn("mandatory", F.split("mandatory", ","))


def _duck(text: str) -> str:
    return text.replace("AS STRING)", "AS VARCHAR)")


#: DuckDB text of the same view, to stand after WITH.
DOSSIER_SQL = (
    "\nraw_dossier AS (\n  "
    + "\n  UNION ALL ".join(
        f"SELECT {_K} AS application_id, o_orderdate, " + ", ".join(f"{_duck(v)} AS {n}" for n, v in _values(e) if n != "occurs") + f" FROM orders WHERE {e[3]}" for e in EVENTS
    )
    + "\n), log AS (\n  SELECT * REPLACE (string_split(mandatory, ',') AS mandatory), row_number() OVER (PARTITION BY application_id, stream_id ORDER BY seq) AS stream_position,"
    + "\n    application_id * 100 + seq AS global_position, o_orderdate + to_hours(seq) AS recorded_at\n  FROM raw_dossier\n)"
)
