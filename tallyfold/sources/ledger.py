"""Ledger views of the driver tables: a case log and an activity log.

The case log has one row an event of a loan application (an order), with typed payload
columns; positions are per application, so that no window spans the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payload columns of the case log and their types; each event type fills some.
PAYLOAD = {
    "requested_amount": "double", "mandatory": "array<string>", "regulation_set": "string", "agent_id": "string", "model_version": "string",
    "confidence": "double", "limit_amount": "double", "rule_id": "string", "failure_reason": "string", "recommendation": "string",
    "orchestrator": "string", "reviewer": "string", "override": "boolean", "final_decision": "string", "approved_amount": "double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event(kind: str | Column, at: Column, seq: int, rn: Column, occurs: Column | None = None, **payload: Column) -> tuple[Column, dict[str, Column]]:
    """Where one event of a row occurs, and its columns."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    columns = {"event_type": kind, "recorded_at": at, "seq": F.lit(seq), "rn": rn.cast("int")}
    return F.lit(True) if occurs is None else occurs, columns | {name: payload[name].cast(typ) for name, typ in PAYLOAD.items() if name in payload}


def _exploded(frame: DataFrame, *events: tuple[Column, dict[str, Column]]) -> DataFrame:
    """All events of a table's rows by one pass over it; only their numbers are exploded, so that columns which nobody reads aren't made."""
    turns = F.array(*[F.when(occurs, F.lit(i)) for i, (occurs, _) in enumerate(events)])
    rows = frame.withColumn("turn", F.explode(turns)).filter("turn is not null")

    def column(name: str, kind: str | None = None) -> Column:
        own = [(F.col("turn") == i, columns[name]) for i, (_, columns) in enumerate(events) if name in columns]
        out = F.when(*own[0]) if own else F.lit(None)
        for holds, value in own[1:]:
            out = out.when(holds, value)
        return (out if kind is None else out.cast(kind)).alias(name)

    return rows.select("application_id", *[column(c) for c in ("event_type", "recorded_at", "seq", "rn")], *[column(c, t) for c, t in PAYLOAD.items()])


def case_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes (application_id, stream_id, stream_position, global_position, event_type, recorded_at) with payload columns."""
    orders = table(spark, sf_dir, "orders").withColumn("application_id", F.col("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem")
    everything = [lines[c] for c in lines.columns if c != "l_orderkey"]
    items = lines.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*everything)))
    items = items.join(orders.select("application_id", "o_orderdate"), items["l_orderkey"] == F.col("application_id"))
    items = items.withColumn("at", F.greatest("l_shipdate", "o_orderdate")).withColumn("rule", F.concat(F.lit("rule-"), F.col("l_linenumber")))
    last = items.groupBy("application_id").agg(F.max("at").alias("last_item"), F.array_sort(F.collect_set("rule")).alias("rules"))
    cases = orders.join(last, "application_id", "left").withColumn("last", F.coalesce("last_item", "o_orderdate")).withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    zero, day = F.lit(0), F.expr("interval '1' day")
    status = F.col("o_orderstatus")
    final, at, rn = status.isin("F", "O"), F.col("at"), F.col("rn")
    of_cases = _exploded(
        cases,
        _event("ApplicationSubmitted", F.col("o_orderdate"), 10, zero, requested_amount=F.col("o_totalprice")),
        _event("ComplianceCheckRequested", F.col("o_orderdate"), 20, zero, mandatory=F.col("rules"), regulation_set=F.concat(F.lit("reg-"), F.year("o_orderdate"))),
        _event("DecisionGenerated", F.col("last") + day, 50, zero, recommendation=F.when(status == "F", "APPROVE").when(status == "O", "DECLINE").otherwise("REFER"),
               orchestrator=F.concat(F.lit("orchestrator-"), F.substring("o_orderpriority", 1, 1))),
        _event("HumanReviewCompleted", F.col("last") + F.expr("interval '36' hour"), 60, zero, final, reviewer=F.concat(F.lit("reviewer-"), F.col("o_custkey") % 10),
               override=F.col("o_orderpriority") == "1-URGENT", final_decision=F.when(status == "F", "APPROVE").otherwise("DECLINE")),
        _event(F.when(status == "F", "ApplicationApproved").otherwise("ApplicationDeclined"), F.col("last") + F.expr("interval '2' day"), 70, zero, final,
               approved_amount=F.when(status == "F", F.col("o_totalprice"))),
    )
    returned = F.col("l_returnflag") == "R"
    of_items = _exploded(
        items,
        _event("CreditAnalysisCompleted", at, 30, rn, agent_id=F.concat(F.lit("agent-"), F.col("l_suppkey")), model_version=F.concat(F.lit("credit-"), F.col("l_linestatus")),
               confidence=F.round(F.col("l_discount") * 10, 2), limit_amount=F.col("l_extendedprice")),
        _event(F.when(returned, "ComplianceRuleFailed").otherwise("ComplianceRulePassed"), at, 40, rn, rule_id=F.col("rule"),
               failure_reason=F.when(returned, F.concat(F.lit("returned by supplier "), F.col("l_suppkey")))),
    )
    log = of_cases.unionByName(of_items)
    order = Window.partitionBy("application_id").orderBy("recorded_at", "seq", "rn")
    log = log.withColumn("stream_position", F.row_number().over(order).cast("long"))
    return log.select(
        "application_id", F.concat(F.lit("loan-"), F.col("application_id")).alias("stream_id"), "stream_position",
        (F.col("application_id") * 1000 + F.col("stream_position")).alias("global_position"), "event_type", "recorded_at", "seq", *PAYLOAD,
    )


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as envelopes of one stream a user."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("stream_id"), F.row_number().over(order).cast("long").alias("stream_position"),
        (F.col("event_id") + 1).alias("global_position"), F.col("event_id").cast("string").alias("event_id"), "user_id", "event_type",
        F.lit(1).alias("event_version"), F.col("props").alias("payload"), F.col("ts").alias("recorded_at"), "value",
    )


#: DuckDB text of the same two views, to stand after WITH.
CASE_SQL = """
items AS (
  SELECT l.*, o_orderdate, greatest(l_shipdate, o_orderdate) AS ts_, 'rule-' || l_linenumber AS rule,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
), last_items AS (
  SELECT l_orderkey AS k, max(ts_) AS last_item, list_sort(list_distinct(list(rule))) AS rules FROM items GROUP BY l_orderkey
), cases AS (
  SELECT o.*, coalesce(last_item, o_orderdate) AS last_, coalesce(rules, []) AS rules FROM orders o LEFT JOIN last_items ON k = o_orderkey
), raw_log AS (
  SELECT o_orderkey AS application_id, 'ApplicationSubmitted' AS event_type, o_orderdate AS recorded_at, 10 AS seq, 0 AS rn, o_totalprice AS requested_amount,
    NULL::VARCHAR[] AS mandatory, NULL::VARCHAR AS regulation_set, NULL::VARCHAR AS agent_id, NULL::VARCHAR AS model_version, NULL::DOUBLE AS confidence, NULL::DOUBLE AS limit_amount,
    NULL::VARCHAR AS rule_id, NULL::VARCHAR AS failure_reason, NULL::VARCHAR AS recommendation, NULL::VARCHAR AS orchestrator, NULL::VARCHAR AS reviewer, NULL::BOOLEAN AS override,
    NULL::VARCHAR AS final_decision, NULL::DOUBLE AS approved_amount FROM cases
  UNION ALL SELECT o_orderkey, 'ComplianceCheckRequested', o_orderdate, 20, 0, NULL, rules, 'reg-' || year(o_orderdate), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cases
  UNION ALL SELECT l_orderkey, 'CreditAnalysisCompleted', ts_, 30, rn, NULL, NULL, NULL, 'agent-' || l_suppkey, 'credit-' || l_linestatus, round(l_discount * 10, 2), l_extendedprice, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM items
  UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'ComplianceRuleFailed' ELSE 'ComplianceRulePassed' END, ts_, 40, rn, NULL, NULL, NULL, NULL, NULL, NULL, NULL, rule,
    CASE WHEN l_returnflag = 'R' THEN 'returned by supplier ' || l_suppkey END, NULL, NULL, NULL, NULL, NULL, NULL FROM items
  UNION ALL SELECT o_orderkey, 'DecisionGenerated', last_ + INTERVAL 1 DAY, 50, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'O' THEN 'DECLINE' ELSE 'REFER' END, 'orchestrator-' || o_orderpriority[1], NULL, NULL, NULL, NULL FROM cases
  UNION ALL SELECT o_orderkey, 'HumanReviewCompleted', last_ + INTERVAL 36 HOUR, 60, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'reviewer-' || (o_custkey % 10),
    o_orderpriority = '1-URGENT', CASE o_orderstatus WHEN 'F' THEN 'APPROVE' ELSE 'DECLINE' END, NULL FROM cases WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ApplicationApproved' ELSE 'ApplicationDeclined' END, last_ + INTERVAL 2 DAY, 70, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, CASE o_orderstatus WHEN 'F' THEN o_totalprice END FROM cases WHERE o_orderstatus IN ('F', 'O')
), log AS (
  SELECT *, 'loan-' || application_id AS stream_id, p AS stream_position, application_id * 1000 + p AS global_position
  FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY recorded_at, seq, rn) AS p FROM raw_log)
)"""

ACTIVITY_SQL = """
activity AS (
  SELECT 'user-' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS stream_position, event_id + 1 AS global_position,
    CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, 1 AS event_version, props AS payload, ts AS recorded_at, value
  FROM events
)"""
