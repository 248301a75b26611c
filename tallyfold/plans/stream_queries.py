"""Streams drained into views, and scalar helpers, each with its DuckDB text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json as js
from ..operators import projections as pj
from ..operators import stored
from ..sources import shared
from ..sources.dossier import DOSSIER_SQL, dossier_log
from ..sources.ledger import ACTIVITY_SQL, activity_log
from ..streaming import relay, views
from .dossier_queries import _EPOCH_SQL
from .ledger_queries import query


@query(" SELECT stream_id, event_type, count(*) AS n, max(global_position) AS last_position FROM activity GROUP BY ALL", ACTIVITY_SQL)
def streamed_counters(spark, sf_dir):
    """The events table replayed as a stream into a counters view."""
    folder = f"{shared.folder(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    envelopes = stream.select(F.concat(F.lit("user-"), F.col("user_id")).alias("stream_id"), "event_type", (F.col("event_id") + 1).alias("global_position"), F.col("ts").alias("recorded_at"))
    view = views.View(spark, f"{folder}/view", views.COUNTERS)
    views.keep_up(envelopes, view, views.counters, views.added, f"{folder}/checkpoint").awaitTermination()
    return view.read()


@query(" SELECT count(*) FILTER (WHERE global_position > 9000) AS events_behind, CASE WHEN count(*) FILTER (WHERE global_position > 9000) = 0 THEN CAST(0 AS BIGINT) ELSE date_diff('microsecond', min(recorded_at) FILTER (WHERE global_position > 9000), TIMESTAMP '2024-02-01') // 1000 END AS lag_ms, CASE WHEN count(*) FILTER (WHERE global_position > 9000) = 0 THEN 'OK' ELSE 'CRITICAL' END AS status FROM activity", ACTIVITY_SQL)
def projection_lag(spark, sf_dir):
    return views.lag(9000, activity_log(spark, sf_dir), "2024-02-01 00:00:00")


@query(" SELECT date_trunc('day', recorded_at)::DATE AS day, event_type, count(*) AS n FROM activity GROUP BY ALL", ACTIVITY_SQL)
def daily_activity(spark, sf_dir):
    return views.daily_activity(activity_log(spark, sf_dir)).withColumn("day", F.col("day").cast("date"))


@query(" SELECT event_id, json_extract_string(payload, '$.k') AS k, json_exists(payload, '$.k') AS has_k, json_exists(payload, '$.z') AS has_z, CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS k_number, CASE WHEN value BETWEEN 0 AND 1 THEN value END AS unit_value FROM activity", ACTIVITY_SQL)
def json_fields(spark, sf_dir):
    log = activity_log(spark, sf_dir)
    return log.select("event_id", js.text("payload", "k").alias("k"), js.has("payload", "k").alias("has_k"), js.has("payload", "z").alias("has_z"), js.number(js.text("payload", "k")).alias("k_number"), js.in_unit_range(F.col("value")).alias("unit_value"))


@query(""" SELECT event_id, '{"k":' || CASE WHEN event_id::BIGINT % 2 = 0 THEN '"new"' ELSE json_extract_string(payload, '$.k') END || ',"tag":{"on":true}}' AS metadata FROM activity""", ACTIVITY_SQL)
def metadata_merge(spark, sf_dir):
    """Numbers and objects keep their types."""
    patch = F.when(F.col("event_id").cast("long") % 2 == 0, '{"tag":{"on":true},"k":"new"}').otherwise('{"tag":{"on":true}}')
    return activity_log(spark, sf_dir).select("event_id", js.merged(F.col("payload"), patch).alias("metadata"))


@query(" SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(value > 100, false) THEN 'value' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'type' END) AS violations FROM activity", ACTIVITY_SQL)
def payload_violations(spark, sf_dir):
    checks = {"value": F.col("value") > 100, "type": F.col("event_type").isin("view", "click")}
    return activity_log(spark, sf_dir).select("event_id", F.array_join(js.violations(checks), ",").alias("violations"))


@query(
    _EPOCH_SQL + """ SELECT o_orderkey AS application_id, o_orderdate + to_hours(CAST(o_orderkey % 60 AS INTEGER)) AS as_of, t.global_position, t.event_type, t.status
FROM orders ASOF JOIN (SELECT application_id, recorded_at, max_by(struct_pack(global_position := global_position, event_type := event_type, status := status), global_position) AS t
    FROM timeline GROUP BY ALL) x ON x.application_id = o_orderkey AND o_orderdate + to_hours(CAST(o_orderkey % 60 AS INTEGER)) >= x.recorded_at""",
    DOSSIER_SQL,
)
def stored_compliance(spark, sf_dir):
    """The stored compliance timeline asked for each application at a moment of its own."""
    timeline = stored.intervals(pj.compliance_timeline(dossier_log(spark, sf_dir)))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # A bucket is written by one task: there are more of them where there are more applications.
    buckets = max(16, -(-orders.count() // APPLICATIONS))
    view = stored.stored(timeline, f"stored/{uuid.uuid4().hex}", "application_id", ("valid_from",), buckets=buckets)
    moments = orders.select(F.col("o_orderkey").alias("application_id"), (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 60).cast("int"))).alias("as_of"))
    return stored.as_of(view.all(), moments).select("application_id", "as_of", "global_position", "event_type", "status")


#: Applications of a bucket of the stored compliance timeline.
APPLICATIONS = 50_000
#: Files of a part of the relay's log.
LOG_FILES = 16


@query(
    """ SELECT event_id::BIGINT AS outbox_id, CASE WHEN event_id::BIGINT % 7 = 0 THEN 'dead_letter' WHEN event_id::BIGINT % 7 = 6 THEN 'pending' ELSE 'published' END AS status,
  CAST(CASE event_id::BIGINT % 7 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 3 END AS INTEGER) AS attempts,
  CASE WHEN event_id::BIGINT % 7 = 0 THEN 'down' END AS last_error FROM activity""",
    ACTIVITY_SQL,
)
def relayed_messages(spark, sf_dir):
    """Deliveries over a stream of messages, outcomes and ticks, three attempts at most.

    Of seven messages one always fails, three are published at the first to third attempt, one loses its
    first claim and one its outcomes, so that leases end; one is told twice.
    """
    folder = f"{shared.folder(spark)}/streams/{uuid.uuid4().hex}"
    log = activity_log(spark, sf_dir)
    n = F.col("event_id").cast("long")
    turn = n % 7

    def rows(frame, kind, seconds, attempt=0, error=None):
        at = F.timestamp_seconds(F.lit(1_704_067_200 + seconds))
        return frame.select(n.alias("outbox_id"), F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"), (F.lit(error).cast("string") if error is None else error).alias("error"), at.alias("at"))

    fails = lambda *turns: F.when(turn.isin(*turns) if turns else F.lit(False), "down")
    slots = F.explode(F.sequence(F.lit(0), F.lit(LOG_FILES - 1))).alias("slot")
    tick = lambda seconds: rows(spark.range(1).select(F.lit(-1).alias("event_id")), "tick", seconds)
    first = rows(log.filter(~turn.isin(4, 6)), "outcome", 1, 1, fails(0, 2, 3)).unionByName(rows(log.filter(turn == 5), "outcome", 2, 1, fails(5)))
    files = [
        rows(log, "message", 0), first, tick(10), rows(log.filter(turn.isin(0, 2, 3)), "outcome", 11, 2, fails(0, 3)), tick(20), tick(21),
        rows(log.filter(turn.isin(0, 3)), "outcome", 22, 3, fails(0)), tick(100), tick(101), rows(log.filter(turn == 4), "outcome", 102, 2, fails()), tick(200), tick(201),
    ]
    for i, part in enumerate(files):
        # A tick at the part's own time in each slot, so that each part is LOG_FILES files and a batch.
        own = (0, 1, 10, 11, 20, 21, 22, 100, 101, 102, 200, 201)[i]
        dealt = part.withColumn("slot", F.pmod(F.xxhash64("outbox_id"), F.lit(LOG_FILES)).cast("int")).unionByName(tick(own).select("*", slots))
        dealt.repartition(LOG_FILES, "slot").write.partitionBy("slot").parquet(f"{folder}/log/{i:02}")
    stream = spark.readStream.schema(relay.INPUT).option("maxFilesPerTrigger", LOG_FILES).parquet(f"{folder}/log/*/slot=*")
    changes = relay.deliveries(stream, max_attempts=3)
    relay.start(changes, folder).awaitTermination()
    return relay.states(relay.changes_of(spark, folder)).select("outbox_id", "status", "attempts", "last_error")
