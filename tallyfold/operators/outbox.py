"""At-least-once delivery: an outbox as a table and its transitions as pure functions.

Rows: outbox_id, topic, status (pending, published, dead_letter), attempts,
next_attempt_at, created_at, published_at, last_error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, MAX_ATTEMPTS, BASE_SECONDS, CAP_SECONDS, LEASE_SECONDS = 100, 8, 0.5, 60.0, 30
ERROR_LENGTH = 1000


def due(outbox: DataFrame, now: str) -> DataFrame:
    return outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz")))


def claim(outbox: DataFrame, now: str, batch: int = BATCH, lease: int = LEASE_SECONDS) -> DataFrame:
    """The oldest due messages, with one attempt more, no error and invisible for the lease (T-10, O-09)."""
    taken = due(outbox, now).orderBy("outbox_id").limit(batch).withColumn("last_error", F.lit(None).cast("string"))
    return taken.withColumn("attempts", F.col("attempts") + 1).withColumn("next_attempt_at", F.lit(now).cast("timestamp_ntz") + F.expr(f"interval '{int(lease)}' second"))


def delay_seconds(attempts, base: float = BASE_SECONDS, cap: float = CAP_SECONDS):
    """Doubling from the base to the cap."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(40))))


def truncated(error, most: int = ERROR_LENGTH):
    """Errors of at most ``most`` characters, the last three of a longer one dots."""
    return F.when(F.length(error) > most, F.concat(F.substring(error, 1, most - 3), F.lit("..."))).otherwise(error)


def settle(claimed: DataFrame, outcomes: DataFrame, now: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claimed messages after their outcomes (outbox_id, error): published, retried or dead.

    A message without an outcome keeps its lease and is due again when that ends.
    """
    at = F.lit(now).cast("timestamp_ntz")
    joined = claimed.join(outcomes.select("outbox_id", "error", F.lit(True).alias("tried")), "outbox_id", "left")
    failed = F.col("tried") & F.col("error").isNotNull()
    sent = F.col("tried") & F.col("error").isNull()
    dead = failed & (F.col("attempts") >= max_attempts)
    again = at + F.make_dt_interval(secs=delay_seconds(F.col("attempts")).cast("decimal(18,6)"))
    out = joined.withColumns(
        {
            "status": F.when(sent, "published").when(dead, "dead_letter").otherwise(F.col("status")),
            "published_at": F.when(sent, at).otherwise(F.col("published_at")),
            "next_attempt_at": F.when(failed & ~dead, again).otherwise(F.col("next_attempt_at")),
            "last_error": F.when(failed, truncated(F.col("error"))).otherwise(F.col("last_error")),
        }
    )
    return out.drop("error", "tried")


def applied(outbox: DataFrame, changed: DataFrame) -> DataFrame:
    """The outbox with changed rows in place of theirs (J-08)."""
    return outbox.join(changed.select("outbox_id"), "outbox_id", "left_anti").unionByName(changed)


def delivery_summary(outbox: DataFrame, now: str) -> DataFrame:
    """Counts by state, attempts, what was published lately, and the status ladder (A-10, A-31)."""
    at, is_in = F.lit(now).cast("timestamp_ntz"), lambda s: F.col("status") == s
    count = lambda test: F.count_if(test).cast("long")
    since = lambda text: is_in("published") & (F.col("published_at") >= at - F.expr(f"interval '{text}' minute"))
    row = outbox.agg(
        count(is_in("pending")).alias("pending"),
        count(is_in("published")).alias("published"),
        count(is_in("dead_letter")).alias("dead_letter"),
        count(is_in("pending") & (F.col("next_attempt_at") <= at)).alias("due"),
        count(is_in("pending") & (F.col("attempts") > 0)).alias("retrying"),
        F.max("attempts").alias("max_attempts"),
        F.coalesce(F.avg(F.when(is_in("pending"), F.col("attempts"))), F.lit(0.0)).alias("pending_attempts"),
        count(since("5")).alias("published_5m"),
        count(since("60")).alias("published_1h"),
        F.max("published_at").alias("last_published_at"),
        F.min(F.when(is_in("pending"), F.col("created_at"))).alias("oldest_pending"),
    )
    return row.withColumn("health", F.when(F.col("dead_letter") > 0, "dead_letter").when(F.col("pending") > 0, "pending").otherwise("healthy"))


def topics_by_last_hour(outbox: DataFrame, now: str) -> DataFrame:
    """Topics by what they published in the last hour (O-08)."""
    at = F.lit(now).cast("timestamp_ntz")
    lately = (F.col("status") == "published") & (F.col("published_at") >= at - F.expr("interval '1' hour"))
    return outbox.groupBy("topic").agg(F.count_if(lately).cast("long").alias("published_1h"), F.count("*").alias("messages")).orderBy(F.desc("published_1h"), "topic")


def delivery_topics(outbox: DataFrame, k: int = 8) -> DataFrame:
    """Counts of the k topics with most messages (A-11)."""
    one = lambda s: F.count_if(F.col("status") == s).cast("long")
    return outbox.groupBy("topic").agg(F.count("*").alias("messages"), one("published").alias("published"), one("pending").alias("pending"), one("dead_letter").alias("dead_letter")).orderBy(F.desc("messages"), "topic").limit(k)


def messages(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Delivery form of events (K-10, F-31): key, JSON value and headers, for any message sink."""
    key = F.coalesce("stream_id", "event_id")
    value = F.to_json(F.struct("event_id", "event_type", F.col("global_position"), F.try_parse_json(payload).alias("payload"), "stream_id"))
    headers = F.filter(F.array(F.struct(F.lit("event_type").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("stream_id").alias("key"), F.col("stream_id").alias("value"))), lambda h: h["value"].isNotNull())
    return events.select(F.col("global_position").alias("outbox_id"), key.alias("key"), value.alias("value"), headers.alias("headers"))


def delivered_once(sink: DataFrame, new: DataFrame, key: str = "outbox_id") -> DataFrame:
    """Messages that the sink lacks, each once (K-07, K-11)."""
    return new.dropDuplicates([key]).join(sink.select(key), key, "left_anti")
