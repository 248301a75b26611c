"""Session context: pending work, health and a summary of a session's log (C-04).

Works on envelopes of one stream a session; ``flagged`` marks pending or error events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests and what completes them.
COMPLETES = {"CreditAnalysisRequested": "CreditAnalysisCompleted", "FraudScreeningRequested": "FraudScreeningCompleted", "DecisionRequested": "DecisionGenerated", "HumanReviewRequested": "HumanReviewCompleted"}
#: Decisions that something must follow, and the marks of trouble.
UNFINISHED = ("DecisionGenerated", "DecisionRequested")
MARKS = ("PENDING", "ERROR", "FAILED")
KEPT = 3


def troubled(payload: Column | str, metadata: Column | str | None = None) -> Column:
    """Whether a text value anywhere in the JSON holds a mark of trouble in any case; keys don't count (F-38)."""
    text = r'"(?:[^"\\]|\\.)*(?:' + "|".join(MARKS) + r')(?:[^"\\]|\\.)*"(?!\s*:)'
    inside = lambda c: F.coalesce(F.upper(c).rlike(text), F.lit(False))
    return inside(payload) if metadata is None else inside(payload) | inside(metadata)


def flagged(log: DataFrame) -> DataFrame:
    """The log with ``flagged``: trouble in the values, PENDING or ERROR in the type, or an open request for a decision or review."""
    kind = F.upper("event_type")
    named = F.contains(kind, F.lit("PENDING")) | F.contains(kind, F.lit("ERROR")) | F.col("event_type").isin("DecisionRequested", "HumanReviewRequested")
    return log.withColumn("flagged", named | troubled("payload", "metadata" if "metadata" in log.columns else None))


def open_requests(log: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """The last request of each type that no completion follows (J-12, W-06); a completion clears all before it."""
    pairs = pairs or COMPLETES
    kind = F.col("event_type")
    request = F.when(kind.isin(*pairs), kind)
    for asked, done in pairs.items():
        request = F.when(kind == done, F.lit(asked)).otherwise(request)
    rows = log.withColumn("request_type", request).filter("request_type is not null").withColumn("asks", kind == F.col("request_type"))
    last = rows.groupBy("stream_id", "request_type").agg(F.max(F.when(F.col("asks"), F.col("stream_position"))).alias("request_position"), F.max(F.when(~F.col("asks"), F.col("stream_position"))).alias("completion_position"))
    return last.filter("request_position is not null and (completion_position is null or completion_position < request_position)").select("stream_id", F.col("request_type").alias("event_type"), F.col("request_position").alias("stream_position"))


def pending_work(log: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """(stream_id, work_type, event_type, stream_position), each once."""
    pairs = pairs or COMPLETES
    flagged = log.filter(F.col("flagged") & ~F.col("event_type").isin(*pairs, *pairs.values()))
    last = log.groupBy("stream_id").agg(F.max_by("event_type", "stream_position").alias("event_type"), F.max("stream_position").alias("stream_position")).filter(F.col("event_type").isin(*UNFINISHED))
    part = lambda frame, work: frame.select("stream_id", F.lit(work).alias("work_type"), "event_type", "stream_position")
    return part(flagged, "PENDING_OR_ERROR_STATE").unionByName(part(open_requests(log, pairs), "REQUEST_INCOMPLETE")).unionByName(part(last, "DECISION_NOT_FINALIZED")).dropDuplicates(["stream_id", "work_type", "event_type", "stream_position"])


def session_health(log: DataFrame, opening: str, pairs: dict[str, str] | None = None) -> DataFrame:
    """NEEDS_RECONCILIATION, DEGRADED or HEALTHY for each session; ``opening`` must have come in it."""
    opened = log.groupBy("stream_id").agg(F.bool_or(F.col("event_type") == opening).alias("opened"), F.max_by("event_type", "stream_position").alias("last_type"), F.max("stream_position").alias("last_position"))
    work = pending_work(log, pairs).groupBy("stream_id").agg(F.count("*").alias("pending"))
    joined = opened.join(work, "stream_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    health = F.when(~F.col("opened") | F.col("last_type").isin(*UNFINISHED), "NEEDS_RECONCILIATION").when(F.col("pending") > 0, "DEGRADED").otherwise("HEALTHY")
    return joined.select("stream_id", "last_position", "pending", health.alias("health"))


def preserved(log: DataFrame) -> DataFrame:
    """Events kept word for word: the last three and flagged ones (W-04)."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("stream_position")))
    return log.withColumn("preserved", (rank <= KEPT) | F.col("flagged"))


def summary(log: DataFrame, budget: int = 60) -> DataFrame:
    """Summary line of the older events of each session within a budget of tokens (A-24, F-32).

    Full text if it fits, else counts alone.
    """
    old = preserved(log).filter(~F.col("preserved"))
    per = old.groupBy("stream_id", "event_type").agg(F.count("*").alias("n"), F.min("stream_position").alias("low"), F.max("stream_position").alias("high"))
    full = F.concat(F.col("event_type"), F.lit(" x"), F.col("n"), F.lit(" ["), F.col("low"), F.lit(".."), F.col("high"), F.lit("]"))
    short = F.concat(F.col("event_type"), F.lit(" x"), F.col("n"))
    lines = per.groupBy("stream_id").agg(F.array_join(F.array_sort(F.collect_list(full)), "; ").alias("full"), F.array_join(F.array_sort(F.collect_list(short)), "; ").alias("short"), F.sum("n").alias("summarized"))
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")
    text = F.when(tokens("full") <= budget, F.col("full")).otherwise(F.col("short"))
    return lines.select("stream_id", "summarized", text.alias("summary"), tokens(text).alias("tokens"))


def context_text(log: DataFrame, budget: int = 4096, opening: str = "AgentContextLoaded", pairs: dict[str, str] | None = None) -> DataFrame:
    """Each session's text for its next start (C-04): whole, else compact, else its first four lines.

    Events are envelopes with a JSON ``payload``; a text's tokens are a quarter of its characters.
    """
    rows = preserved(log)
    json_of = lambda *fields: F.to_json(F.struct(*[(F.try_parse_json(f) if f == "payload" else F.col(f)).alias(f) for f in sorted(fields)]))
    rows = rows.withColumns({"line": json_of("event_type", "payload", "recorded_at", "stream_id", "stream_position"), "short": json_of("event_type", "payload", "stream_position")})
    kept_ = F.when(F.col("preserved"), F.struct("stream_position", "line", "short"))
    old = rows.filter(~F.col("preserved")).groupBy("stream_id", "event_type").agg(F.count("*").alias("n"), F.min("recorded_at").alias("low"), F.max("recorded_at").alias("high"))
    counted = F.concat(F.col("event_type"), F.lit(" x"), F.col("n"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    old = old.groupBy("stream_id").agg(F.array_join(F.array_sort(F.collect_list(counted)), ", ").alias("counts"), stamp(F.min("low")).alias("low"), stamp(F.max("high")).alias("high"))
    told = F.concat(F.lit("Earlier history summary: "), "counts", F.lit(" between "), "low", F.lit(" and "), "high", F.lit("."))
    work = pending_work(log, pairs)
    item = F.concat("work_type", F.lit(" at position "), "stream_position", F.lit(" ("), "event_type", F.lit(")"))
    work = work.withColumn("item", item).groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stream_position", "work_type", "item"))), lambda w: w["item"]), "; ").alias("items"), F.count("*").alias("pending")
    )
    sessions = rows.groupBy("stream_id").agg(F.count("*").alias("events"), F.max("stream_position").alias("last_position"), F.array_sort(F.collect_list(kept_)).alias("kept"))
    joined = sessions.join(old.select("stream_id", told.alias("told")), "stream_id", "left").join(work, "stream_id", "left")
    none = "Earlier history summary: none (all events preserved verbatim)."
    head = F.concat(F.lit("Agent session reconstruction for "), "stream_id", F.lit(".\nTotal events: "), "events", F.lit("; last_event_position: "), "last_position", F.lit(".\n"), F.coalesce("told", F.lit(none)))
    work_line = F.coalesce(F.concat(F.lit("Pending work: "), "items"), F.lit("Pending work: none."))
    count_line = F.concat(F.lit("Pending work count: "), F.coalesce("pending", F.lit(0)))
    lines = lambda name: F.array_join(F.transform("kept", lambda k: k[name]), "\n")
    whole = F.concat_ws("\n", head, work_line, F.lit("Verbatim preserved events:"), lines("line"))
    compact = F.concat_ws("\n", head, count_line, F.lit("Verbatim preserved events (compact):"), lines("short"))
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")
    text = F.when(tokens(whole) <= budget, whole).when(tokens(compact) <= budget, compact).otherwise(F.concat_ws("\n", head, count_line))
    health = session_health(log, opening, pairs).select("stream_id", "health")
    return joined.select("stream_id", "last_position", text.alias("context_text")).withColumn("tokens", tokens("context_text")).join(health, "stream_id")
