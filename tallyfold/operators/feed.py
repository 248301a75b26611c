"""Rows behind dashboards: merged feeds, scopes, gauges, formatted figures and named resources."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .projections import is_type


def related(log: DataFrame, application: int | str, key: str = "application_id") -> DataFrame:
    """Events of an application's loan stream or with its id in the payload, in order (S-04)."""
    return log.filter((F.col("stream_id") == f"loan-{application}") | (F.col(key).cast("string") == str(application))).orderBy("global_position")


def scoped(log: DataFrame, application: int | str, entity: tuple[str, str] = ("entity_type", "entity_id"), key: str = "application_id") -> DataFrame:
    """An application's whole scope in order (S-06): its id in the payload or as the entity of an audit, and all events of streams that hold it."""
    name = str(application)
    own = F.col(key).cast("string") == name
    kind, which = (F.col(c) if c in log.columns else F.lit(None).cast("string") for c in entity)
    own = F.coalesce(own, F.lit(False)) | F.coalesce((kind == "application") & (which == name), F.lit(False))
    streams = log.filter(own).select("stream_id").distinct()
    fixed = F.col("stream_id").isin(f"loan-{name}", f"compliance-{name}", f"docpkg-{name}")
    inside = log.join(streams.withColumn("held", F.lit(True)), "stream_id", "left")
    return inside.filter(F.col("held") | fixed | own).drop("held").orderBy("global_position")


def merged_feed(events: DataFrame, timeline: DataFrame) -> DataFrame:
    """Events and compliance rows by position and type, each once; an event stands before a timeline row (J-15)."""
    columns = ["application_id", "global_position", "event_type", "recorded_at"]
    both = events.select(*columns, F.lit(0).alias("source")).unionByName(timeline.select(*columns, F.lit(1).alias("source")))
    first = Window.partitionBy("global_position", "event_type").orderBy("source", "application_id")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def vocabulary(log: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in order (U-04)."""
    return log.select(F.col(column).alias("value")).filter("value is not null").distinct().orderBy("value")


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    """A page of rows with the total beside each (O-02, P-11); limit 1 to 500, offset 0 or more."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a limit of 1 to 500 and an offset of 0 or more are needed")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def lag_rollup(lags: DataFrame) -> DataFrame:
    """Of views' lags (view, events_behind, lag_ms, status): how many are synced, the worst, and the alarm (A-29)."""
    worst = F.max(F.struct("events_behind", "lag_ms", "view"))
    row = lags.agg(
        F.count("*").alias("views"), F.count_if(F.col("events_behind") == 0).cast("long").alias("synced"), worst.alias("w"),
        F.bool_or(F.col("status") == "CRITICAL").alias("critical"), F.bool_or(F.col("status") == "WARNING").alias("warning"),
    )
    alarm = F.when(F.col("critical"), "CRITICAL").when(F.col("warning"), "WARNING").otherwise("OK")
    return row.select("views", "synced", F.col("w.view").alias("worst_view"), F.col("w.events_behind").alias("worst_backlog"), alarm.alias("status"))


def gauges(lags: DataFrame, delivery: DataFrame) -> DataFrame:
    """(name, labels, value) rows of lags and of a delivery summary (T-12)."""
    label = F.concat(F.lit('{view="'), "view", F.lit('"}'))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
    one = lags.select(label.alias("labels"), F.explode(F.array(pair("projection_events_behind", F.col("events_behind")), pair("projection_lag_ms", F.col("lag_ms")))).alias("g"))
    states = ("pending", "retrying", "dead_letter", "published", "due")
    two = delivery.select(F.lit("").alias("labels"), F.explode(F.array(*[pair(f"outbox_{s}", F.col(s)) for s in states])).alias("g"))
    return one.unionByName(two).select("g.name", "labels", "g.value")


def shown_count(n: Column) -> Column:
    """A number rounded to whole ones, with thousands parted; 0 where there is none (F-36)."""
    return F.coalesce(F.format_number(F.floor(n + 0.5).cast("long"), 0), F.lit("0"))


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, by its exact decimal value."""
    return F.round(x.cast("decimal(38,18)"), digits).cast(f"decimal(30,{digits})").cast("string")


def shown_percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.concat(_fixed(x, max(0, min(2, digits))), F.lit("%")))


def shown_duration(seconds: Column) -> Column:
    """Seconds below a minute, else minutes, with three figures and no zeros behind them."""

    def short(x: Column) -> Column:
        text = F.when(x < 10, _fixed(x, 2)).otherwise(_fixed(x, 1))
        return F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"(\.\d*?)0+$", "$1")

    shown = F.when(seconds < 60, F.concat(short(seconds), F.lit(" sec"))).otherwise(F.concat(short(seconds / 60.0), F.lit(" min")))
    return F.when(seconds.isNull() | (seconds < 0), "n/a").otherwise(shown)


def titled(name: Column) -> Column:
    """Words parted by underscores or hyphens, each with a capital; what else they hold stays."""
    parts = F.split(F.regexp_replace(name, "[_-]+", " "), " ")
    words = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(F.coalesce(name, F.lit("")) == "", "Not set").otherwise(F.array_join(words, " "))


def short_id(name: Column, edge: int = 6) -> Column:
    """The ends of a long name."""
    cut = F.concat(F.left(name, F.lit(edge)), F.lit("..."), F.right(name, F.lit(edge)))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unavailable").when(F.length(name) <= 2 * edge + 3, name).otherwise(cut)


#: The resources: a pattern, and what it answers from the views' names and the parts of the name.
RESOURCES: list[tuple[str, Callable[..., DataFrame]]] = [
    (r"ledger://applications/(\d+)", lambda views, app: views["summary"].filter(F.col("application_id") == int(app))),
    (r"ledger://applications/(\d+)/compliance(?:\?as_of=(.+))?", lambda views, app, moment: _compliance(views["compliance"], int(app), moment)),
    (r"ledger://applications/(\d+)/audit-trail", lambda views, app: views["log"].filter(F.col("stream_id") == f"audit-application-{app}").orderBy("stream_position")),
    (r"ledger://agents/([^/]+)/performance", lambda views, agent: views["agents"].filter(F.col("agent_id") == agent).orderBy("model_version")),
    (r"ledger://agents/([^/]+)/sessions/([^/]+)", lambda views, agent, session: views["log"].filter(F.col("stream_id") == f"agent-{agent}-{session}").orderBy("stream_position")),
    (r"ledger://ledger/health", lambda views: views["lags"]),
]


def _compliance(timeline: DataFrame, application: int, moment: str | None) -> DataFrame:
    """The whole timeline of an application, or its last row at or before a moment."""
    rows = timeline.filter(F.col("application_id") == application)
    if moment is None:
        return rows.orderBy("global_position")
    return rows.filter(F.col("recorded_at") <= F.lit(moment).cast("timestamp_ntz")).orderBy(F.desc("recorded_at"), F.desc("global_position")).limit(1)


def resource(uri: str, views: dict[str, DataFrame]) -> DataFrame:
    """What a resource name stands for (M-07): views are summary, compliance (a timeline), agents, lags and the log."""
    for pattern, answer in RESOURCES:
        if found := re.fullmatch(pattern, uri):
            return answer(views, *found.groups())
    raise KeyError(f"no resource {uri}")


def approvals_waiting(log: DataFrame) -> DataFrame:
    """Applications with a decision and no final event."""
    row = log.groupBy("application_id").agg(F.bool_or(is_type("DecisionGenerated")).alias("decided"), F.bool_or(is_type("ApplicationApproved", "ApplicationDeclined")).alias("final"))
    return row.filter("decided and not final").select("application_id")
