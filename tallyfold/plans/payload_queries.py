"""Typed payloads and refusals over the activity log, each with its DuckDB text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import refusals
from ..sources.ledger import ACTIVITY_SQL, activity_log
from .ledger_queries import query

TURNS = 6


def _cases() -> list[tuple[str, int, str, str]]:
    """(type, turn, payload, errors): a fitting payload, and one with each kind of fault, of every type."""
    out = []
    for kind, text in payloads.EVENTS.items():
        good, listed = payloads.example(text), payloads.fields(text)
        first = listed[0]["name"]
        bounded = next((f for f in listed if f["above"] is not None or f["least"] is not None), None)
        out.append((kind, 0, json.dumps(good), ""))
        out.append((kind, 1, json.dumps({k: v for k, v in good.items() if k != first}), f"{first}:missing"))
        if bounded is None:
            out.append((kind, 2, "[1]", ":model_type"))
        else:
            code = "greater_than" if bounded["above"] is not None else "greater_than_equal"
            out.append((kind, 2, json.dumps(good | {bounded["name"]: -1}), f"{bounded['name']}:{code}"))
        out.append((kind, 3, json.dumps(good | {"zz": 1, "aa": None}), "aa:extra_forbidden,zz:extra_forbidden"))
        out.append((kind, 4, json.dumps(good | {first: 7}), f"{first}:string_type"))
        out.append((kind, 5, json.dumps({f["name"]: good[f["name"]] for f in listed if not f["lax"]} | {f["name"]: None for f in listed if f["lax"] == "?"}), ""))
    return out


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(k)}, {quoted(p)}, {quoted(e)})" for i, (k, _, p, e) in enumerate(_cases()))


@query(
    f""", cases AS (SELECT * FROM (VALUES {_values()}) AS c(i, event_type, payload, errors))
SELECT event_id, c.event_type, c.errors FROM activity JOIN cases c ON c.i = event_id::BIGINT % {len(_cases())}""",
    ACTIVITY_SQL,
)
def payload_errors(spark, sf_dir):
    """Each activity carries one payload of the 28 types: fitting, lacking, out of range, with more keys, of wrong types, or sparse."""
    cases = _cases()
    place = F.col("event_id").cast("long") % len(cases)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))
    rows = activity_log(spark, sf_dir).select("event_id", pick([c[0] for c in cases]).alias("event_type"), pick([c[2] for c in cases]).alias("payload"))
    found = F.transform(payloads.violations("event_type", "payload"), lambda e: F.concat(e["loc"], F.lit(":"), e["code"]))
    return rows.select("event_id", "event_type", F.array_join(found, ",").alias("errors"))


_CALLS_SQL = ACTIVITY_SQL + """, calls AS (
  SELECT event_id, event_id::BIGINT AS n, recorded_at, global_position, 'user' || (event_id::BIGINT % 3) AS entity,
    CASE WHEN event_id::BIGINT % 11 = 0 THEN 'UnknownTool' WHEN event_id::BIGINT % 11 = 1 THEN 'ValidationError' WHEN event_id::BIGINT % 11 = 2 THEN 'AuthorizationError'
      WHEN event_id::BIGINT % 11 = 3 THEN 'PreconditionFailed' END AS e
  FROM activity
), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY recorded_at, global_position) AS k FROM calls WHERE e IS NULL
), times AS (SELECT entity, recorded_at, min(k) AS k FROM o GROUP BY ALL
), following AS MATERIALIZED (SELECT a.entity, a.k, b.k AS next_k FROM o a ASOF JOIN times b ON a.entity = b.entity AND a.recorded_at + INTERVAL 1 MINUTE <= b.recorded_at
), passed AS (SELECT entity, k FROM o WHERE k = 1 UNION ALL SELECT f.entity, f.next_k FROM passed p JOIN following f ON f.entity = p.entity AND f.k = p.k
), said AS (
  SELECT event_id, n, e FROM calls WHERE e IS NOT NULL
  UNION ALL SELECT event_id, n, CASE WHEN p.k IS NULL THEN 'RateLimitExceeded' END FROM o LEFT JOIN passed p USING (entity, k)
)"""


@query(
    """ SELECT event_id, e AS error_type, CASE e WHEN 'UnknownTool' THEN 'use_list_tools' WHEN 'ValidationError' THEN 'fix_input_and_retry' WHEN 'AuthorizationError' THEN 'use_admin_or_compliance_credentials'
  WHEN 'PreconditionFailed' THEN 'inspect_stream' WHEN 'RateLimitExceeded' THEN 'retry_after_cooldown' END AS suggested_action,
  CASE WHEN e = 'ValidationError' THEN 'entity_id:missing,more:extra_forbidden' END AS validation_errors FROM said""",
    "RECURSIVE " + _CALLS_SQL,
)
def command_refusals(spark, sf_dir):
    """Integrity checks on three entities: unknown tools, wrong arguments, roles, preconditions, and calls too soon."""
    n = F.col("event_id").cast("long")
    tool = F.when(n % 11 == 0, "run_check").otherwise("run_integrity_check")
    role = F.when(n % 11 == 2, "viewer").when(n % 2 == 0, "admin").otherwise("compliance")
    good = F.to_json(F.struct(F.lit("application").alias("entity_type"), F.concat(F.lit("user"), n % 3).alias("entity_id"), role.alias("role")))
    arguments = F.when(n % 11 == 1, '{"entity_type":"application","role":"admin","more":1}').otherwise(good)
    calls = activity_log(spark, sf_dir).select("event_id", tool.alias("tool"), arguments.alias("arguments"), "recorded_at", "global_position")
    out = refusals.judged(calls, F.when(n % 11 == 3, "the stream is empty"), F.lit("inspect_stream"))
    return out.select("event_id", "error_type", "suggested_action", "validation_errors")
