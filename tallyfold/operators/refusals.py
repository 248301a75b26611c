"""Commands' refusals as typed rows: schema, role, precondition, then rate (M-06, P-13).

The first of these that stands against a call is its error; a call without any goes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions import payloads
from .lifecycle import rate_limited

#: Who may give which command where not everyone may.
ROLES = {"compliance": ("run_integrity_check",), "admin": ("run_integrity_check",)}
#: What a caller is told to do about an error.
ACTIONS = {
    "UnknownTool": "use_list_tools", "ValidationError": "fix_input_and_retry", "AuthorizationError": "use_admin_or_compliance_credentials",
    "DomainError": "review_preconditions_and_retry", "RateLimitExceeded": "retry_after_cooldown", "OptimisticConcurrencyError": "reload_stream_and_retry",
}
SECONDS = 60


def judged(calls: DataFrame, precondition: Column | None = None, action: Column | None = None) -> DataFrame:
    """The calls with ``error_type``, ``suggested_action`` and ``validation_errors``; all null for those that pass.

    ``calls`` have tool, arguments (JSON), recorded_at and global_position.  ``precondition`` is a
    reason or null, ``action`` what it suggests.  Of the integrity checks that would pass, those within
    a minute after the last one that passed on the same entity are refused.
    """
    known = F.col("tool").isin(*payloads.COMMANDS)
    calls, errors = calls.withColumn("_errors", F.when(known, payloads.violations("tool", "arguments", payloads.COMMANDS))), F.col("_errors")
    shown = F.array_join(F.transform(errors, lambda e: F.concat(e["loc"], F.lit(":"), e["code"])), ",")
    limited = {c for own in ROLES.values() for c in own}
    allowed = ~F.col("tool").isin(*limited) | js.permitted(js.text("arguments", "role"), F.col("tool"), ROLES)
    stage = (
        F.when(F.col("tool").isNull() | ~known, "UnknownTool").when(F.size(errors) > 0, "ValidationError").when(~allowed, "AuthorizationError")
        .when((F.lit(None).cast("string") if precondition is None else precondition).isNotNull(), "PreconditionFailed")
    )
    entity = F.concat_ws(":", js.text("arguments", "entity_type"), js.text("arguments", "entity_id"))
    rows = calls.withColumns({"error_type": stage, "validation_errors": F.when(F.size(errors) > 0, shown), "_said": F.lit(None).cast("string") if action is None else action})
    # Calls that are no checks, or have failed already, take no part in the limit: each has a key of its own, so that all calls are judged by one pass.
    checked = (F.col("tool") == "run_integrity_check") & F.col("error_type").isNull()
    rows = rows.withColumn("_checked", F.coalesce(checked, F.lit(False))).withColumn("_entity", F.when(F.col("_checked"), F.concat(F.lit("c"), entity)).otherwise(F.concat(F.lit("n"), "global_position")))
    rows = rate_limited(rows, "_entity", seconds=SECONDS)
    rows = rows.withColumn("error_type", F.when(F.col("_checked") & ~F.col("allowed"), "RateLimitExceeded").otherwise(F.col("error_type")))
    told = F.when(F.col("error_type") == "PreconditionFailed", F.coalesce("_said", F.lit(ACTIONS["DomainError"])))
    for name, what in ACTIONS.items():
        told = told.when(F.col("error_type") == name, what)
    return rows.withColumn("suggested_action", told).drop("_said", "_entity", "_checked", "_errors", "allowed")
