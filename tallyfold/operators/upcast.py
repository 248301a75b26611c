"""Read-time schema evolution: a registry of column rewrites, applied in version order.

Rows are envelopes with ``event_type``, ``event_version``, ``recorded_at`` and JSON text
``payload`` and ``metadata``.  The stored rows never change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import bound, merged


class Upcasters:
    """One rewrite for each (event type, from version)."""

    def __init__(self):
        self.steps: dict[tuple[str, int], tuple[int, Callable[[], Column]]] = {}

    def register(self, event_type: str, from_version: int, to_version: int):
        """Decorator of a function that gives the new payload column."""
        if to_version <= from_version:
            raise ValueError("a rewrite leads to a later version")
        if (event_type, from_version) in self.steps:
            raise ValueError(f"{event_type} v{from_version} has a rewrite already")

        def add(function: Callable[[], Column]):
            self.steps[event_type, from_version] = (to_version, function)
            return function

        return add

    def apply(self, log: DataFrame) -> DataFrame:
        """All rows at their latest version, with the names of the steps that were applied."""
        out = log.withColumn("upcast_steps", F.array().cast("array<string>"))
        for (kind, version), (to, function) in sorted(self.steps.items(), key=lambda x: x[0][1]):
            due = (F.col("event_type") == kind) & (F.col("event_version") == version)
            out = out.withColumn(READ, F.when(due, read())).withColumns(
                {
                    "payload": F.when(due, function()).otherwise(F.col("payload")),
                    "metadata": F.when(due, noted(F.col("metadata"), kind, version, to)).otherwise(F.col("metadata")),
                    "event_version": F.when(due, F.lit(to)).otherwise(F.col("event_version")).cast("int"),
                    "upcast_steps": F.when(due, F.concat("upcast_steps", F.array(F.lit(f"{kind}:v{version}->v{to}")))).otherwise(F.col("upcast_steps")),
                }
            ).drop(READ)
        return out


def noted(metadata: Column, kind: str, version: int, to: int) -> Column:
    """Metadata whose ``upcast_notes`` name one step more."""
    held = F.from_json(F.get_json_object(metadata, "$.upcast_notes"), "array<string>")
    notes = F.concat(F.coalesce(held, F.array().cast("array<string>")), F.array(F.lit(f"{kind}:v{version}->v{to}")))
    return merged(F.coalesce(metadata, F.lit("{}")), F.to_json(F.struct(notes.alias("upcast_notes"))))


#: The column that a rewrite finds both in, and what it reads of a payload and of its metadata.
READ = "_read"
PAYLOAD = "model_version string, regulatory_basis string, confidence_score string, orchestrator_agent_id string, decision_basis_summary string, contributing_agent_sessions array<string>, model_versions map<string,string>"
METADATA = "model_version string, regulation_set_version string, orchestrator_model_version string, agent_session_model_versions map<string,string>, agent_model_versions map<string,string>"


def some(value: Column) -> Column:
    """A text that isn't empty, else null."""
    return F.when(value != "", value)


def before(moment: str) -> Column:
    return F.col("recorded_at") < F.lit(moment).cast("timestamp_ntz")


def credit_model(payload: Column, metadata: Column) -> Column:
    """The model in force by release window, where neither payload nor metadata names it."""
    window = F.when(F.col("recorded_at").isNull(), "legacy-unknown").when(before("2025-01-01"), "credit-v1").when(before("2025-09-01"), "credit-v1.5").otherwise("credit-v2")
    return F.coalesce(some(payload["model_version"]), some(metadata["model_version"]), window)


def regulatory_basis(payload: Column, metadata: Column) -> Column:
    window = F.when(F.col("recorded_at").isNull(), None).when(before("2025-07-01"), "regset-2025.1").when(before("2026-01-01"), "regset-2025.2").otherwise("regset-2026.1")
    return F.coalesce(some(payload["regulatory_basis"]), some(metadata["regulation_set_version"]), window)


def confidence(payload: Column) -> Column:
    """A score within [0, 1], else null: unknown is not invented."""
    score = payload["confidence_score"].try_cast("double")
    return F.when(score.between(0, 1), score)


def agent_of_session(stream: Column) -> Column:
    """The agent in ``agent-<agent>-<session>``; the session stands after the last hyphen."""
    return F.nullif(F.regexp_extract(stream, r"^agent-(.*)-[^-]*$", 1), F.lit(""))


def model_versions(payload: Column, metadata: Column) -> Column:
    """A decision's models by agent: those it names, then its sessions', then the orchestrator's."""
    unknown = F.lit("legacy-unknown")
    named = F.map_filter(payload["model_versions"], lambda k, v: (k != "") & (v != ""))
    sessions = F.transform(payload["contributing_agent_sessions"], lambda s: F.struct(s.alias("session"), agent_of_session(s).alias("agent")))
    of = lambda s: F.coalesce(some(F.try_element_at(metadata["agent_session_model_versions"], s["session"])), some(F.try_element_at(metadata["agent_model_versions"], s["agent"])), unknown)
    pairs = F.transform(F.filter(sessions, lambda s: s["agent"].isNotNull()), lambda s: F.struct(s["agent"].alias("key"), of(s).alias("value")))
    orchestrator = F.struct(some(payload["orchestrator_agent_id"]).alias("key"), F.coalesce(some(metadata["orchestrator_model_version"]), unknown).alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(F.coalesce(F.map_entries(named), none), F.coalesce(pairs, none), F.filter(F.array(orchestrator), lambda e: e["key"].isNotNull()))
    # Of an agent's several entries the first holds.
    first = lambda es: F.filter(es["entries"], lambda e, i: F.array_position(es["keys"], e["key"]) == i + 1)
    keyed = bound(entries, lambda es: F.struct(es.alias("entries"), es["key"].alias("keys")))
    return bound(keyed, lambda es: F.map_from_entries(F.array_sort(first(es))))


def read() -> Column:
    """The payload as a whole, and what the rewrites read of it and of the metadata: each text is parsed here alone."""
    return F.struct(F.try_parse_json("payload").alias("whole"), F.from_json("payload", PAYLOAD).alias("payload"), F.from_json("metadata", METADATA).alias("metadata"))


def _rewritten(keys: tuple[str, ...], more: dict[str, Column]) -> Column:
    """The payload with these keys as they are and more."""
    return F.to_json(F.struct(*[F.try_variant_get(f"{READ}.whole", f"$.{k}", "variant").alias(k) for k in keys], *[c.alias(k) for k, c in more.items()]))


def default_upcasters() -> Upcasters:
    registry = Upcasters()

    payload, metadata = F.col(f"{READ}.payload"), F.col(f"{READ}.metadata")

    @registry.register("CreditAnalysisCompleted", 1, 2)
    def credit() -> Column:
        kept = ("application_id", "agent_id", "session_id", "risk_tier", "recommended_limit_usd", "analysis_duration_ms", "input_data_hash")
        return _rewritten(kept, {"model_version": credit_model(payload, metadata), "confidence_score": confidence(payload), "regulatory_basis": regulatory_basis(payload, metadata)})

    @registry.register("DecisionGenerated", 1, 2)
    def decision() -> Column:
        kept = ("application_id", "orchestrator_agent_id", "recommendation", "compliance_status", "assessed_max_limit_usd")
        more = {
            "confidence_score": payload["confidence_score"].try_cast("double"), "contributing_agent_sessions": payload["contributing_agent_sessions"],
            "decision_basis_summary": F.coalesce(payload["decision_basis_summary"], F.lit("LEGACY_EVENT_NO_SUMMARY")), "model_versions": model_versions(payload, metadata),
        }
        return _rewritten(kept, more)

    return registry
