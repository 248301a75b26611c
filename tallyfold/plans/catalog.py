"""All registered queries of the library, but those of the llm subpackage."""

from __future__ import annotations

from . import (  # noqa: F401  (registration)
    command_queries, decision_queries, dossier_queries, ledger_queries, payload_queries, refinery_queries, replay_queries, stream_queries, structure_queries,
)


def queries() -> dict:
    return dict(ledger_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ledger_queries.ORACLES)
