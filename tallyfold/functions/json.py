"""JSON and scalar helpers over columns (F-01 to F-16, K-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is made once a row: a column used in several places is made in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(column: str | Column, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def has(column: str | Column, key: str) -> Column:
    """Whether the object has the key, with a null value too."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def number(column: Column) -> Column:
    """Text as a double; null where it is empty or no number."""
    return F.nullif(column, F.lit("")).try_cast("double")


def truthy(column: Column) -> Column:
    return F.lower(F.coalesce(column, F.lit("false"))) == "true"


def merged(left: Column, right: Column) -> Column:
    """Two objects in one with sorted keys; the right one's keys win, and values keep their types (K-03)."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    mine = F.map_filter(as_map(left), lambda k, v: ~F.coalesce(F.array_contains(F.json_object_keys(right), k), F.lit(False)))
    return F.to_json(F.try_parse_json(F.to_json(F.map_concat(mine, as_map(right)))))


def stamped(metadata: Column, correlation_id: Column, causation_id: Column) -> Column:
    """Metadata with the correlation and cause that a write gives; null ones leave what is there (K-02)."""
    given = F.to_json(F.struct(correlation_id.alias("correlation_id"), causation_id.alias("causation_id")))
    return merged(F.coalesce(metadata, F.lit("{}")), given)


def in_unit_range(column: Column) -> Column:
    return F.when(column.between(0, 1), column)


def hours_between(start: str, stop: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(stop)) / 3600e6


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold, null counting as not holding (P-12)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def permitted(role: Column, command: Column, policy: dict[str, tuple[str, ...]]) -> Column:
    """Whether a role may give a command (P-13)."""
    out = F.lit(False)
    for name, commands in policy.items():
        out = out | ((role == name) & command.isin(*commands))
    return F.coalesce(out, F.lit(False))
