"""Reads of a log by stream and by position, within bounds and at the latest versions of their types.

``log`` has stream_id, stream_position, global_position, event_type, event_version,
recorded_at, payload and metadata; stored rows are never changed.  Bounds are filters on plain
columns, which reach the scan of a stored log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upcast import Upcasters, default_upcasters


def _latest(rows: DataFrame, upcasters: Upcasters | None) -> DataFrame:
    return (default_upcasters() if upcasters is None else upcasters).apply(rows).drop("upcast_steps")


def stream(log: DataFrame, stream_id: str, start: int = 1, stop: int | None = None, limit: int | None = None, upcasters: Upcasters | None = None) -> DataFrame:
    """A stream's events by position, from ``start`` to ``stop``, at most ``limit`` of them (S-01, U-13)."""
    if start < 1:
        raise ValueError("start is at least 1")
    if stop is not None and stop < start:
        raise ValueError("stop is not before start")
    if limit is not None and limit < 1:
        raise ValueError("limit is at least 1")
    rows = log.filter((F.col("stream_id") == stream_id) & (F.col("stream_position") >= start))
    rows = rows.filter(F.col("stream_position") <= stop) if stop is not None else rows
    rows = rows.orderBy("stream_position")
    return _latest(rows.limit(limit) if limit is not None else rows, upcasters)


def after(log: DataFrame, position: int = 0, event_types: list[str] | None = None, limit: int | None = None, upcasters: Upcasters | None = None) -> DataFrame:
    """Events behind a global position, of some types, in order (S-02); an empty list of types stands for all."""
    if position < 0:
        raise ValueError("position is not negative")
    if limit is not None and limit < 1:
        raise ValueError("limit is at least 1")
    rows = log.filter(F.col("global_position") > position)
    rows = (rows.filter(F.col("event_type").isin(list(event_types))) if event_types else rows).orderBy("global_position")
    return _latest(rows.limit(limit) if limit is not None else rows, upcasters)


def batches(log: DataFrame, size: int, position: int = 0, event_types: list[str] | None = None):
    """The events behind a position as frames of at most ``size``, one read after another (S-02).

    A batch is read from where the one before it ended; nothing is skipped or read ahead.
    """
    if size < 1:
        raise ValueError("size is at least 1")
    while True:
        batch = after(log, position, event_types, size)
        last = batch.agg(F.max("global_position")).first()[0]
        if last is None:
            return
        yield batch
        position = last
