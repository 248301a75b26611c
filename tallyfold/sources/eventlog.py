"""An append-only event log of Parquet files with optimistic concurrency.

A commit writes its rows to a folder of its own and then creates the next numbered
commit file, which exactly one writer can do; the loser reads the heads again.  Readers
see the folders that commit files name.  Works on any file system that Spark reaches
and whose create-without-overwrite is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as js
from ..operators import integrity, scans
from ..operators.upcast import default_upcasters

SCHEMA = (
    "event_id string, stream_id string, stream_position long, global_position long, event_type string, event_version int, payload string, metadata string, "
    "recorded_at timestamp_ntz, aggregate_type string"
)
#: Rows of a commit that one task numbers.
BUCKET_ROWS = 500_000


class ConcurrencyError(Exception):
    """Another writer moved a stream past the expected version."""


class StreamNotFound(Exception):
    """No event has been written to a stream."""


class TypeMismatch(Exception):
    """A stream holds events of one aggregate type only."""


class StreamArchived(Exception):
    """An archived stream takes no events."""


class EventLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    # --- commit files

    def _numbers(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.folder}/commits"))
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found if f.getPath().getName().endswith(".json"))

    def _load(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, n: int, entry: dict) -> None:
        """Creates commit n, or fails where it exists."""
        try:
            stream = self._fs.create(self._path(f"{self.folder}/commits/{n}.json"), False)
        except Exception as error:
            if "exist" in str(error).lower():
                raise ConcurrencyError(f"commit {n} has been taken") from error
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()

    def commits(self) -> list[dict]:
        return [self._load(n) for n in self._numbers()]

    # --- reads

    def read(self, upto: int | None = None) -> DataFrame:
        """All committed rows, or those of commits up to a number."""
        names = [c["data"] for n, c in zip(self._numbers(), self.commits()) if c.get("data") and (upto is None or n <= upto)]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/data/{n}" for n in names])

    def current(self) -> DataFrame:
        """All rows as the latest versions of their types say; ``read`` gives them as they were written (U-13)."""
        return default_upcasters().apply(self.read()).drop("upcast_steps")

    def heads(self) -> DataFrame:
        last = lambda c: F.max_by(c, "stream_position")
        link = last(F.get_json_object("metadata", "$.integrity_hash")).alias("last_hash")
        return self.read().groupBy("stream_id").agg(F.max("stream_position").alias("version"), last("aggregate_type").alias("aggregate_type"), link)

    def describe(self, stream_id: str) -> dict:
        """Version, type, last link and archive reason of a stream (S-09)."""
        row = self.heads().filter(F.col("stream_id") == stream_id).first()
        if row is None:
            raise StreamNotFound(stream_id)
        reason = next((e.get("reason") for e in self.commits() if stream_id in e.get("archived", [])), None)
        return row.asDict() | {"archived_reason": reason}

    def stream(self, stream_id: str, start: int = 1, stop: int | None = None, limit: int | None = None) -> DataFrame:
        """A stream's events by position, at their latest versions (S-01)."""
        return scans.stream(self.read(), stream_id, start, stop, limit)

    def after(self, position: int, event_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Events behind a position, of some types, at their latest versions (S-02)."""
        return scans.after(self.read(), position, event_types, limit)

    def version(self, stream_id: str) -> int:
        return self.read().filter(F.col("stream_id") == stream_id).agg(F.coalesce(F.max("stream_position"), F.lit(0))).first()[0]

    # --- writes

    def append(self, events: DataFrame, expected: DataFrame, correlation_id: str | None = None, causation_id: str | None = None, after_write: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Appends the events of streams at their expected versions (-1 and 0: new streams).

        ``events`` have event_id, stream_id, seq (order within the stream), event_type,
        event_version, payload, metadata, recorded_at and maybe aggregate_type;
        ``expected`` has stream_id and expected_version.  Correlation and cause, where
        given, go into the metadata, as do a hash of each event and that before it.  All
        or nothing; returns the new heads.  ``after_write`` gets them once they stand (X-07).
        """
        numbers = self._numbers()
        entries = [self._load(n) for n in numbers]
        archived = {s for e in entries for s in e.get("archived", [])}
        if archived and not events.filter(F.col("stream_id").isin(list(archived))).isEmpty():
            raise StreamArchived(", ".join(sorted(archived)))
        if "aggregate_type" not in events.columns:
            events = events.withColumn("aggregate_type", F.lit(None).cast("string"))
        asked = expected.join(self.heads(), "stream_id", "left").withColumn("version", F.coalesce("version", F.lit(0)))
        wrong = asked.filter(F.greatest(F.col("expected_version"), F.lit(0)) != F.col("version")).orderBy("stream_id").first()
        if wrong is not None:
            raise ConcurrencyError(f"{wrong['stream_id']}: expected {wrong['expected_version']}, actual {wrong['version']}")
        heads = asked.select("stream_id", "version", F.col("aggregate_type").alias("held"), "last_hash")
        placed = events.join(heads, "stream_id")
        other = placed.filter(F.col("aggregate_type") != F.col("held")).first()
        if other is not None:
            raise TypeMismatch(f"{other['stream_id']} holds {other['held']} events, not {other['aggregate_type']}")
        turn = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq", "event_id"))
        placed = placed.withColumn("stream_position", F.col("version") + turn)
        stamp = js.stamped(F.col("metadata"), F.lit(correlation_id).cast("string"), F.lit(causation_id).cast("string"))
        placed = placed.withColumn("metadata", stamp if correlation_id or causation_id else F.coalesce("metadata", F.lit("{}")))
        placed = self._numbered(self._chained(placed), max((e.get("last_position", 0) for e in entries), default=0))
        data = uuid.uuid4().hex
        columns = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        placed.select(*columns).write.parquet(f"{self.folder}/data/{data}")
        last = self.spark.read.parquet(f"{self.folder}/data/{data}").agg(F.max("global_position")).first()[0]
        self._create((numbers[-1] if numbers else 0) + 1, {"data": data, "last_position": last or max((e.get("last_position", 0) for e in entries), default=0)})
        done = self.heads().join(expected.select("stream_id"), "stream_id", "left_semi").select("stream_id", "version")
        if after_write is not None:
            after_write(done)
        return done

    @staticmethod
    def _chained(placed: DataFrame) -> DataFrame:
        """Events with their own and the previous link in the metadata (K-01, A-25)."""
        return integrity.attached(placed, "last_hash")

    @staticmethod
    def _numbered(placed: DataFrame, base: int) -> DataFrame:
        """Global positions behind ``base``: streams in buckets, buckets behind each other by their sizes alone."""
        buckets = max(16, -(-placed.count() // BUCKET_ROWS))
        rows = placed.withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int"))
        sizes = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        starts, at = [], base
        for bucket in range(buckets):
            starts.append(at)
            at += sizes.get(bucket, 0)
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy("stream_id", "stream_position"))
        return rows.withColumn("global_position", F.array(*map(F.lit, starts))[F.col("bucket")].cast("long") + turn)

    def archive(self, stream_id: str, reason: str) -> None:
        numbers = self._numbers()
        last = max((self._load(n).get("last_position", 0) for n in numbers), default=0)
        self._create((numbers[-1] if numbers else 0) + 1, {"archived": [stream_id], "reason": reason, "last_position": last})
