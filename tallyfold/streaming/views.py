"""Views kept up to date by Structured Streaming, one version folder a batch.

A batch's new version is written whole before the pointer names it, and is named by
the batch's number: a batch that runs again writes the same version.  Readers keep the
version they opened.  Rows that fail validation go to quarantine and never block.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class View:
    """A versioned table: folder/v=<version> and numbered pointer files, of which the last holds.

    A pointer is written whole under another name and then renamed, so that no reader
    meets half of one.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        where = self._path(f"{self.folder}/pointers")
        if not self._fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def pointer(self) -> dict | None:
        last = self._last()
        if not last:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/pointers/{last}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        now = self.pointer()
        return self.spark.createDataFrame([], self.schema) if now is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={now['version']}")

    def publish(self, rows: DataFrame, version: int | str, position: int | None = None, floor: int = 0) -> None:
        """Writes a version and then points to it; a version that is pointed to already stays.

        ``floor`` is the position up to which the version holds the whole log.
        """
        now = self.pointer()
        if now is not None and now["version"] == version:
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        part = self._path(f"{self.folder}/pointers/{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps({"version": version, "position": position, "floor": floor}).encode()))
        stream.close()
        if not self._fs.rename(part, self._path(f"{self.folder}/pointers/{self._last() + 1}.json")):
            raise RuntimeError(f"another writer published a version of {self.folder}")

    def reset(self) -> None:
        self._fs.delete(self._path(self.folder), True)


def _tried(action: Callable[[], None], retries: int, delay: float) -> None:
    """Runs an action again after failures, with doubling pauses."""
    for turn in range(retries + 1):
        try:
            return action()
        except Exception:
            if turn == retries:
                raise
            time.sleep(delay * 2**turn)


def keep_up(
    stream: DataFrame, view: View, delta: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str,
    valid: F.Column | None = None, quarantine: str | None = None, position: str = "global_position", trigger: dict | None = None, retries: int = 3, delay: float = 0.2,
):
    """Starts a query that merges each batch's delta into the view (K-05 to K-07, T-01 to T-05).

    ``merge`` gets the old view and the delta of the batch.  A batch that runs again has
    its number and is published once; events that a rebuild covers are left out.  A batch
    that fails is tried again after growing pauses; rows that fail validation go aside.
    """

    def step(batch: DataFrame, number: int) -> None:
        now = view.pointer() or {}
        if isinstance(now.get("version"), int) and now["version"] >= number:
            return
        floor = now.get("floor") or 0
        fresh = batch.filter(F.col(position) > floor)
        good = fresh if valid is None else fresh.filter(F.coalesce(valid, F.lit(False)))
        if valid is not None and quarantine:
            fresh.filter(~F.coalesce(valid, F.lit(False))).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        top = max(now.get("position") or 0, fresh.agg(F.max(position)).first()[0] or 0)
        _tried(lambda: view.publish(merge(view.read(), delta(good)), number, top, floor), retries, delay)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lowest(views: list[View]) -> int:
    """The position that all these views have reached (T-01)."""
    return min(((v.pointer() or {}).get("position") or 0 for v in views), default=0)


def counters(events: DataFrame) -> DataFrame:
    """Events of each stream by type, and the last event of each."""
    return events.groupBy("stream_id", "event_type").agg(F.count("*").alias("n"), F.max("global_position").alias("last_position"))


COUNTERS = "stream_id string, event_type string, n long, last_position long"


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of both (K-06): sums, and the greater position."""
    return old.unionByName(new).groupBy("stream_id", "event_type").agg(F.sum("n").alias("n"), F.max("last_position").alias("last_position"))


def lag(view_position: int | None, log: DataFrame, now: str, position: str = "global_position") -> DataFrame:
    """Events behind, age of the oldest of them and an alarm level (T-06)."""
    behind = log.filter(F.col(position) > (view_position or 0))
    row = behind.agg(F.count("*").alias("events_behind"), F.min("recorded_at").alias("oldest"))
    age = F.coalesce(F.timestamp_diff("MILLISECOND", F.col("oldest"), F.lit(now).cast("timestamp_ntz")), F.lit(0).cast("long"))
    row = row.withColumn("lag_ms", F.when(F.col("events_behind") == 0, 0).otherwise(age))
    return row.select("events_behind", "lag_ms", F.when(F.col("lag_ms") > 5000, "CRITICAL").when(F.col("lag_ms") > 1000, "WARNING").otherwise("OK").alias("status"))


def rebuild(view: View, log: DataFrame, fold: Callable[[DataFrame], DataFrame], version: str, upto: int) -> None:
    """A fresh version from the log up to a position; readers see the old one until it is done (T-07, T-08)."""
    view.publish(fold(log.filter(F.col("global_position") <= upto)), version, upto, upto)


def daily_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events a day and type with a watermark; for streams and tables alike."""
    timed = events.withColumn("at", F.col("recorded_at").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
