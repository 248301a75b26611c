"""A relay over an outbox: a state machine of deliveries, and a sink that publishes with commit and abort.

``deliveries`` keeps messages in Spark's state store, the messages of a bucket as columns of one value, so
that Python is called once a bucket and batch.  A new message is claimed at once
and leased; an outcome publishes it, sends it back with a doubling pause, or buries it after the
last attempt.  A lease or pause that ends is noticed by its bucket's timer, so that time is that of
the stream's watermark: a virtual clock in tests.

``Outbox`` is the sink for claims.  Its tasks publish each message by a publisher of the user's own and
stage outcomes as files; ``commit`` moves a batch's files to where ``deliveries`` reads
outcomes, ``abort`` deletes them.  A run that dies between publishing and commit publishes again: a
message is delivered at least once, and a receiver keeps one by its outbox_id.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.outbox import BASE_SECONDS, CAP_SECONDS, ERROR_LENGTH, LEASE_SECONDS, MAX_ATTEMPTS
from .keyed import ROCKS

CHANGES = "outbox_id long, change string, attempts int, due_ms long, error string, at_ms long"
INPUT = "outbox_id long, kind string, attempt int, error string, at timestamp"
#: Messages are dealt out over so many values of the state store.
BUCKETS = 1024
PENDING, PUBLISHED, DEAD = 0, 1, 2
OUTCOMES = "outbox_id long, attempt int, error string, at timestamp"


class Publisher(Protocol):
    """What a relay publishes by; raising is a failed delivery."""

    def publish(self, message: dict) -> None: ...


def shortened(error: str | None, most: int = ERROR_LENGTH) -> str | None:
    return error if error is None or len(error) <= most else error[: most - 3] + "..."


def pause_ms(attempts: int, base: float = BASE_SECONDS, cap: float = CAP_SECONDS) -> int:
    return int(1000 * min(base * 2 ** max(0, min(attempts - 1, 40)), cap))


class Held:
    """The deliveries of one bucket of messages in columns, sorted by outbox_id; ``due`` is -1 where none is."""

    def __init__(self, value: tuple | None):
        kinds = (np.int64, np.int8, np.int32, np.int64)
        parts = (b"",) * 4 if value is None else value[:4]
        self.ids, self.status, self.attempts, self.due = (np.frombuffer(p, k).copy() for p, k in zip(parts, kinds))
        self.timer = None if value is None else value[4]

    def value(self) -> tuple:
        return (*(c.tobytes() for c in (self.ids, self.status, self.attempts, self.due)), self.timer)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids stand or would stand, and whether they are there."""
        at = np.searchsorted(self.ids, ids)
        there = at < len(self.ids)
        there[there] = self.ids[at[there]] == ids[there]
        return at, there

    def add(self, ids: np.ndarray, due: np.ndarray) -> None:
        """New ids in ascending order, claimed for the first time."""
        at = np.searchsorted(self.ids, ids)
        self.ids, self.due = np.insert(self.ids, at, ids), np.insert(self.due, at, due)
        self.status, self.attempts = np.insert(self.status, at, PENDING), np.insert(self.attempts, at, 1)


class Delivery(StatefulProcessor):
    """pending -> (published | dead_letter), by outcomes and timers, for all messages of a bucket at once.

    A bucket has one timer, that of its next lease or pause.
    """

    def __init__(self, max_attempts: int, base: float, cap: float, lease: float):
        self.max_attempts, self.lease_ms = max_attempts, int(1000 * lease)
        self.pauses = np.array([pause_ms(n, base, cap) for n in range(42)], np.int64)  # the later ones are equal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("deliveries", "ids binary, status binary, attempts binary, due binary, timer long")

    def _keep(self, held: Held) -> None:
        waits = held.due[held.due >= 0]
        due = int(waits.min()) if len(waits) else None
        if due != held.timer:
            if held.timer is not None:
                self.handle.deleteTimer(held.timer)
            if due is not None:
                self.handle.registerTimer(due)
            held.timer = due
        self.state.update(held.value())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [c for c in (chunk[chunk["kind"] != "tick"] for chunk in rows) if len(c)]
        if not chunks:
            return
        # What is told of one message is taken in the order of time, its message first.
        told = pd.concat(chunks)
        told = told.iloc[np.lexsort(((told["kind"] != "message").to_numpy(), told["at_ms"].to_numpy(), told["outbox_id"].to_numpy()))]
        turn = told.groupby("outbox_id", sort=False).cumcount().to_numpy()
        held, out = Held(self.state.get()), []
        for n in range(int(turn.max()) + 1):
            out += self._taken(held, told[turn == n])
        if out:
            self._keep(held)
            yield pd.concat(out)

    def _taken(self, held: Held, told: pd.DataFrame) -> list[pd.DataFrame]:
        """Changes by rows of distinct messages, in their order."""
        out, message = [], (told["kind"] == "message").to_numpy()
        ids, now = told["outbox_id"].to_numpy(np.int64), told["at_ms"].to_numpy(np.int64)
        at, there = held.places(ids)
        new = message & ~there  # a message that comes again is the same
        settled = (told["kind"] == "outcome").to_numpy() & there
        attempt = told["attempt"].to_numpy()
        settled[settled] = (held.status[at[settled]] == PENDING) & (held.attempts[at[settled]] == attempt[settled])
        failed = told["error"].notna().to_numpy()
        last = attempt >= self.max_attempts
        for which, change, status in ((settled & ~failed, "published", PUBLISHED), (settled & failed & last, "dead_letter", DEAD), (settled & failed & ~last, "retried", PENDING)):
            if which.any():
                due = now[which] + self.pauses[np.clip(attempt[which], 0, 41).astype(int)] if change == "retried" else np.full(which.sum(), -1)
                held.status[at[which]], held.due[at[which]] = status, due
                errors = None if change == "published" else [shortened(str(e).strip() or "Error") for e in told["error"][which]]
                out.append(self._frame(ids[which], change, attempt[which], due, errors, now[which]))
        if new.any():
            held.add(ids[new], now[new] + self.lease_ms)
            out.append(self._frame(ids[new], "claimed", 1, now[new] + self.lease_ms, None, now[new]))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, mark, held = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), Held(self.state.get())
        held.timer = None  # it is gone already
        ended = (held.due >= 0) & ((held.due <= at) | (held.due < mark))
        # Claimed when it is noticed, as a poll would.
        now = np.maximum(held.due[ended], mark)
        held.attempts[ended] += 1
        held.due[ended] = now + self.lease_ms
        self._keep(held)
        yield self._frame(held.ids[ended], "claimed", held.attempts[ended], now + self.lease_ms, None, now)

    @staticmethod
    def _frame(ids: np.ndarray, change: str, attempts, due: np.ndarray, errors: list | None, now: np.ndarray) -> pd.DataFrame:
        due = pd.array(due, "Int64")
        due[due < 0] = pd.NA
        frame = pd.DataFrame({"outbox_id": ids, "change": change, "attempts": attempts, "due_ms": due, "error": pd.Series(errors, dtype=object) if errors else None, "at_ms": now})
        return frame.astype({"change": object, "attempts": "int32", "error": object})

    def close(self) -> None:
        pass


def deliveries(
    stream: DataFrame, max_attempts: int = MAX_ATTEMPTS, base: float = BASE_SECONDS, cap: float = CAP_SECONDS, lease: float = LEASE_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Changes of messages' states (T-10, T-11): claimed, published, retried or dead_letter, with attempts and when they are due.

    ``stream`` has INPUT's columns: messages, outcomes of attempts, and ticks, whose only use is their time.
    An outcome of an attempt that has been given up is ignored, as is one of a message that is done.
    What a batch tells of one message is taken in the order of time.
    Ticks are in a bucket of their own.
    """
    bucket = F.when(F.col("kind") == "tick", F.lit(-1)).otherwise(F.pmod(F.xxhash64("outbox_id"), F.lit(buckets)).cast("int"))
    timed = stream.withWatermark("at", "0 seconds").select(bucket.alias("bucket"), "outbox_id", "kind", "attempt", "error", F.unix_millis("at").alias("at_ms"), "at")
    return timed.groupBy("bucket").transformWithStateInPandas(Delivery(max_attempts, base, cap, lease), CHANGES, "Update", "EventTime")


def start(changes: DataFrame, folder: str, trigger: dict | None = None):
    """Appends the changes under ``folder``, claims apart from the rest, a folder a batch; returns the query."""
    spark = changes.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("change") == "claimed", "claim").otherwise("done")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/changes/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def changes_of(spark: SparkSession, folder: str) -> DataFrame:
    shape = f"{CHANGES}, batch long, kind string"
    return spark.read.schema(shape).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")


def states(changes: DataFrame) -> DataFrame:
    """(outbox_id, status, attempts, due_ms, last_error) after the last change of each message."""
    order = F.struct("batch", "attempts", F.when(F.col("change") == "claimed", 0).otherwise(1))
    last = changes.groupBy("outbox_id").agg(F.max_by(F.struct("change", "attempts", "due_ms", "error"), order).alias("x"))
    status = F.when(F.col("x.change").isin("published", "dead_letter"), F.col("x.change")).otherwise("pending")
    return last.select("outbox_id", status.alias("status"), "x.attempts", "x.due_ms", F.col("x.error").alias("last_error"))


# ------------------------------------------------------------------- the sink


@dataclass
class Staged(WriterCommitMessage):
    """One task's outcomes: where they lie and how many they are."""

    path: str | None
    rows: int


class Outbox(DataSource):
    """``writeStream.format("tallyfold_outbox")`` with options publisher (``module:Class``) and folder."""

    @classmethod
    def name(cls) -> str:
        return "tallyfold_outbox"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return OutboxWriter(self.options["publisher"], self.options["folder"])


class OutboxWriter(DataSourceStreamWriter):
    """Publishes claims; outcomes count once their batch is committed."""

    def __init__(self, publisher: str, folder: str):
        self.publisher, self.folder = publisher, folder

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str]:
        """The file system of the folder's URI, and the folder in it."""
        return pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        module, name = self.publisher.split(":")
        publisher: Publisher = getattr(importlib.import_module(module), name)()
        out = []
        for row in iterator:
            message, error = row.asDict(), None
            try:
                publisher.publish(message)
            except Exception as e:
                error = shortened(str(e).strip() or type(e).__name__)
            out.append((message["outbox_id"], message["attempts"], error, pd.Timestamp(message["at_ms"], unit="ms", tz="UTC")))
        if not out:
            return Staged(None, 0)
        files, root = self._files()
        files.create_dir(f"{root}/staged", recursive=True)
        path = f"staged/{uuid.uuid4().hex}.parquet"
        shape = pa.schema([("outbox_id", pa.int64()), ("attempt", pa.int32()), ("error", pa.string()), ("at", pa.timestamp("us", tz="UTC"))])
        pyarrow.parquet.write_table(pa.Table.from_pylist([dict(zip(shape.names, r)) for r in out], schema=shape), f"{root}/{path}", filesystem=files)
        return Staged(path, len(out))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = self._files()
        files.create_dir(f"{root}/outcomes", recursive=True)
        for m in messages:
            if m is not None and m.path is not None:
                files.move(f"{root}/{m.path}", f"{root}/outcomes/{batchId}-{m.path.removeprefix('staged/')}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = self._files()
        for m in messages:
            if m is not None and m.path is not None:
                files.delete_file(f"{root}/{m.path}")


def publish(claims: DataFrame, publisher: str, folder: str, checkpoint: str, trigger: dict | None = None):
    """Starts the query that publishes a stream of claims (outbox_id, attempts, at_ms and what the publisher reads)."""
    claims.sparkSession.dataSource.register(Outbox)
    writer = claims.writeStream.format("tallyfold_outbox").option("publisher", publisher).option("folder", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
