"""What lies between two jobs: checkpoints and tables in the folder that the whole cluster shares.

The folder is that of ``spark.checkpoint.dir``.  Only a session within one machine may
leave it unset and gets a temporary one; on a cluster that is an error, as executors
would write to disks of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_tables: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[context.applicationId]


def kept(frame: DataFrame) -> DataFrame:
    """The rows behind a checkpoint, so that their lineage ends there."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(frame.sparkSession))
    return frame.checkpoint()


def large(frame: DataFrame) -> DataFrame:
    """The frame as a join's side that is dealt out by key, never broadcast.

    Sizes behind an explode or a fold are guessed from the source's bytes and come out far too small: a
    side that grows with the log would go through the driver as a whole.
    """
    return frame.hint("merge")


def written(frame: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a Parquet table of the shared folder, read again; ``release`` deletes it."""
    out, path = table_at(frame, name)
    _tables.append(path)
    return out


def table_at(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table of the shared folder, read again, and where it lies; its maker deletes it."""
    path = f"{folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that ``written`` made after the first ``since``; what reads them must be done."""
    while len(_tables) > since:
        delete(spark, _tables.pop())


def tables() -> int:
    """How many tables ``written`` has made that are not deleted."""
    return len(_tables)
