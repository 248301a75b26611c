"""Stored views that are read by key: rows with validity intervals, dealt out by key and sorted.

A view is written into ``buckets`` folders by a hash of its key, each one sorted by key and time in
small row groups.  A point read opens one folder, named by the key's hash, so that no other file is
listed or opened, and its filters reach the row groups.  What a timeline said at a
moment is the row whose interval holds that moment: no sort, no window.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared

BUCKETS = 64
#: Bytes of a row group: a point read decodes one.
ROW_GROUP = 1 << 20


def intervals(timeline: DataFrame, key: str = "application_id", at: str = "recorded_at", order: str = "global_position") -> DataFrame:
    """The rows with ``valid_from`` and ``valid_to``, null for the last one (J-07).

    Of rows at one moment the one with the greatest position holds; the others have empty intervals.
    """
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, order))
    return timeline.withColumn("valid_from", F.col(at)).withColumn("valid_to", following)


def holds(moment: Column) -> Column:
    """Whether a row's interval holds a moment."""
    return (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))


def as_of(rows: DataFrame, moments: DataFrame, key: str = "application_id", at: str = "as_of") -> DataFrame:
    """For each (key, moment) the row of ``intervals`` that holds it; moments before a key's first row find none."""
    asked = moments.select(F.col(key).alias("k"), F.col(at).alias("m"))
    met = asked.join(shared.large(rows), (F.col("k") == F.col(key)) & holds(F.col("m")))
    return met.select(F.col(key), F.col("m").alias(at), *[c for c in rows.columns if c not in (key, "valid_from", "valid_to")])


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write(view: DataFrame, folder: str, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """Writes a view for point reads; a folder that exists is replaced.

    A bucket is one file; ``buckets`` should grow with the view, so that files stay of a size.
    """
    rows = view.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", key, *order)
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(folder)
    about = {"key": key, "buckets": buckets, "schema": view.schema.json()}
    spark = view.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_about")


class Stored:
    """A written view.  What it needs to know of it is read once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = json.loads(spark.read.text(f"{self.folder}/_about").first()[0])
        self.key, self.buckets, self.schema = about["key"], about["buckets"], T.StructType.fromJson(json.loads(about["schema"]))
        self._hashes: dict = {}

    def _folder_of(self, value) -> str:
        if value not in self._hashes:
            kind = self.schema[self.key].dataType
            row = self.spark.range(1).select(_bucket(F.lit(value).cast(kind), self.buckets)).first()
            self._hashes[value] = row[0]
        return f"{self.folder}/bucket={self._hashes[value]}"

    def read(self, value) -> DataFrame:
        """The key's rows, from one folder; none for a key that the view lacks."""
        where = self._folder_of(value)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(where).filter(F.col(self.key) == F.lit(value))

    def at(self, value, moment: str) -> DataFrame:
        """The row that held at a moment (C-10)."""
        return self.read(value).filter(holds(F.lit(moment).cast(self.schema["valid_from"].dataType)))

    def now(self, value) -> DataFrame:
        """The row that holds last."""
        return self.read(value).filter(F.col("valid_to").isNull())

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/bucket=*"])


def stored(view: DataFrame, name: str, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> Stored:
    """The view written into the shared folder, and opened."""
    folder = f"{shared.folder(view.sparkSession)}/{name}"
    write(view, folder, key, order, buckets)
    return Stored(view.sparkSession, folder)
