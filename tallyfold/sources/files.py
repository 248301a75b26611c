"""Document files as tables, guarded SQL over facts, and JSON sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings where a rules table names none.
DEFAULT_RULES = {
    "fast_text_confidence_gate": 0.90, "layout_aware_confidence_gate": 0.88, "vision_confidence_gate": 0.72, "fast_text_min_chars": 300, "fast_text_max_image_ratio": 0.5, "chunk_max_tokens": 450,
}
#: Size that a rules file may have.
RULES_BYTES = 1 << 20


def text_files(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, doc_id, suffix, text) of whole files, and of those under folders, each path once and in order (S-11, S-13, F-19).

    Bytes that are no UTF-8 are left out; files of no bytes give no row.  A path that is missing is an error, as are paths without any
    file.  ``doc_id`` follows from path, time of change in nanoseconds and length.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    if not given:
        raise ValueError("no path is given")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(given).dropDuplicates(["path"])
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no file under {', '.join(given)}")

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else c.decode("utf-8", errors="ignore"))

    path = F.regexp_replace("path", "^file:(//)?", "")
    stamp = F.concat_ws(":", path, (F.unix_micros("modificationTime") * 1000).cast("string"), F.col("length").cast("string"))
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(decoded(F.when(~F.is_valid_utf8(raw), F.col("content"))))
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]+)$", 1))
    return found.select(path.alias("path"), F.substring(F.sha2(stamp, 256), 1, 16).alias("doc_id"), suffix.alias("suffix"), text.alias("text")).orderBy("path")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose first row names the columns, all as text."""
    return spark.read.option("header", "true").csv(path)


def _rule(value: str) -> object:
    """A number, a truth value, or the text without its quotes."""
    if value.replace(".", "", 1).isdigit():
        return float(value) if "." in value else int(value)
    return value.lower() == "true" if value.lower() in ("true", "false") else value.strip("\"'")


def rules(spark: SparkSession, path: str) -> dict[str, object]:
    """``key: value`` lines merged over the defaults (S-14); lines further in belong to the key above them.

    A rules file is a few lines; a larger one is refused, as it comes to the driver whole.
    A key without a value and without lines below it changes nothing, as does a comment.
    """
    file = spark.read.format("binaryFile").load(path)
    size = file.agg(F.sum("length")).first()[0] or 0
    if size > RULES_BYTES:
        raise ValueError(f"a rules file has at most {RULES_BYTES} bytes")
    out: dict[str, object] = {}
    open_ = [(-1, out)]
    for content in file.orderBy("path").select(F.col("content").cast("string").alias("c")).collect():
        for line in content["c"].splitlines():
            key, colon, value = line.strip().partition(":")
            if not colon or key.startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            while depth <= open_[-1][0]:
                open_.pop()
            if value.strip():
                open_[-1][1][key.strip()] = _rule(value.strip())
            else:
                inner: dict[str, object] = {}
                open_[-1][1][key.strip()] = inner
                open_.append((depth, inner))
    return DEFAULT_RULES | {k: v for k, v in out.items() if v != {}}


def structured_query(facts: DataFrame, sql: str, view: str = "fact_table") -> DataFrame:
    """A SELECT over the facts; anything else is refused (S-15)."""
    if not sql.strip().lower().startswith("select"):
        raise ValueError("only SELECT statements are answered")
    facts.createOrReplaceTempView(view)
    return facts.sparkSession.sql(sql)


def write_json(frame: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, in place of what is there or behind it (K-12)."""
    frame.write.mode("append" if append else "overwrite").json(path)


def insert_facts(found: DataFrame, path: str) -> None:
    """Facts behind those of a table; nothing is replaced, so a fact that comes again stands twice (K-13)."""
    found.write.mode("append").parquet(path)


def audited(log: DataFrame, limit: int = 100, at: str = "recorded_at", tie: str = "global_position") -> DataFrame:
    """The newest audit rows first (O-07)."""
    return log.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def seeded(users: DataFrame, seeds: DataFrame, key: str = "username", order: str = "turn") -> DataFrame:
    """Users after seeding (K-14, U-06): of seeds with one key the last holds and is active, other users are not."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    chosen = seeds.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", order, "active").withColumn("active", F.lit(True))
    others = users.join(chosen.select(key), key, "left_anti").drop("active").withColumn("active", F.lit(False))
    return chosen.unionByName(others, allowMissingColumns=True)
