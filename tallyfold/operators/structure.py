"""Document structure: titles carried forward, sections, packed tables, references, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = ("total_revenue", "net_income", "ebitda", "total_assets", "total_liabilities")


def carried_titles(blocks: DataFrame, key: str, order: str, title: str = "title") -> DataFrame:
    """Blocks with the last title at or before each, ``Document`` before the first (W-08)."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_title", F.coalesce(F.last(title, ignorenulls=True).over(window), F.lit("Document")))


def section_groups(chunks: DataFrame, key: str, order: list[str], title: str = "title", page: str = "page") -> DataFrame:
    """Runs of chunks with one title; a General run also ends where the page grows (W-07).

    Chunks come in page order, so the greatest page of an open run is that of its last chunk.
    """
    by = Window.partitionBy(key).orderBy(*order)
    before, page_before = F.lag(title).over(by), F.lag(page).over(by)
    starts = before.isNull() | (before != F.col(title)) | ((F.col(title) == "General") & (F.col(page) > page_before))
    rows = chunks.withColumn("starts", starts.cast("long")).withColumn("section", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "section").agg(F.first(title).alias(title), F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count("*").alias("chunks"))


def packed_tables(lines: DataFrame, key: str, order: str, tokens: str, header_tokens: int, budget: int) -> DataFrame:
    """Parts of each table: lines in order, a new part with a header where the budget would be passed (W-11)."""
    table = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens].cast("long")).alias("t"))
    start = F.struct(F.lit(1).cast("long").alias("part"), F.lit(header_tokens).cast("long").alias("used"), F.lit(0).cast("long").alias("rows"), F.lit(header_tokens).cast("long").alias("most"))

    def step(s: Column, n: Column) -> Column:
        full = (s["used"] + n > budget) & (s["rows"] > 0)
        used = F.when(full, F.lit(header_tokens) + n).otherwise(s["used"] + n).cast("long")
        return F.struct((s["part"] + full.cast("long")).alias("part"), used.alias("used"), F.when(full, F.lit(1).cast("long")).otherwise(s["rows"] + 1).alias("rows"), F.greatest(s["most"], used).alias("most"))

    return table.select(key, F.aggregate("t", start, step).alias("s")).select(key, F.col("s.part").alias("parts"), F.col("s.most").alias("largest_part"))


def cross_references(chunks: DataFrame, tables: DataFrame, key: str, chunk: str = "chunk_id", content: str = "content") -> DataFrame:
    """Chunks with the table chunks that their ``table N`` mentions name, sorted, each once (J-13).

    ``tables`` have the key, ordinal (from 1) and table_chunk_id.
    """
    mentions = F.regexp_extract_all(F.lower(content), F.lit(r"table\s+([0-9]+)"), F.lit(1))
    named = chunks.select(key, chunk, F.explode(F.array_distinct(mentions)).alias("m")).withColumn("ordinal", F.col("m").try_cast("int"))
    found = named.join(tables, [key, "ordinal"]).groupBy(key, chunk).agg(F.array_join(F.array_sort(F.collect_set("table_chunk_id")), ",").alias("relationships"))
    return chunks.select(key, chunk).join(found, [key, chunk], "left").withColumn("relationships", F.coalesce("relationships", F.lit("")))


def quality(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of critical facts that are there, those missing, and anomalies (F-41)."""
    present = sum((F.col(c).isNotNull().cast("int") for c in CRITICAL), F.lit(0))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CRITICAL])), ",")
    below = F.coalesce(F.col("total_assets") < F.col("total_liabilities"), F.lit(False))
    odd = F.coalesce(F.abs("net_income") > F.col("total_revenue") * 1.5, F.lit(False))
    anomalies = F.concat_ws(",", F.when(below, "assets_below_liabilities"), F.when(odd, "net_income_implausible_relative_to_revenue"))
    return facts.select(key, F.round(present / len(CRITICAL), 3).alias("overall_confidence"), (~below).alias("is_coherent"), anomalies.alias("anomalies"), missing.alias("critical_missing_fields"), (missing != "").alias("reextraction_recommended"))
