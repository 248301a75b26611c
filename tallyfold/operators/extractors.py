"""Extraction strategies as a polymorphic table function: registered by name, chosen by a lateral join.

A strategy turns one document into blocks, tables and figures of its own; its output columns are those
of ``COMMON`` and what it adds.  The function's schema follows from the strategy's
name when a query is analysed, so that one function serves all.  It runs where the
document lies: a lateral join moves no text.

``attempted`` asks strategies in turn; only documents whose result stays below the
strategy's gate meet the next one.  It takes all of a document's strategies by one call that returns
what they found in numbers, so that texts go to Python once and don't come back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from .refinery import GATES, confidences, triage

BLOCK = T.StructType().add("page_number", "integer").add("section_title", "string").add("text", "string")
TABLE = T.StructType().add("page_number", "integer").add("headers", T.ArrayType(T.StringType())).add("rows", T.ArrayType(T.ArrayType(T.StringType())))
COMMON = T.StructType().add("text_blocks", T.ArrayType(BLOCK)).add("tables", T.ArrayType(TABLE)).add("chars", "integer")


@dataclass(frozen=True)
class Strategy:
    """``extract`` of (text, suffix) gives a dict with COMMON's entries and those of ``more``."""

    name: str
    extract: Callable[[str, str], dict]
    more: tuple[tuple[str, str], ...] = field(default=())

    def schema(self) -> T.StructType:
        out = T.StructType(list(COMMON.fields))
        for name, kind in self.more:
            out = out.add(name, kind)
        return out


def paragraphs(text: str) -> list[str]:
    """Parts between empty lines, bare of white space around them."""
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def tables_of(text: str, suffix: str) -> list[tuple]:
    """A file of rows as one table; else the lines of three fields and more, where there are two."""
    lines = [x.strip() for x in re.split(r"\r\n|\n|\r", text) if x.strip()]
    rows = [x.split(",") for x in lines if suffix == ".csv" or x.count(",") >= 2]
    least = 1 if suffix == ".csv" else 2
    return [(1, rows[0], rows[1:])] if len(rows) >= least else []


def _title(text: str) -> str | None:
    """The first of a block's first eight lines that reads like a heading."""
    for line in [x.strip() for x in text.splitlines() if x.strip()][:8]:
        line = " ".join(line.split()).strip(" -|")
        words = [w for w in line.split() if any(c.isalpha() for c in w)]
        if not line or len(line) > 90 or line.isdigit() or line[-1] in ".!?;:":
            continue
        if re.match(r"\d+(\.\d+)*\s", line):
            return line
        if not words or len(line.split()) > 12:
            continue
        share = sum(w[0].isupper() for w in words) / len(words)
        if line.isupper() or share >= 0.7 or len(words) <= 5 and share >= 0.5:
            return line
    return None


def fast_text(text: str, suffix: str) -> dict:
    return {"text_blocks": [(1, None, p) for p in paragraphs(text)], "tables": tables_of(text, suffix), "chars": len(text)}


def layout_aware(text: str, suffix: str) -> dict:
    """As ``fast_text``, each block under the last heading seen."""
    base, title, blocks = fast_text(text, suffix), "Document", []
    for page, _, part in base["text_blocks"]:
        title = _title(part) or title
        blocks.append((page, title, part))
    return base | {"text_blocks": blocks, "sections": len({b[1] for b in blocks})}


def vision_augmented(text: str, suffix: str) -> dict:
    """The local part of a vision pass: layout, and how many metrics a reader would look for."""
    base = layout_aware(text, suffix)
    return base | {"figures": len(re.findall(r"\b(?:figure|chart)\b", text, re.I))}


REGISTRY: dict[str, Strategy] = {}


def register(strategy: Strategy) -> None:
    """Makes a strategy available under its name; a name is given once."""
    if strategy.name in REGISTRY:
        raise ValueError(f"{strategy.name} has been registered")
    REGISTRY[strategy.name] = strategy


register(Strategy("fast_text", fast_text))
register(Strategy("layout_aware", layout_aware, (("sections", "integer"),)))
register(Strategy("vision_augmented", vision_augmented, (("sections", "integer"), ("figures", "integer"))))


def _function(registry: dict[str, Strategy]):
    @udtf
    class Extract:
        @staticmethod
        def analyze(strategy: AnalyzeArgument, text: AnalyzeArgument, suffix: AnalyzeArgument) -> AnalyzeResult:
            if not strategy.isConstantExpression or strategy.value not in registry:
                raise ValueError(f"the strategy is one of {', '.join(sorted(registry))}")
            if text.dataType != T.StringType() or suffix.dataType != T.StringType():
                raise ValueError("text and suffix are strings")
            return AnalyzeResult(schema=registry[strategy.value].schema())

        def eval(self, strategy: str, text: str, suffix: str) -> Iterator[tuple]:
            own = registry[strategy]
            found = own.extract(text or "", suffix or "")
            yield tuple(found[f] for f in own.schema().names)

    return Extract


def install(spark: SparkSession, name: str = "extract", registry: dict[str, Strategy] | None = None) -> str:
    """Registers the table function with the strategies known now; SQL calls it ``LATERAL extract('name', text, suffix)``."""
    spark.udtf.register(name, _function(dict(REGISTRY if registry is None else registry)))
    return name


def extracted(docs: DataFrame, strategy: str, key: str = "doc_id", registry: dict[str, Strategy] | None = None) -> DataFrame:
    """(key, the strategy's columns) of each document, which has text and suffix; a null text is an empty one."""
    spark = docs.sparkSession
    install(spark, "tallyfold_extract", registry)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col(key).alias("k"), text, F.col("suffix").cast("string").alias("suffix"))
    found = spark.sql("SELECT d.k, e.* FROM {docs} d, LATERAL tallyfold_extract('" + strategy + "', d.text, d.suffix) e", docs=rows)
    return found.withColumnRenamed("k", key)


def _tries(registry: dict[str, Strategy]):
    @udtf(returnType="attempt int, text_blocks int, tables int, sections int", useArrow=True)
    class Tries:
        def eval(self, strategies: list[str], text: str, suffix: str) -> Iterator[tuple]:
            for turn, name in enumerate(strategies, 1):
                found = registry[name].extract(text or "", suffix or "")
                yield turn, len(found["text_blocks"]), len(found["tables"]), found.get("sections")

    return Tries


def attempted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, attempt, strategy, confidence, passed, text_blocks, tables, sections) of every strategy tried, in turn.

    ``docs`` are those of ``refinery.triage``; a document starts at its cost tier and meets the next strategy
    only where this one stays below its gate.
    """
    rows = confidences(triage(docs.withColumn("doc", F.struct(F.col("text").cast("string").alias("text"), F.col("suffix").cast("string").alias("suffix"))), key, more=("doc",)))
    first = F.when(F.col("cost") == "fast_text_sufficient", 1).when(F.col("cost") == "needs_layout_model", 2).otherwise(3)
    turns = [F.struct(F.lit(name).alias("strategy"), F.col(f"c_{name}").alias("c"), F.lit(gate).alias("gate")) for name, gate in GATES.items()]
    rows = rows.select(F.col(key).alias("k"), "doc", F.slice(F.array(*turns), first, len(turns)).alias("due"))
    # The strategies up to the first that passes.
    passes = F.array_position(F.transform("due", lambda t: t["c"] >= t["gate"]), True).cast("int")
    rows = rows.withColumn("n", passes).select("k", "doc", F.when(F.col("n") > 0, F.slice("due", 1, F.col("n"))).otherwise(F.col("due")).alias("due"))
    docs.sparkSession.udtf.register("tallyfold_tries", _tries(dict(REGISTRY)))
    found = docs.sparkSession.sql("SELECT d.k, d.due, e.* FROM {docs} d, LATERAL tallyfold_tries(d.due.strategy, d.doc.text, d.doc.suffix) e", docs=rows)
    own = F.get("due", F.col("attempt") - 1)
    return found.select(
        F.col("k").alias(key), "attempt", own["strategy"].alias("strategy"), (own["c"] / 100).alias("confidence"), (own["c"] >= own["gate"]).alias("passed"), "text_blocks", "tables", "sections",
    )
