"""Document refinement: profiles, chunks, tables, sections, facts and search, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WORDS = 450
#: Keywords of each domain, in the order that breaks ties.
DOMAINS = {
    "financial": ("revenue", "ebitda", "balance sheet", "net income", "asset"),
    "legal": ("whereas", "agreement", "plaintiff", "statute", "clause"),
    "technical": ("system", "architecture", "latency", "throughput", "api"),
    "medical": ("patient", "diagnosis", "clinical", "treatment", "hospital"),
}
#: Patterns of metrics in lower-case text.
METRICS = {
    "total_revenue": r"(?:total\s+revenue|revenue)\s*[:=-]?\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)",
    "net_income": r"(?:net\s+income)\s*[:=-]?\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)",
    "ebitda": r"(?:ebitda)\s*[:=-]?\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)",
    "total_assets": r"(?:total\s+assets)\s*[:=-]?\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)",
    "total_liabilities": r"(?:total\s+liabilities)\s*[:=-]?\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)",
}


def words(text: Column) -> Column:
    """Words between white space (F-20)."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct lower-case letter and digit tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def domain(text: Column) -> Column:
    """The domain with most keywords, the first on ties, general without any (F-25)."""
    low = F.lower(text)
    scores = {d: sum((F.contains(low, F.lit(k)).cast("int") for k in ks), F.lit(0)) for d, ks in DOMAINS.items()}
    best = F.greatest(*scores.values())
    out = F.lit("general")
    for d in reversed(DOMAINS):
        out = F.when((best > 0) & (scores[d] == best), d).otherwise(out)
    return out


#: File types that are read as text, those that are forms, and layouts that need more than text.
TEXT_TYPES = (".txt", ".md", ".csv", ".json")
FORM_TYPES = (".csv", ".xlsx")
COMPLEX = ("multi_column", "table_heavy", "mixed")
LARGE_PAGES = 20


def _commas(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))


def triage(docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Signals and classes of each document (C-11): density, layout, origin, domain, cost tier; columns in ``more`` stay.

    ``docs`` may bring suffix (``.txt`` where it has none), page_count (1) and
    image_area_ratio (0).  Density is by line for text files, by page for ``.pdf`` and the
    whole length for others.  A null text is an empty one.
    """
    given = lambda name, default: F.coalesce(F.col(name), default) if name in docs.columns else default
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    count = lambda test: F.size(F.filter("lines", test))
    pages = F.greatest(given("page_count", F.lit(1)).cast("int"), F.lit(1))
    out = docs.select(
        key, *more, t.alias("t"), lines.alias("lines"), F.lower(given("suffix", F.lit(".txt"))).alias("suffix"), pages.alias("page_count"),
        given("image_area_ratio", F.lit(0.0)).cast("double").alias("image_area_ratio"),
    )
    n = F.size("lines")
    table = count(lambda x: (_commas(x) >= 3) | F.contains(x, F.lit("|"))) / n
    figure = count(lambda x: F.lower(x).rlike(r"\b(figure|chart)\b")) / n
    header = count(lambda x: F.trim(x).rlike(r"^(\d+(\.\d+)*)\s+"))
    layout = F.when(n == 0, "mixed").when(table > 0.2, "table_heavy").when(figure > 0.1, "figure_heavy").when(header > 8, "multi_column").otherwise("single_column")
    is_pdf, is_text = F.col("suffix") == ".pdf", F.col("suffix").isin(*TEXT_TYPES)
    breaks = F.greatest(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))), F.lit(1))
    density = F.round(F.length("t") / F.when(is_pdf, F.col("page_count")).when(is_text, breaks).otherwise(F.lit(1)), 4)
    out = out.withColumns({"char_density": density, "layout": layout, "domain": domain(F.col("t")), "visible": F.length(F.trim("t"))})
    scanned = (F.col("char_density") < 30) & (F.col("image_area_ratio") > 0.6)
    of_pdf = F.when(scanned, "scanned_image").when(F.col("image_area_ratio") > 0.3, "mixed").otherwise("native_digital")
    origin = F.when(is_pdf, of_pdf).when(F.col("suffix").isin(*FORM_TYPES), "form_fillable").when(F.col("visible") < 40, "mixed").otherwise("native_digital")
    large = (F.col("page_count") >= LARGE_PAGES) & F.col("layout").isin("multi_column", "table_heavy")
    # A text is a table where it is a file of rows, or has two lines of three fields.
    rows = count(lambda x: _commas(F.trim(x)) >= 2)
    tables = F.when((F.col("suffix") == ".csv") & (F.length("t") > 0), 1).when(rows >= 2, 1).otherwise(0)
    blocks = F.size(F.filter(F.split("t", r"\n\s*\n"), lambda x: F.trim(x) != ""))
    out = out.withColumns({"origin": origin, "large_complex": large, "tables": tables, "blocks": blocks})
    vision = (F.col("origin") == "scanned_image") | F.col("large_complex")
    some = F.col("layout").isin(*COMPLEX) | (F.col("origin") == "mixed")
    cost = F.when(vision, "needs_vision_model").when(some, "needs_layout_model").otherwise("fast_text_sufficient")
    return out.withColumn("cost", cost).drop("t", "lines")


#: Confidence that each strategy's result must reach, in hundredths.
GATES = {"fast_text": 90, "layout_aware": 88, "vision_augmented": 72}
STRATEGIES = tuple(GATES)
#: Dollars of a fast and a layout pass, of a page's vision pass, its least, and its budget.
FAST_USD, LAYOUT_USD, PAGE_USD, LEAST_USD, VISION_BUDGET = 0.001, 0.01, 0.08, 0.05, 1.5


def confidences(profiles: DataFrame) -> DataFrame:
    """The confidence of each strategy's result, in hundredths (F-28, C-15)."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    fast = F.lit(35) + points(F.col("visible") > 300, 25) + points(F.col("char_density") > 120, 15) + points(F.col("image_area_ratio") < 0.25, 15) + points(F.col("tables") > 0, 10)
    lost = points(F.col("origin").isin("mixed", "scanned_image"), 12) + points(F.col("image_area_ratio") >= 0.5, 8) + points(F.col("large_complex"), 35)
    raised = F.least(F.lit(100), F.greatest(F.lit(0), F.least(F.lit(100), fast) + F.when(F.col("layout").isin(*COMPLEX), 20).otherwise(10) - lost))
    layout = F.when(F.col("large_complex"), F.least(F.lit(84), raised)).otherwise(raised)
    rows = profiles.withColumns({"c_fast_text": F.least(F.lit(100), fast), "c_layout_aware": layout})
    return rows.withColumn("c_vision_augmented", F.least(F.lit(100), F.col("c_layout_aware") + 10))


def routed(profiles: DataFrame, gate: float | None = None) -> DataFrame:
    """The first strategy from the cost tier on whose confidence passes its gate, else the last; attempts and costs (C-12, F-30).

    ``gate`` stands in for every strategy's own.
    """
    gates = {s: GATES[s] if gate is None else round(gate * 100) for s in STRATEGIES}
    rows = confidences(profiles)
    first = F.when(F.col("cost") == "fast_text_sufficient", 1).when(F.col("cost") == "needs_layout_model", 2).otherwise(3)
    strategy = F.lit(STRATEGIES[-1])
    for turn, name in reversed(list(enumerate(STRATEGIES[:-1], 1))):
        strategy = F.when((first <= turn) & (F.col(f"c_{name}") >= gates[name]), name).otherwise(strategy)
    rows = rows.withColumn("strategy", strategy)
    chain = F.array(*map(F.lit, STRATEGIES))
    last = F.array_position(chain, F.col("strategy")).cast("int")
    held = F.when(F.col("strategy") == STRATEGIES[0], F.col("c_fast_text")).when(F.col("strategy") == STRATEGIES[1], F.col("c_layout_aware")).otherwise(F.col("c_vision_augmented"))
    vision = F.least(F.lit(VISION_BUDGET), F.greatest(F.lit(LEAST_USD), F.round(F.lit(PAGE_USD) * F.col("page_count"), 4)))
    cost = F.when(F.col("strategy") == STRATEGIES[0], FAST_USD).when(F.col("strategy") == STRATEGIES[1], LAYOUT_USD).otherwise(vision)
    rows = rows.withColumn("attempted", F.array_join(F.slice(chain, first, last - first + 1), ","))
    return rows.withColumns({"confidence": held / 100, "cost_usd": cost}).drop(*[f"c_{s}" for s in STRATEGIES])


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS) -> DataFrame:
    """Slices of at most ``size`` words with their hash (C-16, F-18, F-20); whole texts, no join."""
    rows = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    rows = rows.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("w", i * size + 1, size))).alias("i", "part"))
    part = F.col("part")
    rows = rows.select(key, (F.col("i") + 1).alias("chunk"), F.concat_ws("-", F.col(key).cast("string"), F.lit("paragraph"), (F.col("i") + 1).cast("string")).alias("chunk_id"), F.size(part).alias("token_count"), F.array_join(part, " ").alias("content"))
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", "chunk_id", F.lit("paragraph"), F.lit("None"), "content"), 256))


def inline_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts' lines with two commas or more, where there are two such lines (C-13)."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) >= 2)
    out = docs.select(key, rows.alias("rows")).filter(F.size("rows") >= 2)
    return out.select(key, F.size("rows").alias("n_rows"), F.size(F.split(F.col("rows")[0], ",")).alias("n_columns"), F.sha2(F.array_join("rows", "\n"), 256).alias("table_hash"))


def page_sections(pages: DataFrame) -> DataFrame:
    """Headings of raw web pages in order with the words that follow each (C-17, W-07)."""
    parts = F.split("html", r"(?i)<h[1-3][^>]*>")
    rows = pages.select("page_id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("section", "part"))
    title = F.trim(F.regexp_replace(F.regexp_extract("part", r"(?is)^(.*?)</h[1-3]>", 1), r"<[^>]*>", " "))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"(?is)^.*?</h[1-3]>", ""), r"<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", (F.col("section") + 1).alias("section"), title.alias("title"), F.size(words(body)).alias("n_words"))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 8) -> DataFrame:
    """The first capitalised names of a text, at most four words each, once whatever their case (F-21)."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    names = F.regexp_extract_all(clean, F.lit(r"\b([A-Z][A-Za-z]{1,}(?:\s+[A-Z][A-Za-z]{1,})*)\b"), F.lit(1))
    few = F.filter(names, lambda x: F.size(F.split(x, " ")) <= 4)
    rows = docs.select(key, F.posexplode(few).alias("i", "name"))
    first = rows.groupBy(key, F.lower("name").alias("low")).agg(F.min(F.struct("i", "name")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("f.i"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, F.col("rank").cast("int").alias("rank"), F.col("f.name").alias("entity"))


def summary_sentences(text: Column) -> Column:
    """The first two sentences, 320 characters at most (F-22)."""
    # The result is a prefix of the words with single spaces: 320 words hold it.
    clean = F.substring(F.array_join(F.slice(words(text), 1, 320), " "), 1, 320)
    return F.when(clean == "", "No summary available.").otherwise(F.substring(F.array_join(F.slice(F.split(clean, r"(?<=[.!?])\s+"), 1, 2), " "), 1, 320))


def facts(chunked: DataFrame, key: str = "doc_id", content: str = "content", chunk: str = "chunk_id") -> DataFrame:
    """First match of each metric in each chunk (C-18)."""
    low = F.lower(F.col(content))
    found = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.regexp_extract(low, p, 1).alias("raw_value")) for m, p in METRICS.items()])
    rows = chunked.select(key, F.col(chunk).alias("source_chunk_id"), F.explode(F.filter(found, lambda f: f["raw_value"] != "")).alias("f"))
    return rows.select(key, "source_chunk_id", "f.metric_name", "f.raw_value", F.replace("f.raw_value", F.lit(","), F.lit("")).try_cast("double").alias("metric_value"))


def fact_pivot(found: DataFrame, key: str = "doc_id", order: str = "source_chunk_id") -> DataFrame:
    """One column a metric; of several values the last holds (A-30)."""
    return found.groupBy(key).agg(*[F.max_by("metric_value", F.when(F.col("metric_name") == m, F.col(order))).alias(m) for m in METRICS])


def coerced(value: Column) -> Column:
    """A number from text with brackets, thousands and magnitude words (F-24)."""
    raw = F.lower(F.trim(value))
    negative = raw.rlike(r"^\(.*\)$")
    bare = F.when(negative, F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw)
    scale = F.when(F.contains(bare, F.lit("billion")) | bare.endswith("bn"), 1e9).when(F.contains(bare, F.lit("million")) | bare.endswith("m") | bare.endswith("mn"), 1e6).when(F.contains(bare, F.lit("thousand")) | bare.endswith("k"), 1e3).otherwise(1.0)
    number = F.nullif(F.regexp_replace(bare, r"[^0-9.\-]", ""), F.lit("")).try_cast("double") * scale
    return F.when(~raw.isin("", "null", "none", "n/a", "na"), F.when(negative, -number).otherwise(number))


def search(chunked: DataFrame, question: str, k: int = 5, content: str = "content", order: tuple[str, ...] = ("doc_id", "chunk")) -> DataFrame:
    """The k chunks that hold most of the question's tokens, in order on ties (F-23, O-05)."""
    asked = tokens(F.lit(question))
    share = F.round(F.size(F.array_intersect(asked, tokens(F.col(content)))) / F.size(asked), 6)
    return chunked.withColumn("score", share).filter("score > 0").orderBy(F.desc("score"), *order).limit(k)


def provenance(found: DataFrame, chunked: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Facts with the start of their chunk; ids may carry a prefix up to a colon (J-10, F-37)."""
    source = F.col("source_chunk_id")
    excerpt = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, 180)
    chunks_ = chunked.select(F.col(chunk).alias("c"), excerpt.alias("excerpt"))
    return found.join(chunks_, F.element_at(F.split(source, ":"), -1) == F.col("c"), "left").drop("c")
