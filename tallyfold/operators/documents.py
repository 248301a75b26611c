"""Documents as blocks, chunks, sections and answers.

Blocks have a document key, block number, page, text and section title; tables a number,
headers and rows.  Chunks carry chunk_id, chunk_type, content, page, parent_section,
token_count and content_hash.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import bound
from ..sources import shared
from .refinery import METRICS, summary_sentences, words

#: Order of chunk types within a page.
PRIORITY = {"paragraph": 0, "list": 1, "table": 2, "figure": 3, "section": 4}
MAX_TOKENS = 450
#: What ``\\s`` matches.
WHITE = " \t\n\x0b\f\r"


def _stripped(text: Column) -> Column:
    """Without white space at its ends; only a text that has some is trimmed, which goes over all its characters."""
    loose = F.lit(False)
    for c in WHITE:
        loose = loose | F.startswith(text, F.lit(c)) | F.endswith(text, F.lit(c))
    return F.when(loose, F.btrim(text, F.lit(WHITE))).otherwise(text)


def stripped_lines(text: Column) -> Column:
    """Lines that hold more than white space, without it at their ends."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), _stripped), lambda x: x != "")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, page, text) of blank-line paragraphs; a text without any is one empty block (C-13)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.filter(F.transform(F.split(whole, r"\n\s*\n"), _stripped), lambda x: x != "")
    some = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    return docs.select(key, F.posexplode(some).alias("i", "text")).select(key, (F.col("i") + 1).alias("block"), F.lit(1).alias("page"), "text")


def _bare(line: Column) -> Column:
    """A line with single spaces and without marks at its ends; one too long for a heading even then stays as it is."""
    marked = F.startswith(line, F.lit("-")) | F.startswith(line, F.lit("|")) | F.endswith(line, F.lit("-")) | F.endswith(line, F.lit("|"))
    long = (F.length(line) > 90) & ~(marked | line.rlike(r"\s\s"))
    return F.when(long, line).otherwise(F.btrim(F.regexp_replace(line, r"\s+", " "), F.lit(" -|")))


def inferred_title(text: Column) -> Column:
    """The first of eight lines that reads as a heading, else null (C-14).

    A heading is numbered, or has at most twelve words of which most begin in upper case.
    """
    clean = F.transform(F.slice(stripped_lines(text), 1, 8), _bare)

    def heading(x: Column) -> Column:
        spoken = F.filter(F.split(x, " "), lambda w: w.rlike(r"\p{L}"))
        upper = F.size(F.filter(spoken, lambda w: w.rlike(r"^\p{Lu}")))
        share = upper / F.greatest(F.size(spoken), F.lit(1))
        titled = (F.upper(x) == x) | (share >= 0.7) | ((F.size(spoken) <= 5) & (share >= 0.5))
        fits = (x != "") & (F.length(x) <= 90) & ~x.rlike(r"^\d+$") & ~x.rlike(r"[.!?;:]\s*$")
        return fits & (x.rlike(r"^(\d+(\.\d+)*)\s+") | ((F.size(F.split(x, " ")) <= 12) & (F.size(spoken) > 0) & titled))

    return F.try_element_at(F.filter(clean, heading), F.lit(1))


def titled_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with the last inferred title at or before each, ``Document`` before the first."""
    order = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    own = inferred_title(F.col("text"))
    return blocks.withColumn("own", own).withColumn("section_title", F.coalesce(F.last("own", ignorenulls=True).over(order), F.lit("Document"))).drop("own")


def titled_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``titled_blocks`` of ``paragraphs`` within each row: no text is sorted or moved; columns in ``more`` stay.

    A row is one document.  Its paragraphs are cut into runs at those that have a title of
    their own, so that the work grows with the text alone.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), _stripped), lambda x: x != "")
    rows = docs.select(key, *more, parts.alias("p")).select(key, *more, F.when(F.size("p") == 0, F.array(F.lit(""))).otherwise(F.col("p")).alias("p"))
    place = lambda i, title: F.struct(i.alias("i"), title.alias("title"))
    own = F.filter(F.transform("p", lambda x, i: place(i, inferred_title(x))), lambda s: s["title"].isNotNull())
    rows = rows.withColumn("starts", F.concat(F.array(place(F.lit(0), F.lit("Document"))), own))
    until = lambda j: F.coalesce(F.get("starts", j + 1)["i"], F.size("p"))
    runs = F.transform("starts", lambda s, j: F.struct(s["i"].alias("i"), s["title"].alias("title"), F.slice("p", s["i"] + 1, until(j) - s["i"]).alias("texts")))
    # Outer explodes: plain ones put a filter before them that computes their arrays once more.
    rows = rows.select(key, *more, F.explode_outer(runs).alias("r")).select(key, *more, "r.i", "r.title", F.posexplode_outer("r.texts").alias("k", "text")).filter("k is not null")
    return rows.select(key, *more, (F.col("i") + F.col("k") + 1).alias("block"), F.lit(1).alias("page"), "text", F.col("title").alias("section_title"))


def _marked(rows: DataFrame) -> DataFrame:
    text = F.concat_ws("|", "chunk_id", "chunk_type", F.coalesce("parent_section", F.lit("None")), "content")
    return rows.withColumn("content_hash", F.sha2(text, 256))


def _hashed(rows: DataFrame) -> DataFrame:
    return _marked(rows.withColumn("token_count", F.size(words(F.col("content")))))


def text_chunks(blocks: DataFrame, key: str = "doc_id", most: int = MAX_TOKENS, more: tuple[str, ...] = ()) -> DataFrame:
    """A numbered list that fits stays whole; other blocks are slices of at most ``most`` words (C-16).

    A block of no more than that is one chunk, unchanged.
    """
    # Only a text that begins as a numbered line does is cut into lines.
    lines = F.when(F.col("text").rlike(r"^\s*\d+[).]"), stripped_lines(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = blocks.withColumn("lines", lines).withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    numbered = (F.size("lines") > 1) & F.forall("lines", lambda x: x.rlike(r"^\d+[).]"))
    listed = numbered & (F.col("n") <= most)
    last = F.greatest(F.floor((F.col("n") - 1) / most).cast("int"), F.lit(0))
    # The words of a part are counted with it, once.
    part = lambda content, n: F.struct(content.alias("content"), n.alias("n"))
    left = lambda i: F.col("n") - i * most
    slices = F.transform(F.sequence(F.lit(0), last), lambda i: part(F.array_join(F.slice("w", i * most + 1, most), " "), F.when(left(i) >= most, most).otherwise(left(i))))
    parts = F.when(listed, F.array(part(F.array_join("lines", "\n"), F.col("n")))).when(F.col("n") <= most, F.array(part(F.col("text"), F.col("n")))).otherwise(slices)
    kind = F.when(listed, "list").otherwise("paragraph")
    rows = rows.select(key, *more, "block", "page", F.col("section_title").alias("parent_section"), kind.alias("chunk_type"), F.posexplode_outer(parts).alias("part", "c"))
    rows = rows.select(key, *more, "block", "page", "parent_section", "chunk_type", "part", F.col("c.content").alias("content"), F.col("c.n").alias("token_count"))
    name = F.concat_ws("-", F.col(key).cast("string"), "chunk_type", F.col("block").cast("string"), F.when(F.col("chunk_type") == "paragraph", (F.col("part") + 1).cast("string")))
    return _marked(rows.withColumn("chunk_id", name)).select(key, *more, "chunk_id", "chunk_type", "page", "parent_section", "content", "token_count", "content_hash")


def table_chunks(tables: DataFrame, key: str = "doc_id", most: int = MAX_TOKENS, more: tuple[str, ...] = ()) -> DataFrame:
    """Each table's rows under its header, a new part where the budget would be passed (C-16, W-11).

    Rows that do not fit beside the header are continued; a header that fills the budget
    is shortened.  A table is one row here, so that its rows are folded in place.
    """
    count = lambda text: F.size(words(text))
    full = F.concat(F.lit("headers: "), F.array_join("headers", " | "))
    rows = tables.withColumn("full", full)
    short = F.concat(F.lit("headers: "), F.array_join(F.slice(words(F.col("full")), 1, max(most - 4, 1)), " "), F.lit(" ..."))
    rows = rows.withColumn("header", F.when(count(F.col("full")) >= most, short).otherwise(F.col("full"))).withColumn("head", count(F.col("header")))
    room = F.greatest(most - F.col("head") - 2, F.lit(1))

    def lines(row: Column) -> Column:
        text = F.concat(F.lit("row: "), F.array_join(row, " | "))
        said = words(text)
        starts = F.sequence(F.lit(0), F.floor((F.size(said) - 1) / room).cast("int"))
        cut = F.transform(starts, lambda i: F.concat(F.when(i > 0, "row_cont: ").otherwise(""), F.array_join(F.slice(said, i * room + 1, room), " ")))
        return F.when(count(text) + F.col("head") <= most, F.array(text)).otherwise(cut)

    flat = F.flatten(F.transform("rows", lines))
    rows = rows.withColumn("lines", F.when(F.size(flat) == 0, F.array(F.lit("row: "))).otherwise(flat))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.col("head").alias("used"))

    def step(s: Column, line: Column) -> Column:
        n = count(line)
        over = (s["used"] + n > most) & (s["open"] != "")
        done = F.when(over, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        text = F.when(over | (s["open"] == ""), line).otherwise(F.concat(s["open"], F.lit("\n"), line))
        return F.struct(done.alias("done"), text.alias("open"), (F.when(over, F.col("head")).otherwise(s["used"]) + n).alias("used"))

    parts = F.aggregate("lines", start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    rows = rows.select(key, *more, "table", "page", "header", F.posexplode(parts).alias("part", "body"))
    name = F.concat_ws("-", F.col(key).cast("string"), F.lit("table"), F.col("table").cast("string"), (F.col("part") + 1).cast("string"))
    rows = rows.withColumns({
        "chunk_id": name, "chunk_type": F.lit("table"), "content": F.concat_ws("\n", "header", "body"), "parent_section": F.concat(F.lit("Table "), F.col("table").cast("string")),
    })
    return _hashed(rows).select(key, *more, "chunk_id", "chunk_type", "page", "parent_section", "content", "token_count", "content_hash")


def _table_lines(files: DataFrame, text: str) -> tuple[Column, Column]:
    """The lines of a text that are a table's, and how many there must be."""
    csv = F.lower(F.coalesce(F.col("suffix"), F.lit(""))) == ".csv" if "suffix" in files.columns else F.lit(False)
    fields = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    return F.filter(stripped_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: (fields(x) >= 2) | csv), F.when(csv, 1).otherwise(2)


def inline_tables(files: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, table, page, headers, rows) of texts' lines of three fields and more, where there are two, and of whole ``.csv`` files (C-13)."""
    lines, least = _table_lines(files, text)
    found = files.select(key, *more, F.transform(lines, lambda x: F.split(x, ",")).alias("r"), least.alias("least")).filter(F.size("r") >= F.col("least"))
    return found.select(key, *more, F.lit(1).alias("table"), F.lit(1).alias("page"), F.col("r")[0].alias("headers"), F.slice("r", 2, F.size("r")).alias("rows"))


def figure_chunks(figures: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """One chunk a figure's caption; ``figures`` have the key, figure, page and caption (C-16)."""
    rows = figures.select(
        key, *more, F.concat_ws("-", F.col(key).cast("string"), F.lit("figure"), F.col("figure").cast("string")).alias("chunk_id"), F.lit("figure").alias("chunk_type"), "page",
        F.lit("Figure").alias("parent_section"), F.coalesce("caption", F.lit("")).alias("content"),
    )
    return _hashed(rows).select(key, *more, "chunk_id", "chunk_type", "page", "parent_section", "content", "token_count", "content_hash")


def captions(files: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, figure, page, caption) of the lines that begin as a figure's or chart's caption does."""
    lines = F.filter(stripped_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: x.rlike(r"(?i)^(figure|chart)\b"))
    return files.select(key, *more, F.posexplode(lines).alias("i", "caption")).select(key, *more, (F.col("i") + 1).alias("figure"), F.lit(1).alias("page"), "caption")


def refined(files: DataFrame, key: str = "doc_id", most: int = MAX_TOKENS) -> DataFrame:
    """A document's chunks as one result: tables, figures and text, with ``relationships`` to the tables that they name (C-16, C-19).

    ``files`` have the key, text and maybe suffix.  A chunk that mentions ``table N`` is related to the first
    chunk of the document's Nth table.  A row is one document; its tables' names go with its chunks, so
    that chunks are made once and no text moves.
    """
    lines, least = _table_lines(files, "text")
    named = F.lower(F.coalesce(F.col("text"), F.lit(""))).rlike(r"table\s+[0-9]")
    first = F.array(F.concat(F.col(key).cast("string"), F.lit("-table-1-1")))
    # Only a text that names a table is looked through for one.
    files, more = files.withColumn("_tables", F.when(named, F.when(F.size(lines) >= least, first))), ("_tables",)
    chunks = table_chunks(inline_tables(files, key, more=more), key, most, more).unionByName(figure_chunks(captions(files, key, more=more), key, more))
    chunks = chunks.unionByName(text_chunks(titled_paragraphs(files, key, more=more), key, most, more))
    mentions = F.regexp_extract_all(F.lower("content"), F.lit(r"table\s+([0-9]+)"), F.lit(1))
    found = F.array_compact(F.transform(mentions, lambda m: F.get("_tables", m.try_cast("int") - 1)))
    related = F.when(F.col("_tables").isNotNull(), F.array_join(F.array_sort(F.array_distinct(found)), ",")).otherwise("")
    return chunks.withColumn("relationships", related).drop("_tables")


def invalid_chunks(chunks: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Tables and lists over the budget, and tables without their header, with the reason (the validator of C-16)."""
    over = (F.col("token_count") > most) & F.col("chunk_type").isin("table", "list")
    bare = (F.col("chunk_type") == "table") & ~F.contains(F.lower("content"), F.lit("headers:"))
    return chunks.withColumn("reason", F.when(over, "over the token budget").when(bare, "table without a header")).filter("reason is not null")


def in_reading_order(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with their place by page, type and id (O-06)."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])[F.col("chunk_type")], F.lit(9))
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("page", rank, "chunk_id")))


def section_of(parent: Column, content: Column) -> Column:
    """A chunk's section: its parent but for ``Document``, else a heading among its first lines, else General (C-17)."""
    named = F.trim(F.coalesce(parent, F.lit("")))
    clean = F.transform(F.slice(stripped_lines(content), 1, 3), _bare)

    def title(x: Column) -> Column:
        said = F.split(x, " ")
        capital = F.size(F.filter(said, lambda w: w.rlike(r"^\p{Lu}")))
        heads = (F.size(said) <= 10) & (capital >= F.greatest(F.lit(1), F.floor(F.size(said) / 2)))
        named_ = x.rlike(r"^(\d+(\.\d+)*)\s+") | heads
        return F.when((x == "") | (F.length(x) > 80), None).when(F.startswith(F.lower(x), F.lit("headers:")), "Table").when(~x.rlike(r"^\d+$") & named_, x)

    found = F.filter(F.transform(clean, title), lambda x: x.isNotNull())
    return F.when((named != "") & (F.lower(named) != "document"), named).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("General")))


def _sectioned(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks in reading order with the ``title`` and number of their ``section`` and their ``turn`` within it."""
    rows = in_reading_order(chunks.withColumn("title", section_of(F.col("parent_section"), F.col("content"))), key)
    by = Window.partitionBy(key).orderBy("place")
    before, page_before = F.lag("title").over(by), F.lag("page").over(by)
    starts = before.isNull() | (before != F.col("title")) | ((F.col("title") == "General") & (F.col("page") > page_before))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("section", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key, "section").orderBy("place")))


def _body() -> Column:
    """The first four chunks of a section, as an aggregate over it."""
    few = F.array_sort(F.collect_list(F.when(F.col("turn") <= 4, F.struct("turn", "content"))))
    return F.array_join(F.transform(few, lambda x: x["content"]), "\n")


def sections(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page index (C-17): runs of chunks of one section, with pages, types and a summary of the first four."""
    out = _sectioned(chunks, key).groupBy(key, "section").agg(
        F.first("title").alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("chunks"),
        F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("data_types"), _body().alias("body"),
    )
    return out.withColumn("summary", summary_sentences(F.col("body"))).drop("body")


def overlap(question: str, text: Column) -> Column:
    """Share of the question's tokens that a text holds; the text's own are not cut out, as most are not asked for."""
    asked = list(dict.fromkeys(re.findall("[a-z0-9]+", question.lower())))
    has = lambda low, t: F.contains(low, F.lit(t)) & F.rlike(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])"))
    held = lambda low: functools.reduce(Column.__add__, [F.when(has(low, t), 1).otherwise(0) for t in asked])
    return F.coalesce(F.round(bound(F.lower(text), held) / len(asked), 6), F.lit(0.0)) if asked else F.lit(0.0)


def navigate(index: DataFrame, topic: str, k: int = 3, key: str = "doc_id") -> DataFrame:
    """Each document's k sections that hold most of the topic, in order on ties (O-05)."""
    scored = index.withColumn("score", overlap(topic, F.concat_ws(" ", "title", "summary"))).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "section"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def ask(index: DataFrame, chunks: DataFrame, question: str, facts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Each document's answer with its supporting chunks and citations (C-20).

    Chunks of the two best sections are searched, the four best support the answer and
    three are cited; without such chunks the whole document is searched.  A question on
    revenue is answered by the last total that was extracted, if there is one.
    """
    best = navigate(index, question, 2, key).groupBy(key).agg(F.collect_set(F.lower("title")).alias("best"))
    # Sides are joined by the key alone and grow with the documents: chunks that lie by key stay where they are.
    rows = _scored(in_reading_order(chunks, key), question).join(shared.large(best), key, "left")
    out = _supported(rows, key)
    if facts is not None and "revenue" in question.lower():
        total = facts.filter("metric_name = 'total_revenue'").groupBy(key).agg(F.max_by("metric_value", "source_chunk_id").alias("total"))
        out = out.join(shared.large(total), key, "left")
    return _answered(out, key)


def ask_own(chunks: DataFrame, question: str, key: str = "doc_id") -> DataFrame:
    """``ask`` of the documents' own ``sections`` and extracted totals, by one pass over the chunks.

    Sections are scored by windows over their chunks: chunks are made once, and no side is joined.
    """
    rows = _scored(_sectioned(chunks, key), question)
    # A section is scored at its first chunk, the place that stands for it.
    opens = F.col("turn") == 1
    rows = rows.withColumn("body", F.when(opens, _body_ahead(key)))
    rows = rows.withColumn("fits", F.when(opens, overlap(question, F.concat_ws(" ", "title", summary_sentences(F.col("body")))))).drop("body")
    by = Window.partitionBy(key)
    nth = F.row_number().over(by.orderBy(F.desc_nulls_last("fits"), "section"))
    rows = rows.withColumn("best", F.when((F.col("fits") > 0) & (nth <= 2), F.lower("title")))
    rows = rows.withColumn("best", F.collect_set("best").over(by))
    if "revenue" not in question.lower():
        return _answered(_supported(rows, key), key)
    raw = F.regexp_extract(F.lower("content"), METRICS["total_revenue"], 1)
    rows = rows.withColumn("raw", F.when(raw != "", raw))
    value = F.replace("raw", F.lit(","), F.lit("")).try_cast("double")
    return _answered(_supported(rows, key, total=F.max_by(value, F.when(F.col("raw").isNotNull(), F.col("chunk_id")))), key)


def _body_ahead(key: str) -> Column:
    """A section's first four chunks, seen from the first of them."""
    ahead = Window.partitionBy(key, "section").orderBy("place").rowsBetween(0, 3)
    return F.array_join(F.collect_list("content").over(ahead), "\n")


def _scored(rows: DataFrame, question: str) -> DataFrame:
    return rows.withColumn("score", overlap(question, F.col("content"))).withColumn("t", F.lower(F.coalesce("parent_section", F.lit(""))))


def _supported(rows: DataFrame, key: str, **more: Column) -> DataFrame:
    """Samples, supporting chunks and citations of each document from scored chunks beside the titles of its ``best`` sections."""
    rows = rows.withColumn("scoped", F.coalesce(F.array_contains("best", F.col("t")), F.lit(False)))
    rows = rows.withColumn("any", F.max("scoped").over(Window.partitionBy(key))).withColumn("kept", F.col("scoped") | (~F.col("any") & (F.col("score") > 0)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("kept"), F.desc("score"), "place")))
    of = lambda name, most: F.transform(F.array_sort(F.collect_list(F.when(F.col("kept") & (F.col("rank") <= most), F.struct("rank", name)))), lambda x: x[name])
    return rows.groupBy(key).agg(
        F.max("kept").alias("kept"), of("content", 2).alias("sample"), F.array_join(of("chunk_id", 4), ",").alias("supporting"), F.array_join(of("content_hash", 3), ",").alias("citations"),
        *[c.alias(n) for n, c in more.items()],
    )


def _answered(out: DataFrame, key: str) -> DataFrame:
    said = F.trim(F.array_join(F.slice(F.split(F.array_join("sample", " "), r"(?<=[.!?])\s+"), 1, 2), " "))
    answer = F.when(said != "", said).otherwise(F.substring(F.get("sample", F.lit(0)), 1, 280))
    if "total" in out.columns:
        answer = F.when(F.col("total").isNotNull(), F.concat(F.lit("Latest extracted total revenue is "), F.format_string("%.2f", "total"), F.lit(" USD."))).otherwise(answer)
    answer = F.when(~F.col("kept"), "No supporting evidence found in the document.").otherwise(answer)
    return out.select(key, answer.alias("answer"), "supporting", "citations")


def package_events(documents: DataFrame, key: str = "application_id") -> DataFrame:
    """The events of each application's document package, in order (C-21).

    Documents have the key, path, supported (by format), facts and reextraction (a flag).
    A package opens, each document is added, validated, extracted and assessed, and the
    package is ready where no document was refused.
    """
    event = lambda kind, rank: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("event_type"))
    good = F.array(event("DocumentAdded", 0), event("DocumentFormatValidated", 1), event("ExtractionStarted", 2), event("ExtractionCompleted", 3), event("QualityAssessmentCompleted", 4))
    bad = F.array(event("DocumentAdded", 0), event("DocumentFormatValidated", 1))
    each = documents.select(key, F.col("path"), F.explode(F.when(F.col("supported"), good).otherwise(bad)).alias("e"), "supported", "facts", "reextraction")
    each = each.select(key, F.lit(1).alias("part"), "path", "e.rank", "e.event_type", F.when(F.col("e.rank") >= 3, F.col("facts")).alias("facts"), F.when(F.col("e.rank") == 4, F.col("reextraction")).alias("reextraction"))
    whole = documents.groupBy(key).agg(F.bool_and("supported").alias("ready"))
    blank = [F.lit("").alias("path"), F.lit(0).alias("rank")]
    tail = [F.lit(None).cast(documents.schema["facts"].dataType).alias("facts"), F.lit(None).cast("boolean").alias("reextraction")]
    opening = whole.select(key, F.lit(0).alias("part"), *blank, F.lit("PackageCreated").alias("event_type"), *tail)
    closing = whole.filter("ready").select(key, F.lit(2).alias("part"), *blank, F.lit("PackageReadyForAnalysis").alias("event_type"), *tail)
    turn = F.row_number().over(Window.partitionBy(key).orderBy("part", "path", "rank")).cast("long")
    rows = opening.unionByName(each).unionByName(closing).withColumn("stream_position", turn)
    return rows.select(key, "stream_position", "event_type", F.nullif("path", F.lit("")).alias("path"), "facts", "reextraction")
