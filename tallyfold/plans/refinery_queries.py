"""Document refinement queries over documents, pages and reports made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extractors
from ..operators import refinery as rf
from ..sources.ledger import table
from .ledger_queries import query


def _kw(domain: str) -> str:
    return " + ".join(f"CAST(contains(low, '{k}') AS INT)" for k in rf.DOMAINS[domain])


_DOMAIN = "CASE " + " ".join(f"WHEN greatest({', '.join('s_' + d for d in rf.DOMAINS)}) > 0 AND s_{d} = greatest({', '.join('s_' + d for d in rf.DOMAINS)}) THEN '{d}'" for d in rf.DOMAINS) + " ELSE 'general' END"
#: Documents as files: a type, pages and a share of images that follow from the source and the id.
_FILES_SQL = """WITH files AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(regexp_extract(coalesce(source, ''), '[0-9]+') AS INTEGER) AS s,
    CASE s % 5 WHEN 1 THEN '.csv' WHEN 2 THEN '.pdf' WHEN 3 THEN '.md' WHEN 4 THEN '.bin' ELSE '.txt' END AS suffix,
    CAST(CASE WHEN suffix = '.pdf' THEN 1 + doc_id % 30 ELSE 1 END AS INTEGER) AS page_count,
    CASE WHEN suffix = '.pdf' THEN (doc_id % 8) / 8.0 ELSE 0.0 END AS image_area_ratio
  FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN replace(text, ' ', chr(10) || '1.2 ') WHEN doc_id % 9 = 1 THEN replace(text, ' ', ',') WHEN doc_id % 9 = 2 THEN replace(text, ' ', chr(10) || 'Chart ') ELSE text END AS text, source FROM documents)
)"""


def _files(spark, sf_dir):
    """The files of the SQL; of nine documents one is made of numbered lines, one of fields, one of captions."""
    key, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    spread = lambda by: F.replace("text", F.lit(" "), F.lit(by))
    text = F.when(key % 9 == 0, spread("\n1.2 ")).when(key % 9 == 1, spread(",")).when(key % 9 == 2, spread("\nChart ")).otherwise(F.col("text"))
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "[0-9]+", 0).try_cast("int")
    suffix = F.when(number % 5 == 1, ".csv").when(number % 5 == 2, ".pdf").when(number % 5 == 3, ".md").when(number % 5 == 4, ".bin").otherwise(".txt")
    rows = docs.select("doc_id", text.alias("text"), suffix.alias("suffix"))
    pdf = F.col("suffix") == ".pdf"
    return rows.withColumn("page_count", F.when(pdf, 1 + key % 30).otherwise(1)).withColumn("image_area_ratio", F.when(pdf, (key % 8) / 8.0).otherwise(0.0))


_TRIAGE = _FILES_SQL + f""", a AS (
  SELECT *, lower(t) AS low, list_filter(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> '') AS lines FROM files
), b AS (
  SELECT *, {", ".join(f"{_kw(d)} AS s_{d}" for d in rf.DOMAINS)}, len(lines) AS n,
    len(list_filter(lines, lambda x: length(x) - length(replace(x, ',', '')) >= 3 OR contains(x, '|'))) AS tl,
    len(list_filter(lines, lambda x: regexp_matches(lower(x), '\\b(figure|chart)\\b'))) AS fl,
    len(list_filter(lines, lambda x: regexp_matches(trim(x), '^(\\d+(\\.\\d+)*)\\s+'))) AS hl,
    len(list_filter(lines, lambda x: length(x) - length(replace(x, ',', '')) >= 2)) AS il
  FROM a
), c AS (
  SELECT doc_id, t, suffix, page_count, image_area_ratio, il,
    round(length(t) / CASE WHEN suffix = '.pdf' THEN page_count WHEN suffix = '.bin' THEN 1 ELSE greatest(length(t) - length(replace(t, chr(10), '')), 1) END, 4) AS char_density,
    CASE WHEN n = 0 THEN 'mixed' WHEN tl / n > 0.2 THEN 'table_heavy' WHEN fl / n > 0.1 THEN 'figure_heavy' WHEN hl > 8 THEN 'multi_column' ELSE 'single_column' END AS layout,
    {_DOMAIN} AS domain, CAST(length(trim(t)) AS INTEGER) AS visible
  FROM b
), d AS (
  SELECT doc_id, suffix, page_count, CAST(image_area_ratio AS DOUBLE) AS image_area_ratio, char_density, layout, domain, visible,
    CASE WHEN suffix = '.pdf' THEN CASE WHEN char_density < 30 AND image_area_ratio > 0.6 THEN 'scanned_image' WHEN image_area_ratio > 0.3 THEN 'mixed' ELSE 'native_digital' END
      WHEN suffix = '.csv' THEN 'form_fillable' WHEN visible < 40 THEN 'mixed' ELSE 'native_digital' END AS origin,
    page_count >= 20 AND layout IN ('multi_column', 'table_heavy') AS large_complex,
    CAST(CASE WHEN suffix = '.csv' AND t <> '' OR il >= 2 THEN 1 ELSE 0 END AS INTEGER) AS tables,
    CAST(len(list_filter(string_split_regex(t, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS INTEGER) AS blocks
  FROM c
), p AS (
  SELECT *, CASE WHEN origin = 'scanned_image' OR large_complex THEN 'needs_vision_model'
    WHEN layout IN ('multi_column', 'table_heavy', 'mixed') OR origin = 'mixed' THEN 'needs_layout_model' ELSE 'fast_text_sufficient' END AS cost
  FROM d
)"""
_ROUTED = _TRIAGE + """, e AS (
  SELECT *, 35 + 25 * CAST(visible > 300 AS INT) + 15 * CAST(char_density > 120 AS INT) + 15 * CAST(image_area_ratio < 0.25 AS INT) + 10 * tables AS f0 FROM p
), g AS (
  SELECT *, least(CASE WHEN large_complex THEN 84 ELSE 100 END, greatest(0, f0 + CASE WHEN layout IN ('multi_column', 'table_heavy', 'mixed') THEN 20 ELSE 10 END
    - 12 * CAST(origin IN ('mixed', 'scanned_image') AS INT) - 8 * CAST(image_area_ratio >= 0.5 AS INT) - 35 * CAST(large_complex AS INT))) AS l0 FROM e
), h AS (
  SELECT *, CASE WHEN cost = 'fast_text_sufficient' AND f0 >= 90 THEN 1 WHEN cost <> 'needs_vision_model' AND l0 >= 88 THEN 2 ELSE 3 END AS last_,
    CASE cost WHEN 'fast_text_sufficient' THEN 1 WHEN 'needs_layout_model' THEN 2 ELSE 3 END AS first_ FROM g
)"""


@query(_TRIAGE + " SELECT * FROM p", "")
def triage_profile(spark, sf_dir):
    return rf.triage(_files(spark, sf_dir))


@query(
    _ROUTED + """ SELECT doc_id, cost, CASE last_ WHEN 1 THEN 'fast_text' WHEN 2 THEN 'layout_aware' ELSE 'vision_augmented' END AS strategy,
  CAST(CASE last_ WHEN 1 THEN f0 WHEN 2 THEN l0 ELSE least(100, l0 + 10) END / 100 AS DOUBLE) AS confidence FROM h""",
    "",
)
def routed_extraction(spark, sf_dir):
    return rf.routed(rf.triage(_files(spark, sf_dir))).select("doc_id", "cost", "strategy", "confidence")


@query(
    _ROUTED + """ SELECT doc_id, array_to_string((['fast_text', 'layout_aware', 'vision_augmented'])[first_:last_], ',') AS attempted, blocks, tables,
  CAST(CASE last_ WHEN 1 THEN 0.001 WHEN 2 THEN 0.01 ELSE least(1.5, greatest(0.05, round(0.08 * page_count, 4))) END AS DOUBLE) AS cost_usd FROM h""",
    "",
)
def extraction_attempts(spark, sf_dir):
    """Every document's strategies in turn with what they found and what the last one costs."""
    return rf.routed(rf.triage(_files(spark, sf_dir))).select("doc_id", "attempted", "blocks", "tables", "cost_usd")


@query(
    _ROUTED + """, tries AS (
  SELECT doc_id, unnest(range(first_, last_ + 1)) AS s, first_, f0, l0, blocks, tables FROM h
)
SELECT doc_id, CAST(s - first_ + 1 AS INTEGER) AS attempt, (['fast_text', 'layout_aware', 'vision_augmented'])[s] AS strategy,
  CAST((CASE s WHEN 1 THEN f0 WHEN 2 THEN l0 ELSE least(100, l0 + 10) END) / 100 AS DOUBLE) AS confidence,
  CASE s WHEN 1 THEN f0 >= 90 WHEN 2 THEN l0 >= 88 ELSE least(100, l0 + 10) >= 72 END AS passed, blocks AS text_blocks, tables
FROM tries""",
    "",
)
def extraction_log(spark, sf_dir):
    """Every strategy tried on every document, run by the table function."""
    return extractors.attempted(_files(spark, sf_dir)).drop("sections")


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_CHUNKS = f"""WITH a AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 450 + 1)) AS i FROM a WHERE len(w) > 0
), chunks AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk, doc_id || '-paragraph-' || (i + 1) AS chunk_id, CAST(len(w[i * 450 + 1:i * 450 + 450]) AS INTEGER) AS token_count, array_to_string(w[i * 450 + 1:i * 450 + 450], ' ') AS content FROM b)"""


@query(_CHUNKS + " SELECT doc_id, chunk, chunk_id, token_count, sha256(chunk_id || '|paragraph|None|' || content) AS content_hash FROM chunks", "")
def paragraph_chunks(spark, sf_dir):
    return rf.chunks(table(spark, sf_dir, "documents")).drop("content")


@query("""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) - length(replace(x, ',', '')) >= 2) AS r FROM documents)
SELECT doc_id, CAST(len(r) AS INTEGER) AS n_rows, CAST(len(string_split(r[1], ',')) AS INTEGER) AS n_columns, sha256(array_to_string(r, chr(10))) AS table_hash FROM a WHERE len(r) >= 2""", "")
def inline_tables(spark, sf_dir):
    return rf.inline_tables(table(spark, sf_dir, "documents"))


@query("""WITH a AS (SELECT page_id, string_split_regex(html, '(?i)<h[1-3][^>]*>') AS p FROM pages), b AS (SELECT page_id, unnest(p[2:]) AS part, generate_subscripts(p[2:], 1) AS section FROM a)
SELECT page_id, CAST(section AS INTEGER) AS section, trim(regexp_replace(regexp_extract(part, '(?is)^(.*?)</h[1-3]>', 1), '<[^>]*>', ' ', 'g')) AS title,
  CAST(len(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(part, '(?is)^.*?</h[1-3]>', ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM b""", "")
def page_sections(spark, sf_dir):
    return rf.page_sections(table(spark, sf_dir, "pages"))


_REPORTS = """WITH reports AS (SELECT o_orderkey AS doc_id, 'Quarterly report. Total Revenue: $' || printf('%.2f', o_totalprice) || '. Net income = ' || (o_orderkey % 1000) || ',000. ' || CASE WHEN o_orderkey % 4 = 0 THEN 'EBITDA 12,500.75' ELSE 'No further figures' END AS content FROM orders
), facts AS (SELECT doc_id, m AS metric_name, v AS raw_value FROM (
  SELECT doc_id, unnest(['total_revenue', 'net_income', 'ebitda']) AS m, unnest([regexp_extract(lower(content), '(?:total\\s+revenue|revenue)\\s*[:=-]?\\s*\\$?([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), regexp_extract(lower(content), '(?:net\\s+income)\\s*[:=-]?\\s*\\$?([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), regexp_extract(lower(content), '(?:ebitda)\\s*[:=-]?\\s*\\$?([0-9][0-9,]*(?:\\.[0-9]+)?)', 1)]) AS v FROM reports) WHERE v <> '')"""


def _reports(spark, sf_dir):
    key = F.col("o_orderkey")
    content = F.concat(F.lit("Quarterly report. Total Revenue: $"), F.format_string("%.2f", "o_totalprice"), F.lit(". Net income = "), key % 1000, F.lit(",000. "), F.when(key % 4 == 0, "EBITDA 12,500.75").otherwise("No further figures"))
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit("1").alias("chunk_id"), content.alias("content"))


@query(_REPORTS + " SELECT doc_id, '1' AS source_chunk_id, metric_name, raw_value, CAST(replace(raw_value, ',', '') AS DOUBLE) AS metric_value FROM facts", "")
def fact_extract(spark, sf_dir):
    return rf.facts(_reports(spark, sf_dir))


@query(_REPORTS + """ SELECT doc_id, max(v) FILTER (WHERE metric_name = 'total_revenue') AS total_revenue, max(v) FILTER (WHERE metric_name = 'net_income') AS net_income, max(v) FILTER (WHERE metric_name = 'ebitda') AS ebitda,
  NULL::DOUBLE AS total_assets, NULL::DOUBLE AS total_liabilities FROM (SELECT *, CAST(replace(raw_value, ',', '') AS DOUBLE) AS v FROM facts) GROUP BY 1""", "")
def evidence_pivot(spark, sf_dir):
    return rf.fact_pivot(rf.facts(_reports(spark, sf_dir)))


_QUESTION = "the hating of inor lyst worthless figures"


@query(_CHUNKS + f""", q AS (SELECT list_distinct(regexp_extract_all('{_QUESTION}', '([a-z0-9]+)', 1)) AS q
), s AS (SELECT doc_id, chunk, chunk_id, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(content), '([a-z0-9]+)', 1)))) / len(q), 6) AS score FROM chunks, q)
SELECT doc_id, chunk_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id, chunk LIMIT 5""", "")
def search_topk(spark, sf_dir):
    return rf.search(rf.chunks(table(spark, sf_dir, "documents")), _QUESTION).select("doc_id", "chunk_id", "score")


@query("""WITH a AS (SELECT item_id AS doc_id, list_filter(regexp_extract_all(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '[À-ɏ]', '_', 'g'), '\\b([A-Z][A-Za-z]{1,}(?:\\s+[A-Z][A-Za-z]{1,})*)\\b', 1), lambda x: len(string_split(x, ' ')) <= 4) AS n FROM benchmark
), b AS (SELECT doc_id, unnest(n) AS name, generate_subscripts(n, 1) AS i FROM a), c AS (SELECT doc_id, lower(name) AS low, min(i) AS i, min_by(name, i) AS entity FROM b GROUP BY ALL
) SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS rank, entity FROM c) WHERE rank <= 8""", "")
def entities(spark, sf_dir):
    return rf.entities(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '(1,' || n || '.5)' WHEN 1 THEN '$' || n || '.25 billion' WHEN 2 THEN n || 'm' WHEN 3 THEN ' ' || n || 'K ' WHEN 4 THEN 'n/a' WHEN 5 THEN '-' || n ELSE 'abc' END AS value,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN -(CAST('1' || n AS DOUBLE) + 0.5) WHEN 1 THEN (n + 0.25) * 1e9 WHEN 2 THEN n * 1e6 WHEN 3 THEN n * 1e3 WHEN 5 THEN -CAST(n AS DOUBLE) END AS DOUBLE) AS number
FROM (SELECT o_orderkey, o_custkey AS n FROM orders)""",
    "",
)
def coerced_values(spark, sf_dir):
    """Customer numbers written in seven ways, and read again."""
    n, turn = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 7
    value = (
        F.when(turn == 0, F.concat(F.lit("(1,"), n, F.lit(".5)"))).when(turn == 1, F.concat(F.lit("$"), n, F.lit(".25 billion"))).when(turn == 2, F.concat(n, F.lit("m")))
        .when(turn == 3, F.concat(F.lit(" "), n, F.lit("K "))).when(turn == 4, "n/a").when(turn == 5, F.concat(F.lit("-"), n)).otherwise("abc")
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value.alias("value"))
    return rows.withColumn("number", rf.coerced(F.col("value")))
