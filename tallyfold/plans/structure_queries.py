"""Structure queries, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents
from ..operators import refinery as rf
from ..operators import structure as st
from ..sources.files import structured_query
from ..sources.ledger import table
from .ledger_queries import query
from .refinery_queries import _REPORTS, _reports


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'Document') AS section_title FROM conversations""", "")
def carried_titles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("turn") % 3 == 1, F.concat("role", F.col("turn"))))
    return st.carried_titles(turns, "conv_id", "turn").select("conv_id", "turn", "section_title")


_LINES = "SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'N' THEN 'General' ELSE 'Section ' || l_returnflag END AS title, l_linenumber AS page, CAST(l_quantity AS BIGINT) AS tokens, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS i FROM lineitem"


def _lines(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order))
    title = F.when(F.col("l_returnflag") == "N", "General").otherwise(F.concat(F.lit("Section "), "l_returnflag"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), title.alias("title"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("long").alias("tokens"), "i")


@query(f"""WITH x AS ({_LINES}), y AS (SELECT *, CASE WHEN lag(title) OVER w IS NULL OR lag(title) OVER w <> title OR (title = 'General' AND page > lag(page) OVER w) THEN 1 ELSE 0 END AS b FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), z AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM y)
SELECT doc_id, section, any_value(title) AS title, min(page) AS page_start, max(page) AS page_end, count(*) AS chunks FROM z GROUP BY 1, 2""", "")
def page_index(spark, sf_dir):
    return st.section_groups(_lines(spark, sf_dir), "doc_id", ["i"])


@query(f"""WITH x AS ({_LINES}), y AS (SELECT doc_id, list_reduce(list_prepend(1004000004, list(tokens ORDER BY i)), lambda a, n: CASE WHEN (a // 1000000) % 1000 + n > 60 AND (a // 1000000) % 1000 > 4
  THEN (a // 1000000000 + 1) * 1000000000 + (4 + n) * 1000000 + greatest(a % 1000000, 4 + n) ELSE a + n * 1000000 - a % 1000000 + greatest(a % 1000000, (a // 1000000) % 1000 + n) END) AS s FROM x WHERE tokens > 0 GROUP BY 1)
SELECT doc_id, s // 1000000000 AS parts, s % 1000000 AS largest_part FROM y""", "")
def table_chunks(spark, sf_dir):
    return st.packed_tables(_lines(spark, sf_dir).filter("tokens > 0"), "doc_id", "i", "tokens", 4, 60)


@query("""WITH c AS (SELECT o_orderkey AS doc_id, 'c' || o_orderkey AS chunk_id, 'See Table ' || (o_orderkey % 4) || ' and table  ' || (o_orderkey % 3) AS content FROM orders)
SELECT doc_id, chunk_id, array_to_string(list_sort(list_distinct(list_transform(list_filter([doc_id % 4, doc_id % 3], lambda n: n BETWEEN 1 AND 2), lambda n: doc_id || '-table-' || n || '-1'))), ',') AS relationships FROM c""", "")
def cross_references(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select(key.alias("doc_id"), F.concat(F.lit("c"), key).alias("chunk_id"), F.concat(F.lit("See Table "), key % 4, F.lit(" and table  "), key % 3).alias("content"))
    tables = orders.select(key.alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    return st.cross_references(chunks, tables.withColumn("table_chunk_id", F.concat("doc_id", F.lit("-table-"), "ordinal", F.lit("-1"))), "doc_id")


_PIVOT = _REPORTS + """, p AS (SELECT doc_id, max(v) FILTER (WHERE metric_name = 'total_revenue') AS r, max(v) FILTER (WHERE metric_name = 'net_income') AS n, max(v) FILTER (WHERE metric_name = 'ebitda') AS e FROM (SELECT *, CAST(replace(raw_value, ',', '') AS DOUBLE) AS v FROM facts) GROUP BY 1)"""


@query(_PIVOT + """ SELECT doc_id, CASE WHEN e IS NULL THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS overall_confidence, true AS is_coherent, CASE WHEN abs(n) > r * 1.5 THEN 'net_income_implausible_relative_to_revenue' ELSE '' END AS anomalies,
  CASE WHEN e IS NULL THEN 'ebitda,' ELSE '' END || 'total_assets,total_liabilities' AS critical_missing_fields, true AS reextraction_recommended FROM p""", "")
def quality_assessment(spark, sf_dir):
    return st.quality(rf.fact_pivot(rf.facts(_reports(spark, sf_dir))))


@query(_REPORTS + " SELECT metric_name, count(*) AS n, max(CAST(replace(raw_value, ',', '') AS DOUBLE)) AS most FROM facts GROUP BY 1", "")
def structured_facts(spark, sf_dir):
    return structured_query(rf.facts(_reports(spark, sf_dir)), "SELECT metric_name, count(*) AS n, max(metric_value) AS most FROM fact_table GROUP BY metric_name")


#: Documents with a heading, a caption and a reference before their own text; lines are those of the text.
_TEXT_SQL = r"""
files AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Section Of Notes' || chr(10) || chr(10) ELSE '' END || coalesce(text, '') ||
    CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Figure 1 of the tables' || chr(10) || chr(10) || 'See Table 1 and table 7 here.' ELSE '' END AS text
  FROM documents
), lines AS (
  SELECT doc_id, i, l FROM (
    SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM files))
), cells AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE length(l) - length(replace(l, ',', '')) >= 2
), said AS (
  SELECT doc_id, k, CASE WHEN k = 1 THEN 'headers: ' ELSE 'row: ' END || array_to_string(string_split(l, ','), ' | ') AS t FROM cells WHERE n >= 2
), counted AS (
  SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM said
), heads AS (
  SELECT doc_id, CASE WHEN len(w) >= 450 THEN 'headers: ' || array_to_string(w[1:446], ' ') || ' ...' ELSE t END AS header,
    len(list_filter(string_split_regex(header, '\s+'), lambda x: x <> '')) AS head
  FROM counted WHERE k = 1
), cut AS (
  SELECT c.doc_id, c.k, h.head, c.t, c.w, greatest(450 - h.head - 2, 1) AS room, len(c.w) + h.head <= 450 AS fits FROM counted c JOIN heads h USING (doc_id) WHERE c.k > 1
), pieces AS (
  SELECT doc_id, head, k, j, CASE WHEN fits THEN t ELSE CASE WHEN j > 0 THEN 'row_cont: ' ELSE '' END || array_to_string(w[j * room + 1:j * room + room], ' ') END AS t
  FROM (SELECT *, unnest(range(0, CASE WHEN fits THEN 1 ELSE (len(w) - 1) // room + 1 END)) AS j FROM cut)
), ordered AS MATERIALIZED (
  SELECT doc_id, head, t, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS p FROM pieces
), filled AS (
  SELECT doc_id, p, head + n AS used, 1 AS part FROM ordered WHERE p = 1
  UNION ALL SELECT o.doc_id, o.p, CASE WHEN f.used + o.n > 450 THEN o.head + o.n ELSE f.used + o.n END, f.part + CASE WHEN f.used + o.n > 450 THEN 1 ELSE 0 END
  FROM filled f JOIN ordered o ON o.doc_id = f.doc_id AND o.p = f.p + 1
), of_tables AS (
  SELECT doc_id, doc_id || '-table-1-' || part AS chunk_id, 'table' AS chunk_type, 'Table 1' AS parent_section, any_value(header) || chr(10) || string_agg(t, chr(10) ORDER BY p) AS content
  FROM filled JOIN ordered USING (doc_id, p) JOIN heads USING (doc_id) GROUP BY doc_id, part
), of_figures AS (
  SELECT doc_id, doc_id || '-figure-' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_id, 'figure' AS chunk_type, 'Figure' AS parent_section, l AS content
  FROM lines WHERE regexp_matches(l, '(?i)^(figure|chart)\b')
)"""


@query(
    """ SELECT doc_id, chunk_id, chunk_type, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS INTEGER) AS token_count,
  sha256(chunk_id || '|' || chunk_type || '|' || parent_section || '|' || content) AS content_hash,
  CASE WHEN regexp_matches(lower(content), 'table\\s+1([^0-9]|$)') AND doc_id IN (SELECT doc_id FROM of_tables) THEN doc_id || '-table-1-1' ELSE '' END AS relationships
FROM (SELECT * FROM of_tables UNION ALL SELECT * FROM of_figures)""",
    "RECURSIVE " + _TEXT_SQL,
)
def refined_tables(spark, sf_dir):
    """Tables and figures of all documents' own texts, with the tables that they name."""
    return documents.refined(_noted(spark, sf_dir)).filter("chunk_type in ('table', 'figure')").select("doc_id", "chunk_id", "chunk_type", "token_count", "content_hash", "relationships")


def _noted(spark, sf_dir):
    key = F.col("doc_id")
    before = F.when(key % 3 == 0, "Section Of Notes\n\n").otherwise("")
    behind = F.when(key % 4 == 0, "\nFigure 1 of the tables\n\nSee Table 1 and table 7 here.").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(before, F.coalesce("text", F.lit("")), behind).alias("text"))


@query(
    """, b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS b FROM files
), blocks AS (SELECT doc_id, unnest(CASE WHEN len(b) = 0 THEN [''] ELSE b END) AS t, unnest(range(1, greatest(len(b), 1) + 1)) AS block FROM b
), w AS (SELECT *, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM blocks
), parts AS (SELECT doc_id, block, w, t, unnest(range(0, greatest(len(w) - 1, 0) // 450 + 1)) AS j FROM w
), texts AS (SELECT doc_id, doc_id || '-paragraph-' || block || '-' || (j + 1) AS chunk_id, CASE WHEN len(w) <= 450 THEN t ELSE array_to_string(w[j * 450 + 1:j * 450 + 450], ' ') END AS content FROM parts)
SELECT doc_id, chunk_id, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS INTEGER) AS token_count, sha256(content) AS content_sha256,
  CASE WHEN regexp_matches(lower(content), 'table\\s+1([^0-9]|$)') AND doc_id IN (SELECT doc_id FROM of_tables) THEN doc_id || '-table-1-1' ELSE '' END AS relationships FROM texts""",
    "RECURSIVE " + _TEXT_SQL,
)
def refined_texts(spark, sf_dir):
    """Text chunks of all documents, with the tables that they name."""
    chunks = documents.refined(_noted(spark, sf_dir)).filter("chunk_type not in ('table', 'figure')")
    return chunks.select("doc_id", "chunk_id", "token_count", F.sha2("content", 256).alias("content_sha256"), "relationships")
