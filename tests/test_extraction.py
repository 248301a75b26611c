import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import extractors, lifecycle
from tallyfold.operators import refinery as rf

PROFILE = "doc_id int, visible int, char_density double, image_area_ratio double, tables int, layout string, origin string, large_complex boolean, page_count int, cost string"


def plain(visible, density, image, tables, layout, origin, large, pages, cost):
    """Strategy, confidence and cost by sums of decimals in the order in which they are given."""
    complex_ = layout in ("multi_column", "table_heavy", "mixed")
    fast = 0.35 + (0.25 if visible > 300 else 0) + (0.15 if density > 120 else 0) + (0.15 if image < 0.25 else 0) + (0.1 if tables else 0)
    fast = min(1.0, fast)
    lay = max(0.0, min(1.0, fast + (0.2 if complex_ else 0.1) - ((0.12 if origin in ("mixed", "scanned_image") else 0) + (0.08 if image >= 0.5 else 0) + (0.35 if large else 0))))
    lay = min(lay, 0.84) if large else lay
    vision = min(1.0, lay + 0.1)
    chain = ["fast_text", "layout_aware", "vision_augmented"]
    start = {"fast_text_sufficient": 0, "needs_layout_model": 1}.get(cost, 2)
    for name, got, gate in list(zip(chain, (fast, lay, vision), (0.9, 0.88, 0.72)))[start:]:
        if got >= gate - 1e-9:
            break
    usd = {"fast_text": 0.001, "layout_aware": 0.01}.get(name, min(1.5, max(0.05, 0.08 * pages)))
    return name, round(got, 4), round(usd, 4)


def test_routing_of_all_profiles(spark):
    layouts = ("single_column", "multi_column", "table_heavy", "figure_heavy", "mixed")
    rows = []
    for v, d, im, t, layout, origin, large in itertools.product((10, 301), (50.0, 130.0), (0.0, 0.3, 0.7), (0, 1), layouts, ("native_digital", "mixed", "scanned_image", "form_fillable"), (False, True)):
        if large and layout not in ("multi_column", "table_heavy"):
            continue
        cost = "needs_vision_model" if origin == "scanned_image" or large else "needs_layout_model" if layout in ("multi_column", "table_heavy", "mixed") or origin == "mixed" else "fast_text_sufficient"
        rows.append((len(rows), v, d, im, t, layout, origin, large, 25 if large else 1, cost))
    got = {r.doc_id: (r.strategy, round(r.confidence, 4), round(r.cost_usd, 4)) for r in rf.routed(spark.createDataFrame(rows, PROFILE)).collect()}
    assert got == {r[0]: plain(*r[1:]) for r in rows} and len({g[0] for g in got.values()}) == 3
    one = rf.routed(spark.createDataFrame(rows, PROFILE), gate=0.0)
    assert {r.strategy for r in one.filter("cost = 'fast_text_sufficient'").collect()} == {"fast_text"}


def test_file_types_and_origins(spark):
    long = "word " * 200
    rows = [
        (1, long, ".pdf", 1, 0.0), (2, long, ".pdf", 1, 0.4), (3, "x" * 20, ".pdf", 5, 0.9), (4, "a,b\n1,2", ".csv", None, None), (5, "tiny", ".txt", None, None), (6, long, None, None, None),
        (7, "1,2,3,4\n" * 50, ".pdf", 20, 0.0), (8, "1,2,3,4\n" * 50, ".pdf", 19, 0.0), (9, None, ".txt", None, None), (10, "1,2,3,4\n" * 60, ".txt", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, suffix string, page_count int, image_area_ratio double")
    got = {r.doc_id: r for r in rf.triage(docs).collect()}
    assert [got[i].origin for i in range(1, 7)] == ["native_digital", "mixed", "scanned_image", "form_fillable", "mixed", "native_digital"]
    assert (got[7].cost, got[8].cost, got[3].cost, got[9].layout) == ("needs_vision_model", "needs_layout_model", "needs_vision_model", "mixed")
    routes = {r.doc_id: (r.strategy, r.confidence) for r in rf.routed(rf.triage(docs)).collect()}
    assert routes[10] == ("layout_aware", 1.0)  # 0.35 + 0.25 + 0.15 + 0.10 for the text, 0.20 for its layout
    assert rf.triage(docs.limit(0)).count() == 0
    bare = rf.triage(docs.select("doc_id", "text")).filter("doc_id = 6").first()
    assert (bare.suffix, bare.page_count) == (".txt", 1)


def test_strategies_by_name(spark):
    text = "REPORT OF THE YEAR\n\nSome plain text that ends here.\n\na,b,c\n1,2,3\n\nFigure 1 shows a chart."
    docs = spark.createDataFrame([(1, text, ".txt"), (2, None, None), (3, "h,i\n1,2", ".csv")], "doc_id int, text string, suffix string")
    fast = {r.doc_id: r for r in extractors.extracted(docs, "fast_text").collect()}
    assert len(fast[1].text_blocks) == 4 and fast[1].tables[0].headers == ["a", "b", "c"] and fast[1].tables[0].rows == [["1", "2", "3"]]
    assert fast[2].text_blocks == [] and fast[2].chars == 0 and fast[3].tables[0].headers == ["h", "i"]
    layout = {r.doc_id: r for r in extractors.extracted(docs, "layout_aware").collect()}
    assert layout[1].text_blocks[1].section_title == "REPORT OF THE YEAR" and layout[1].sections >= 1
    assert extractors.extracted(docs, "vision_augmented").columns == ["doc_id", "text_blocks", "tables", "chars", "sections", "figures"]
    assert {r.doc_id: r.figures for r in extractors.extracted(docs, "vision_augmented").collect()}[1] == 2


def test_a_strategy_of_ones_own(spark):
    own = extractors.Strategy("upper", lambda text, suffix: {"text_blocks": [(1, None, text.upper())], "tables": [], "chars": len(text), "kind": suffix}, (("kind", "string"),))
    docs = spark.createDataFrame([(1, "abc", ".md")], "doc_id int, text string, suffix string")
    row = extractors.extracted(docs, "upper", registry={"upper": own}).first()
    assert (row.text_blocks[0].text, row.kind) == ("ABC", ".md")
    with pytest.raises(ValueError):
        extractors.register(extractors.Strategy("fast_text", extractors.fast_text))
    with pytest.raises(Exception, match="the strategy is one of"):
        extractors.extracted(docs, "other").collect()


def greedy(times, window):
    out, until = [], None
    for t in times:
        out.append(until is None or t >= until)
        until = t + window if out[-1] else until
    return out


def test_refused_calls_open_no_window(spark):
    rows = [("a", 0, 1), ("a", 40, 2), ("a", 80, 3), ("b", 80, 4), ("b", 80, 5), ("b", 139, 6), ("b", 140, 7), (None, 5, 8)]
    calls = spark.createDataFrame(rows, "entity string, at long, global_position long").withColumn("recorded_at", F.timestamp_seconds("at"))
    got = {r.global_position: r.allowed for r in lifecycle.rate_limited(calls, "entity").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: False}
    assert lifecycle.rate_limited(calls.limit(0), "entity").count() == 0


def test_rate_limits_equal_a_plain_pass(spark):
    draw = random.Random(7)
    rows = [(draw.choice("abc") if i % 3 else "hot", draw.randrange(4000), i) for i in range(1500)]
    calls = spark.createDataFrame(rows, "entity string, at long, global_position long").withColumn("recorded_at", F.timestamp_seconds("at")).repartition(4)
    got = {r.global_position: r.allowed for r in lifecycle.rate_limited(calls, "entity", seconds=45).collect()}
    want = {}
    for entity in {r[0] for r in rows}:
        own = sorted((t, i) for e, t, i in rows if e == entity)
        want |= dict(zip((i for _, i in own), greedy([t for t, _ in own], 45)))
    assert got == want
