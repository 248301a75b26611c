"""What must not grow with the data on one machine: sides that are broadcast, states, tasks."""

import pytest

import __spark_entry__ as entry
from conftest import SF


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["contributing_sessions", "counterfactual_outcomes", "regulatory_packages", "command_analyses", "command_submissions", "command_sessions", "command_screenings", "stored_compliance"],
)
def test_no_side_that_grows_is_broadcast(spark, name):
    """Sizes behind an explode are guessed too small, so that only a hint keeps these sides off the driver."""
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["contributing_sessions", "application_summary"])
def test_columns_that_nobody_reads_are_not_made(spark, name):
    """Only numbers of events are exploded, not rows of all payload columns."""
    text = plan(entry.queries()[name](spark, SF))
    assert "Generate explode" in text and "failure_reason" not in text and "lambda" not in text


def test_envelopes_are_sealed_by_one_pass_of_python(spark):
    """Texts were parsed as variants several times an event before, and once more in Python."""
    from tallyfold.operators import integrity

    text = plan(integrity.sealed(spark.sql("select 'loan-1' stream_id, 1L stream_position, 'A' event_type, 1 event_version, '{\"b\":1,\"a\":2}' payload, '{}' metadata from range(3)")))
    assert "try_parse_json" not in text and text.count("ArrowEvalPython") == 1


def test_a_walk_leaves_each_pair_on_disk_once(spark, tmp_path):
    """Checkpoints of all that had been reached were written again each turn, as rows lie in memory, and stayed."""
    import os

    from pyspark.sql import functions as F

    from tallyfold.operators import causal
    from tallyfold.sources import shared

    def used():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared.folder(spark)) for f in files)

    log = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.when(F.col("id") % 8 > 0, F.concat(F.lit("e"), F.col("id") - 1)).alias("causation_id"))
    before = used()
    out = causal.descendants(log, log.filter("causation_id is null").select(F.col("event_id").alias("root_id")))
    left = used() - before
    assert out.count() == 17_500 and left < 1_000_000


def test_thousands_are_parted_as_the_text_says(spark, duck, tmp_path):
    """Beyond a million the query and its SQL differed."""
    k = [1, 999, 1000, 999_999, 1_000_000, 1_000_007, 12_345_678]
    rows = [(i, 1, "F", 1.0, None, "1") for i in k]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    sql = entry.oracle_sql()["formatted"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {r[0]: r for r in duck.execute(sql).fetchall()}
    got = {r.k: tuple(r) for r in entry.queries()["formatted"](spark, str(tmp_path)).collect()}
    assert got == want


def test_a_timeline_sorts_its_rows_twice(spark):
    """Four orders and more in one task each held their rows at the same time."""
    text = plan(entry.queries()["dossier_compliance_timeline"](spark, SF))
    assert 0 < text.count("Sort [application_id") <= 2


def test_stored_timelines_have_more_buckets_where_there_are_more_applications(spark, monkeypatch):
    from tallyfold.operators import stored
    from tallyfold.plans import stream_queries

    seen, write = [], stored.write
    monkeypatch.setattr(stream_queries, "APPLICATIONS", 50)
    monkeypatch.setattr(stored, "write", lambda *a, **k: (seen.append(k.get("buckets", a[-1])), write(*a, **k)))
    assert entry.queries()["stored_compliance"](spark, SF).count() > 0
    assert seen == [-(-spark.read.parquet(f"{SF}/orders.parquet").count() // 50)] and seen[0] > 16


@pytest.mark.parametrize("name", ["upcast_decision_v1_v2", "upcast_credit_v1_v2"])
def test_a_rewrite_parses_each_text_once(spark, name):
    """A payload was parsed for each key that a rewrite reads, and for each session once more."""
    text = plan(entry.queries()[name](spark, SF))
    assert text.count("parseJson") <= 3 and text.count("get_json_object") <= 2


@pytest.mark.parametrize("name", ["payload_errors", "command_refusals"])
def test_a_payload_is_checked_by_one_parse(spark, name):
    """A payload was parsed for every use of each of its fields, and again for the calls that are limited."""
    assert plan(entry.queries()[name](spark, SF)).count("parseJson") == 1


@pytest.mark.parametrize("name", ["refined_texts", "refined_tables"])
def test_chunks_are_made_once_where_their_text_lies(spark, name):
    """Chunks were made four times and joined by key, texts and all."""
    text = plan(entry.queries()[name](spark, SF))
    assert "Join" not in text and "Exchange" not in text


def test_a_scope_reads_the_log_once(spark):
    """The log was made three times, and its events dealt out by position to drop doubles."""
    text = plan(entry.queries()["case_events_scope"](spark, SF))
    assert text.count("explode") == 2 and "global_position" in text and "HashAggregate(keys=[global_position" not in text


def test_annotations_fit_methods_that_the_machine_compiles(spark):
    """A method of more than 8,000 bytes is never compiled: the whole expression was one of 12,021."""
    stages = entry.queries()["lineage_annotated"](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_what_a_stream_undoes_itself_is_not_walked(spark, monkeypatch):
    """Every event of an application was walked to by links, though nothing before a branch follows from it."""
    from tallyfold.operators import causal

    monkeypatch.setattr(causal, "_walked", None)
    assert entry.queries()["divergence_events"](spark, SF).count() > 0


def test_strategies_meet_a_text_once(spark):
    """Texts were joined with their profiles, and went to Python and back for each strategy."""
    text = plan(entry.queries()["extraction_log"](spark, SF))
    assert "Join" not in text and "Exchange" not in text and text.count("EvalPythonUDTF") == 1


def test_a_counterfactual_writes_no_log_down(spark):
    """The whole log was checkpointed twice, and each round of causes written as tables."""
    import os

    from tallyfold.sources import shared

    def used():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared.folder(spark)) for f in files)

    before = used()
    out = entry.queries()["counterfactual_outcomes"](spark, SF)
    assert out.count() > 0 and used() == before
    text = plan(out)
    assert "Join" not in text and "Scan ExistingRDD" not in text


def test_causes_are_followed_in_any_order_and_within_an_application(spark):
    """Against a plain walk: causes behind their effects, cycles, ids of other applications, parts that end within an application."""
    import random

    from tallyfold.operators import causal

    draw, rows, want = random.Random(5), [], {}
    for app in range(40):
        n = 3000 if app == 7 else draw.randint(1, 12)
        events = [(app, 100_000 * app + i, f"e{i}", f"e{draw.randrange(n)}" if draw.random() < 0.8 else None, draw.choice("st")) for i in range(n)]
        at = draw.randrange(n)
        stream, gone = events[at][4], {e[2] for e in events[at:] if e[4] == events[at][4]}
        while True:
            more = {e[2] for e in events if e[3] in gone} - gone
            if not more:
                break
            gone |= more
        want |= {e[1]: e[2] in gone and e[1] >= events[at][1] for e in events}
        rows += [(*e, e[1], "Branch" if i == at else "Other") for i, e in enumerate(events)]
    frame = spark.createDataFrame(rows, "application_id long, global_position long, event_id string, causation_id string, stream_id string, stream_position long, event_type string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.global_position for r in causal.divergence(frame.repartition(5), "Branch").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {p for p, undone in want.items() if undone}


def test_a_package_reads_the_log_few_times(spark):
    """The log was made nine times, for counts, story, models, each fold and the chain, and dealt out by stream."""
    text = plan(entry.queries()["regulatory_packages"](spark, SF))
    assert text.count("FileScan") <= 4 and text.count("Exchange") <= 5
