"""Folds, commands, context and documents on small logs, held against plain versions."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import json as js
from tallyfold.operators import causal, commands, context, documents, feed, folds, integrity, upcast
from tallyfold.sources import files, shared
from tallyfold.sources.dossier import FIELDS
from tallyfold.sources.eventlog import EventLog, StreamNotFound, TypeMismatch
from tallyfold.streaming import views

T0 = datetime(2025, 1, 1)
SCHEMA = "application_id long, stream_id string, stream_position long, global_position long, event_id string, causation_id string, event_type string, recorded_at timestamp_ntz, " + ", ".join(
    f"{k} {'array<string>' if k == 'mandatory' else v}" for k, v in FIELDS.items()
)


def log(spark, events):
    """Events of (application, stream, type, cause, payload) in order."""
    seen, rows = {}, []
    for i, (app, stream, kind, cause, payload) in enumerate(events):
        seen[stream] = seen.get(stream, 0) + 1
        rows.append((app, stream, seen[stream], i + 1, f"e{i + 1}", cause, kind, T0 + timedelta(hours=i), *[payload.get(k) for k in FIELDS]))
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_keeps_types(spark):
    (r,) = spark.createDataFrame([('{"k":3,"o":{"a":1},"b":true}', '{"k":null,"z":[1.5]}')], "a string, b string").select(js.merged(F.col("a"), F.col("b")).alias("m")).collect()
    assert json.loads(r.m) == {"k": None, "o": {"a": 1}, "b": True, "z": [1.5]}


def test_upcast_keeps_numbers_and_leaves_a_note(spark):
    payload = json.dumps({"application_id": "a", "recommended_limit_usd": 5000.5, "analysis_duration_ms": 12, "confidence_score": None})
    rows = spark.createDataFrame([("CreditAnalysisCompleted", 1, T0, payload, '{"actor":"x"}')], "event_type string, event_version int, recorded_at timestamp_ntz, payload string, metadata string")
    r = upcast.default_upcasters().apply(rows).first()
    got = json.loads(r.payload)
    assert got["recommended_limit_usd"] == 5000.5 and got["analysis_duration_ms"] == 12 and "confidence_score" not in got and got["model_version"] == "credit-v1.5"
    assert json.loads(r.metadata) == {"actor": "x", "upcast_notes": ["CreditAnalysisCompleted:v1->v2"]}


def test_folds_of_one_application(spark):
    rows = log(spark, [
        (1, "loan-1", "ApplicationSubmitted", None, {"requested_amount": 9.0}), (1, "agent-x", "CreditAnalysisCompleted", "e1", {"agent_id": "x", "confidence": 0.5}),
        (1, "compliance-1", "ComplianceCheckRequested", None, {"mandatory": ["a", "b"]}), (1, "compliance-1", "ComplianceRuleFailed", None, {"rule_id": "a"}),
        (1, "compliance-1", "ComplianceCheckRequested", None, {"mandatory": ["a"]}), (1, "compliance-1", "ComplianceRulePassed", None, {"rule_id": "a"}),
        (1, "compliance-1", "ComplianceCheckCompleted", None, {"overall_verdict": "FAILED"}), (1, "loan-1", "DecisionGenerated", "e2", {"recommendation": "approve"}),
    ])
    (r,) = folds.outcome(rows).collect()
    assert (r.current_state, r.decision_recommendation, r.compliance, r.agents) == ("APPROVED_PENDING_HUMAN", "APPROVE", "CLEARED", "x:unknown:1:0")
    assert folds.outcome(rows.limit(0)).count() == 0


def test_counterfactual_needs_events_and_keeps_what_is_independent(spark):
    rows = log(spark, [
        (1, "loan-1", "ApplicationSubmitted", None, {"requested_amount": 9.0}), (1, "agent-x", "CreditAnalysisCompleted", "e1", {"agent_id": "x"}), (1, "loan-1", "DecisionGenerated", "e2", {"recommendation": "APPROVE"}),
        (1, "other-1", "FraudScreeningCompleted", "e1", {"agent_id": "y"}), (1, "loan-1", "ApplicationApproved", "e3", {"approved_amount": 5.0}),
    ])
    with pytest.raises(ValueError):
        causal.counterfactual(rows, "CreditAnalysisCompleted", [])
    (r,) = causal.counterfactual(rows, "CreditAnalysisCompleted", [{"event_type": "ApplicationDeclined"}]).collect()
    assert (r.real_current_state, r.real_approved_amount, r.other_current_state, r.other_final_decision) == ("FINAL_APPROVED", 5.0, "FINAL_DECLINED", "DECLINE")
    assert (r.other_agents, r.events_undone, r.simulated_events) == ("y:unknown:0:1", 3, 3)


def test_sessions_stop_at_their_first_error(spark):
    rows = log(spark, [
        (1, "agent-a", "AgentContextLoaded", None, {"model_version": "m"}), (1, "agent-a", "CreditAnalysisCompleted", None, {"model_version": "m"}), (1, "agent-a", "AgentContextLoaded", None, {"model_version": "m"}),
        (1, "agent-a", "CreditAnalysisCompleted", None, {"model_version": "m"}), (1, "agent-b", "FraudScreeningCompleted", None, {"model_version": "m"}), (1, "agent-b", "AgentContextLoaded", None, {"model_version": "m"}),
    ])
    got = {r.stream_id: (r.context_loaded, r.outputs, r.first_error, r.error_position) for r in folds.agent_sessions(rows).collect()}
    assert got == {"agent-a": (True, 1, "context loaded twice", 3), "agent-b": (False, 0, "output before the context", 1)}


def test_trouble_is_in_values_only(spark):
    cases = {'{"error":"fine"}': False, '{"a":{"b":["x","has failed"]}}': True, '{"PENDING":1,"q":"a \\" ERROR"}': True, '{"a":"x","error":{"failed":2}}': False, None: False, "": False}
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, payload string").select("i", context.troubled(F.col("payload")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == list(cases.values())


def plain_context(events, budget):
    """The text of one session, written out."""
    last = {e["stream_position"] for e in events[-3:]}
    kept = [e for e in events if e["stream_position"] in last or e["flagged"]]
    old = [e for e in events if e not in kept]
    lines = ["Agent session reconstruction for s.", f"Total events: {len(events)}; last_event_position: {events[-1]['stream_position']}."]
    if old:
        counts = {}
        for e in old:
            counts[e["event_type"]] = counts.get(e["event_type"], 0) + 1
        lines.append("Earlier history summary: " + ", ".join(f"{k} x{n}" for k, n in sorted(counts.items())) + f" between {old[0]['recorded_at'].isoformat()} and {old[-1]['recorded_at'].isoformat()}.")
    else:
        lines.append("Earlier history summary: none (all events preserved verbatim).")
    n = sum(e["flagged"] for e in events)
    short = [json.dumps({"event_type": e["event_type"], "payload": json.loads(e["payload"]), "stream_position": e["stream_position"]}, separators=(",", ":")) for e in kept]
    compact = "\n".join([*lines, f"Pending work count: {n}", "Verbatim preserved events (compact):", *short])
    return compact if len(compact) // 4 <= budget else "\n".join([*lines, f"Pending work count: {n}"])


def test_context_text_equals_a_plain_one(spark):
    rnd = random.Random(3)
    events = [{"stream_id": "s", "stream_position": i + 1, "event_type": rnd.choice(["AgentContextLoaded", "Step", "Other"]), "payload": json.dumps({"k": rnd.choice(["ok", "failed"])}), "recorded_at": T0 + timedelta(minutes=i)} for i in range(12)]
    for e in events:
        e["flagged"] = "failed" in e["payload"]
    frame = context.flagged(spark.createDataFrame([tuple(e[c] for c in ("stream_id", "stream_position", "event_type", "payload", "recorded_at")) for e in events], "stream_id string, stream_position long, event_type string, payload string, recorded_at timestamp_ntz"))
    for budget in (100, 10):
        assert context.context_text(frame, budget).first().context_text == plain_context(events, budget)
    whole = context.context_text(frame, 4096).first()
    assert whole.context_text.count("\n") > 6 and "Verbatim preserved events:" in whole.context_text and whole.health in ("DEGRADED", "HEALTHY", "NEEDS_RECONCILIATION")


def test_chunks_of_lists_tables_and_long_blocks(spark):
    text = "1 Results\nTotal Revenue: 5\n\n1) a\n2) b\n\n" + "w " * 1000
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    chunks = documents.text_chunks(documents.titled_blocks(documents.paragraphs(docs)))
    got = [(r.chunk_id, r.token_count, r.parent_section) for r in chunks.filter("doc_id = 1").orderBy("chunk_id").collect()]
    assert got == [("1-list-2", 4, "1 Results"), ("1-paragraph-1-1", 5, "1 Results"), ("1-paragraph-3-1", 450, "1 Results"), ("1-paragraph-3-2", 450, "1 Results"), ("1-paragraph-3-3", 100, "1 Results")]
    assert chunks.filter("doc_id > 1").count() == 2
    tables = spark.createDataFrame([(1, 1, 1, ["a", "b", "c"], [[str(i), "x", "y"] for i in range(20)] + [["z " * 60]]), (2, 1, 1, ["h"] * 40, [])], "doc_id long, table int, page int, headers array<string>, rows array<array<string>>")
    parts = documents.table_chunks(tables, most=25)
    assert parts.filter("token_count > 25").count() == 0 and documents.invalid_chunks(parts, 25).count() == 0
    assert parts.filter("doc_id = 1").count() > 1 and parts.filter("not startswith(content, 'headers: ')").count() == 0
    body = " ".join(r.content for r in parts.filter("doc_id = 1").collect())
    assert all(f"row: {i} | x | y" in body for i in range(20)) and body.count("z") == 60
    assert documents.invalid_chunks(chunks.withColumn("chunk_type", F.lit("table"))).count() == chunks.count()


def test_titles(spark):
    cases = {"RESULTS OF THE YEAR\nmore": "RESULTS OF THE YEAR", "a plain sentence that ends here.": None, "12": None, "2.1 scope of work": "2.1 scope of work", "Two Words": "Two Words", "one Two three four": None, "": None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string").select("i", documents.inferred_title(F.col("text")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == list(cases.values())


def test_ask_without_evidence(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta\n\nSome text on ships. And more. End."), (2, "nothing here")], "doc_id long, text string")
    chunks = documents.text_chunks(documents.titled_blocks(documents.paragraphs(docs)))
    got = {r.doc_id: r for r in documents.ask(documents.sections(chunks), chunks, "ships").collect()}
    assert got[1].answer.startswith("Some text on ships.") or got[1].answer.startswith("Alpha Beta")
    assert got[1].citations and got[2].answer == "No supporting evidence found in the document."


def test_resources_and_pages(spark):
    rows = log(spark, [(7, "loan-7", "ApplicationSubmitted", None, {"requested_amount": 1.0}), (8, "loan-8", "ApplicationSubmitted", None, {"requested_amount": 2.0})])
    summary = folds.application_fold(rows)
    assert feed.resource("ledger://applications/7", {"summary": summary}).first().application_id == 7
    assert feed.resource("ledger://agents/a/sessions/s", {"log": rows}).count() == 0
    with pytest.raises(KeyError):
        feed.resource("ledger://else", {})
    with pytest.raises(ValueError):
        feed.page(summary, ["application_id"], 0, 0)
    assert [(r.application_id, r.total) for r in feed.page(summary, ["application_id"], 1, 1).collect()] == [(8, 2)]


def test_refused_commands(spark):
    state = spark.createDataFrame([(1, "FINAL_APPROVED"), (2, "SUBMITTED")], "application_id long, current_state string")
    sessions = spark.createDataFrame([("s", True, "m")], "stream_id string, context_loaded boolean, model_version string")
    given = [(1, 1, "s", "m", 0.5, "h", 1.0, 1), (2, 2, "s", "m", 0.5, "h", 1.0, 1), (3, 2, "t", "m", 0.5, "h", 1.0, 1), (4, 9, "s", "m", 0.5, "h", 1.0, 1), (5, 2, "s", "m", None, "h", 1.0, 1)]
    frame = spark.createDataFrame(given, "command_id long, application_id long, stream_id string, model_version string, score double, input_hash string, limit_amount double, duration_ms long")
    got = {r.command_id: r.reason for r in commands.record_output(frame, state, sessions).collect()}
    assert got == {1: "application is final", 2: None, 3: "session has no context", 4: "application does not exist", 5: "score out of range"}


def events(spark, stream, n, tag, kind="Loan"):
    schema = "event_id string, stream_id string, seq int, event_type string, event_version int, payload string, metadata string, recorded_at timestamp_ntz, aggregate_type string"
    return spark.createDataFrame([(f"{tag}{i}", stream, i, "CreditAnalysisCompleted", 1, '{"agent_id":"a"}', None, T0, kind) for i in range(n)], schema)


def test_event_log_chains_stamps_and_upcasts(spark, tmp_path):
    store = EventLog(spark, str(tmp_path / "log"))
    expect = lambda v: spark.createDataFrame([("s", v)], "stream_id string, expected_version long")
    heads = []
    store.append(events(spark, "s", 2, "a"), expect(0), correlation_id="c1", after_write=lambda h: heads.append(h.first().version))
    store.append(events(spark, "s", 2, "b"), expect(2))
    assert heads == [2]
    rows = store.read().orderBy("stream_position").collect()
    notes = [json.loads(r.metadata) for r in rows]
    assert [n["previous_hash"] for n in notes] == ["GENESIS", *[n["integrity_hash"] for n in notes[:-1]]]
    assert notes[0]["correlation_id"] == "c1" and "correlation_id" not in notes[2]
    assert sorted(r.global_position for r in rows) == [1, 2, 3, 4]
    assert {r.event_version for r in store.stream("s").collect()} == {2} and {r.event_version for r in rows} == {1}
    assert store.after(1, ["CreditAnalysisCompleted"], limit=2).count() == 2
    assert store.describe("s")["version"] == 4
    with pytest.raises(TypeMismatch):
        store.append(events(spark, "s", 1, "x", "Audit"), expect(4))
    with pytest.raises(StreamNotFound):
        store.describe("none")


def test_views_count_files_that_come_out_of_order(spark, tmp_path):
    for part, (low, high) in enumerate([(20, 30), (0, 10), (10, 20)]):
        spark.range(low, high).selectExpr("'s' as stream_id", "'t' as event_type", "id + 1 as global_position").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    view = views.View(spark, str(tmp_path / "view"), views.COUNTERS)
    stream = spark.readStream.schema("stream_id string, event_type string, global_position long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    views.keep_up(stream, view, views.counters, views.added, str(tmp_path / "cp")).awaitTermination()
    assert view.read().agg(F.sum("n")).first()[0] == 30 and view.pointer()["position"] == 30 and views.lowest([view]) == 30


def test_a_failing_merge_is_tried_again(spark, tmp_path):
    spark.range(3).selectExpr("'s' as stream_id", "'t' as event_type", "id + 1 as global_position").write.parquet(str(tmp_path / "in"))
    view = views.View(spark, str(tmp_path / "view"), views.COUNTERS)
    turns = []

    def merge(old, new):
        turns.append(1)
        if len(turns) < 3:
            raise RuntimeError("not now")
        return views.added(old, new)

    stream = spark.readStream.schema("stream_id string, event_type string, global_position long").parquet(str(tmp_path / "in"))
    views.keep_up(stream, view, views.counters, merge, str(tmp_path / "cp"), delay=0.01).awaitTermination()
    assert len(turns) == 3 and view.read().first().n == 3


def test_rules_files_and_appends(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("fast_text_confidence_gate: 0.5\n# note\nother: 'x'\nflag: True\nn: 7\nbudget:\n  usd: 1.5\n  deep:\n    a: b\nlast: -1\nempty:\n")
    got = files.rules(spark, str(tmp_path / "r.yaml"))
    assert got == files.DEFAULT_RULES | {"fast_text_confidence_gate": 0.5, "other": "x", "flag": True, "n": 7, "budget": {"usd": 1.5, "deep": {"a": "b"}}, "last": "-1"}
    rows = spark.range(2)
    for _ in range(2):
        files.insert_facts(rows, str(tmp_path / "facts"))
        files.write_json(rows, str(tmp_path / "j"), append=True)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 4 and spark.read.json(str(tmp_path / "j")).count() == 4


def test_shared_tables_are_released(spark):
    before = shared.tables()
    assert shared.written(spark.range(3)).count() == 3 and shared.tables() == before + 1
    shared.release(spark, before)
    assert shared.tables() == before


def test_files_of_any_bytes(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        files.text_files(spark, str(folder))
    (folder / "b.txt").write_bytes("é ok".encode())
    (folder / "deep" / "a.CSV").write_bytes(b"a,b\n1,\xff2")
    (folder / "none").write_bytes(b"")
    rows = files.text_files(spark, [str(folder), str(folder / "b.txt")]).collect()
    assert [(r.path, r.suffix, r.text) for r in rows] == [(str(folder / "b.txt"), ".txt", "é ok"), (str(folder / "deep" / "a.CSV"), ".csv", "a,b\n1,2")]
    assert len({r.doc_id for r in rows}) == 2 and all(len(r.doc_id) == 16 for r in rows)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.text_files(spark, str(tmp_path / "gone"))


def test_titled_paragraphs_equal_titled_blocks_without_moving_text(spark):
    texts = ["Alpha Beta\n\nplain text that ends.\n\nGAMMA\n\nmore text, that ends.\n \n\n\tlast one.", "no title here, it ends.\n\nDelta\r\nnext", "", None, " \n\n ", "One\n\nTwo", "a\x0b b \r\r1) c\n\n1) x\r2) y\n\n" + "w\t" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got, want = documents.titled_paragraphs(docs), documents.titled_blocks(documents.paragraphs(docs))
    columns = ("doc_id", "block", "page", "text", "section_title")
    of = lambda frame: sorted(tuple(r[c] for c in columns) for r in frame.collect())
    assert of(got) == of(want) and len(of(got)) == 15
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    chunks = documents.text_chunks(got)
    assert chunks.filter(F.col("token_count") != F.size(F.expr("filter(split(content, '\\\\s+'), w -> w <> '')"))).count() == 0


def test_papers_are_dealt_out_before_their_text_is_made(spark):
    from conftest import SF
    from tallyfold.plans import decision_queries

    plan = decision_queries.document_answers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Every exchange is the one of keys alone.
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") > 0


def test_answers_make_their_chunks_once(spark):
    """Chunks were made three times: for sections, for facts and for scores."""
    from conftest import SF
    from tallyfold.plans import decision_queries

    plan = decision_queries.document_answers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_own_sections_and_facts_answer_as_given_ones(spark):
    from tallyfold.operators import refinery as rf

    draw, rows = random.Random(3), []
    words_ = ["Revenue", "order", "report", "cost", "reports", "total revenue: $12,000.", "revenue = 7", "It ends.", "what", "showing", "DOES"]
    for i in range(60):
        parts = [draw.choice(["Order Report", "GENERAL NOTES", "1) one\n2) two", "", "Costs"]) if draw.random() < 0.4 else " ".join(draw.choices(words_, k=draw.randint(1, 40))) * draw.choice([1, 1, 30]) for _ in range(draw.randint(0, 9))]
        rows.append((i, "\n\n".join(parts)))
    chunks = documents.text_chunks(documents.titled_paragraphs(spark.createDataFrame(rows, "doc_id int, text string").repartition(3, "doc_id"))).cache()
    for question in ("What revenue does the order report show?", "Which costs are in the notes?", "?"):
        given = documents.ask(documents.sections(chunks), chunks, question, rf.facts(chunks))
        assert sorted(map(tuple, documents.ask_own(chunks, question).collect()), key=repr) == sorted(map(tuple, given.collect()), key=repr)
    score = chunks.select(documents.overlap("Revenue, order 12 cost?", F.col("content")).alias("a"), F.round(F.size(F.array_intersect(F.expr("array('revenue','order','12','cost')"), rf.tokens(F.col("content")))) / 4, 6).alias("b"))
    assert score.filter("not (a <=> b)").count() == 0
