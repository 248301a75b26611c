import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import analytics, causal, context, integrity, lifecycle, outbox, projections, upcast
from tallyfold.operators import refinery as rf
from tallyfold.sources.eventlog import ConcurrencyError, EventLog, StreamArchived
from tallyfold.sources.ledger import PAYLOAD
from tallyfold.streaming import views

T0 = datetime(2025, 1, 1)
ENVELOPE = "application_id long, global_position long, event_type string, recorded_at timestamp_ntz, " + ", ".join(f"{k} {v}" for k, v in PAYLOAD.items())


def log(spark, events):
    rows = []
    for i, (app, kind, payload) in enumerate(events):
        rows.append((app, i + 1, kind, T0 + timedelta(hours=i), *[payload.get(k) for k in PAYLOAD]))
    return spark.createDataFrame(rows, ENVELOPE)


def test_compliance_timeline_equals_a_plain_fold(spark):
    rnd = random.Random(4)
    events = []
    for _ in range(900):
        app, kind = rnd.randrange(40), rnd.choice(["ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed", "ComplianceRulePassed", "Other"])
        rules = [f"r{i}" for i in range(rnd.randrange(4))]
        events.append((app, kind, {"mandatory": rules} if kind == "ComplianceCheckRequested" else {"rule_id": rnd.choice(["r0", "r1", "r2", "r9", "", None])}))
    state, expected = {}, []
    for i, (app, kind, p) in enumerate(events):
        if not kind.startswith("Compliance"):
            continue
        s = state.setdefault(app, {"m": set(), "p": set(), "f": set()})
        if kind == "ComplianceCheckRequested":
            s["m"], s["p"], s["f"] = set(p["mandatory"]), set(), set()
        elif p["rule_id"]:
            (s["p"] if kind.endswith("Passed") else s["f"]).add(p["rule_id"])
            (s["f"] if kind.endswith("Passed") else s["p"]).discard(p["rule_id"])
        status = "FAILED" if s["f"] else "CLEARED" if s["m"] and s["m"] <= s["p"] else "PENDING" if s["m"] else "NOT_STARTED"
        expected.append((app, i + 1, status))
    got = projections.compliance_timeline(log(spark, events)).select("application_id", "global_position", "status").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_as_of_takes_the_latest_row_not_after(spark):
    timeline = log(spark, [(1, "ComplianceCheckRequested", {"mandatory": ["a", "b"]}), (1, "ComplianceRulePassed", {"rule_id": "a"}), (1, "ComplianceRulePassed", {"rule_id": "b"})])
    states = projections.compliance_timeline(timeline)
    moments = spark.createDataFrame([(1, T0 - timedelta(hours=1)), (1, T0 + timedelta(hours=1)), (1, T0 + timedelta(hours=9)), (2, T0)], "application_id long, as_of timestamp_ntz")
    got = {(r.application_id, r.as_of): r.status for r in projections.as_of(states, moments).collect()}
    assert got == {(1, T0 - timedelta(hours=1)): None, (1, T0 + timedelta(hours=1)): "PENDING", (1, T0 + timedelta(hours=9)): "CLEARED", (2, T0): None}


def test_null_confidence_is_no_sample(spark):
    rows = log(spark, [(1, "CreditAnalysisCompleted", {"agent_id": "a", "model_version": "m"}), (1, "CreditAnalysisCompleted", {"agent_id": "a", "model_version": "m", "confidence": 1.7})])
    (r,) = projections.agent_performance(rows).collect()
    assert (r.analyses_completed, r.confidence_samples, r.avg_confidence) == (2, 0, 0.0)


def test_empty_log(spark):
    empty = log(spark, [])
    for frame in (projections.application_summary(empty), projections.compliance_timeline(empty), projections.client_analytics(empty), lifecycle.loan_lifecycle(empty)):
        assert frame.count() == 0
    assert analytics.kpi_summary(empty, T0, 7).first().submitted == 0
    assert analytics.approval_trend(empty, T0, 7).count() == 7
    with pytest.raises(ValueError):
        analytics.kpi_summary(empty, T0, 14)


def test_lifecycle_names_the_first_violation(spark):
    rows = log(spark, [(1, "ApplicationSubmitted", {"requested_amount": 5.0}), (1, "ApplicationApproved", {}), (1, "ApplicationSubmitted", {"requested_amount": 5.0}), (2, "ApplicationSubmitted", {"requested_amount": 0.0})])
    got = {r.application_id: (r.end_state, r.error_position) for r in lifecycle.loan_lifecycle(rows).collect()}
    assert got == {1: ("SUBMITTED", 2), 2: ("EMPTY", 4)}


def test_upcast_registry_rejects_duplicates():
    registry = upcast.Upcasters()
    registry.register("A", 1, 2)(lambda: F.col("payload"))
    with pytest.raises(ValueError):
        registry.register("A", 1, 3)
    with pytest.raises(ValueError):
        registry.register("A", 2, 2)


def test_causal_descendants_survive_a_cycle(spark):
    rows = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None)], "event_id string, causation_id string")
    got = {(r.event_id, r.depth) for r in causal.descendants(rows, spark.createDataFrame([("a",)], "root_id string"), rounds=8).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_causal_descendants_of_long_chains(spark):
    rows = spark.createDataFrame([(f"e{i}", f"e{i - 1}" if i else None) for i in range(61)], "event_id string, causation_id string")
    root = spark.createDataFrame([("e0",)], "root_id string")
    assert {(r.event_id, r.depth) for r in causal.descendants(rows, root).collect()} == {(f"e{i}", i) for i in range(1, 61)}
    assert causal.descendants(rows.limit(9), root, rounds=8).count() == 8
    with pytest.raises(RuntimeError):
        causal.descendants(rows, root, rounds=8)


def test_a_long_chain_takes_few_turns(spark):
    n, turns = 10_000, []
    rows = spark.range(n).select(F.concat(F.lit("e"), "id").alias("event_id"), F.when(F.col("id") > 0, F.concat(F.lit("e"), F.col("id") - 1)).alias("causation_id"))
    found = causal.descendants(rows, spark.createDataFrame([("e0",), ("e9000",)], "root_id string"), turns=turns)
    assert found.filter("root_id = 'e0'").count() == n - 1 and found.filter("root_id = 'e9000'").count() == 999
    assert found.filter("root_id = 'e0' and event_id = 'e9999'").first().depth == 9999 and len(turns) < 20


def test_a_cycle_and_two_causes_of_one_event(spark):
    links = [("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "d"), ("x", None), ("y", "gone")]
    rows = spark.createDataFrame(links, "event_id string, causation_id string")
    found = causal.descendants(rows, spark.createDataFrame([("a",), ("x",)], "root_id string")).collect()
    assert sorted((r.root_id, r.event_id, r.depth) for r in found) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "e", 2)]


def test_what_if_keeps_independent_events_of_other_streams(spark):
    # (position, event, cause, stream, its position, type): the branch is b, of stream s.
    log = [(1, "a", None, "s", 1, "ApplicationSubmitted"), (2, "b", "a", "s", 2, "DecisionGenerated"), (3, "c", "b", "t", 1, "ApplicationDeclined"), (4, "d", None, "s", 3, "HumanReviewCompleted"),
           (5, "e", "d", "u", 1, "ApplicationDeclined"), (6, "f", "a", "v", 1, "ApplicationApproved"), (7, "g", "c", "t", 2, "ApplicationDeclined"), (8, "h", "x", "w", 1, "AgentNoted")]
    rows = [(k, 10 * k + p, f"{k}{e}", c and f"{k}{c}", f"{k}{s}", n, t) for k in (1, 2) for p, e, c, s, n, t in log if k == 1 or e != "f"]
    frame = spark.createDataFrame(rows, "application_id long, global_position long, event_id string, causation_id string, stream_id string, stream_position long, event_type string")
    assert {(r.application_id, r.global_position, r.is_branch) for r in causal.divergence(frame, "DecisionGenerated").collect()} == {(k, 10 * k + p, p == 2) for k in (1, 2) for p in (2, 3, 4, 5, 7)}
    got = {r.application_id: (r.real_outcome, r.counterfactual_outcome, r.events_undone) for r in causal.what_if(frame, "DecisionGenerated", "DECLINE").collect()}
    assert got == {1: ("FINAL_DECLINED", "FINAL_APPROVED", 5), 2: ("FINAL_DECLINED", "FINAL_DECLINED", 5)}


def test_context_after_a_crash(spark):
    rows = [("s", i + 1, k, k == "ERROR") for i, k in enumerate(["AgentContextLoaded", "CreditAnalysisRequested", "ERROR", "CreditAnalysisCompleted", "DecisionGenerated"])]
    frame = spark.createDataFrame(rows, "stream_id string, stream_position long, event_type string, flagged boolean")
    assert {r.work_type for r in context.pending_work(frame).collect()} == {"PENDING_OR_ERROR_STATE", "DECISION_NOT_FINALIZED"}
    assert context.session_health(frame, "AgentContextLoaded").first().health == "NEEDS_RECONCILIATION"


def test_outbox_dies_at_its_last_attempt(spark):
    box = spark.createDataFrame([(1, "t", "pending", 0, T0, T0, None, None), (2, "t", "pending", 1, T0, T0, None, None)], "outbox_id long, topic string, status string, attempts int, next_attempt_at timestamp_ntz, created_at timestamp_ntz, published_at timestamp_ntz, last_error string")
    taken = outbox.claim(box, "2025-01-02 00:00:00")
    done = outbox.settle(taken, spark.createDataFrame([(1, "x" * 2000), (2, "down")], "outbox_id long, error string"), "2025-01-02 00:00:00", max_attempts=2)
    got = {r.outbox_id: r for r in outbox.applied(box, done).collect()}
    assert got[1].status == "pending" and got[2].status == "dead_letter" and len(got[1].last_error) == 1000
    assert outbox.delivery_summary(outbox.applied(box, done), "2025-01-02 00:00:00").first().health == "dead_letter"


def events(spark, stream, n, tag):
    return spark.createDataFrame([(f"{tag}{i}", stream, i, "E", 1, "{}", "{}", T0) for i in range(n)], "event_id string, stream_id string, seq int, event_type string, event_version int, payload string, metadata string, recorded_at timestamp_ntz")


def test_event_log_has_one_winner(spark, tmp_path):
    store = EventLog(spark, str(tmp_path / "log"))
    expect = lambda v: spark.createDataFrame([("s", v)], "stream_id string, expected_version long")
    store.append(events(spark, "s", 3, "a"), expect(-1))

    def race(tag):
        try:
            EventLog(spark, str(tmp_path / "log")).append(events(spark, "s", 1, tag), expect(3))
            return "won"
        except ConcurrencyError:
            return "lost"

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(race, "bc")) == ["lost", "won"]
    assert [r.stream_position for r in store.stream("s").collect()] == [1, 2, 3, 4]
    assert store.version("s") == 4 and store.version("none") == 0
    assert store.after(2).count() == 2
    store.archive("s", "done")
    with pytest.raises(StreamArchived):
        store.append(events(spark, "s", 1, "d"), expect(4))


def test_stream_equals_batch_and_quarantines(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", "bad" if i == 5 else "ok", i + 1, T0) for i in range(30)], "stream_id string, event_type string, global_position long, recorded_at timestamp_ntz")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    view = views.View(spark, str(tmp_path / "view"), views.COUNTERS)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    valid = F.col("event_type") != "bad"
    views.keep_up(stream, view, views.counters, views.added, str(tmp_path / "cp"), valid, str(tmp_path / "q")).awaitTermination()
    assert sorted(map(tuple, view.read().collect())) == sorted(map(tuple, views.counters(rows.filter(valid)).collect()))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    views.keep_up(stream, view, views.counters, views.added, str(tmp_path / "cp"), valid, str(tmp_path / "q")).awaitTermination()
    assert view.read().agg(F.sum("n")).first()[0] == 29
    old = view.read()
    views.rebuild(view, rows.filter(valid), views.counters, "fresh", 30)
    assert view.pointer()["version"] == "fresh" and old.count() == view.read().count()


def test_refinery_facts_and_search(spark):
    text = "1 Results\nTotal Revenue: 1,250,000\nNet Income: $210,000\nEBITDA 300.5"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    chunked = rf.chunks(docs)
    assert chunked.count() == 1
    assert {r.metric_name: r.metric_value for r in rf.facts(chunked).collect()} == {"total_revenue": 1250000.0, "net_income": 210000.0, "ebitda": 300.5}
    assert rf.triage(docs).filter("doc_id = 1").first().domain == "financial"
    assert rf.search(chunked, "net revenue").count() == 1
