import json

import pytest

from tallyfold.operators import lineage, scans

SCHEMA = "stream_id string, stream_position long, global_position long, event_type string, event_version int, recorded_at timestamp, payload string, metadata string"


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for i in range(1, 21):
        kind = "CreditAnalysisCompleted" if i % 4 == 0 else "Other"
        rows.append(("a" if i % 2 else "b", (i + 1) // 2, i, kind, 1, None, '{"agent_id":"x"}', None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def positions(frame, column="global_position"):
    return [r[column] for r in frame.collect()]


def test_bounds_and_limits_of_a_stream(log):
    assert positions(scans.stream(log, "a"), "stream_position") == list(range(1, 11))
    assert positions(scans.stream(log, "a", 3, 7), "stream_position") == [3, 4, 5, 6, 7]
    assert positions(scans.stream(log, "a", 3, 7, 2), "stream_position") == [3, 4]
    assert positions(scans.stream(log, "none")) == [] and positions(scans.stream(log, "a", 11)) == []
    for bad in ((0,), (3, 2), (1, None, 0)):
        with pytest.raises(ValueError):
            scans.stream(log, "a", *bad)


def test_scans_give_latest_versions(log):
    rows = scans.after(log, 3, ["CreditAnalysisCompleted"], 2).collect()
    assert [(r.global_position, r.event_version) for r in rows] == [(4, 2), (8, 2)]
    assert json.loads(rows[0].payload)["model_version"] == "legacy-unknown" and "upcast_notes" in rows[0].metadata
    assert log.filter("event_version = 2").count() == 0
    assert {r.event_version for r in scans.stream(log, "a").collect()} == {1}
    for bad in ((-1,), (0, None, 0)):
        with pytest.raises(ValueError):
            scans.after(log, *bad)


def test_batches_follow_each_other(log):
    got = [positions(b) for b in scans.batches(log, 6, 2)]
    assert got == [[3, 4, 5, 6, 7, 8], [9, 10, 11, 12, 13, 14], [15, 16, 17, 18, 19, 20]]
    assert [positions(b) for b in scans.batches(log, 2, 0, ["CreditAnalysisCompleted"])] == [[4, 8], [12, 16], [20]]
    assert list(scans.batches(log, 5, 20)) == []
    with pytest.raises(ValueError):
        next(scans.batches(log, 0))


def test_actors_lanes_and_tones(spark):
    cases = [
        ("DocumentUploaded", '{"uploaded_by":"u"}', None, "u", "Document Intake", "Operational event", "Intake", "neutral"),
        ("DocumentAdded", None, None, "Ledger Control", "Ledger", "Operational event", "Intake", "neutral"),
        ("AgentSessionRecovered", '{"agent_id":" "}', None, "Agent Session", "Agent Session", "Operational event", "Analysis", "neutral"),
        ("FraudScreeningRequested", '{"assigned_agent_id":"f"}', None, "f", "FraudDetection", "Operational event", "Analysis", "info"),
        ("ComplianceRuleFailed", '{"agent_id":"x"}', None, "ComplianceAgent", "ComplianceAgent", "Regulatory evidence", "Compliance", "critical"),
        ("HumanReviewRequested", "{}", '{"actor_id":"me"}', "me", "DecisionOrchestrator", "Awaiting binding review", "Decision", "warning"),
        ("HumanReviewCompleted", '{"reviewer_id":"r"}', "{}", "r", "Human Review", "Binding review", "Final Outcome", "warning"),
        ("ApplicationApproved", "{}", None, "Loan Officer", "Final Decision", "Final disposition", "Final Outcome", "ok"),
        ("AuditIntegrityCheckRun", None, None, "Compliance Service", "Integrity", "Hash-chain attestation", "Final Outcome", "neutral"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "event_type string, payload string, metadata string")
    got = {r.event_type: (r.actor, r.lane, r.checkpoint, r.phase, r.tone) for r in lineage.annotated(rows).collect()}
    assert got == {c[0]: c[3:] for c in cases}
