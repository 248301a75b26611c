import json

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import json as js
from tallyfold.functions import payloads
from tallyfold.operators import refusals

MODEL = {"T": "s str, f float? >0, r float? 0..1, i int? >=0, b bool~, l list~, d dict~, df dict[float]~, ds dict[str]~, at time?"}


def errors(spark, rows, models=MODEL):
    """{row: [loc:code]} of (type, payload) rows."""
    frame = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows)], "i int, kind string, payload string")
    return {r.i: [f"{e.loc}:{e.code}" for e in r.e] for r in frame.select("i", payloads.violations("kind", "payload", models).alias("e")).collect()}


def test_all_types_are_there():
    assert len(payloads.EVENTS) == 28 and len(payloads.COMMANDS) == 8
    for models in (payloads.EVENTS, payloads.COMMANDS):
        for text in models.values():
            names = [f["name"] for f in payloads.fields(text)]
            assert len(set(names)) == len(names)
    with pytest.raises(ValueError):
        payloads.fields("a text")


VALUES = [
    ({"s": "x"}, []), ({"s": ""}, []), ({}, ["s:missing"]), ({"s": None}, ["s:string_type"]), ({"s": 1}, ["s:string_type"]), ({"s": ["x"]}, ["s:string_type"]),
    ({"s": "x", "f": 1}, []), ({"s": "x", "f": "1.5"}, []), ({"s": "x", "f": True}, []), ({"s": "x", "f": None}, []), ({"s": "x", "f": 0}, ["f:greater_than"]), ({"s": "x", "f": "y"}, ["f:float_parsing"]),
    ({"s": "x", "f": {}}, ["f:float_type"]), ({"s": "x", "r": 1.0}, []), ({"s": "x", "r": 1.01}, ["r:less_than_equal"]), ({"s": "x", "r": -0.01}, ["r:greater_than_equal"]),
    ({"s": "x", "i": 2.0}, []), ({"s": "x", "i": 2.5}, ["i:int_from_float"]), ({"s": "x", "i": "3"}, []), ({"s": "x", "i": "3.5"}, ["i:int_parsing"]), ({"s": "x", "i": -1}, ["i:greater_than_equal"]),
    ({"s": "x", "i": [1]}, ["i:int_type"]), ({"s": "x", "b": "Yes"}, []), ({"s": "x", "b": 1}, []), ({"s": "x", "b": 2}, ["b:bool_parsing"]), ({"s": "x", "b": "maybe"}, ["b:bool_parsing"]),
    ({"s": "x", "b": None}, ["b:bool_type"]), ({"s": "x", "b": []}, ["b:bool_type"]), ({"s": "x", "l": ["a", 1, "b", None]}, ["l.1:string_type", "l.3:string_type"]), ({"s": "x", "l": []}, []),
    ({"s": "x", "l": "a"}, ["l:list_type"]), ({"s": "x", "d": {"a": [1, None]}}, []), ({"s": "x", "d": []}, ["d:dict_type"]), ({"s": "x", "df": {"a": 1, "b": "z"}}, ["df.b:float_parsing"]),
    ({"s": "x", "ds": {"a": "v", "b": 3}}, ["ds.b:string_type"]), ({"s": "x", "at": "2024-05-06T07:08:09"}, []), ({"s": "x", "at": "noon"}, ["at:datetime_from_date_parsing"]), ({"s": "x", "at": 5}, ["at:datetime_type"]),
    ({"z": 1, "s": 2, "a": 3, "f": -1}, ["s:string_type", "f:greater_than", "a:extra_forbidden", "z:extra_forbidden"]),
]


def test_values_of_each_kind(spark):
    got = errors(spark, [("T", json.dumps(v)) for v, _ in VALUES])
    assert [(VALUES[i][0], got[i]) for i in got] == [(v, e) for v, e in VALUES]


def test_texts_that_are_no_objects(spark):
    got = errors(spark, [("T", None), ("T", ""), ("T", "[1]"), ("T", "{"), ("T", "3"), ("U", "{}"), (None, "{}")])
    assert [got[i] for i in range(7)] == [[":model_type"]] * 5 + [["event_type:unknown_type"]] * 2


def test_examples_fit(spark):
    for models in (payloads.EVENTS, payloads.COMMANDS):
        rows = [(k, json.dumps(payloads.example(t))) for k, t in models.items()]
        assert set(map(tuple, errors(spark, rows, models).values())) == {()}


def test_roles(spark):
    rows = spark.createDataFrame([("admin", "run_integrity_check"), ("viewer", "run_integrity_check"), (None, "run_integrity_check"), ("admin", "other")], "role string, tool string")
    got = [r.ok for r in rows.select(js.permitted(F.col("role"), F.col("tool"), refusals.ROLES).alias("ok")).collect()]
    assert got == [True, False, False, False]


def test_the_first_error_of_a_call_holds(spark):
    check = lambda **more: json.dumps({"entity_type": "application", "entity_id": "1", "role": "admin"} | more)
    submit = json.dumps(payloads.example(payloads.COMMANDS["submit_application"]))
    rows = [
        (1, "nothing", "{}", 0, None), (2, None, None, 0, None), (3, "run_integrity_check", check(role=1), 0, "gone"), (4, "run_integrity_check", check(role="viewer"), 0, "gone"),
        (5, "run_integrity_check", check(), 1, "gone"), (6, "run_integrity_check", check(), 2, None), (7, "run_integrity_check", check(), 40, None), (8, "run_integrity_check", check(role="compliance"), 62, None),
        (9, "run_integrity_check", check(entity_id="2"), 40, None), (10, "submit_application", submit, 40, None), (11, "submit_application", submit, 41, "exists"),
    ]
    calls = spark.createDataFrame(rows, "global_position long, tool string, arguments string, at long, why string").withColumn("recorded_at", F.timestamp_seconds("at"))
    got = {r.global_position: (r.error_type, r.suggested_action) for r in refusals.judged(calls, F.col("why"), F.when(F.col("why") == "exists", "use_unique_application_id")).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "UnknownTool", 2: "UnknownTool", 3: "ValidationError", 4: "AuthorizationError", 5: "PreconditionFailed", 6: None, 7: "RateLimitExceeded", 8: None, 9: None, 10: None, 11: "PreconditionFailed",
    }
    assert got[11][1] == "use_unique_application_id" and got[5][1] == "review_preconditions_and_retry" and got[7][1] == "retry_after_cooldown" and got[6][1] is None
    assert refusals.judged(calls.limit(0), F.col("why")).count() == 0


def test_truth_of_texts(spark):
    rows = spark.createDataFrame([("true",), ("TRUE",), ("false",), ("1",), (None,)], "t string")
    assert [r.x for r in rows.select(js.truthy(F.col("t")).alias("x")).collect()] == [True, True, False, False, False]


def test_applications_that_wait(spark):
    from tallyfold.operators import feed

    rows = [(1, "DecisionGenerated"), (2, "DecisionGenerated"), (2, "ApplicationDeclined"), (3, "ApplicationSubmitted")]
    log = spark.createDataFrame(rows, "application_id int, event_type string")
    assert [r.application_id for r in feed.approvals_waiting(log).collect()] == [1]
