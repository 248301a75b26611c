import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyfold.streaming import relay

T0 = 1_704_067_200
PUBLISHER = '''
import os

SENT = {sent!r}

class Flaky:
    """Messages that divide by 10 never pass, those that divide by 3 pass at their second attempt."""

    def publish(self, message):
        n = message["outbox_id"]
        if n % 10 == 0 or n % 3 == 0 and message["attempts"] == 1:
            raise RuntimeError("refused " + "x" * 2000 if n % 10 == 0 else "")
        with open(os.path.join(SENT, f"{{n}}-{{message['attempts']}}-{{os.urandom(4).hex()}}"), "w"):
            pass
'''


def rows(spark, ids, kind, at, attempt=0, error=None):
    return spark.createDataFrame([(i, kind, attempt, error) for i in ids], "outbox_id long, kind string, attempt int, error string").withColumn("at", F.timestamp_seconds(F.lit(T0 + at)))


def append(frame, folder):
    frame.coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, **more):
    stream = spark.readStream.schema(relay.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    relay.start(relay.deliveries(stream, **more), folder).awaitTermination()
    return {r.outbox_id: (r.status, r.attempts, r.last_error) for r in relay.states(relay.changes_of(spark, folder)).collect()}


def test_lease_retry_and_dead_letter(spark, tmp_path):
    folder = str(tmp_path)
    append(rows(spark, [1, 2, 3], "message", 1), f"{folder}/log")
    assert drain(spark, folder, max_attempts=2) == {1: ("pending", 1, None), 2: ("pending", 1, None), 3: ("pending", 1, None)}
    append(rows(spark, [1], "outcome", 2, 1).unionByName(rows(spark, [2], "outcome", 2, 1, " down ")).unionByName(rows(spark, [9], "outcome", 2, 1)), f"{folder}/log")
    assert drain(spark, folder, max_attempts=2) == {1: ("published", 1, None), 2: ("pending", 1, "down"), 3: ("pending", 1, None)}
    # Time passes: the pause of 2 and the lease of 3 end.
    for at in (50, 51):
        append(rows(spark, [-1], "tick", at), f"{folder}/log")
    got = drain(spark, folder, max_attempts=2)
    assert got[2][:2] == ("pending", 2) and got[3][:2] == ("pending", 2)
    # Late outcomes of a first attempt say nothing any more; messages told again are the same.
    append(rows(spark, [3], "outcome", 52, 1).unionByName(rows(spark, [1, 2], "message", 52)).unionByName(rows(spark, [1], "outcome", 52, 1, "again")), f"{folder}/log")
    append(rows(spark, [2], "outcome", 53, 2, "x" * 3000), f"{folder}/log")
    got = drain(spark, folder, max_attempts=2)
    assert got[1] == ("published", 1, None) and got[3][:2] == ("pending", 2)
    assert got[2][:2] == ("dead_letter", 2) and len(got[2][2]) == 1000 and got[2][2].endswith("...")


@pytest.mark.parametrize("attempts,want", [(1, 500), (2, 1000), (5, 8000), (8, 60_000), (80, 60_000)])
def test_pauses_double_up_to_a_cap(attempts, want):
    assert relay.pause_ms(attempts) == want


@pytest.fixture
def publisher(tmp_path, monkeypatch, spark):
    sent = tmp_path / "sent"
    sent.mkdir()
    name = f"publisher_{uuid.uuid4().hex}"
    (tmp_path / f"{name}.py").write_text(PUBLISHER.format(sent=str(sent)))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    return sent, f"{name}:Flaky"


def deliver(spark, folder, publisher):
    claims = spark.readStream.schema(f"{relay.CHANGES}, batch long, kind string").option("basePath", f"{folder}/changes").parquet(f"{folder}/changes/*/kind=claim")
    relay.publish(claims.select("outbox_id", "attempts", "at_ms"), publisher, folder, f"{folder}/sink").awaitTermination()


def outcomes(spark, folder):
    return spark.read.schema(relay.OUTCOMES).parquet(f"{folder}/outcomes")


def test_messages_pass_through_the_sink(spark, tmp_path, publisher):
    folder = str(tmp_path / "relay")
    append(rows(spark, range(1, 31), "message", 1), f"{folder}/log")
    drain(spark, folder, max_attempts=2)
    for turn, at in enumerate((60, 120)):
        deliver(spark, folder, publisher[1])
        got = outcomes(spark, folder).filter(F.col("attempt") == turn + 1)
        append(got.select("outbox_id", F.lit("outcome").alias("kind"), "attempt", "error", F.timestamp_seconds(F.lit(T0 + at - 50)).alias("at")), f"{folder}/log")
        for tick in (at, at + 1):
            append(rows(spark, [-1], "tick", tick), f"{folder}/log")
        state = drain(spark, folder, max_attempts=2)
    want = {i: "dead_letter" if i % 10 == 0 else "published" for i in range(1, 31)}
    assert {i: s for i, (s, _, _) in state.items()} == want
    assert {i: a for i, (_, a, _) in state.items()} == {i: 2 if i % 10 == 0 or i % 3 == 0 else 1 for i in range(1, 31)}
    assert state[10][2].startswith("refused") and len(state[10][2]) == 1000 and not os.listdir(f"{folder}/staged")
    assert sorted({int(f.split("-")[0]) for f in os.listdir(publisher[0])}) == [i for i in range(1, 31) if i % 10]


def test_a_run_that_dies_before_its_commit_delivers_again(spark, tmp_path, publisher):
    folder = str(tmp_path / "relay")
    append(rows(spark, [1, 2, 4], "message", 1), f"{folder}/log")
    drain(spark, folder)
    writer = relay.OutboxWriter(publisher[1], folder)
    claims = [r for r in relay.changes_of(spark, folder).filter("kind = 'claim'").collect()]
    staged = writer.write(iter(claims))  # published, and then the run dies: nothing is committed
    assert staged.rows == 3 and not os.path.exists(f"{folder}/outcomes")
    deliver(spark, folder, publisher[1])
    sent = [int(f.split("-")[0]) for f in os.listdir(publisher[0])]
    assert sorted(sent) == [1, 1, 2, 2, 4, 4] and sorted(set(sent)) == [1, 2, 4]
    assert sorted(r.outbox_id for r in outcomes(spark, folder).collect()) == [1, 2, 4]
    writer.abort([staged, None], 0)
    assert os.listdir(f"{folder}/staged") == []


def test_states_are_those_of_buckets(spark, tmp_path):
    """A state and a timer a message made each batch call Python once a message."""
    folder = str(tmp_path)
    append(rows(spark, range(200), "message", 1), f"{folder}/log")
    late = rows(spark, range(0, 200, 2), "outcome", 3, 1, "late").unionByName(rows(spark, range(200), "outcome", 2, 1)).unionByName(rows(spark, [500], "outcome", 4, 1))
    append(late.unionByName(rows(spark, [500], "message", 3)), f"{folder}/log")
    stream = spark.readStream.schema(relay.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    query = relay.start(relay.deliveries(stream, buckets=4), folder)
    query.awaitTermination()
    assert {r.status for r in relay.states(relay.changes_of(spark, folder)).collect()} == {"published"}
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4
