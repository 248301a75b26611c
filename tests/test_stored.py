import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyfold.operators import projections as pj
from tallyfold.operators import stored
from tallyfold.sources.dossier import dossier_log


@pytest.fixture(scope="module")
def timeline(spark):
    log = dossier_log(spark, SF).filter("application_id <= 200")
    return stored.intervals(pj.compliance_timeline(log)).cache()


def test_one_interval_holds_each_moment(spark, timeline):
    ends = timeline.groupBy("application_id").agg(F.count_if(F.col("valid_to").isNull()).alias("n"))
    assert ends.filter("n <> 1").count() == 0
    moments = timeline.select("application_id", F.col("recorded_at").alias("as_of")).distinct()
    got = stored.as_of(timeline, moments).select("application_id", "as_of", "global_position", "status")
    want = pj.as_of(timeline.drop("valid_from", "valid_to"), moments).select("application_id", "as_of", "global_position", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_point_reads_open_one_file(spark, timeline, tmp_path):
    stored.write(timeline, str(tmp_path / "view"), "application_id", ("valid_from",), buckets=8)
    view = stored.Stored(spark, str(tmp_path / "view"))
    for key in (1, 8, 100):
        own = timeline.filter(F.col("application_id") == key)
        assert sorted(map(tuple, view.read(key).collect())) == sorted(map(tuple, own.select(view.schema.names).collect()))
        assert len(view.read(key).inputFiles()) == 1
        last = own.orderBy(F.desc("global_position")).first()
        assert view.now(key).first().global_position == last.global_position
        moment = own.orderBy("global_position").collect()[1].recorded_at
        want = own.filter(F.col("recorded_at") <= F.lit(moment)).orderBy(F.desc("recorded_at"), F.desc("global_position")).first()
        assert view.at(key, str(moment)).first().global_position == want.global_position
        assert view.at(key, "1900-01-01").count() == 0
    plan = view.read(8)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(application_id,8)" in plan and "bucket=" in plan
    assert view.read(123456).count() == 0
    assert view.all().count() == timeline.count()


def test_rows_at_one_moment(spark):
    rows = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 20, 3, "c"), (2, 5, 1, "d")], "application_id int, at long, global_position long, status string")
    timed = rows.withColumn("recorded_at", F.timestamp_seconds("at"))
    moments = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, 99), (2, 5), (3, 5)], "application_id int, m long").withColumn("as_of", F.timestamp_seconds("m"))
    got = stored.as_of(stored.intervals(timed), moments).select("application_id", F.unix_seconds("as_of").alias("m"), "status").collect()
    assert sorted(map(tuple, got)) == [(1, 10, "b"), (1, 19, "b"), (1, 20, "c"), (1, 99, "c"), (2, 5, "d")]
    assert stored.as_of(stored.intervals(timed.limit(0)), moments).count() == 0
