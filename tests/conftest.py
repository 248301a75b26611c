import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame_or_result, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in frame_or_result)


def same(spark, duck, name, queries, oracles):
    frame = queries[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(oracles[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [dict(zip(names, r)) for r in result.fetchall()]
    assert rows(frame.collect(), columns) == rows(theirs, columns)
