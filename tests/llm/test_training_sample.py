from pyspark.sql import functions as F

from tallyfold.llm import convolution, toxicity


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in sorted({i for i, _ in texts})], "doc_id long, quality int, toxic int")
    return docs, labels


def taken(docs, labels, **more):
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 6000, **more).collect()
    return sorted((r.k, r.text) for r in rows)


def keys(spark, n):
    """Keys of the training folds in the order in which they are tried."""
    return [r.id for r in spark.range(n).filter("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.expr("crc32(cast(cast(id as string) as binary))")).collect()]


def test_a_text_that_does_not_fit_is_passed_over(spark):
    first, second, third, *_ = keys(spark, 30)
    docs, labels = tables(spark, [(first, "x" * 500), (second, "y" * 60), (third, "é" * 30), (third + 1000, None)])
    assert [k for k, _ in taken(docs, labels, most=100)] != []
    got = dict(taken(docs, labels, most=100))
    assert first not in got and got[second] == "y" * 60 and third not in got  # 60 + 60 bytes are more than 100
    assert set(dict(taken(docs, labels, most=120))) >= {second, third}
    assert first in dict(taken(docs, labels))


def test_a_repeated_key_gives_one_text(spark):
    first, second, *_ = keys(spark, 30)
    docs, labels = tables(spark, [(first, "long " * 200)] * 50 + [(first, "short")] * 50 + [(second, "other")])
    assert taken(docs, labels) == sorted([(first, "short"), (second, "other")])


def test_the_task_skips_and_goes_on(spark):
    sample = spark.createDataFrame([(1, b"a" * 500), (2, b"b" * 40), (3, b"c" * 80), (4, b"d" * 60), (5, None)], "n int, data binary")
    assert convolution.trained(sample, ["n"], lambda rows: [r["n"] for r in rows], "data", most=100) == [2, 4, 5]
    assert convolution.trained(sample.limit(0), ["n"], len, "data") == 0


def test_a_long_text_first_does_not_empty_the_sample(spark):
    ids = keys(spark, 400)
    words = {0: "kind calm meadow", 1: "vile rotten scum"}
    docs, labels = tables(spark, [(ids[0], "padding " * 50000), *((i, f"{words[i % 2]} {words[i % 2]}") for i in ids[1:])])
    chosen = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 6000, most=100_000)
    assert chosen.count() == len(ids) - 1


def test_toxicity_trains_on_every_labelled_row(spark):
    """At most 6,000 rows and 64 MB were taken before, in one task."""
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('word', id % 7, if(id % 3 = 0, ' vile', ' kind'), ' end') as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic")
    want = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "toxic")
    assert want > 6000 and rows.count() == want
    few = docs.limit(1200)
    nets = [toxicity.fit(few, labels, task_rows=300) for _ in range(2)]
    assert all((nets[0][0].parts[k] == nets[1][0].parts[k]).all() for k in nets[0][0].parts) and nets[0][1] == nets[1][1]
    scored = toxicity.score(docs, *nets[0])
    assert scored.filter("toxic_predicted <> int(doc_id % 3 = 0)").count() == 0


def test_thresholds_part_by_counts():
    counts = [("en", 100, 50, 0), ("en", 400, 5, 1), ("en", 800, 0, 30), (None, 900, 1, 0), ("fr", 700, 0, 3)]
    cuts = toxicity.thresholds(counts)
    assert set(cuts) == {None, "en"} and 0.4 < cuts["en"] < 0.8
