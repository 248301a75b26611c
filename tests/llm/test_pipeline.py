import collections

import corpus_pipeline
from conftest import SF


def test_stages_in_order_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
            counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "substrings", "secrets", "packing"]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4]
    tokens = collections.Counter()
    for r in docs.collect():
        tokens[r.doc_id] += r.length
    assert len(tokens) == counts[-1]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
