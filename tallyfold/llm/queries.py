"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, drake, jaccard, kdtree, language, multiprobe, ngrams, packing, secrets, substrings, toxicity, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), path, digests=True)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_table(spark, sf_dir, "documents"), digests=True)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_table(spark, sf_dir, "documents"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store(_table(spark, sf_dir, "documents"), with_media=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # The history arrives in two parts; the second is scanned against the ledger of the first.
    late = F.coalesce(_remainder("doc_id", 2) == 1, F.lit(False))
    ledger = secrets.incremental([docs.filter(~late), docs.filter(late)])
    return secrets.digest(secrets.findings(docs, ledger), "doc_id")


def _remainder(key: str, n: int) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net, cuts = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, cuts)
    return scored.select(
        "doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"), F.col("toxic_flagged").alias("flagged"),
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return kdtree.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    names, net = language.fit(docs)
    found = language.predict(docs, names, net)
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, with_ids=False)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return multiprobe.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"), least=100, cover=100, best=2000)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_byte_bpe, op2_substrings, op3_language_model, op4_webp, op5_secrets, op6_toxicity, op7_top_k,
        op8_language, op9_jaccard, op10_packing, op11_neighbours, op12_collocations, op13_centroids,
    )
    return {f.__name__: f for f in listed}
