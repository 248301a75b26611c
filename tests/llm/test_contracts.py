"""The registered queries of trained operators against plain versions, and hard cases of the pipeline's stages."""

import collections
import math
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from tallyfold.llm import language, ngrams, queries, toxicity
from tallyfold.llm.arrays import utf8


def words(text):
    out, word = [], []
    for c in (text or ""):
        if c in " \t\n\v\f\r":
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c)
    return out + (["".join(word)] if word else [])


def plain_scores(rows):
    """Interpolated bigram scores, weights by leave-one-out likelihood of each class of contexts."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = {k: [*words(lower(t)), None] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    one, two, begins = collections.Counter(), collections.Counter(), 0
    for k, tokens in texts.items():
        if not held[k]:
            begins += 1
            one.update(tokens)
            two.update(zip(["<begin>", *tokens], tokens))
    total, distinct = sum(one.values()), len(one)
    floor = 1 / (total + 0.1 * (distinct + 1))
    of = lambda v: begins if v == "<begin>" else one[v]
    mix = lambda low, both, context, m: (both + m * low) / (context + m) if context > 0 else low
    group = lambda n: sum(n >= c for c in ngrams.CONTEXT_CLASSES)
    gain = collections.defaultdict(float)
    for k, tokens in texts.items():
        for v, w in zip(["<begin>", *tokens], tokens):
            if not held[k]:
                for i, m in enumerate(ngrams.WEIGHTS):
                    gain[group(of(v)), i] += math.log10(mix((max(one[w] - 1, 0) + 0.1) * floor, max(two[v, w] - 1, 0), of(v) - 1, m))
    best = {g: max(range(len(ngrams.WEIGHTS)), key=lambda i: (gain[g, i], -i)) for g in range(len(ngrams.CONTEXT_CLASSES) + 1)}
    return {k: sum(math.log10(mix((one[w] + 0.1) * floor, min(two[v, w], of(v)), of(v), ngrams.WEIGHTS[best[group(of(v))]])) for v, w in zip(["<begin>", *tokens], tokens)) for k, tokens in texts.items()}


def test_op3_scores_equal_a_plain_model(spark):
    rows = [(i, " ".join(f"W{(i * j * j + j) % 17}" for j in range(i % 13))) for i in range(40)] + [(40, None), (41, "only here"), (42, "w1 w2 " * 40)]
    got = {r.doc_id: r.score for r in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in got)


def test_op3_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b"), (2, "")]
    got = ngrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 4), (1, 4), (2, 1)]


def test_op6_query_equals_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net, cuts = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, SF).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows[:40]:
        features, _ = toxicity.word_features(*utf8(pa.array([r.text or ""])))
        e = [sum(net.parts["embedding"][f] for f in word) for word in features]
        pooled = []
        for w in toxicity.WIDTHS:
            best = np.zeros(toxicity.FILTERS) if not e else np.full(toxicity.FILTERS, -np.inf)
            for at in range(len(e)):
                best = np.maximum(best, sum(e[at + k] @ net.parts[f"filter{w}"][k] for k in range(w) if at + k < len(e)))
            pooled.append(best)
        logits = np.maximum(np.concatenate(pooled), 0) @ net.parts["linear"] + net.parts["bias"]
        p = 1 / (1 + math.exp(logits[0] - logits[1]))
        x = got[r.doc_id]
        assert abs(x.score - p) < 1e-3 and x.predicted == int(x.score >= 0.5) and x.flagged == (x.score >= cuts.get(r.lang, cuts[None]))
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_of_odd_labels(spark):
    docs = spark.createDataFrame([(1, "", 7, "x"), (2, None, 8, "y"), (3, "word " * 2_000, 9, "z"), (3, "again", 9, "z")], "doc_id long, text string, label long, k string")
    labels = spark.createDataFrame([(i, t) for i in (1, 2, 3) for t in (0, 1, None)], "doc_id long, toxic int")
    net, cuts = toxicity.fit(docs, labels)
    out = toxicity.score(docs, net, cuts)
    assert out.columns[:4] == docs.columns and out.count() == 4
    assert toxicity.score(docs.limit(0), *toxicity.fit(docs.limit(0), labels)).count() == 0


def test_op8_query_equals_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, net = language.fit(docs)
    got = {r.doc_id: r for r in queries.op8_language(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[:15]:
        raw = (r.text or "").encode()
        total = np.zeros(len(names))
        parts = [raw[i : i + language.WINDOW].ljust(language.WINDOW, b"\0") for i in range(0, len(raw), language.WINDOW)]
        for part in parts:
            e = net.parts["embedding"][list(part)]
            pooled = np.concatenate([np.max([sum(e[at + k] @ net.parts[f"filter{w}"][k] for k in range(w)) for at in range(language.WINDOW - w + 1)], 0) for w in language.WIDTHS])
            logits = np.maximum(pooled, 0) @ net.parts["linear"] + net.parts["bias"]
            total += np.log(np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum() + 1e-6)
        q = np.exp(total / max(1, len(parts)) - (total / max(1, len(parts))).max())
        x = got[r.doc_id]
        if any(map(str.isalpha, r.text or "")):
            assert x.lang_pred == names[int(q.argmax())] and abs(x.score - q.max() / q.sum()) < 1e-2
        else:
            assert (x.lang_pred, x.score) == ("und", 0.0)


def test_number_characters_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ 12"), (3, "a²"), (3, "a²"), (4, None), (5, "")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'x' as key", "1 as score")
    names, net = language.fit(docs)
    got = sorted((r.doc_id, r.lang_pred) for r in language.predict(docs, names, net).collect())
    assert got == [(1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "und"), (5, "und")]


HARD = [(1, "clean words in a row", "en", "s"), (1, "clean words in a row", "en", "s"), (2, None, None, None), (None, "", "en", "s"), (3, "password: abcdef123456 and more", "en", "s"), (None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows_and_none(spark, stage):
    docs = spark.createDataFrame(HARD, SCHEMA).selectExpr("*", "cast(length(text) as long) as n_chars", "1 as blob__", "'t' as spans__", "2 as row", "3 as id", "4 as lead__", "5 as tie__")
    run = dict(corpus_pipeline.STAGES)[stage]
    kept = run(spark, docs, SF).collect()
    assert run(spark, docs.limit(0), SF).count() == 0
    if stage == "packing":
        assert sum(r.length for r in kept) >= len(HARD)
        return
    texts = [r.text or "" for r in kept]
    if stage in ("toxicity", "substrings", "secrets"):
        assert len(kept) == len(HARD)
    if stage == "jaccard":
        assert 4 <= len(kept) <= 5 and sum(t.startswith("clean") for t in texts) == 1
    if stage == "secrets":
        assert not any("abcdef123456" in t for t in texts) and sum(t.startswith("clean") for t in texts) == 2
    else:
        assert any("password" in t for t in texts)


def test_top_k_over_many_shards_with_copies_lengths_and_repeated_ids(spark):
    import numpy as np

    from tallyfold.llm import kdtree

    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-8, 9, 6) / 4], "a") for i in range(900)]
    rows += [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 2.0], "copy") for i in range(900, 1400)]
    rows += [(i, [float(x) for x in draw.integers(-8, 9, 3) / 4], "b") for i in range(1400, 1500)]
    rows += [(50, [2.0] * 6, "again"), (7, None, "c"), (8, [None] * 6, "d"), (None, [1.0] * 6, "e"), (9, [float("nan")] * 6, "f")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string").repartition(7)
    got = kdtree.top_k(frame, frame.filter("vec_id % 50 = 0"), shard_rows=64).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    for query in range(0, 1500, 50):
        if query == 50:
            continue  # two vectors of one id are two queries under one name
        vector = next(v for i, v in whole if i == query)
        scores = sorted((-int(v @ vector), i) for i, v in whole if i != query and len(v) == len(vector))[:5]
        assert found[query] == [(-s, i) for s, i in scores]


def test_top_k_refuses_scores_beyond_64_bits(spark):
    import pytest

    from tallyfold.llm import kdtree

    frame = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        kdtree.top_k(frame, frame).collect()
