import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tallyfold.llm import collocations

SCHEMA = "doc_id long, text string, lang string, piece string, n long"


def plain(rows, least, cover, best):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= cover * a and inside(p, q) for (m, q), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((g, i, p.decode(), -a, x, y, n[g], -s) for g, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:best], 1))


def mined(spark, rows, least, cover=100, best=2000, parts=3):
    table = spark.createDataFrame([(i, t, g, "p", 0) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(table, least, cover, best).collect())


def prose(n, seed):
    draw, ends = random.Random(seed), [". ", ", ", "\n", "! ", "\t", "  ", " ", "\r\n", "\x0b"]
    words = ["the", "The", "new", "york", "state", "of", "a", "é", "É", "naïve", "x-ray", "it's", " "]
    return [("".join(draw.choice(words) + (draw.choice(ends) if draw.random() < 0.3 else " ") for _ in range(draw.randrange(40))), draw.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("least,cover,best", [(2, 100, 2000), (5, 100, 2000), (3, 60, 2000), (3, 100, 7), (1, 100, 2000)])
def test_equals_plain_counts(spark, least, cover, best):
    rows = prose(60 if least > 1 else 12, least)
    assert mined(spark, rows, least, cover, best) == plain(rows, least, cover, best)


def test_irregular_texts(spark):
    rows = [(None, "en"), ("", "en"), ("one", None), (".,;:!?", "de"), (" \t ", "de"), ("a b a b a b a b", "en"), ("A B", None), ("a b" * 3000, "en"), ("c d. " * 500, "")]
    rows += [("same old line", "en")] * 40 + [("w" * 300000 + " tail", "en")] * 2
    assert mined(spark, rows, 2) == plain(rows, 2, 100, 2000)


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.mine(empty).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(empty, least=0)


def test_large_multiplicities(spark):
    schema = "lang string, piece string, words long, m long"
    pieces = spark.createDataFrame([("en", "big apple", 2, 3 * 10**9), ("en", "big", 1, 10**9), ("en", "x", 1, 4 * 10**12)], schema)
    counts = {(r.n, r.phrase): r.f for r in collocations.frequent(pieces, 100).collect()}
    assert counts == {(1, "big"): 4 * 10**9, (1, "apple"): 3 * 10**9, (2, "big apple"): 3 * 10**9, (1, "x"): 4 * 10**12}


def test_pieces_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", None], "text": ["Big  Apple, big\tapple.. X", "big apple"]})
    out = [r for b in collocations.pieces([batch]) for r in b.to_pylist()]
    assert sorted((r["lang"], r["piece"], r["words"], r["m"]) for r in out) == [("en", "big apple", 2, 2), ("en", "x", 1, 1), ("und", "big apple", 2, 1)]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    import numpy as np

    pieces = [pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "piece": ["a b c", "a b d", "a b c d"], "m": pa.array([5, 1, 2], pa.int64())})]
    full = np.full(1 << (collocations.FILTER_BITS - 3), 255, np.uint8)
    out = {(r["n"], r["phrase"]): r["c"] for _, b in collocations.grams(pieces, full) for r in b.to_pylist()}
    assert out[2, "a b"] == 8 and out[3, "a b c"] == 7 and out[4, "a b c d"] == 2 and out[1, "d"] == 3
