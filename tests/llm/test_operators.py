"""Operators against plain Python on small fixtures with nulls, empty, long and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyfold.llm import bpe, components, jaccard, kdtree, language, ngrams, packing, secrets, substrings, toxicity, webp
from tallyfold.llm.elias_fano import EliasFano, TrieLevel, mapped, quantised

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
rnd = random.Random(8)
WORDS = [f"w{i}" for i in range(60)]


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SHARED = sentence(45, 1)
TEXTS = [
    (1, sentence(80, 2) + " " + SHARED), (2, SHARED + "\n" + sentence(30, 3)), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, sentence(80, 2) + " " + SHARED),
    (8, sentence(300, 4) + "  x"), (9, "é 漢字 😀 'll don't  \t\n token: abcdef12 AKIA" + "Q" * 20), (10, (SHARED + " ") * 3), (11, "z" * 5000), (12, sentence(300, 4) + " y"), (13, " \n\t"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_bpe():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none):
    enc = brute_bpe()
    got = {r.doc_id: r for r in bpe.encode(docs, RANKS).collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    for i, t in TEXTS:
        assert list(got[i].ids) == enc.encode_ordinary(t or "")
        assert back[i] == (t or "").encode()
        assert got[i].offsets[-1] == len(back[i])
    assert bpe.encode(none, RANKS).count() == 0


def test_bpe_boundaries_on_random_texts():
    enc, own = brute_bpe(), bpe.Codec(RANKS)
    letters = [*"aset'rlvmd'  \n\t 1!é' 　漢²", "😀", "'re", "'ll", "'ve", "  ", " '"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(4000)] + ["a!" * 500, "\0\0", "\x1c x"]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)


def brute_removed(pairs):
    seen, out = set(), {}
    for i, t in sorted(pairs, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substrings(docs, none):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs, digests=True).collect()}
    assert got == brute_removed(TEXTS)
    assert substrings.removed(none).count() == 0
    kept = {r.doc_id: r for r in substrings.stripped(docs).collect()}
    assert kept[1].text == dict(TEXTS)[1] and kept[7].text == "" and kept[1].ids == "clash" and kept[3].text == ""


def test_substrings_many_random_documents(spark):
    r = random.Random(3)
    common = [sentence(r.randrange(15, 60), 100 + i) for i in range(12)]
    pairs = [(i, " ".join(r.choice(common) if r.random() < 0.4 else sentence(r.randrange(1, 40), 1000 + 7 * i + k) for k in range(r.randrange(6)))) for i in range(250)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.removed(frame, digests=True).collect()}
    assert got == brute_removed(pairs)


def test_repeated_and_null_keys(spark):
    frame = spark.createDataFrame([(1, SHARED), (1, SHARED), (1, "other " + SHARED), (None, SHARED), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substrings.removed(frame, digests=True).collect())
    assert got == [(False, 45, 45), (False, 45, 45), (False, 46, 45), (True, 0, 0), (True, 45, 0)]
    assert substrings.stripped(frame).count() == 5
    linked = jaccard.join(frame).collect()
    assert len(linked) == 5 and {r.n_links for r in linked if r.doc_id is not None} <= {1, 2}
    assert 1 <= jaccard.representatives(frame).count() <= 3


def brute_links(pairs):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in ids}
    out = {}
    for i in ids:
        group, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - group)
            group |= new
        out[i] = (min(group), len(links[i]))
    return out


def test_jaccard(docs, none):
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()} == brute_links(TEXTS)
    assert jaccard.join(none).count() == 0
    assert {r.doc_id for r in jaccard.representatives(docs).collect()} == {i for i, (c, _) in brute_links(TEXTS).items() if c == i}


def test_jaccard_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(150)]
    pairs = []
    for i in range(700):
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(150)] = f"x{r.randrange(50)}"
        pairs.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_links(pairs)


def test_jaccard_bounds_follow_the_threshold():
    for t in (0.45, 0.5, 0.6, 0.8, 0.95, 1):
        need = jaccard.likely_for(t)
        lost = sum(math.comb(64, k) * t**k * (1 - t) ** (64 - k) for k in range(need))
        missed = (1 - t * (1 - (1 - t) ** 2)) ** jaccard.runs_for(t)
        assert lost + missed <= 1e-8
    with pytest.raises(ValueError):
        jaccard.runs_for(0.2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_language_model(docs, none):
    got = {r.doc_id: r for r in ngrams.score(docs).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*(t or "").encode().translate(lower).split(), b" "] for i, t in TEXTS}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(count.values())
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(ws) and got[i].train_tokens == total
        assert got[i].n_known == sum(count[w] > 0 for w in ws) and got[i].held_out == held[i] and got[i].score < 0
    assert ngrams.score(none).count() == 0


def test_language_model_beats_single_words(spark):
    r = ngrams.score(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > r.b


def test_elias_fano(tmp_path):
    g = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 9), (900, 1 << 60), (3000, 4000)):
        v = np.sort(g.integers(0, top, n).astype(np.uint64))
        e = EliasFano(EliasFano.encode(v))
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([v, g.integers(0, top, 200).astype(np.uint64)])
        assert [(int(x) in set(v.tolist())) for x in q] == (e.find(q) >= 0).tolist()
    keys = np.unique(g.integers(0, 1 << 62, 3000).astype(np.uint64) & np.uint64(0x3000000FF00000FF))
    counts = g.integers(1, 5000, len(keys))
    (tmp_path / "level").write_bytes(TrieLevel.build(keys, counts))
    level = mapped(str(tmp_path / "level"))
    assert (level.look_up(keys) == quantised(counts)).all() and not level.look_up(keys + np.uint64(1 << 9)).any()


def test_webp_decodes_all_it_can_write():
    g = np.random.default_rng(0)
    for h, w, k in ((1, 1, 1), (5, 7, 2), (9, 13, 4), (8, 8, 16), (10, 11, 200), (20, 17, 1 << 20)):
        p = (g.integers(0, k, (h, w)).astype(np.uint32) * np.uint32(0x01234567) | np.uint32(0xFF000000)).astype(np.uint32)
        tiles = (-(-h // 4), -(-w // 4))
        ways = [{}, {"references": False}, {"cache_bits": 4}, {"subtract_green": True, "cache_bits": 1}, {"cross_colour": g.integers(0, 1 << 24, tiles), "predictor": g.integers(0, 14, tiles), "cache_bits": 3}]
        ways += [{"palette": True}] * (k <= 200) + [{"predictor": np.full(tiles, m)} for m in range(14)]
        for way in ways:
            assert (webp.decode(webp.encode(p, **way)) == p).all()
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_webp_columns(docs, none):
    got = {r.doc_id: r for r in webp.store(docs).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        pixels = b"".join(((webp.decode(file) >> 8) & 255).astype(np.uint8).tobytes() for file in webp._split(bytes(got[i].media)))
        assert pixels == full and got[i].n_bytes == len(raw) and got[i].payload_bytes == len(full)
        assert got[i].payload_sha256 == hashlib.sha256(full).hexdigest() and got[i].tail_crc32 == zlib.crc32(full[-32:]) and got[i].media_bytes == len(got[i].media)
    assert got[5].media_sha256 == got[6].media_sha256 and webp.store(none).count() == 0


def test_webp_stores_lengths_that_fill_no_rectangle(spark, monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 1200)
    rows = 1201  # a prime above the longest side
    text = "".join(chr(97 + i * i % 23) for i in range(1000)) * (rows * 576 // 1000) + "the text's end" * 50
    full = text.encode() + b"\xff" * (rows * 576 - len(text))
    r = webp.store(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), rows * 576, hashlib.sha256(full).hexdigest())
    assert r.feature.startswith("576x1201;")
    for size in (576, 1201 * 576, 2399 * 576, 2401 * 576):
        raw = np.frombuffer(full * 2, np.uint8)[:size]
        media = webp.write_samples(raw, np.array([0, size]))
        assert webp.read_samples(media, [size]) == [raw.tobytes()]


def test_webp_texts_go_through_the_whole_codec(monkeypatch):
    raw = np.frombuffer((SHARED * 400).encode()[: 16 * 576], np.uint8)
    media, calls, whole = webp.write_samples(raw, np.array([0, len(raw)])), [], webp.decode_many
    monkeypatch.setattr(webp, "decode_many", lambda files: calls.append(list(map(len, files))) or whole(files))
    assert webp.read_samples(media, [len(raw)]) == [raw.tobytes()] and calls == [[len(media[0])]]
    bits = webp.BitReader(webp._chunk(media[0])[1:])
    assert [bits.get(n) for n in (14, 14, 1, 3, 1, 2)] == [575, 15, 0, 0, 1, 3]  # the palette transform
    assert len(media[0]) < len(raw) / 10  # prefix codes alone take a bit a sample or more


def test_webp_side_by_side_equals_one_by_one(monkeypatch):
    g = np.random.default_rng(5)
    images, ways = [], []
    for i in range(120):
        h, w = int(g.integers(1, 20)), int(g.integers(1, 30))
        p = (g.integers(0, int(g.choice([2, 5, 60, 1 << 20])), (h, w)).astype(np.uint32) * np.uint32(0x01234567) | np.uint32(0xFF000000)).astype(np.uint32)
        p[h // 2 :] = p[: h - h // 2] if i % 2 else p[h // 2 :]
        tiles = (-(-h // 4), -(-w // 4))
        ways.append([{}, {"cache_bits": 5}, {"subtract_green": True}, {"predictor": g.integers(0, 14, tiles)}, {"references": False, "cache_bits": 1}][i % 5])
        images.append(p)
    files = [webp.encode(p, **way) for p, way in zip(images, ways)]
    monkeypatch.setattr(webp, "LANES", 1)
    assert all((a == p).all() for a, p in zip(webp.decode_many(files), images))
    monkeypatch.setattr(webp, "LANES", 60)
    assert all((a == p).all() for a, p in zip(webp.decode_many(files), images))
    same = webp.encode_many(images, cache_bits=3)
    assert same == [webp.encode(p, cache_bits=3) for p in images]
    with pytest.raises(ValueError):
        webp.decode_many([f[:-40] if len(f) > 400 else f for f in files])


def test_webp_reads_a_plan_of_several_codes():
    """A stream put together bit by bit: two groups of prefix codes, chosen by tile, one of them with a single symbol."""
    out = webp.BitWriter()
    webp._header(out, 8, 4, False)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # a plan, of tiles of 4 by 4
    out.put(0, 3)
    out.put(0, 1)  # the plan's image: no cache; green is 0 or 1, all else one symbol
    for value, size in ((1 | 1 << 1 | 0 << 2 | 0 << 3 | 1 << 4, 12), (1, 4), (1, 4), (1, 4), (1, 4)):
        out.put(value, size)
    out.put(0, 1)
    out.put(1, 1)
    for green in (7, 9):
        out.put(1 | 1 << 2 | green << 3, 11)
        for value in (1, 1):
            out.put(value, 4)
        out.put(1 | 1 << 2 | 255 << 3, 11)
        out.put(1, 4)
    pixels = webp.decode(webp._file(out.take()))
    assert (pixels[:, :4] == 0xFF000700).all() and (pixels[:, 4:] == 0xFF000900).all()


def test_secrets(spark, docs, none, tmp_path):
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in ledger.update(docs).collect()}
    text = dict(TEXTS)[9]
    assert [(k, text[a:b]) for k, a, b in found[9]] == [("assign", "token: abcdef12"), ("access", "AKIA" + "Q" * 20)]
    before = ledger.read().count()
    assert before == len({t or "" for _, t in TEXTS})
    ledger.update(docs.unionByName(docs.withColumn("doc_id", F.lit(99))))
    assert ledger.read().count() == before
    assert secrets.digest(secrets.findings(none, secrets.scan(none)), "doc_id").count() == 0
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[9].text.endswith("[assign] [access]") and clean[3].text is None and clean[1].text == dict(TEXTS)[1] and len(clean) == len(TEXTS)


def test_secret_matches_that_fail_use_up_their_text():
    assert secrets.find("password=abc secret = 'abcdefg' API-key x api_key:zzzzzzz") == [("assign", 13, 30), ("assign", 42, 57)]
    assert secrets.find("0123456789abcdef0123456789abcde") == [("hex", 0, 31)] and secrets.find("AKIA" + "A" * 15) == []
    assert secrets.find("ſecret=abcdefgh") == []


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in TEXTS}
    parts, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path, tiers=(16, 64, 128)).collect():
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(parts[i]):
            assert start == at
            at += n
        assert at == len(x)
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128 and at & (at - 1) == 0
    assert packing.pack(none, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, path, tiers=(3, 5))


def test_packing_gives_added_tokens_their_id(spark):
    from tokenizers import Tokenizer

    path, end = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    lib = Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end * 3, f"é{end}\n{end}  x", f"<|endoftext{end}|>", "<|endoftext|", "plain", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pack(frame, path).orderBy("doc_id", "start").collect():
        got[r.doc_id] += r.ids
    assert dict(got) == {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    own = packing.json_codec(path)
    assert [own.decode(x).decode() for x in own.encode_batch(texts)] == texts


def test_top_k_with_ties_and_bad_vectors(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.integers(-3, 4, 6) / 8]) for i in range(400)] + [(400 + i, [0.25] * 6) for i in range(150)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, []), (1250, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_k(frame, frame.filter("vec_id % 50 = 0"), shard_rows=100).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows[:550]}
    expected = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected
    assert kdtree.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_toxicity_learns(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, sentence(60, 50 + i) + (" awful " if bad else " fine ") + sentence(60, 900 + i), int(bad)))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(1000, None, None), (1001, "", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net, cuts = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("toxic_score", F.lit("clash")), net, cuts).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].toxic_predicted == y for i, y in held) >= 0.95 * len(held) and len(got) == 402 and 0 <= got[1000].toxic_score <= 1
    empty, _ = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, empty, {None: 0.5}).count() == 402


def test_language_learns(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, net = language.fit(docs)
    held = language.predict(docs, names, net).join(docs, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count()
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language.predict(odd, names, net).collect()} == {"und"}
    names, net = language.fit(none)
    assert names == [] and language.predict(odd, names, net).count() == 3
