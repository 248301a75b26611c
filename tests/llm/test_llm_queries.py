import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from conftest import SF, same
from tallyfold.llm import oracles, queries

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, name, QUERIES, ORACLES)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert SF


def documents(spark, sf_dir=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = documents(spark)
    for r in QUERIES["op1_byte_bpe"](spark, SF).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op4_round_trip(spark):
    texts = documents(spark)
    for r in QUERIES["op4_webp"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_op5_equals_plain_patterns(spark):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    kinds = [("assign", re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    larger = SF.replace("sf0.001", "sf0.01")  # the smallest table holds no secrets
    texts, found = documents(spark, larger), 0
    for r in QUERIES["op5_secrets"](spark, larger).collect():
        spans = []
        for place, (kind, pattern) in enumerate(kinds):
            for m in pattern.finditer(texts[r.doc_id] or ""):
                if {"assign": len(m.group(m.lastindex or 0)) >= 6, "access": len(m.group()) >= 20, "hex": len(m.group()) >= 24}[kind]:
                    spans.append((m.start(), place, m.end(), kind))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        found += len(spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in spans) for k, _ in kinds]
    assert found


def test_op10_pieces_are_whole(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in documents(spark).items()}
    covered, windows = dict.fromkeys(ids, 0), {}
    for r in QUERIES["op10_packing"](spark, SF).orderBy("doc_id", "start").collect():
        assert r.start == covered[r.doc_id] and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        windows[r.sequence_id] = windows.get(r.sequence_id, 0) + r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert all(n <= 2048 and n & (n - 1) == 0 for n in windows.values())
