"""Language-model scores from an Elias-Fano n-gram trie, in shards.

Counts come from all training texts.  Texts are encoded in batches of whole documents;
a batch sends each n-gram that it holds once, with its training count, to the shard of
the n-gram's context (and, so that a hot context does not fall to one shard, of some
bits of the successor).  A shard sums the counts, builds its trie level, and answers
every batch's n-grams in the order they came in.  Neither the model nor the texts pass
through the driver or are broadcast; shards hold a bounded number of n-grams.

Probabilities interpolate orders: P(w | v) = (c(v w) + m P(w)) / (c(v) + m), where m
depends on how often the context was seen and is chosen by leave-one-out likelihood
over all training tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import kept
from .arrays import give_back, mix64, prefix_sums, rebatched, span_hash, utf8, word_bounds
from .elias_fano import COUNTS, SUCCESSOR_BITS, TrieLevel, scratch
from .substrings import pack, unpack

FOLDS = 10
BATCH_BYTES = 6 << 20
SHARD_TOKENS = 2_000_000
#: Marks of the document's end, a token, and of its beginning, a context.
_END, _BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Contexts by how often they were seen, and the weights tried for each class.
CONTEXT_CLASSES = (1, 2, 4, 16, 64, 256, 4096)
WEIGHTS = (0.25, 1.0, 4.0, 16.0, 128.0, 1024.0, 16384.0, 1e6)
_SPREAD_BITS = 4


def _lower(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw - np.uint8(65)) < 26] += 32
    return out


def _encoded(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    """One row a batch: documents, their sizes, token numbers, and the tokens' sorted hashes."""
    serial = TaskContext.get().partitionId() << 24
    for part in rebatched(batches, most=BATCH_BYTES):
        raw, at = utf8(part.column("text"))
        raw = _lower(raw)
        starts, ends, first = word_bounds(raw, at)
        hashes = span_hash(prefix_sums(raw), starts, ends)
        sizes = np.diff(first) + 1
        stops = np.cumsum(sizes) - 1
        tokens = np.full(int(sizes.sum()), _END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[stops] = False
        tokens[inner] = hashes
        vocabulary, number = np.unique(tokens, return_inverse=True)
        keys = part.column("key").to_pylist()
        held = np.array([k is not None and zlib.crc32(str(k).encode()) % folds == 0 for k in keys], np.uint8)
        gaps = np.diff(vocabulary, prepend=np.uint64(0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([serial], pa.int64()),
                pa.array([part.column("key").to_pylist()], pa.list_(part.column("key").type)),
                pa.array([pack(sizes)], pa.binary()), pa.array([pack(held)], pa.binary()),
                pa.array([pack(number)], pa.binary()), pa.array([pack(gaps)], pa.binary()),
                pa.array([len(tokens)], pa.int64()), pa.array([int(sizes[held == 0].sum())], pa.int64()),
            ],
            names=["batch", "keys", "sizes", "held", "tokens", "vocabulary", "n", "trained"],
        )
        serial += 1


def _grams(order: int, number: np.ndarray, vocabulary: np.ndarray, sizes: np.ndarray, shards: int):
    """(sorted distinct keys, each token's place among them, shard of each key)."""
    if order == 1:
        keys, place = vocabulary, number
        shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return keys, place, shard.astype(np.int64)
    tokens = vocabulary[number]
    stops = np.cumsum(sizes)
    context = np.empty(len(tokens), np.uint64)
    context[1:] = tokens[:-1]
    context[stops - sizes] = _BEGIN
    # Longer histories fold in one more token a turn, none from before the document.
    place = np.arange(len(tokens)) - np.repeat(stops - sizes, sizes)
    for back in range(2, order):
        far = np.full(len(tokens), _BEGIN, np.uint64)
        far[back:] = tokens[:-back]
        far[place < back] = _BEGIN
        context = mix64(context + far * np.uint64(0x9E3779B97F4A7C15))
    keys, place = np.unique(mix64(context) >> np.uint64(SUCCESSOR_BITS) << np.uint64(SUCCESSOR_BITS) | tokens >> np.uint64(64 - SUCCESSOR_BITS), return_inverse=True)
    some = keys >> np.uint64(SUCCESSOR_BITS - _SPREAD_BITS) & np.uint64((1 << _SPREAD_BITS) - 1)
    spread = mix64((keys >> np.uint64(SUCCESSOR_BITS)) + some * np.uint64(0xC2B2AE3D27D4EB4F))
    shard = ((spread >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return keys, place, shard.astype(np.int64)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, held, token numbers, vocabulary) of a batch row."""
    return unpack(row["sizes"]).astype(np.int64), unpack(row["held"]).astype(bool), unpack(row["tokens"]).astype(np.int64), np.cumsum(unpack(row["vocabulary"]))


def _requests(batches: Iterator[pa.RecordBatch], orders: int, shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sizes, held, number, vocabulary = _opened(row)
            train = np.repeat(~held, sizes)
            for order in range(1, orders + 1):
                keys, place, shard = _grams(order, number, vocabulary, sizes, shards)
                counts = np.bincount(place[train], minlength=len(keys))
                line = np.argsort(shard, kind="stable")
                keys, counts = keys[line], counts[line]
                used, first = np.unique(shard[line], return_index=True)
                parts = list(zip(first, np.append(first[1:], len(keys))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used * 8 + order), pa.array([row["batch"]] * len(used), pa.int64()),
                        pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
                        pa.array([pack(counts[a:b]) for a, b in parts], pa.binary()),
                    ],
                    names=["shard", "batch", "keys", "counts"],
                )


def _answers(table: pa.Table) -> pa.Table:
    """Sums a shard's counts, builds its level, and answers each batch by look-ups in it.

    Single tokens are answered exactly; the level of longer n-grams holds quantised counts.
    """
    shard = table.column("shard")[0].as_py()
    asked = [np.cumsum(unpack(x)) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, counts)
    seen = total > 0
    if shard % 8 == 1:
        edges = np.cumsum([len(x) for x in asked])[:-1]
        answers = [pack(x) for x in np.split(total[place], edges)]
    else:
        level = scratch(TrieLevel.build(keys[seen], total[seen]))
        answers = [pack(level.look_up(x)) for x in asked]
        del level
    del keys, place, total, counts
    give_back()
    return pa.table(
        {"batch": table.column("batch"), "shard": table.column("shard"), "codes": pa.array(answers, pa.binary()), "distinct": pa.array([int(seen.sum()) if i == 0 else 0 for i in range(len(asked))], pa.int64())}
    )


def _mixed(lower: np.ndarray, joint: np.ndarray, context: np.ndarray, weight: float) -> np.ndarray:
    return (joint + weight * lower) / (context + weight)


def _scores(left: pa.Table, right: pa.Table, shards: int, orders: int, total: int, distinct: int, documents_trained: int, key: str, kind: pa.DataType) -> pa.Table:
    row = left.to_pylist()[0]
    sizes, held, number, vocabulary = _opened(row)
    by_order: dict[int, list[tuple[int, bytes]]] = {}
    for shard, codes in zip(right.column("shard").to_pylist(), right.column("codes").to_pylist()):
        by_order.setdefault(shard % 8, []).append((shard, codes))
    per_token = {}
    for order in range(1, orders + 1):
        keys, place, shard = _grams(order, number, vocabulary, sizes, shards)
        values = np.empty(len(keys))
        got = np.concatenate([unpack(c) for _, c in sorted(by_order[order], key=lambda x: x[0])])
        values[np.argsort(shard, kind="stable")] = got if order == 1 else COUNTS[got.astype(np.int64)]
        per_token[order] = values[place]
    first = np.cumsum(sizes) - sizes
    train = np.repeat(~held, sizes)
    floor = 1 / (total + 0.1 * (distinct + 1))
    own = per_token[1]
    lower = (own + 0.1) * floor
    lower_out = np.where(train, np.maximum(own - 1, 0) + 0.1, own + 0.1) * floor
    base = np.add.reduceat(np.log10(lower), first)
    known = np.add.reduceat((own > 0).astype(np.int64), first)
    context = np.empty(len(own))
    context[1:] = own[:-1]
    context[first] = documents_trained
    n_classes, n_weights = len(CONTEXT_CLASSES), len(WEIGHTS)
    spent = np.repeat(np.arange(len(sizes)), sizes)
    cells = np.zeros((len(sizes), n_classes + 1, n_weights))
    out_cells = np.zeros((n_classes + 1, n_weights))
    group = np.searchsorted(CONTEXT_CLASSES, context, side="right")
    spot = spent * (n_classes + 1) + group
    joint = np.minimum(per_token[orders], context)
    left_out = np.where(train, 1.0, 0.0)
    for k, weight in enumerate(WEIGHTS):
        value = np.log10(np.where(context > 0, _mixed(lower, joint, context, weight), lower))
        cells[:, :, k] = np.bincount(spot, value, len(sizes) * (n_classes + 1)).reshape(len(sizes), -1)
        less = np.maximum(context - left_out, 0)
        value = np.log10(np.where(less > 0, _mixed(lower_out, np.maximum(joint - left_out, 0), less, weight), lower_out))
        out_cells[:, k] = np.bincount(group[train], value[train], n_classes + 1)
    n = len(sizes)
    flat = cells.reshape(n, -1)
    return pa.table(
        {
            key: pa.array(row["keys"], kind), "held_out": pa.array(held), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base),
            "cells": pa.array(list(flat), pa.list_(pa.float64())),
            "out": pa.array([out_cells.ravel() if i == 0 else None for i in range(n)], pa.list_(pa.float64())),
        }
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts whose crc32(key as text) mod ``folds`` is 0 are held out; null keys train.
    Null and empty texts are the end token alone.  Repeated rows count each.
    """
    orders = 2
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    state = T.StructType().add("batch", "long").add("keys", T.ArrayType(kind))
    for name in ("sizes", "held", "tokens", "vocabulary"):
        state = state.add(name, "binary")
    state = state.add("n", "long").add("trained", "long")
    encoded = kept(rows.mapInArrow(lambda b: _encoded(b, folds), state))
    sums = encoded.agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")).first()
    total = sums["trained"] or 0
    shards = max(16, -(-(sums["n"] or 0) // SHARD_TOKENS))
    requests = encoded.select("batch", "sizes", "held", "tokens", "vocabulary").mapInArrow(lambda b: _requests(b, orders, shards), "shard long, batch long, keys binary, counts binary")
    answers = kept(requests.groupBy("shard").applyInArrow(_answers, "batch long, shard long, codes binary, distinct long"))
    distinct = answers.filter("shard % 8 = 1").agg(F.sum("distinct")).first()[0] or 0
    arrow_kind = to_arrow_type(kind)
    shape = T.StructType().add(key, kind).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double")
    shape = shape.add("cells", T.ArrayType(T.DoubleType())).add("out", T.ArrayType(T.DoubleType()))
    documents = _trained_documents(encoded)
    pairs = encoded.select("batch", "keys", "sizes", "held", "tokens", "vocabulary").groupBy("batch").cogroup(answers.select("batch", "shard", "codes").groupBy("batch"))
    scored = kept(pairs.applyInArrow(lambda left, right: _scores(left, right, shards, orders, total, distinct, documents, key, arrow_kind), shape))
    width = (len(CONTEXT_CLASSES) + 1) * len(WEIGHTS)
    row = scored.filter("out is not null").agg(*[F.sum(F.col("out")[i]).alias(f"c{i}") for i in range(width)]).first()
    likelihood = np.array([row[i] or 0.0 for i in range(width)]).reshape(-1, len(WEIGHTS))
    best = likelihood.argmax(1)
    cell = [F.col("cells")[int(i * len(WEIGHTS) + k)] for i, k in enumerate(best)]
    value = cell[0]
    for x in cell[1:]:
        value = value + x
    return scored.select(F.col(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", value.alias("score"))


def _trained_documents(encoded: DataFrame) -> int:
    """How many documents the counts come from: the beginning's count as a context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int((unpack(x) == 0).sum()) for x in batch.column("held").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return encoded.select("held").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
