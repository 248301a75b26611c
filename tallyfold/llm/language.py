"""Language identification by a byte convolutional network.

Whole texts are cut into fixed-length byte windows; filters of several widths run over
each window's bytes, their maxima feed a softmax, and a text's windows vote with the
means of their log probabilities.  A filter's first two taps, and the last two of the
widest, are looked up together by byte pair.

Training takes a bounded sample (``ROWS_PER_LANGUAGE`` texts of each of the ``LANGUAGES``
languages with most rows, those with the smallest hash of their key; a few windows of
each, evenly spread over the text), in one task.  Every row is scored, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import rebatched, strings, utf8
from .convolution import MaxConvolution, trained

WINDOW = 192
SIZE = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
ROWS_PER_LANGUAGE = 600
LANGUAGES = 200
WINDOWS_PER_TEXT = 4
STEPS = 500
BATCH = 64
RATE = 0.01
FOLDS = 5
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter by its category; number characters are none."""
    return any(map(str.isalpha, text))


def training_rows(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(k, text, lang) of the bounded sample; keys are chosen before texts are read.

    A language's share of hashes is cut to about three times what is wanted before its
    rows are ranked, so that no task ranks a language whole.
    """
    rows = docs.select(docs[key].alias("k"), docs[label].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("k").isNotNull() & (F.crc32(F.col("k").cast("string").cast("binary")) % FOLDS != 0))
    sizes = rows.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("of")).orderBy(F.desc("of"), "l").limit(LANGUAGES)
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(sizes), F.col("lang") == F.col("l")).filter(share * F.col("of") < 3 * ROWS_PER_LANGUAGE).select("k", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), "k")
    chosen = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= ROWS_PER_LANGUAGE).select("k", "lang")
    texts = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text"), docs[label].cast("string").alias("lang"))
    return texts.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), ["k", "lang"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most WINDOWS_PER_TEXT evenly spread windows of each text, end to end."""
    for part in rebatched(batches):
        grid, owner = windows(*utf8(part.column("text")))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.maximum(np.bincount(owner, minlength=part.num_rows)[owner], 1)
        pick = np.flatnonzero((place * WINDOWS_PER_TEXT // count) != ((place - 1) * WINDOWS_PER_TEXT // count))
        edges = np.searchsorted(owner[pick], np.arange(part.num_rows + 1))
        taken = [grid[pick[a:b]].tobytes() for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([part.column("k"), part.column("lang"), pa.array(taken, pa.binary())], names=["k", "lang", "taken"])


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, the last of a text filled with zeros, and whose each is."""
    sizes = np.diff(at)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((len(owner), WINDOW), np.uint8)
    shift = ends[:-1] * WINDOW - at[:-1]
    out.ravel()[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
    return out, owner


class Pairs:
    """The net's tables by byte pair, for fast scoring of windows."""

    def __init__(self, net: MaxConvolution):
        tables = net.tables()
        both = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.two = both(*tables[2])
        self.three, self.third = both(*tables[3][:2]), tables[3][2]
        self.four, self.last = both(*tables[4][:2]), both(*tables[4][2:])
        self.net = net

    def log_probabilities(self, grid: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(grid), len(self.net.parts["bias"])), np.float32)
        for k in range(0, len(grid), step):
            b = grid[k : k + step].astype(np.int64)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            two = self.two.take(pair, 0).max(1)
            three = self.three.take(pair[:, :-1], 0)
            three += self.third.take(b[:, 2:], 0)
            four = self.four.take(pair[:, :-2], 0)
            four += self.last.take(pair[:, 2:], 0)
            out[k : k + step] = np.log(self.net.probabilities(np.concatenate([two, three.max(1), four.max(1)], 1)) + 1e-6)
        return out


def _fitted(found: list[dict], seed: int = 5) -> tuple[list[str], MaxConvolution | None]:
    names = sorted({r["lang"] for r in found})
    if not names:
        return [], None
    rng = np.random.default_rng(seed)
    grid = np.frombuffer(b"".join(r["taken"] for r in found), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([names.index(r["lang"]) for r in found], [len(r["taken"]) // WINDOW for r in found])
    net = MaxConvolution(256, SIZE, WIDTHS, FILTERS, len(names), seed)
    weight = (len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names)))))[y]
    order, at_row = rng.permutation(len(y)), 0
    for step in range(STEPS if len(y) else 0):
        if at_row >= len(order):
            order, at_row = rng.permutation(len(y)), 0
        rows = order[at_row : at_row + BATCH]
        at_row += BATCH
        net.step(grid[rows].astype(np.int64)[:, :, None], y[rows], weight[rows], RATE * (0.3 if 4 * step >= 3 * STEPS else 1))
    return names, net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> tuple[list[str], MaxConvolution | None]:
    """(languages, net) from the bounded sample, trained in one task; no net without a labelled row.

    Rows whose key, text or language is null, and those of the held-out fold, are no examples.
    """
    kinds = training_rows(docs, key, text, label).select(F.col("k").cast("string").alias("k"), "text", "lang")
    sample = kinds.mapInArrow(_spread, "k string, lang string, taken binary").withColumn("order", F.crc32(F.col("k").cast("binary")))
    return trained(sample, ["order", "k", "taken", "lang"], _fitted, "taken")


def predict(docs: DataFrame, names: list[str], net: MaxConvolution | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): ``und`` with score 0 where a text is null or has no letter."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast((names, net))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_names, own_net = model.value
        pairs = Pairs(own_net) if own_net is not None else None
        for part in rebatched(batches):
            n = part.num_rows
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            if pairs is not None:
                grid, owner = windows(*utf8(part.column("text")))
                total = np.zeros((n, len(own_names)))
                if len(owner):
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    total[owner[first]] = np.add.reduceat(pairs.log_probabilities(grid).astype(np.float64), first, 0)
                total /= np.maximum(1, np.bincount(owner, minlength=n))[:, None]
                q = np.exp(total - total.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                known = np.array([has_letter(t) for t in strings(part.column("text"))], bool)
                best = q.argmax(1)
                lang[known] = np.array(own_names, object)[best[known]]
                score[known] = np.round(q[np.arange(n), best], 6)[known]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(lang, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, rows.schema["key"].dataType)]).add("lang_pred", "string").add("score", "double"))
