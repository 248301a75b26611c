"""Toxicity by a convolutional text classifier.

Words are bags of hashed features (the whole word and its first bytes, folded to lower
case); a word's embedding is the sum of its features' embeddings.  Filters of several
widths run over the words, maxima over the whole text feed a logistic output.
Thresholds are calibrated for each language on labelled rows that training left out.

Training takes every labelled row outside the held-out fold, dealt out over tasks that hold
``TASK_ROWS`` rows or ``TASK_BYTES`` of text each.  In a round each task goes on from the common net
over all its rows, and the tasks' changes are averaged, parameter by parameter, over the tasks
that changed it.  Scores are for every row and whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from .arrays import give_back, mix64, prefix_sums, rebatched, slices, span_hash, utf8, word_bounds
from .convolution import SAMPLE_BYTES, MaxConvolution

BUCKETS = 1 << 16
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
PREFIXES = (3, 4, 6)
CALIBRATION_SHARE = 6
STEPS = 700
LEAST_DOCUMENTS = 4
BATCH = 64
CHUNK = 256
RATE = 0.01
FOLDS = 5
#: What one training task holds of the labelled rows.
TASK_ROWS = 10_000
TASK_BYTES = 32 << 20
ROUNDS = 3
#: Parts in which the parameters are averaged.
PARTS = 16


def folded(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case."""
    out = raw.copy()
    upper = (raw - np.uint8(65)) < 26
    out[upper] += 32
    if len(raw) > 1:
        second = (raw[:-1] == 0xC3) & ((raw[1:] - np.uint8(0x80)) < 0x1F) & (raw[1:] != 0x97)
        out[1:][second] += 32
    return out


def word_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, features) bucket numbers, and each document's first word."""
    low = folded(raw)
    # Signs part words as white space does: a letter, digit or byte above 127 makes a word.
    solid = ((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10) | (low > 127)
    starts, ends, first = word_bounds(np.where(solid, low, np.uint8(32)), at)
    sums = prefix_sums(low)
    columns = [span_hash(sums, starts, ends)]
    for n in PREFIXES:
        columns.append(mix64(span_hash(sums, starts, np.minimum(starts + n, ends)) + np.uint64(n)))
    return np.stack([(c % np.uint64(BUCKETS)).astype(np.int64) for c in columns], 1), first


def _fold(column, n: int):
    return F.crc32(column.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` labels and ``most`` bytes of text, by hash of the key, none from the held-out fold; ``fit`` takes all.

    Labels are chosen first, then, by sizes alone, the texts that fit: one that is too long
    is passed over.  A key that repeats in the documents gives its shortest text.  Only then
    are texts moved, by a join with that bounded choice.
    """
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("label"))
    chosen = known.filter(F.col("label").isin(0, 1) & F.col("k").isNotNull() & (_fold(F.col("k"), FOLDS) != 0))
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "label").limit(rows)
    texts = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text"), *([docs["lang"].cast("string").alias("lang")] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]))
    texts = texts.withColumn("mark", F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text", "lang").alias("hash")))
    met = texts.join(F.broadcast(chosen), "k")
    # At most ``rows`` keys with their sizes; a key's copies are reduced where they lie.
    sizes = met.groupBy("k", F.crc32(F.col("k").cast("string").cast("binary")).alias("order")).agg(F.min("mark").alias("mark")).collect()
    left, fit_ = most, []
    for row in sorted(sizes, key=lambda r: (r["order"], str(r["k"]))):
        if row["mark"]["size"] <= left:
            left -= row["mark"]["size"]
            fit_.append((row["k"], row["mark"]["size"], row["mark"]["hash"]))
    wanted = docs.sparkSession.createDataFrame(fit_, T.StructType([known.schema["k"]]).add("size", "integer").add("hash", "long"))
    taken = texts.join(F.broadcast(wanted), (texts["k"] == wanted["k"]) & (texts["mark.size"] == wanted["size"]) & (texts["mark.hash"] == wanted["hash"]))
    taken = taken.select(texts["k"], "text", "lang").dropDuplicates(["k"])
    return taken.join(F.broadcast(chosen), "k").select("k", "text", "lang", "label")


def _windows(features: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Every document's runs of at most CHUNK words, and whose they are."""
    windows, owner = [], []
    for d in range(len(first) - 1):
        words = features[first[d] : first[d + 1]]
        for k in range(0, max(1, len(words)), CHUNK):
            windows.append(words[k : k + CHUNK])
            owner.append(d)
    return windows, np.array(owner)


def _padded(windows: list[np.ndarray]) -> np.ndarray:
    size = max(max(WIDTHS), max(len(w) for w in windows)) + 2
    out = np.full((len(windows), size, 1 + len(PREFIXES)), -1, np.int64)
    for i, w in enumerate(windows):
        out[i, : len(w)] = w
    return out


class Examples:
    """One task's labelled texts as windows of features, and the steps over them."""

    def __init__(self, texts: list[str], labels: np.ndarray, rare: np.ndarray):
        features, sizes = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(0, np.int64)]
        for part in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}), most=1 << 20):
            own, first = word_features(*utf8(part.column("text")))
            own = own.astype(np.int32)
            own[rare[own]] = -1
            features.append(own)
            sizes.append(np.diff(first))
        self.windows, self.owner = _windows(np.concatenate(features), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64))
        self.toxic = labels[self.owner] == 1 if len(self.owner) else np.zeros(0, bool)
        self.clean, self.suspects = np.flatnonzero(~self.toxic), np.flatnonzero(self.toxic)
        self.edges = np.concatenate([[0], np.cumsum([len(self.windows[i]) for i in self.suspects])]).astype(np.int64)
        words = [self.windows[i] for i in self.suspects]
        self.words = np.maximum(np.concatenate(words), np.flatnonzero(rare)[0] if rare.any() else 0) if words else None

    def _likeliest(self, net: MaxConvolution) -> np.ndarray:
        """Of each toxic document the window with the largest score."""
        scores, owner = document_scores(net, self.words, self.edges), self.owner[self.suspects]
        order = np.lexsort((-scores, owner))
        return self.suspects[order[np.unique(owner[order], return_index=True)[1]]]

    def round(self, net: MaxConvolution, number: int, rounds: int, ratio: float, rng: np.random.Generator) -> None:
        """Steps over all clean windows, three for each toxic one, and over the toxic ones again with each such share."""
        steps, goal, turn = 0, STEPS / rounds, 0
        while turn == 0 or steps < goal:
            clean, at = rng.permutation(self.clean), 0
            while at < len(clean) or at == 0:
                if number == 0 and turn < 2 or self.words is None:
                    chosen = self.suspects
                elif turn % 2 == 0:
                    chosen = self._likeliest(net)
                some = clean[at : at + max(BATCH, 3 * len(chosen))]
                at += max(1, len(some))
                mix = rng.permutation(np.concatenate([chosen, some]))
                weight = np.where(self.toxic, len(some) / len(chosen) if len(chosen) and len(some) else ratio, 1.0)
                for k in range(0, len(mix), BATCH):
                    pick = mix[k : k + BATCH]
                    net.step(_padded([self.windows[i] for i in pick]), self.toxic[pick].astype(np.int64), weight[pick], RATE * (0.3 if number + 1 == rounds else 1))
                    steps += 1
                turn += 1


def _summed(frame: DataFrame, run, kinds: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums by part of the (part, values, counts) that each task yields; as many rows reach the driver as there are parts."""

    def add(table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x, kinds) for x in table.column(c).to_pylist()) for c in ("values", "counts")]
        return pa.table({"part": table.column("part").slice(0, 1), "values": pa.array([total[0].tobytes()], pa.binary()), "counts": pa.array([total[1].tobytes()], pa.binary())})

    shape = "part int, values binary, counts binary"
    return {r["part"]: (np.frombuffer(r["values"], kinds), np.frombuffer(r["counts"], kinds)) for r in frame.mapInArrow(run, shape).groupBy("part").applyInArrow(add, shape).collect()}


def _parts(values: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, (v, c) in enumerate(zip(np.array_split(values, PARTS), np.array_split(counts, PARTS))):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["part", "values", "counts"])


def _rare(rows: DataFrame) -> np.ndarray:
    """Features of fewer than LEAST_DOCUMENTS training texts: they could only be learned by heart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = np.zeros(BUCKETS, np.int64)
        for part in rebatched(batches):
            own, first = word_features(*utf8(part.column("text")))
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            documents += np.bincount(np.unique(owner[:, None] * BUCKETS + own) % BUCKETS, minlength=BUCKETS)
        yield from _parts(documents, np.zeros(PARTS, np.int64))

    found = _summed(rows.select("text"), run, "q")
    return np.concatenate([found[i][0] for i in range(PARTS)]) < LEAST_DOCUMENTS if found else np.ones(BUCKETS, bool)


def _trained(rows: DataFrame, tasks: int, n: dict[int, int], seed: int = 11) -> MaxConvolution:
    """The net after ROUNDS rounds over all (slot, order, k, text, label)."""
    net = MaxConvolution(BUCKETS, SIZE, WIDTHS, FILTERS, 2, seed)
    if not n.get(0) or not n.get(1):
        net.parts["linear"][:] = 0
        net.parts["bias"][:] = (4, -4) if n.get(0) else (-4, 4) if n.get(1) else (0, 0)
        return net
    rare, names, ratio = _rare(rows), sorted(net.parts), n[0] / n[1]
    net.parts["embedding"][rare] = 0
    dealt = rows.repartition(tasks, "slot").sortWithinPartitions("slot", "order", "k", "label", F.xxhash64("text"))
    context = rows.sparkSession.sparkContext
    for number in range(ROUNDS):
        start = context.broadcast((net, rare))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], number=number, start=start) -> Iterator[pa.RecordBatch]:
            (given, scarce), found = start.value, [b for b in batches if b.num_rows]
            if not found:
                return
            slots = sorted({x for b in found for x in b.column("slot").to_pylist()})
            for slot in slots:  # a slot is a net of its own, so that the result does not depend on which task it meets
                own = pa.Table.from_batches(found)
                own = own.filter(pa.compute.equal(own.column("slot"), slot))
                net = MaxConvolution(BUCKETS, SIZE, WIDTHS, FILTERS, 2, seed)
                net.parts = {k: v.copy() for k, v in given.parts.items()}
                examples = Examples([t or "" for t in own.column("text").to_pylist()], own.column("label").to_numpy(), scarce)
                examples.round(net, number, ROUNDS, ratio, np.random.default_rng([seed, number, slot]))
                change = np.concatenate([(net.parts[k] - given.parts[k]).ravel() for k in names]).astype(np.float64)
                yield from _parts(change, (change != 0).astype(np.float64))
                del own, net, examples, change
            del found
            give_back()

        found = _summed(dealt.select("slot", "text", "label"), run, "d")
        change = np.concatenate([v / np.maximum(c, 1) for v, c in (found[i] for i in range(PARTS))]).astype(np.float32)
        at = 0
        for k in names:
            size = net.parts[k].size
            net.parts[k] = net.parts[k] + change[at : at + size].reshape(net.parts[k].shape)
            at += size
        start.unpersist()
    return net


def document_scores(net: MaxConvolution, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each run of words ``first[i]:first[i+1]``."""
    n = len(first) - 1
    pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    sizes = np.diff(first)
    filled = sizes > 0
    total = len(features)
    if total:
        embedded = net.parts["embedding"].take(features[:, 0], 0)
        for k in range(1, features.shape[1]):
            embedded += net.parts["embedding"].take(features[:, k], 0)
        last = np.repeat(first[1:], sizes)
        place = np.arange(total)
        for j, w in enumerate(WIDTHS):
            f = net.parts[f"filter{w}"]
            response = embedded @ f[0]
            for k in range(1, w):
                tap = np.zeros_like(response)
                tap[:-k] = (embedded @ f[k])[k:]
                tap[place + k >= last] = 0  # words past the end count as none
                response += tap
            pooled[filled, j * FILTERS : (j + 1) * FILTERS] = np.maximum.reduceat(response, first[:-1][filled], 0)
    return net.probabilities(pooled)[:, 1]


def thresholds(counts: list[tuple], least: int = 20) -> dict:
    """For each language the cut with the best F1 on calibration rows; None: for all others.

    ``counts`` are (lang, score in thousandths, rows of label 0, rows of label 1).
    """
    out = {}
    for lang in [None, *sorted({r[0] for r in counts if r[0] is not None})]:
        both: dict[int, np.ndarray] = {}
        for own, cut, clean, toxic in counts:
            if lang is None or own == lang:
                both[cut] = both.get(cut, 0) + np.array([clean, toxic])
        cuts = np.array(sorted(both)) / 1000
        found = np.array([both[c] for c in sorted(both)])
        toxic = found[:, 1].sum()
        if toxic < least and lang is not None:
            continue
        above = found[::-1].cumsum(0)[::-1]  # rows at the cut or over it
        f1 = 2 * above[:, 1] / np.maximum(1, above.sum(1) + toxic)
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        # Halfway between the best cut and the next score below it.
        low = cuts[best[0] - 1] if best[0] else 0.0
        out[lang] = float(min(0.9, max(0.1, (low + cuts[best[-1]]) / 2))) if toxic else 0.5
    return out


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """All (k, text, lang, label, order, aside) of known labels outside the held-out fold; ``aside``: for calibration.

    A document with several labels is an example of each, and so is each document of a key that repeats.
    """
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("k").isNotNull() & (_fold(F.col("k"), FOLDS) != 0))
    texts = docs.select(docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), lang.alias("lang")).filter(_fold(F.col("k"), FOLDS) != 0)
    met = texts.join(shared.large(known), "k").withColumn("k", F.col("k").cast("string"))
    aside = F.crc32(F.concat(F.lit("cut "), "k").cast("binary")) % CALIBRATION_SHARE == 0
    return met.select("k", "text", "lang", "label", F.crc32(F.col("k").cast("binary")).alias("order"), aside.alias("aside"))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", task_rows: int = TASK_ROWS, task_bytes: int = TASK_BYTES
) -> tuple[MaxConvolution, dict]:
    """(net, thresholds by language) from all labelled documents outside the held-out fold.

    The driver gets the net, sums of fixed size, and counts by language and rounded score.  A document
    without a known label or with a null key is no example; no example at all gives a net that scores everything 0.5.
    """
    spark = docs.sparkSession
    rows, path = shared.table_at(labelled(docs, labels, key, text, label), "toxicity")
    sizes = rows.filter("not aside").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    n, size = {r["label"]: r["n"] for r in sizes}, sum(r["size"] for r in sizes)
    tasks = max(1, -(-sum(n.values()) // task_rows), -(-size // task_bytes))
    slot = F.pmod(F.xxhash64("k"), F.lit(tasks)).cast("int").alias("slot")
    net = _trained(rows.filter("not aside").select(slot, "order", "k", "text", "label"), tasks, n)
    cuts: dict = {None: 0.5}
    scored = score(rows.filter("aside").select("text", "lang", "label"), net, cuts, key="text")
    counts = scored.groupBy("lang", F.round(F.col("toxic_score") * 1000).cast("int").alias("cut"))
    counts = counts.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).collect()
    if counts:
        cuts |= thresholds([tuple(r) for r in counts])
    shared.delete(spark, path)
    return net, cuts


def score(docs: DataFrame, net: MaxConvolution, cuts: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with toxic_score, toxic_predicted (score >= 0.5) and toxic_flagged.

    ``toxic_flagged`` compares with the threshold of the row's language.  Every row and
    column is kept, but columns with these three names are replaced; null and empty texts are scored as texts without words.
    """
    docs = docs.drop("toxic_score", "toxic_predicted", "toxic_flagged")
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[text].cast("string").alias("text"), lang.alias("lang"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    model = docs.sparkSession.sparkContext.broadcast((net, cuts))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = model.value
        for part in rebatched(batches):
            raw, at = utf8(part.column("text"))
            s = np.round(document_scores(own, *word_features(raw, at)).astype(np.float64), 6)
            limit = np.array([cut.get(x, cut[None]) for x in part.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)],
                names=["row", "toxic_score", "toxic_predicted", "toxic_flagged"],
            )

    schema = T.StructType([rows.schema["row"]]).add("toxic_score", "double").add("toxic_predicted", "integer").add("toxic_flagged", "boolean")
    out = rows.mapInArrow(run, schema)
    return out.select("row.*", "toxic_score", "toxic_predicted", "toxic_flagged")
