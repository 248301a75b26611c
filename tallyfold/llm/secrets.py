"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The ledger
holds which rule versions have seen which blob and what they found; a scan reads
only blobs with a rule version that the ledger lacks, each once however many paths
hold it, and findings are joined back to all paths.

Nulls count as empty texts and have no findings.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .arrays import rebatched, slices, strings, utf8

#: Kinds in order, each with its version, pattern, least length of the
#: match and of its group 2, and texts of which a match has one (in lower case).
RULES: dict[str, tuple[int, re.Pattern, int, int, tuple[str, ...]]] = {
    "assign": (1, re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 0, 6, ("passw", "secret", "token", "apikey", "api_key")),
    "access": (1, re.compile(r"AKIA[A-Z0-9]+"), 20, 0, ("akia",)),
    "hex": (1, re.compile(r"[0-9a-f]+"), 24, 0, ()),
    "jwt": (1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 0, ("eyj",)),
    "pem": (1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), 0, 0, ("-----begin ",)),
}
BASE = ("assign", "access", "hex")
SALTS = 16
_HEX_RUN = RULES["hex"][2]

_SPANS = "array<struct<kind:string,start:long,stop:long>>"


def rule_versions() -> list[str]:
    return [f"{kind}@{rule[0]}" for kind, rule in RULES.items()]


def find(text: str, kinds=tuple(RULES), hex_runs: bool = True) -> list[tuple[str, int, int]]:
    """Spans of one text by start, then kind."""
    low = text.lower()
    out = []
    for place, (kind, (_, pattern, least, least_2, words)) in enumerate(RULES.items()):
        if kind not in kinds or (words and not any(w in low for w in words)) or (kind == "hex" and not hex_runs):
            continue
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least and (not least_2 or m.end(2) - m.start(2) >= least_2):
                out.append((m.start(), place, m.end(), kind))
    return [(kind, start, stop) for start, _, stop, kind in sorted(out)]


def _has_hex_run(batch: pa.RecordBatch) -> np.ndarray:
    """Which texts hold a run of hexadecimal digits long enough to matter."""
    raw, at = utf8(batch.column("text"))
    digit = ((raw - np.uint8(48)) < 10) | ((raw - np.uint8(97)) < 6)
    other = np.flatnonzero(~digit)
    stops = np.unique(np.concatenate([other, at - 1, [len(raw)]]))
    runs = stops[1:][np.diff(stops) > _HEX_RUN - 1]
    return np.bincount(np.searchsorted(at, runs - 1, side="right") - 1, minlength=batch.num_rows)[: batch.num_rows] > 0 if len(raw) else np.zeros(batch.num_rows, bool)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[tuple[str, str]] = set()  # a repeated row gives its blob twice
    for batch in batches:
        for part in slices(batch):
            blobs, spans, rules = [], [], []
            for blob, text, pending, runs in zip(part.column("blob").to_pylist(), strings(part.column("text")), part.column("pending").to_pylist(), _has_hex_run(part).tolist()):
                if (mark := (blob, ",".join(pending))) in done:
                    continue
                done.add(mark)
                blobs.append(blob)
                rules.append(pending)
                kinds = {r.partition("@")[0] for r in pending}
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in find(text, kinds, runs)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(rules, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))],
                names=["blob", "rules", "spans"],
            )


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text) of every version."""
    content = F.coalesce(versions[text].cast("string"), F.lit(""))
    return versions.select(versions[path].alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans): what the ledger lacks for these versions.

    One version of each unseen blob is chosen by its path and taken to the scan; the
    text is shuffled once, the choice is made on digests alone.
    """
    rows = addressed(versions, path, text)
    wanted = F.array(*map(F.lit, rule_versions()))
    chosen = rows.groupBy("blob").agg(F.min(F.struct("path")).alias("pick"))
    if ledger is None:
        chosen = chosen.withColumn("pending", wanted)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        chosen = chosen.join(seen, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("pending") > 0)
    chosen = chosen.select(F.col("blob").alias("b"), F.col("pick.path").alias("p"), "pending")
    todo = rows.join(chosen.hint("merge"), F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    return todo.select("blob", "text", "pending").mapInArrow(_scan, f"blob string, rules array<string>, spans {_SPANS}")


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, spans) of every version from a ledger that covers it.

    Of each kind only the current rule version's rows count.  A ledger with one row a
    blob (from one scan) needs no grouping and may be joined as it is.
    """
    rows = addressed(versions, path, text).select("path", "blob")
    return rows.join(ledger.select("blob", "spans"), "blob", "left").select(F.col("path").alias(path), "blob", "spans")


def merged(ledger: DataFrame) -> DataFrame:
    """A ledger of several scans as one row a blob, spans of superseded rule versions left out."""
    now = F.array(*map(F.lit, rule_versions()))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(RULES) for x in (k, i)])
    valid = F.transform(F.array_intersect("rules", now), lambda r: F.substring_index(r, "@", 1))
    own = F.filter("spans", lambda s: F.array_contains(valid, s["kind"]))
    grouped = ledger.select("blob", "rules", own.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("rules"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("s"))
    keyed = F.array_sort(F.transform("s", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return grouped.select("blob", F.array_distinct("rules").alias("rules"), F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def incremental(versions: list[DataFrame], path: str = "doc_id", text: str = "text") -> DataFrame:
    """A ledger, one row a blob, filled by scans of one part of the history after another.

    Each scan reads only what the ledger of the parts before lacks.
    """
    ledger = None
    for part in versions:
        new = written(scan(part, ledger, path, text), "ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
    return merged(ledger)


class BlobLedger:
    """A ledger kept as Parquet in a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], f"blob string, rules array<string>, spans {_SPANS}") if not self._exists() else self.spark.read.parquet(self.folder)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def update(self, versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """Scans what is unseen, appends it, and returns the findings of all given paths."""
        scan(versions, self.read(), path, text).write.mode("append").parquet(self.folder)
        return findings(versions, merged(self.read()), path, text)


def spans_text(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def digest(found: DataFrame, key: str) -> DataFrame:
    """Counts of the base kinds and digests of spans for each row of ``findings``."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        key, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; every row and column stays.

    Overlapping spans are replaced together under the first one's kind; null texts stay
    null, repeated rows are rewritten each, and columns of any name are carried along.
    The text is rewritten by the spans of its blob, joined on the content's address; the
    few blobs with spans are repeated for each of SALTS parts, so that many copies of
    one blob are rewritten by several tasks.
    """
    ledger = scan(docs, None, key, text).filter(F.size("spans") > 0)
    spans = ledger.select(F.col("blob").alias("b"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    others = [docs[f"`{c}`"].cast("string") for c in docs.columns if c != text and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    rows = docs.select(whole.alias("row"), F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256).alias("blob"), F.pmod(F.xxhash64(F.lit(SALTS), *others), F.lit(SALTS)).cast("int").alias("salt"))
    joined = rows.join(spans.hint("merge"), (F.col("blob") == F.col("b")) & (F.col("salt") == F.col("s")), "left")
    joined = joined.select("row", F.col(f"row.c{docs.columns.index(text)}").cast("string").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rebatched(batches):
            texts = part.column("text").to_pylist()
            for i, found in enumerate(part.column("spans").to_pylist()):
                if found:
                    texts[i] = masked(texts[i], [(s["kind"], s["start"], s["stop"]) for s in found])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(run, T.StructType([joined.schema["row"]]).add("text", "string"))
    return out.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])
