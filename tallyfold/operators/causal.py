"""Causal closure, counterfactual replay and point-in-time packages.

Events carry ``event_id`` and ``causation_id`` besides the envelope.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import delete, large, table_at
from . import folds
from .integrity import body
from .projections import column_of, is_type


def with_causes(log: DataFrame) -> DataFrame:
    """Event ids, and as cause the latest earlier event of another phase of the application."""
    phase = F.floor(F.col("seq") / 10).cast("int")
    order = Window.partitionBy("application_id").orderBy("global_position")
    out = log.withColumn("event_id", F.concat(F.lit("e"), F.col("global_position"))).withColumn("phase", phase)
    before = F.lag("event_id").over(order)
    return out.withColumn("causation_id", F.when(F.lag("phase").over(order) != F.col("phase"), before))


def _walked(links: DataFrame, start: DataFrame, rounds: int | None = None, turns: list | None = None) -> DataFrame:
    """(root_id, event_id, depth): ``start`` and all that follows from it by (event_id, causation_id) links, at least depth.

    Links double: after k turns one link spans 2**k causes, and everything less deep than that has
    been reached, so that a chain of depth d takes log d turns of two joins.  What a root has
    reached is not reached again: a turn that finds nothing new ends the walk, cycles too.
    With ``rounds``, anything deeper is an error.  ``turns`` receives what each turn found.
    """
    made = []

    def table(frame: DataFrame) -> DataFrame:
        # Parquet instead of a checkpoint: rows as they lie in memory take several times the disk.
        out, path = table_at(frame, "walk")
        made.append(path)
        return out

    spark = links.sparkSession
    step = table(links.filter("causation_id is not null").select(F.col("event_id").alias("child"), F.col("causation_id").alias("parent")).distinct())
    links_at = made[-1]
    # What a turn finds is a table of its own and never written again.
    found_so_far = [table(start.select("root_id", "event_id").distinct().withColumn("depth", F.lit(0)))]
    span = 1
    while True:
        seen = functools.reduce(DataFrame.unionByName, found_so_far)
        found = seen.join(large(step), F.col("event_id") == F.col("parent")).select("root_id", F.col("child").alias("event_id"), (F.col("depth") + span).alias("depth"))
        fresh = table(found.groupBy("root_id", "event_id").agg(F.min("depth").alias("depth")).join(large(seen), ["root_id", "event_id"], "left_anti"))
        if turns is not None:
            turns.append(span)
        if fresh.isEmpty():
            break
        found_so_far.append(fresh)
        above = step.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        step = table(step.join(large(above), "parent").select("child", F.col("grand").alias("parent")).distinct())
        delete(spark, links_at)
        links_at = made[-1]
        span *= 2
    delete(spark, links_at)
    if rounds is not None and not seen.filter(F.col("depth") > rounds).isEmpty():
        raise RuntimeError(f"causal chains go on beyond {rounds} rounds")
    return seen


def descendants(log: DataFrame, roots: DataFrame, rounds: int | None = None, turns: list | None = None) -> DataFrame:
    """(root_id, event_id, depth) of all events that a root led to, by cause (J-09).

    Chains are followed to their ends, with ``rounds`` as far as that and an error beyond;
    cycles end, and an event counts once at its least depth.
    """
    start = roots.select("root_id", F.col("root_id").alias("event_id"))
    return _walked(log.select("event_id", "causation_id"), start, rounds, turns).filter("depth > 0")


def branches(log: DataFrame, event_type: str, key: str = "application_id") -> DataFrame:
    """The first event of a type in each application (W-16)."""
    first = lambda c, name: F.min_by(c, "global_position").alias(name)
    return log.filter(is_type(event_type)).groupBy(key).agg(F.min("global_position").alias("branch_position"), first("event_id", "branch_id"), first("stream_id", "branch_stream"), first("stream_position", "branch_stream_position"))


def _parted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[list[pa.Array]]:
    """The same rows in parts that end where a value of the first column does; its equal values lie together."""
    held: list[tuple[pa.Array, ...]] = []
    whole = lambda parts: [pa.concat_arrays(c) for c in zip(*parts)]
    for batch in batches:
        name = batch[0]
        if not len(name):
            continue
        starts = np.flatnonzero(_changes(name))
        if held and held[-1][0][-1] != name[0]:
            yield whole(held)
            held = []
        if len(starts):
            cut = int(starts[-1]) + 1
            yield whole([*held, tuple(c.slice(0, cut) for c in batch)])
            held = [tuple(c.slice(cut) for c in batch)]
        else:
            held.append(tuple(batch))
    if held:
        yield whole(held)


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return codes[1:] != codes[:-1]


def _reached(name: pa.Array, event: pa.Array, cause: pa.Array, own: pa.Array) -> np.ndarray:
    """Whether each event is one of its name's ``own`` or follows from one by causes within the name, in whatever order they stand."""
    n = len(name)
    ids = pa.concat_arrays([event, cause]).dictionary_encode()
    code = ids.indices.fill_null(-1).to_numpy().astype(np.int64)
    turn = np.concatenate([[0], np.cumsum(_changes(name))])
    there = code >= 0
    node = np.full(2 * n, -1, np.int64)
    found, node[there] = np.unique((np.concatenate([turn, turn]) * len(ids.dictionary) + code)[there], return_inverse=True)
    child, parent, own = node[:n], node[n:], np.asarray(own.fill_null(False).to_numpy(zero_copy_only=False), bool)
    gone = np.zeros(len(found) + 1, bool)
    gone[child[own & (child >= 0)]] = True
    free = ~own & (child >= 0) & (parent >= 0)
    child_of, parent_of = child[free], parent[free]
    order = np.argsort(parent_of, kind="stable")
    child_of, parent_of = child_of[order], parent_of[order]
    fresh = np.flatnonzero(gone)
    while len(fresh):
        lo, hi = np.searchsorted(parent_of, fresh), np.searchsorted(parent_of, fresh, side="right")
        sizes = hi - lo
        links = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        met = np.unique(child_of[links])
        fresh = met[~gone[met]]
        gone[fresh] = True
    return gone[child] & (child >= 0)


def _followed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of rows that lie together by name: 1 where an event is reached, and 2 added at the first row of a name."""
    for name, event, cause, own in _parted(batches):
        marks = _reached(name, event, cause, own).astype(np.int32)
        marks[np.concatenate([[True], _changes(name)])] += 2
        yield pa.array(marks)


def _undone(log: DataFrame, event_type: str, key: str, fields: tuple[str, ...] = ("global_position",)) -> DataFrame:
    """The events of all applications with a branch event, with the branch's ``fields``, whether they are ``undone``, and whether an application ``begins`` (C-05).

    Undone are the branch event, the later ones of its stream, and what these led to by
    cause within the application, as far as it lies behind the branch.  An event counts under its
    application alone, and an application's events lie together behind the window, so that causes are
    followed where the events lie: none is written down or moved again.
    """
    first = F.when(is_type(event_type), F.struct("global_position", "stream_id", "stream_position"))
    rows = log.withColumn("branch", F.min(first).over(Window.partitionBy(key))).filter(F.col("branch").isNotNull())
    own = (F.col("stream_id") == F.col("branch.stream_id")) & (F.col("stream_position") >= F.col("branch.stream_position")) & F.col("event_id").isNotNull()
    rows = rows.withColumn("own", F.coalesce(own, F.lit(False))).withColumn("branch", F.struct(*[F.col(f"branch.{f}") for f in fields]))
    # Not deterministic to the planner: nothing may be filtered out or sorted anew before it.
    rows = rows.withColumn("marks", F.arrow_udf(_followed, "int").asNondeterministic()(key, "event_id", "causation_id", "own"))
    reached = (F.col("marks") % 2 == 1) & F.col(key).isNotNull()
    undone = (F.col("own") | reached) & (F.col("global_position") >= F.col("branch.global_position"))
    return rows.withColumn("undone", undone).withColumn("begins", F.col("marks") >= 2).drop("own", "marks")


def divergence(log: DataFrame, event_type: str, key: str = "application_id") -> DataFrame:
    """Events that a change of the branch event undoes (C-05)."""
    needed = log.select(key, "event_id", "causation_id", "stream_id", "stream_position", "global_position", "event_type")
    rows = _undone(needed, event_type, key).filter("undone")
    return rows.select(key, "global_position", "event_type", (F.col("global_position") == F.col("branch.global_position")).alias("is_branch"))


def what_if(log: DataFrame, event_type: str, decision: str, key: str = "application_id") -> DataFrame:
    """Outcome of each application as it was, and with its branch event replaced by a final decision.

    What ``divergence`` finds goes; the injected event stands in the branch's place, and
    later events that do not depend on the branch stay behind it.
    """
    final = F.when(is_type("ApplicationApproved"), "FINAL_APPROVED").when(is_type("ApplicationDeclined"), "FINAL_DECLINED").when(is_type("ApplicationSubmitted"), "SUBMITTED")
    needed = log.select(key, "event_id", "causation_id", "stream_id", "stream_position", "global_position", "event_type")
    rows = _undone(needed, event_type, key).withColumn("final", final)
    at = F.when(F.col("final").isNotNull(), F.col("global_position"))
    later = F.when(~F.col("undone") & (F.col("global_position") > F.col("branch.global_position")), at)
    out = rows.groupBy(key).agg(
        F.coalesce(F.max_by("final", at), F.lit("UNKNOWN")).alias("real_outcome"), F.max_by("final", later).alias("stayed"), F.count_if("undone").cast("long").alias("events_undone"),
    )
    given = F.lit("FINAL_APPROVED" if decision == "APPROVE" else "FINAL_DECLINED")
    out = out.withColumn("counterfactual_outcome", F.coalesce("stayed", given)).withColumn("diverges", F.col("real_outcome") != F.col("counterfactual_outcome"))
    return out.select(key, "real_outcome", "counterfactual_outcome", "events_undone", "diverges")


def counterfactual(log: DataFrame, event_type: str, injected: list[dict], key: str = "application_id") -> DataFrame:
    """Each application's outcome as it was and with events in place of its branch event (C-05, W-14).

    ``injected`` are a few events by column name, the same for every application; they
    stand behind the branch in their order, before later events.  Columns ``real_*`` and
    ``other_*`` hold the folds of both.
    """
    if not injected:
        raise ValueError("at least one event takes the branch's place")
    needed = log.select(key, "event_id", "causation_id", "stream_id", "stream_position", "global_position", *folds.OUTCOME_FIELDS)
    rows = _undone(needed, event_type, key)
    # The first row of an application brings the new events; its other rows stand for themselves.
    turns = F.when(F.col("begins"), F.sequence(F.lit(0), F.lit(len(injected)))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("turn", F.explode(turns))

    def told(name: str):
        kind, out = log.schema[name].dataType, F.when(F.col("turn") == 0, F.col(name))
        for i, event in enumerate(injected, 1):
            out = out.when(F.col("turn") == i, F.lit(event[name]).cast(kind)) if event.get(name) is not None else out
        return out.alias(name)

    # Between the branch and the next event there is room for the turns.
    room = 1000
    real = F.col("turn") == 0
    place = F.when(real, F.col("global_position") * room).otherwise(F.col("branch.global_position") * room + F.col("turn"))
    rows = rows.select(key, place.alias("place"), real.alias("real"), (real & F.col("undone")).alias("gone"), *[told(c) for c in folds.OUTCOME_FIELDS])
    sides = {"real": F.col("real"), "other": ~F.col("gone")}
    return folds.outcomes(rows, sides, key, "place", {"events_undone": F.col("gone"), "simulated_events": ~F.col("gone")})


SIGNIFICANT = ("ApplicationSubmitted", "CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceRuleFailed", "ComplianceCheckCompleted", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined")


def narrative(log: DataFrame) -> DataFrame:
    """One sentence for each significant event (F-34, P-10)."""
    money = lambda c: F.format_string("%.2f", F.col(c))
    said = (
        F.when(is_type("ApplicationSubmitted"), F.concat(F.lit("Application submitted for "), money("requested_amount"), F.lit(" USD.")))
        .when(is_type("CreditAnalysisCompleted"), F.concat(F.lit("Credit analysis by "), F.col("agent_id"), F.lit(" recommended a limit of "), money("limit_amount"), F.lit(" USD.")))
        .when(is_type("ComplianceRuleFailed"), F.concat(F.lit("Compliance rule "), F.col("rule_id"), F.lit(" failed: "), F.col("failure_reason"), F.lit(".")))
        .when(is_type("DecisionGenerated"), F.concat(F.lit("Decision generated: "), F.col("recommendation"), F.lit(".")))
        .when(is_type("HumanReviewCompleted"), F.concat(F.lit("Human review by "), F.col("reviewer"), F.lit(" completed: "), F.col("final_decision"), F.lit(".")))
        .when(is_type("ApplicationApproved"), F.concat(F.lit("Application approved for "), money("approved_amount"), F.lit(" USD.")))
        .when(is_type("ApplicationDeclined"), "Application declined.")
    )
    return log.filter(is_type(*SIGNIFICANT)).select("application_id", "global_position", said.alias("sentence"))


def _sentence(log: DataFrame) -> Column:
    said = lambda *parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if not isinstance(p, str) else F.lit(p) for p in parts])
    c = F.col
    return (
        F.when(is_type("ApplicationSubmitted"), said("Application ", c("application_id"), " was submitted for ", c("requested_amount"), " USD."))
        .when(is_type("CreditAnalysisCompleted"), said("Credit analysis by agent ", c("agent_id"), " produced risk tier ", column_of(log, "risk_tier"), " with confidence ", c("confidence"), "."))
        .when(is_type("FraudScreeningCompleted"), said("Fraud screening by agent ", c("agent_id"), " produced score ", c("fraud_score"), "."))
        .when(is_type("ComplianceCheckRequested"), said("Compliance checks requested under regulation set ", column_of(log, "regulation_set"), "."))
        .when(is_type("ComplianceRulePassed"), said("Compliance rule ", c("rule_id"), " passed."))
        .when(is_type("ComplianceRuleFailed"), said("Compliance rule ", c("rule_id"), " failed: ", c("failure_reason"), "."))
        .when(is_type("DecisionGenerated"), said("Decision orchestrator recommended ", c("recommendation"), " with confidence ", c("confidence"), "."))
        .when(is_type("HumanReviewCompleted"), said("Human reviewer ", c("reviewer"), " completed review with decision ", c("final_decision"), "."))
        .when(is_type("ApplicationApproved"), said("Application approved for ", c("approved_amount"), " USD at interest rate ", column_of(log, "interest_rate", "double"), "."))
        .when(is_type("ApplicationDeclined"), "Application was declined after review.")
    )


def told(log: DataFrame) -> DataFrame:
    """The sentence of each significant event in the words of an examination (F-34); amounts and scores as they print."""
    return log.withColumn("sentence", _sentence(log)).filter("sentence is not null").select("application_id", "global_position", "sentence")


#: Events behind which an agent and a model stand.
MODELLED = ("CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated")


def _model(log: DataFrame) -> tuple[Column, Column, Column]:
    """Agent, model and score of an event."""
    agent = F.when(is_type("DecisionGenerated"), F.col("orchestrator")).otherwise(F.col("agent_id"))
    model = F.when(is_type("DecisionGenerated"), F.col("decision_model")).otherwise(F.col("model_version"))
    return agent, model, F.when(is_type("FraudScreeningCompleted"), F.col("fraud_score")).otherwise(F.col("confidence"))


def model_metadata(log: DataFrame) -> DataFrame:
    """Agent, model and score behind each analysis, screening and decision."""
    agent, model, score = _model(log)
    return log.filter(is_type(*MODELLED)).select("application_id", "global_position", "event_id", "event_type", agent.alias("agent_id"), model.alias("model_version"), score.alias("score"))


def package(log: DataFrame, moment: str, chain: DataFrame, key: str = "application_id") -> DataFrame:
    """The regulatory package of each application at a moment (C-06): folds, chain, story, models and a hash over them.

    ``chain`` has (key, stream_position, reason, rolling_hash) of the loan streams as checked;
    as much of it is verified as lay before the moment, and its rolling hash is the final one.
    """
    at = log.filter(F.col("recorded_at") <= F.lit(moment).cast("timestamp_ntz"))
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("global_position", name)))), lambda s: s[name])
    agent, model, score = _model(at)
    shown = F.concat_ws(":", "event_id", agent, F.coalesce(model, F.lit("None")), F.coalesce(score.cast("string"), F.lit("None")))
    upto = F.max(F.when(F.startswith("stream_id", F.lit("loan-")), F.col("stream_position"))).alias("upto")
    # Counts, story and models are one pass over the log; sides of joins lie by application as the log does.
    rows = at.withColumns({"sentence": _sentence(at), "shown": F.when(is_type(*MODELLED), shown)})
    counts = rows.groupBy(key).agg(
        F.count("*").alias("events"), F.max("global_position").alias("last_position"), F.array_join(in_order("sentence"), " ").alias("narrative"), F.array_join(in_order("shown"), ",").alias("models"),
    )
    bad = F.col("reason").isNotNull()
    verified = chain.join(large(at.groupBy(key).agg(upto)), key).filter("stream_position <= upto").groupBy(key).agg(
        F.count("*").alias("events_verified"), F.count_if(bad).cast("long").alias("violations"), F.max_by("rolling_hash", "stream_position").alias("final_hash")
    )
    out = counts.join(large(folds.outcome(at, key)), key).join(large(verified), key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("events_verified", "violations")})
    out = out.withColumn("chain_valid", (F.col("events_verified") > 0) & (F.col("violations") == 0))
    whole = [key, "events", "current_state", "compliance", "agents", "events_verified", "violations", "final_hash", "narrative", "models"]
    return out.withColumn("package_hash", F.sha2(body(*whole), 256))


def examination(log: DataFrame, moment: str, key: str = "application_id") -> DataFrame:
    """State of each application at a moment: events, sentences in order, and a hash over the package (C-06)."""
    at = log.filter(F.col("recorded_at") <= F.lit(moment).cast("timestamp_ntz"))
    told = narrative(at).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_position", "sentence"))), lambda s: s["sentence"]), " ").alias("narrative"))
    state = at.groupBy(key).agg(F.count("*").alias("events"), F.max("global_position").alias("last_position"), F.max_by("event_type", "global_position").alias("last_event_type"))
    joined = state.join(large(told), key, "left").withColumn("narrative", F.coalesce("narrative", F.lit("")))
    return joined.withColumn("package_hash", F.sha2(body(key, "events", "last_event_type", "narrative"), 256))
