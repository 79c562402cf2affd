"""Approved recommendations applied to edge tables, with an audit log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routegraph.schema import EDGE
from routegraph.sources.documents import Corpus


def decision_errors(decisions: DataFrame) -> DataFrame:
    """The first decision of each survey that cannot be applied, and why: nothing of such a survey may be applied."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(F.col("decision").isNull() | ~F.col("decision").isin("approved", "rejected"), "Decision must be approved or rejected before apply")
    for name in ("recommendation_id", "approver", "rationale"):
        why = why.when(blank(F.col(name)), f"Decision field {name} must be a non-empty string")
    bad = decisions.withColumn("error", why).where("error is not null")
    return bad.groupBy("survey_key").agg(F.min_by("error", "pos").alias("error"))


def operations(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patch operations in the order in which they are applied: those of each approved recommendation, once, by its first approval."""
    first = decisions.where("decision = 'approved'").groupBy("survey_key", "recommendation_id").agg(F.min("pos").alias("pos"))
    rows = first.join(recommendations.select("survey_key", F.col("id").alias("recommendation_id"), "patch"), ["survey_key", "recommendation_id"])
    return rows.select("survey_key", "recommendation_id", "pos", F.posexplode("patch").alias("step", "p")).select("survey_key", "recommendation_id", "pos", "step", "p.*")


def effective(corpus: Corpus, ops: DataFrame) -> DataFrame:
    """``ops`` with ``takes``: whether each changes anything. An added edge does if its id is new; an update does if the
    first edge with its id exists and has another priority by then. Any other operation fails the job."""
    known = F.coalesce(F.col("op").isin("add_edge", "update_edge"), F.lit(False))
    ops = ops.where(F.assert_true(known, F.concat(F.lit("Unsupported patch operation: "), F.coalesce("op", F.lit("none")))).isNull())
    order = W.partitionBy("survey_key", "kind", "id").orderBy("pos", "step")
    keyed = ops.withColumns({"kind": F.col("op"), "id": F.coalesce("edge.id", "edge_id")})
    keyed = keyed.withColumns({"turn": F.row_number().over(order), "before": F.lag("priority").over(order)})
    there = corpus.edges.where("edge_id is not null").groupBy("survey_key", F.col("edge_id").alias("id")).agg(F.min_by(F.struct("priority", "ord"), "ord").alias("old"))
    joined = keyed.join(there, ["survey_key", "id"], "left")
    current = F.when(F.col("turn") == 1, F.col("old.priority")).otherwise(F.col("before"))
    adds = (F.col("op") == "add_edge") & F.col("old").isNull() & (F.col("turn") == 1)
    updates = (F.col("op") == "update_edge") & F.col("old").isNotNull() & ~F.col("priority").eqNullSafe(current)
    return joined.withColumn("takes", F.coalesce(adds | updates, F.lit(False)))


def apply_patches(corpus: Corpus, recommendations: DataFrame, decisions: DataFrame) -> tuple[Corpus, DataFrame, DataFrame]:
    """The corpus with patched edges, the audit rows without their time, and counters of each survey."""
    ops = effective(corpus, operations(recommendations, decisions))
    updates = ops.where("op = 'update_edge' and takes").groupBy("survey_key", "edge_id").agg(F.max_by("priority", F.struct("pos", "step")).alias("new_priority"))
    first = F.row_number().over(W.partitionBy("survey_key", "edge_id").orderBy("ord")) == 1
    edges = corpus.edges.withColumn("_first", first).join(updates, ["survey_key", "edge_id"], "left")
    edges = edges.withColumn("priority", F.when(F.col("_first"), F.coalesce("new_priority", "priority")).otherwise(F.col("priority")))
    columns = ["survey_key", *[c.strip().split()[0] for c in EDGE.split(",")]]
    last = corpus.edges.groupBy("survey_key").agg(F.max("ord").alias("last"))
    added = ops.where("op = 'add_edge' and takes").join(last, "survey_key", "left")
    number = F.row_number().over(W.partitionBy("survey_key").orderBy("pos", "step"))
    added = added.select("survey_key", (F.coalesce("last", F.lit(-1)) + number).cast("int").alias("ord"), F.col("edge.id").alias("edge_id"), *[F.col(f"edge.{c}").alias(c) for c in ("source", "target", "condition", "condition_text", "priority", "type")])
    patched = replace(corpus, edges=edges.select(*columns).unionByName(added.select(*columns)), rows=None, is_landed=False)  # rows would be those of the edges before
    log = audit(recommendations, decisions)
    return patched, log, counters(ops, decisions)


def audit(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each decision; the issue is null if the recommendation is unknown."""
    issues = recommendations.select("survey_key", F.col("id").alias("recommendation_id"), "issue_id")
    return decisions.join(issues, ["survey_key", "recommendation_id"], "left").select("survey_key", "pos", "approver", "issue_id", "recommendation_id", "decision", "rationale")


def stamped(log: DataFrame, at: Column | None = None) -> DataFrame:
    """``log`` with its UTC time, to the second."""
    time = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return log.select(time.alias("timestamp"), "*")


def counters(ops: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of each survey: how many, applied, skipped and logged."""
    applied = ops.where("takes").groupBy("survey_key").agg(F.countDistinct("recommendation_id").alias("applied_count"))
    counts = decisions.groupBy("survey_key").agg(F.count("*").alias("decision_count")).join(applied, "survey_key", "left").na.fill(0, ["applied_count"])
    return counts.select("survey_key", "decision_count", "applied_count", (F.col("decision_count") - F.col("applied_count")).alias("skipped_count"), F.col("decision_count").alias("logged_count"))
