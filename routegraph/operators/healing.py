"""Repair recommendations derived from issues. All free numbers are found by set difference, never by counting up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from routegraph.operators import graph
from routegraph.schema import NO_PRIORITY, PATCH
from routegraph.sources.documents import Corpus
from routegraph.store import land


def least_free(start: Column, used: Column) -> Column:
    """The smallest integer from ``start`` on that is not in ``used``."""
    return F.array_min(F.array_except(F.sequence(start, start + F.size(used)), used))


def _used_priorities(corpus: Corpus) -> DataFrame:
    """(survey_key, source, used, m): priorities that a source uses, and the least of its unconditional edges."""
    return corpus.edges.where("source is not null").groupBy("survey_key", "source").agg(
        F.array_sort(F.collect_set("priority")).alias("used"), F.min(F.when(F.col("condition").isNull(), F.col("priority"))).alias("m")
    )


def first_terminals(corpus: Corpus) -> DataFrame:
    """(survey_key, terminal): the first listed terminal that is any node."""
    known = corpus.dag_terminals.join(corpus.nodes().select("survey_key", F.col("node").alias("tid")), ["survey_key", "tid"], "left_semi")
    return known.groupBy("survey_key").agg(F.min_by("tid", "pos").alias("terminal"))


def fallthrough_priority(used: Column) -> Column:
    return least_free(F.lit(NO_PRIORITY).cast("long"), used)


def reconnect_priority(used: Column, m: Column) -> Column:
    """The largest free integer below the first unconditional edge, or else the fallthrough priority."""
    below = F.when(m > 1, F.array_max(F.array_except(F.sequence(F.lit(1).cast("long"), m - 1), used)))
    return F.coalesce(below, fallthrough_priority(used))


def fallthrough_targets(corpus: Corpus, sources: DataFrame) -> DataFrame:
    """``sources`` (survey_key, source) with ``target``: the question after the source, or else the first terminal."""
    after = graph.next_questions(graph.block_order(corpus)).withColumnRenamed("qid", "source")
    joined = sources.join(after, ["survey_key", "source"], "left").join(first_terminals(corpus), "survey_key", "left")
    return joined.withColumn("target", F.coalesce("next_qid", "terminal")).drop("next_qid", "terminal").where("target is not null")


def orphan_sources(corpus: Corpus, orphans: DataFrame, reached: DataFrame) -> DataFrame:
    """``orphans`` (survey_key, target) with ``source``: the nearest reachable question before, for those without an
    edge from it already. A node outside the order follows all of it."""
    order = land(graph.block_order(corpus), "block-order")
    before = graph.nearest_predecessors(order, reached).select("survey_key", F.col("qid").alias("target"), "predecessor", F.lit(True).alias("placed"))
    last = order.join(reached.withColumnRenamed("node", "qid"), ["survey_key", "qid"], "left_semi").groupBy("survey_key").agg(F.max_by("qid", "ord").alias("last"))
    found = orphans.join(before, ["survey_key", "target"], "left").join(last, "survey_key", "left")
    found = found.withColumn("source", F.when(F.col("placed"), F.col("predecessor")).otherwise(F.col("last"))).drop("predecessor", "placed", "last").where("source is not null")
    return found.join(corpus.edges.select("survey_key", "source", "target"), ["survey_key", "source", "target"], "left_anti")


def priority_moves(corpus: Corpus, duplicates: DataFrame) -> DataFrame:
    """``duplicates`` (survey_key, source, priority, edge_ids) with ``moves`` array<struct<edge_id, priority>>: the first
    edge stays; each later one gets the next free priority above."""
    named = corpus.edges.where("edge_id is not null and source is not null").groupBy("survey_key", "source").agg(F.collect_set("edge_id").alias("named"))
    rows = duplicates.join(_used_priorities(corpus).drop("m"), ["survey_key", "source"]).join(named, ["survey_key", "source"], "left")
    later = F.filter(F.slice("edge_ids", 2, F.size("edge_ids")), lambda e: F.array_contains("named", e))
    rows = rows.withColumn("later", later).where(F.size("later") > 0)
    free = F.array_except(F.sequence(F.col("priority") + 1, F.col("priority") + F.size("later") + F.size("used")), F.col("used"))
    moves = F.transform("later", lambda e, i: F.struct(e.alias("edge_id"), F.get(free, i).alias("priority")))
    return rows.withColumn("moves", moves).drop("later", "named", "used")


def recommend(corpus: Corpus, issues: DataFrame) -> DataFrame:
    """Recommendations of all surveys: survey_key, rec_no, id, issue_id, type, confidence, rationale, patch, requires_approval.

    In order: fallthroughs and orphans as their issues come, then terminal exits, then priorities."""
    corpus = corpus.landed(land)
    issues = land(issues.select("survey_key", "issue_no", "id", "type", "node_id", "evidence"), "issues")
    kinds = {r["type"] for r in issues.select("type").distinct().collect()}  # a row for each kind of issue, of which there are a dozen
    used = _used_priorities(corpus)
    none = F.array().cast("array<bigint>")
    of = lambda kind: issues.where(F.col("type") == kind).select("survey_key", "issue_no", F.col("id").alias("issue_id"), "node_id", "evidence")

    def rows(df: DataFrame, step: int, kind: str, confidence: str, why: Column, text: str, edge_type: str, priority: Column, moves: Column | None = None) -> DataFrame:
        return df.select(
            "survey_key", F.lit(step).alias("step"), "issue_no", "issue_id", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), why.alias("rationale"), "source", "target",
            F.lit(text).alias("text"), F.lit(edge_type).alias("edge_type"), priority.cast("long").alias("priority"), (F.lit(None) if moves is None else moves).cast("array<struct<edge_id:string,priority:bigint>>").alias("moves"),
        )

    taken, s, t = F.coalesce("used", none), F.col("source"), F.col("target")
    found = []  # only what some issue asks for is computed
    if "missing_fallthrough" in kinds:
        falls = fallthrough_targets(corpus, of("missing_fallthrough").withColumnRenamed("node_id", "source")).join(used, ["survey_key", "source"], "left")
        found.append(rows(falls, 1, "add_fallthrough_edge", "medium", F.format_string("Source %s branches without a default path; fall through to the next question or terminal, for human review.", s), "fallthrough", "fallthrough", fallthrough_priority(taken)))
    if "orphan_node" in kinds:
        reached = land(graph.reachable(corpus), "reachable")
        orphans = orphan_sources(corpus, of("orphan_node").withColumnRenamed("node_id", "target"), reached).join(used, ["survey_key", "source"], "left")
        found.append(rows(orphans, 1, "connect_orphan_node", "low", F.format_string("%s cannot be reached; connect it from %s, the nearest reachable node before it, for human review.", t, s), "orphan reconnect", "fallthrough", reconnect_priority(taken, F.col("m"))))
    if "missing_outgoing_edge" in kinds:
        outgoing = corpus.edges.select("survey_key", "source")
        exits = of("missing_outgoing_edge").withColumnRenamed("node_id", "source").join(outgoing, ["survey_key", "source"], "left_anti").join(first_terminals(corpus), "survey_key").withColumnRenamed("terminal", "target")
        found.append(rows(exits, 2, "add_terminal_exit", "low", F.format_string("Question %s leads nowhere; let it exit to terminal %s, for human review.", s, t), "terminal exit", "terminal", F.lit(NO_PRIORITY)))
    if "duplicate_priority" in kinds or not found:
        evidence = F.from_json("evidence", "priority bigint, edge_ids array<string>")
        doubles = priority_moves(corpus, of("duplicate_priority").withColumnRenamed("node_id", "source").withColumns({"priority": evidence["priority"], "edge_ids": evidence["edge_ids"]}))
        why = F.format_string("Source %s uses priority %d twice; give later edges priorities of their own.", s, F.col("priority"))
        found.append(rows(doubles.withColumn("target", F.lit(None).cast("string")), 3, "adjust_duplicate_priority", "high", why, "", "", F.col("priority"), F.col("moves")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    auto = F.regexp_extract("edge_id", r"^E_AUTO_(\d{4,})$", 1)
    numbers = corpus.edges.where(auto != "").select("survey_key", auto.cast("long").alias("n"), "edge_id").where(F.col("edge_id") == F.format_string("E_AUTO_%04d", F.col("n")))
    numbers = numbers.groupBy("survey_key").agg(F.collect_set("n").alias("auto_used"))
    number = F.row_number().over(W.partitionBy("survey_key").orderBy("step", "issue_no"))
    placed = every.withColumn("rec_no", number.cast("long")).join(numbers, "survey_key", "left")
    edge_id = F.format_string("E_AUTO_%04d", least_free(F.col("rec_no"), F.coalesce("auto_used", none)))
    add = F.array(F.struct(
        F.lit("add_edge").alias("op"),
        F.struct(edge_id.alias("id"), "source", "target", F.lit(None).cast("string").alias("condition"), F.col("text").alias("condition_text"), "priority", F.col("edge_type").alias("type")).alias("edge"),
        F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("long").alias("priority"),
    ))
    no_edge = F.lit(None).cast(T.DataType.fromDDL(PATCH).elementType["edge"].dataType)
    move = F.transform("moves", lambda x: F.struct(F.lit("update_edge").alias("op"), no_edge.alias("edge"), x["edge_id"].alias("edge_id"), x["priority"].alias("priority")))
    return placed.select(
        "survey_key", F.col("rec_no").cast("int").alias("rec_no"), F.format_string("REC_%04d", F.col("rec_no")).alias("id"), "issue_id", "type", "confidence", "rationale",
        F.when(F.col("step") == 3, move).otherwise(add).cast(PATCH).alias("patch"), F.lit(True).alias("requires_approval"),
    )


def link(issues: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``issues`` with the ids of their recommendations; those that have some are ``recommended``."""
    ids = recommendations.groupBy("survey_key", "issue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "id"))), lambda x: x["id"]).alias("_ids"))
    joined = issues.join(ids.withColumnRenamed("issue_id", "id"), ["survey_key", "id"], "left")
    return joined.withColumns({"recommendation_ids": F.coalesce("_ids", "recommendation_ids"), "status": F.when(F.col("_ids").isNotNull(), "recommended").otherwise(F.col("status"))}).select(*issues.columns)
