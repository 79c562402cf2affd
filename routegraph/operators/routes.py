"""Routes of respondents through questionnaires.

``compiled_routes`` serves one survey and any number of respondents: all conditions become columns, and a route is a
fold over at most as many hops as there are nodes, in one projection without a shuffle. ``corpus_routes`` serves many surveys,
whose conditions are data: each respondent meets their survey's edges once, as one row, every different condition is evaluated once, and the route
is a fold again, with no join for a hop. Only surveys of more than PACKED edges are walked by a join for each hop.

A route ends at a terminal (``terminal``), where no edge's condition holds (``no_matching_edge``), at an edge without a
target (``invalid_edge``), at a condition that errs (its message), or after ``max_steps`` hops. As all answers are known
at the start, a node met twice proves an endless loop: its reason is ``max_steps`` too, and the path ends there.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.functions.conditions import Lookup, status
from routegraph.operators.graph import edge_order
from routegraph.schema import NO_PRIORITY
from routegraph.sources.documents import Corpus
from routegraph.store import land


def ordered_edges(edges: list[dict[str, Any]]) -> dict[str, list[dict[str, Any]]]:
    """Edges of one survey by source, in the order in which they are tried."""
    def place(e: tuple[int, dict]) -> tuple:
        p = e[1].get("priority")
        return (p if type(p) is int else NO_PRIORITY, str(e[1].get("id", "")), e[0])

    out: dict[str, list] = {}
    for _, e in sorted(enumerate(edges), key=place):
        if isinstance(e.get("source"), str):
            out.setdefault(e["source"], []).append(e)
    return out


def next_hop(candidates: list[dict[str, Any]], answer: Lookup) -> Column:
    """struct<status, target, edge_id> of the first edge whose condition does not fail; null if all fail."""
    tried = []
    for e in candidates:
        s = status(e.get("condition"), answer)
        target = e.get("target") if isinstance(e.get("target"), str) else None
        tried.append(F.when(s != "F", F.struct(s.alias("status"), F.lit(target).cast("string").alias("target"), F.lit(str(e.get("id", ""))).alias("edge_id"))))
    return F.coalesce(*tried)


def compiled_routes(respondents: DataFrame, entry: str | None, edges: list[dict[str, Any]], terminals: list[str], answer: Lookup, max_steps: int = 1000) -> DataFrame:
    """``respondents`` with ``path``, ``edge_ids`` and ``reason``. ``answer`` gives the answer column of a question."""
    empty = F.array().cast("array<string>")
    if not entry:
        return respondents.withColumns({"path": empty, "edge_ids": empty, "reason": F.lit("missing_entry_node")})
    by_source = ordered_edges(edges)
    nodes = {entry, *by_source, *(e["target"] for e in edges if isinstance(e.get("target"), str))}
    hops = min(max_steps, len(nodes) + 1)
    sources = [s for s in by_source if s not in terminals]
    choices = F.create_map(*[x for s in sources for x in (F.lit(s), next_hop(by_source[s], answer))]) if sources else F.lit(None).cast("map<string,struct<status:string,target:string,edge_id:string>>")
    start = F.struct(F.array(F.lit(entry)).alias("path"), empty.alias("edge_ids"), F.lit(entry).alias("node"), F.lit(None).cast("string").alias("reason"), choices.alias("choices"))

    def step(acc: Column, _: Column) -> Column:
        hop = acc["choices"][acc["node"]]
        state = lambda path, ids, node, reason: F.struct(path.alias("path"), ids.alias("edge_ids"), node.alias("node"), reason.cast("string").alias("reason"), acc["choices"].alias("choices"))
        stop = lambda reason: state(acc["path"], acc["edge_ids"], acc["node"], reason)
        go = lambda reason: state(F.array_append(acc["path"], hop["target"]), F.array_append(acc["edge_ids"], hop["edge_id"]), hop["target"], reason)
        return (
            F.when(acc["reason"].isNotNull(), acc)
            .when(acc["node"].isin(terminals) if terminals else F.lit(False), stop(F.lit("terminal")))
            .when(hop.isNull(), stop(F.lit("no_matching_edge")))
            .when(hop["status"] != "T", stop(F.substring(hop["status"], 3, 1000)))
            .when(hop["target"].isNull(), stop(F.lit("invalid_edge")))
            .when(F.array_contains(acc["path"], hop["target"]), go(F.lit("max_steps")))
            .otherwise(go(F.lit(None)))
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(hops)), start, step, lambda acc: F.struct(acc["path"].alias("path"), acc["edge_ids"].alias("edge_ids"), F.coalesce(acc["reason"], F.lit("max_steps")).alias("reason")))
    routed = respondents.withColumn("_route", done) if hops > 0 else respondents.withColumn("_route", F.struct(F.array(F.lit(entry)).alias("path"), empty.alias("edge_ids"), F.lit("max_steps").alias("reason")))
    return routed.select(*respondents.columns, "_route.path", "_route.edge_ids", "_route.reason")


@F.pandas_udf(T.StringType())
def condition_status(conditions: pd.Series, answers: pd.Series) -> pd.Series:
    """T, F or E: and a message, for a JSON condition and JSON answers. Equal texts are parsed once a batch."""
    parsed: dict[str | None, Any] = {None: None}

    def parse(text: str | None) -> Any:
        if text not in parsed:
            parsed[text] = json.loads(text)
        return parsed[text]

    def one(c: str | None, a: str | None) -> str:
        try:
            return "T" if evaluate(parse(c), parse(a) or {}) else "F"
        except ConditionError as error:
            return f"E:{error}"

    return pd.Series([one(c, a) for c, a in zip(conditions, answers, strict=True)])


def chosen_edges(candidates: DataFrame, keys: list[str], answers: str = "answers") -> DataFrame:
    """Of candidate edges, the first in order whose condition does not fail, for each value of ``keys``."""
    tried = candidates.withColumn("status", F.when(F.col("condition").isNull(), "T").otherwise(condition_status("condition", answers)))
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(edge_order())])
    best = F.min_by(F.struct("status", "target", F.coalesce("edge_id", F.lit("")).alias("edge_id")), place)
    return tried.where("status <> 'F'").groupBy(*keys).agg(best.alias("hop"))


#: Surveys of up to so many edges are sent to their respondents as one row.
PACKED = 4096


@F.pandas_udf(T.ArrayType(T.StringType()))
def condition_statuses(conditions: pd.Series, answers: pd.Series) -> pd.Series:
    """``condition_status`` for an array of conditions. Equal texts of conditions are parsed once a batch, answers once."""
    parsed: dict[str, Any] = {}

    def one(texts: Any, given: str | None) -> list[str]:
        known = (json.loads(given) if given else None) or {}
        out = []
        for text in texts:
            if text not in parsed:
                parsed[text] = json.loads(text)
            try:
                out.append("T" if evaluate(parsed[text], known) else "F")
            except ConditionError as error:
                out.append(f"E:{error}")
        return out

    return pd.Series([one(c, a) for c, a in zip(conditions, answers, strict=True)])


def _folded_routes(respondents: DataFrame, corpus: Corpus, edges: DataFrame, max_steps: int) -> DataFrame:
    """Routes by one join on survey_key and a fold. ``edges`` are those of surveys of bounded size."""
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("source", *[c.alias(f"k{i}") for i, c in enumerate(edge_order())], "target", F.coalesce("edge_id", F.lit("")).alias("id"), "condition")))
    packed = edges.groupBy("survey_key").agg(listed.alias("edges")).withColumn("conditions", F.array_distinct(F.filter(F.transform("edges", lambda e: e["condition"]), lambda c: c.isNotNull())))
    ends = corpus.terminals.groupBy("survey_key").agg(F.collect_set("tid").alias("ends"))
    surveys = corpus.surveys.select("survey_key", "entry_node").join(packed, "survey_key", "left").join(ends, "survey_key", "left")
    rows = respondents.join(surveys, "survey_key").withColumn("statuses", condition_statuses(F.coalesce("conditions", empty), "answers"))
    status = lambda e: F.coalesce(F.try_element_at(F.col("statuses"), F.array_position("conditions", e["condition"]).cast("int")), F.lit("T"))
    tried = F.transform(F.coalesce("edges", F.array().cast(packed.schema["edges"].dataType)), lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["id"].alias("id"), F.when(e["condition"].isNull(), "T").otherwise(status(e)).alias("status")))
    open_ = F.filter(tried, lambda e: e["status"] != "F")
    start = F.struct(F.array("entry_node").alias("path"), empty.alias("edge_ids"), F.col("entry_node").alias("node"), none.alias("reason"), open_.alias("tried"))

    def step(acc: Column, _: Column) -> Column:
        hop = F.get(F.filter(acc["tried"], lambda e: e["source"] == acc["node"]), 0)
        state = lambda path, ids, node, reason: F.struct(path.alias("path"), ids.alias("edge_ids"), node.alias("node"), reason.cast("string").alias("reason"), acc["tried"].alias("tried"))
        stop = lambda reason: state(acc["path"], acc["edge_ids"], acc["node"], reason)
        go = lambda reason: state(F.array_append(acc["path"], hop["target"]), F.array_append(acc["edge_ids"], hop["id"]), hop["target"], reason)
        return (
            F.when(acc["reason"].isNotNull(), acc)
            .when(F.coalesce(F.array_contains("ends", acc["node"]), F.lit(False)), stop(F.lit("terminal")))
            .when(hop.isNull(), stop(F.lit("no_matching_edge")))
            .when(hop["status"] != "T", stop(F.substring(hop["status"], 3, 1000)))
            .when(hop["target"].isNull(), stop(F.lit("invalid_edge")))
            .when(F.array_contains(acc["path"], hop["target"]), go(F.lit("max_steps")))
            .otherwise(go(F.lit(None)))
        )

    # a route without a repeated node takes each source's edge once at most, and one more step tells why it ends
    hops = F.least(F.lit(max_steps), F.coalesce(F.size("edges"), F.lit(0)) + 2)
    walk = F.aggregate(F.when(hops > 0, F.sequence(F.lit(1), hops)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.struct(acc["path"].alias("path"), acc["edge_ids"].alias("edge_ids"), F.coalesce(acc["reason"], F.lit("max_steps")).alias("reason")))
    missing = F.struct(empty.alias("path"), empty.alias("edge_ids"), F.lit("missing_entry_node").alias("reason"))
    return rows.select("survey_key", "respondent", F.when(F.col("entry_node").isNull(), missing).otherwise(walk).alias("r")).select("survey_key", "respondent", "r.path", "r.edge_ids", "r.reason")


def _routes_by_hops(respondents: DataFrame, corpus: Corpus, max_steps: int) -> DataFrame:
    """Routes through surveys of any size: each hop joins the respondents still under way with the edges of their node."""
    empty = F.array().cast("array<string>")
    ends = corpus.terminals.select("survey_key", F.col("tid").alias("node"), F.lit(True).alias("terminal"))
    edges = corpus.edges.where("source is not null").select("survey_key", F.col("source").alias("node"), "target", "edge_id", "condition", "priority", "ord")
    rows = respondents.join(corpus.surveys.select("survey_key", F.col("entry_node").alias("node")), "survey_key")
    rows = rows.select("survey_key", "respondent", "answers", "node", F.when(F.col("node").isNull(), empty).otherwise(F.array("node")).alias("path"), empty.alias("edge_ids"), F.when(F.col("node").isNull(), "missing_entry_node").alias("reason"))
    done, hop_no = None, 0
    while True:
        at = land(rows, "hop")
        out = at.where("reason is not null").select("survey_key", "respondent", "path", "edge_ids", "reason")
        done = out if done is None else done.unionByName(out)
        moving = at.where("reason is null")
        if moving.isEmpty():
            return done
        if hop_no >= max_steps:
            return done.unionByName(moving.select("survey_key", "respondent", "path", "edge_ids", F.lit("max_steps").alias("reason")))
        hop_no += 1
        marked = moving.join(ends, ["survey_key", "node"], "left")
        keys = ["survey_key", "respondent"]
        hops = chosen_edges(marked.where("terminal is null").join(edges, ["survey_key", "node"]), keys)
        step = marked.join(hops, keys, "left")
        hop, target = F.col("hop"), F.col("hop.target")
        reason = (
            F.when(F.col("terminal"), "terminal").when(hop.isNull(), "no_matching_edge").when(F.col("hop.status") != "T", F.substring("hop.status", 3, 1000))
            .when(target.isNull(), "invalid_edge").when(F.array_contains("path", target), "max_steps")
        )
        moves = F.coalesce(F.col("hop.status") == "T", F.lit(False)) & target.isNotNull()
        rows = step.select(
            "survey_key", "respondent", "answers", F.when(moves, target).otherwise(F.col("node")).alias("node"),
            F.when(moves, F.array_append("path", target)).otherwise(F.col("path")).alias("path"),
            F.when(moves, F.array_append("edge_ids", F.col("hop.edge_id"))).otherwise(F.col("edge_ids")).alias("edge_ids"), reason.alias("reason"),
        )


def corpus_routes(respondents: DataFrame, corpus: Corpus, max_steps: int = 1000) -> DataFrame:
    """(survey_key, respondent, path, edge_ids, reason) for (survey_key, respondent, answers as a JSON object). A survey that most
    respondents take is one row of the smaller side of a join, which Spark can split on the larger side."""
    edges = corpus.edges.where("source is not null").select("survey_key", "source", "target", "edge_id", "condition", "priority", "ord")
    large = land(edges.groupBy("survey_key").agg(F.count("*").alias("n")).where(F.col("n") > PACKED).select("survey_key"), "large-surveys")
    if large.isEmpty():
        return _folded_routes(respondents, corpus, edges, max_steps)
    small = _folded_routes(respondents.join(large, "survey_key", "left_anti"), corpus, edges.join(large, "survey_key", "left_anti"), max_steps)
    return small.unionByName(_routes_by_hops(respondents.join(large, "survey_key", "left_semi"), corpus, max_steps))


def route_histogram(routes: DataFrame) -> DataFrame:
    """How many respondents take each path to each end."""
    return routes.groupBy(F.concat_ws(">", "path").alias("path"), "reason").agg(F.count("*").alias("respondents"))


def question_reach(routes: DataFrame) -> DataFrame:
    """How many respondents come to each node."""
    return routes.select(F.explode(F.array_distinct("path")).alias("node")).groupBy("node").agg(F.count("*").alias("respondents"))
