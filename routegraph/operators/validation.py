"""Validation: every check is a query over the normalised tables; issues are numbered in a fixed order."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from routegraph.functions.ast import variables, walk
from routegraph.operators import graph
from routegraph.operators.document_rules import path_json, schema_breaks
from routegraph.schema import NO_PRIORITY, OPERATORS, UNKNOWN
from routegraph.sources.documents import Corpus
from routegraph.store import land

#: Issues before numbering: where they stand (stage and three keys), then what they say.
ORDER = ("stage", "o1", "o2", "o3")


def _issues(rows: DataFrame, kind: str | Column, message: Column, stage: int, o1: Any = 0, o2: Any = 0, o3: Any = "", node: Column | None = None, edge: Column | None = None, evidence: Column | None = None) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    return rows.select(
        "survey_key", F.lit(stage).alias("stage"), col(o1).cast("long").alias("o1"), col(o2).cast("long").alias("o2"), col(o3).cast("string").alias("o3"),
        col(kind).alias("type"), (none if node is None else node).alias("node_id"), (none if edge is None else edge).alias("edge_id"), message.alias("message"),
        (F.lit("{}") if evidence is None else evidence).alias("evidence"),
    )


def _say(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def _edges(corpus: Corpus) -> DataFrame:
    return corpus.edges.withColumn("edge_id", F.coalesce("edge_id", F.lit(UNKNOWN)))


def missing_entries(corpus: Corpus) -> DataFrame:
    absent = corpus.surveys.where("entry_node is null")
    unknown = corpus.surveys.where("entry_node is not null").join(corpus.nodes().withColumnRenamed("node", "entry_node"), ["survey_key", "entry_node"], "left_anti")
    entry = F.col("entry_node")
    return _issues(absent, "missing_entry_node", F.lit("DAG has no entry_node."), 1).unionByName(_issues(unknown, "missing_entry_node", _say("Entry node %s does not exist.", entry), 1, node=entry))


def missing_terminals(corpus: Corpus) -> DataFrame:
    rows = corpus.dag_terminals.join(corpus.terminals, ["survey_key", "tid"], "left_anti")
    return _issues(rows, "missing_terminal_node", _say("Terminal node %s is listed in dag.terminal_nodes but is not defined.", F.col("tid")), 1, 1, F.col("pos"), node=F.col("tid"))


def missing_ends(corpus: Corpus, end: str) -> DataFrame:
    """Edges whose ``end`` (source or target) is no node."""
    rows = _edges(corpus).where(f"{end} is not null").join(corpus.nodes().withColumnRenamed("node", end), ["survey_key", end], "left_anti")
    return _issues(rows, f"missing_edge_{end}", _say(f"Edge %s {end} %s does not exist.", F.col("edge_id"), F.col(end)), 1, 2, F.col("ord"), end, F.col(end), F.col("edge_id"))


PARTS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("operator", T.StringType()), T.StructField("variable", T.StringType()), T.StructField("text", T.StringType())]))


def _cut(text: str | None) -> list:
    """Operators in pre-order (as JSON, and as they read in a message) and the sorted names of variables."""
    node = json.loads(text) if text is not None else None
    heads = [(i, json.dumps(op), None, str(op)) for i, op in enumerate(walk(node))]
    return heads + [(len(heads) + i, None, v, None) for i, v in enumerate(sorted(variables(node)))]


class _Known(dict):
    """Parts of conditions; equal conditions of a batch are parsed once."""

    def __missing__(self, text: str | None) -> list:
        self[text] = _cut(text)
        return self[text]


@F.pandas_udf(PARTS)
def condition_parts(conditions: pd.Series) -> pd.Series:
    known = _Known()
    return conditions.map(lambda text: known[text])


@F.pandas_udf(T.ArrayType(PARTS))
def _parts_of(conditions: pd.Series) -> pd.Series:
    """The same for the conditions of each survey."""
    known = _Known()
    return conditions.map(lambda texts: [known[text] for text in texts])


def condition_issues(corpus: Corpus) -> DataFrame:
    rows = _edges(corpus).where("condition is not null").select("survey_key", "ord", "edge_id", "condition", F.explode(condition_parts("condition")).alias("p")).select("*", "p.*")
    edge, at = F.col("edge_id"), F.col("position")
    unparsed = rows.where(F.col("operator") == '"UNPARSED"')
    unknown = rows.where(F.col("operator").isNotNull() & ~F.col("operator").isin([json.dumps(x) for x in (*OPERATORS, "UNPARSED")]))
    variable = rows.where("variable is not null").withColumnRenamed("variable", "qid").join(corpus.questions, ["survey_key", "qid"], "left_anti")
    shown = F.concat(F.lit('{"condition":'), F.col("condition"), F.lit("}"))
    both = F.concat(F.lit('{"operator":'), F.col("operator"), F.lit(',"condition":'), F.col("condition"), F.lit("}"))
    return (
        _issues(unparsed, "unparsed_condition", _say("Edge %s has an unparsed condition.", edge), 2, F.col("ord"), at, edge=edge, evidence=shown)
        .unionByName(_issues(unknown, "unknown_condition_operator", _say("Edge %s uses unknown condition operator %s.", edge, F.col("text")), 2, F.col("ord"), at, edge=edge, evidence=both))
        .unionByName(_issues(variable, "missing_condition_variable", _say("Edge %s condition references missing question %s.", edge, F.col("qid")), 2, F.col("ord"), at, node=F.col("qid"), edge=edge))
    )


def duplicate_priorities(corpus: Corpus) -> DataFrame:
    """(survey_key, source, priority, edge_ids in document order, first, source_first) of priorities that a source uses twice."""
    rows = _edges(corpus).where("source is not null and priority is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "edge_id"))), lambda x: x["edge_id"])
    groups = rows.groupBy("survey_key", "source", "priority").agg(listed.alias("edge_ids"), F.min("ord").alias("first"))
    return groups.withColumn("source_first", F.min("first").over(W.partitionBy("survey_key", "source"))).where(F.size("edge_ids") > 1)


def priority_issues(corpus: Corpus) -> DataFrame:
    evidence = F.to_json(F.struct("priority", "edge_ids"))
    return _issues(duplicate_priorities(corpus), "duplicate_priority", _say("Source %s has duplicate priority %d.", F.col("source"), F.col("priority")), 3, F.col("source_first"), F.col("first"), node=F.col("source"), evidence=evidence)


def missing_outgoing(corpus: Corpus) -> DataFrame:
    rows = corpus.questions.join(corpus.edges.select("survey_key", F.col("source").alias("qid")), ["survey_key", "qid"], "left_anti")
    return _issues(rows, "missing_outgoing_edge", _say("Question %s has no outgoing edge.", F.col("qid")), 4, F.col("ord"), node=F.col("qid"))


def unreached_nodes(corpus: Corpus, reached: DataFrame) -> DataFrame:
    """(survey_key, node, is_terminal, entry_node) of nodes that no walk from the entry comes to; the entry itself is left out."""
    rows = corpus.nodes().join(reached, ["survey_key", "node"], "left_anti").join(corpus.surveys.select("survey_key", "entry_node"), "survey_key")
    return rows.where("not (node <=> entry_node)")


def reachability_issues(corpus: Corpus, reached: DataFrame) -> DataFrame:
    into = _edges(corpus).where("target is not null").groupBy("survey_key", F.col("target").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "ord"))), lambda x: x["edge_id"]).alias("incoming_edges"))
    rows = unreached_nodes(corpus, reached).join(into, ["survey_key", "node"], "left")
    rows = rows.withColumn("incoming_edges", F.coalesce("incoming_edges", F.array().cast("array<string>")))
    terminal, node = F.col("is_terminal"), F.col("node")
    evidence = F.to_json(F.struct("entry_node", "incoming_edges"), {"ignoreNullFields": "false"})
    message = F.when(terminal, _say("Terminal node %s is not reachable from the entry node.", node)).otherwise(_say("%s is not reachable from the entry node.", node))
    return _issues(rows, F.when(terminal, "unreachable_terminal").otherwise("orphan_node"), message, 5, o3=node, node=node, evidence=evidence)


def cycle_issues(corpus: Corpus) -> DataFrame:
    return _issues(graph.cycles(corpus), "cycle_detected", F.lit("Graph contains a directed cycle."), 6, F.col("cycle_ix"), node=F.col("cycle")[0], evidence=F.to_json(F.struct("cycle")))


def dead_ends(corpus: Corpus, reached: DataFrame) -> DataFrame:
    """(survey_key, node) reached, not listed as terminal, and without a way to a listed terminal."""
    listed = corpus.dag_terminals.select("survey_key", F.col("tid").alias("node"))
    return reached.join(listed, ["survey_key", "node"], "left_anti").join(graph.reaching_terminals(corpus), ["survey_key", "node"], "left_anti")


def dead_end_issues(corpus: Corpus, reached: DataFrame) -> DataFrame:
    node = F.col("node")
    return _issues(dead_ends(corpus, reached), "dead_end", _say("%s has no path to a terminal node.", node), 7, o3=node, node=node)


def missing_fallthroughs(corpus: Corpus) -> DataFrame:
    """(survey_key, source, edge_ids) of sources that branch and have no unconditional edge of type fallthrough."""
    branch = F.coalesce(F.col("type") == "branch", F.lit(False))
    default = F.coalesce(F.col("type") == "fallthrough", F.lit(False)) & F.col("condition").isNull()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("priority", F.lit(999)).alias("p"), "edge_id", "ord"))), lambda x: x["edge_id"])
    groups = _edges(corpus).where("source is not null").groupBy("survey_key", "source").agg(F.bool_or(branch).alias("branches"), F.bool_or(default).alias("falls"), ordered.alias("edge_ids"))
    return groups.where("branches and not falls").select("survey_key", "source", "edge_ids")


def fallthrough_issues(corpus: Corpus) -> DataFrame:
    source = F.col("source")
    evidence = F.to_json(F.struct(F.col("edge_ids").alias("outgoing_edges")))
    return _issues(missing_fallthroughs(corpus), "missing_fallthrough", _say("Branching source %s has no fallthrough edge.", source), 8, o3=source, node=source, evidence=evidence)


# ---- document rules ------------------------------------------------------------------------------------------------


def schema_issues(corpus: Corpus, schema: dict | bool | str | None = None) -> DataFrame:
    """What breaks the built-in document rules, or a draft-07 schema or schema file of one's own; by path, then in the schema's order."""
    found = schema_breaks(corpus.documents, schema)
    place = F.row_number().over(W.partitionBy("survey_key").orderBy("path", "rule_no", "item_no", "message"))
    return _issues(found.withColumn("_at", place), "schema_invalid", F.col("message"), 0, F.col("_at"), evidence=F.concat(F.lit('{"path":'), path_json("path"), F.lit("}")))


# ---- all -----------------------------------------------------------------------------------------------------------


#: The checks in the order of their issues. Each takes the corpus and what is reachable in it.
CHECKS = {
    "entries": lambda c, _: missing_entries(c), "terminals": lambda c, _: missing_terminals(c), "sources": lambda c, _: missing_ends(c, "source"), "targets": lambda c, _: missing_ends(c, "target"),
    "conditions": lambda c, _: condition_issues(c), "priorities": lambda c, _: priority_issues(c), "outgoing": lambda c, _: missing_outgoing(c), "reachability": lambda c, r: reachability_issues(c, r),
    "cycles": lambda c, _: cycle_issues(c), "dead_ends": lambda c, r: dead_end_issues(c, r), "fallthroughs": lambda c, _: fallthrough_issues(c),
}


#: Fields of edges that checks of packed rows look at; a check that is not named may look at all.
EDGE = ("ord", "edge_id", "source", "target", "condition", "priority", "type")
NEEDED = {"entries": (), "terminals": (), "sources": ("ord", "edge_id", "source"), "targets": ("ord", "edge_id", "target"), "conditions": ("ord", "edge_id", "condition")}

#: An issue of a survey that is one row; its fields are in the order of issues.
ISSUE = "struct<stage:int,o1:bigint,o2:bigint,o3:string,type:string,message:string,node_id:string,edge_id:string,evidence:string>"


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _row_cycles(nodes: pd.Series, ends: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.Series:
    """Cycles of surveys as ``graph.cycles`` lists them; none where ``sources`` is null."""
    rows = zip(nodes, ends, sources, targets, strict=True)
    return pd.Series([[] if s is None else graph.depth_first_cycles(sorted(n), set(e), graph.after_of(s, t)) for n, e, s, t in rows], dtype=object)


def _with_cycles(rows: DataFrame) -> DataFrame:
    """Packed rows with ``cycles``. Some step of a cycle does not lead on in the order of names, so only surveys with such a step are searched."""
    known = F.filter("edges", lambda e: graph.has(F.col("nodes"), e["source"]) & graph.has(F.col("nodes"), e["target"]))
    step = lambda e: F.struct(e["source"].alias("source"), F.coalesce(e["priority"], F.lit(NO_PRIORITY)).alias("p"), F.coalesce(e["edge_id"], F.lit("")).alias("edge_id"), e["ord"].alias("ord"), e["target"].alias("target"))
    rows = rows.withColumn("ends", graph.names_of("terminals", "tid")).withColumn("steps", F.array_sort(F.transform(known, step)))
    rows = rows.withColumn("back", F.exists("steps", lambda e: (e["target"] <= e["source"]) & ~graph.has(F.col("ends"), e["target"])))
    return rows.withColumn("cycles", _row_cycles("nodes", "ends", *[F.when(F.col("back"), F.col(f"steps.{end}")) for end in ("source", "target")])).drop("ends", "steps", "back")


def _with_parts(rows: DataFrame) -> DataFrame:
    """Packed rows with ``parts``, array<struct<e, p>>: what ``condition_parts`` finds in the conditions of its edges, each next to its edge."""
    rows = rows.withColumn("asking", F.filter("edges", lambda e: e["condition"].isNotNull())).withColumn("cut", _parts_of(F.col("asking.condition")))
    each = F.transform(F.arrays_zip("asking", "cut"), lambda z: F.transform(z["cut"], lambda p: F.struct(z["asking"].alias("e"), p.alias("p"))))
    return rows.withColumn("parts", F.flatten(each)).drop("asking", "cut")


def _row_issues(texts: bool, without: Collection[str]) -> Column:
    """The issues of a survey that is one row, in their order: what CHECKS find, by expressions over its arrays. Without ``texts``, messages and evidence are empty."""
    has, edges, nodes, entry = graph.has, F.col("named"), F.col("nodes"), F.col("entry_node")
    none = F.lit(None).cast("string")

    def issue(kind: Any, message: Column, stage: int, o1: Any = 0, o2: Any = 0, o3: Any = "", node: Column = none, edge: Column = none, evidence: Column | None = None) -> Column:
        values = [stage, o1, o2, o3, kind, message if texts else "", node, edge, "{}" if evidence is None or not texts else evidence]
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(f"c{i}") for i, v in enumerate(values)]).cast(ISSUE)

    def each(items: Column, holds: Callable[[Column], Column], tell: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(items, holds), tell)

    def one(holds: Column, told: Column) -> Column:
        return F.when(holds, F.array(told)).otherwise(F.array().cast(f"array<{ISSUE}>"))

    def ends(end: str) -> Column:
        return each(edges, lambda e: e[end].isNotNull() & ~has(nodes, e[end]), lambda e: issue(f"missing_edge_{end}", _say(f"Edge %s {end} %s does not exist.", e["edge_id"], e[end]), 1, 2, e["ord"], end, e[end], e["edge_id"]))

    def part(x: Column) -> Column:
        e, p = x["e"], x["p"]
        edge, shown = F.coalesce(e["edge_id"], F.lit(UNKNOWN)), F.concat(F.lit(',"condition":'), e["condition"], F.lit("}"))
        kind = F.when(p["variable"].isNotNull(), "missing_condition_variable").when(p["operator"] == '"UNPARSED"', "unparsed_condition").otherwise("unknown_condition_operator")
        message = F.when(p["variable"].isNotNull(), _say("Edge %s condition references missing question %s.", edge, p["variable"])).when(p["operator"] == '"UNPARSED"', _say("Edge %s has an unparsed condition.", edge)).otherwise(_say("Edge %s uses unknown condition operator %s.", edge, p["text"]))
        evidence = F.when(p["variable"].isNotNull(), "{}").when(p["operator"] == '"UNPARSED"', F.concat(F.lit('{"condition":'), e["condition"], F.lit("}"))).otherwise(F.concat(F.lit('{"operator":'), p["operator"], shown))
        return issue(kind, message, 2, e["ord"], p["position"], "", p["variable"], edge, evidence)

    asked, sources = graph.names_of("questions", "qid"), graph.names_of("edges", "source")
    odd = lambda x: F.coalesce(~x["p"]["operator"].isin([json.dumps(o) for o in OPERATORS]), F.lit(False)) | (x["p"]["variable"].isNotNull() & ~has(asked, x["p"]["variable"]))
    ranked = F.filter(edges, lambda e: e["source"].isNotNull() & e["priority"].isNotNull())
    same = lambda e: F.filter(ranked, lambda x: (x["source"] == e["source"]) & (x["priority"] == e["priority"]))
    doubles = F.filter(ranked, lambda e: (F.size(same(e)) > 1) & (same(e)[0]["ord"] == e["ord"]))
    from_ = lambda e: F.filter(ranked, lambda x: x["source"] == e["source"])[0]["ord"]
    double = lambda e: issue("duplicate_priority", _say("Source %s has duplicate priority %d.", e["source"], e["priority"]), 3, from_(e), e["ord"], "", e["source"], none, F.to_json(F.struct(e["priority"].alias("priority"), F.transform(same(e), lambda x: x["edge_id"]).alias("edge_ids"))))

    tids, reached = graph.names_of("terminals", "tid"), F.col("reached")
    into = lambda node: F.transform(F.array_sort(F.transform(F.filter(edges, lambda e: e["target"] == node), lambda e: F.struct(e["edge_id"].alias("edge_id"), e["ord"].alias("ord")))), lambda x: x["edge_id"])

    def unreached(node: Column) -> Column:
        terminal, evidence = has(tids, node), F.to_json(F.struct(entry.alias("entry_node"), into(node).alias("incoming_edges")), {"ignoreNullFields": "false"})
        message = F.when(terminal, _say("Terminal node %s is not reachable from the entry node.", node)).otherwise(_say("%s is not reachable from the entry node.", node))
        return issue(F.when(terminal, "unreachable_terminal").otherwise("orphan_node"), message, 5, 0, 0, node, node, none, evidence)

    branches = lambda s: F.exists(edges, lambda e: (e["source"] == s) & (e["type"] == "branch"))
    falls = lambda s: F.exists(edges, lambda e: (e["source"] == s) & (e["type"] == "fallthrough") & e["condition"].isNull())
    out = lambda s: F.transform(F.array_sort(F.transform(F.filter(edges, lambda e: e["source"] == s), lambda e: F.struct(F.coalesce(e["priority"], F.lit(999)).alias("p"), e["edge_id"].alias("edge_id"), e["ord"].alias("ord")))), lambda x: x["edge_id"])
    yes = lambda c: F.coalesce(c, F.lit(False))

    found = {
        "entries": lambda: F.concat(
            one(entry.isNull(), issue("missing_entry_node", F.lit("DAG has no entry_node."), 1)),
            one(entry.isNotNull() & ~has(nodes, entry), issue("missing_entry_node", _say("Entry node %s does not exist.", entry), 1, node=entry)),
        ),
        "terminals": lambda: each(F.col("listed"), lambda t: ~has(tids, t["tid"]), lambda t: issue("missing_terminal_node", _say("Terminal node %s is listed in dag.terminal_nodes but is not defined.", t["tid"]), 1, 1, t["pos"], "", t["tid"])),
        "sources": lambda: ends("source"),
        "targets": lambda: ends("target"),
        "conditions": lambda: each(F.col("parts"), odd, part),
        "priorities": lambda: F.transform(doubles, double),
        "outgoing": lambda: each(F.col("questions"), lambda q: ~has(sources, q["qid"]), lambda q: issue("missing_outgoing_edge", _say("Question %s has no outgoing edge.", q["qid"]), 4, q["ord"], 0, "", q["qid"])),
        "reachability": lambda: each(nodes, lambda n: ~has(reached, n) & ~n.eqNullSafe(entry), unreached),
        "cycles": lambda: F.transform(F.col("cycles"), lambda c, i: issue("cycle_detected", F.lit("Graph contains a directed cycle."), 6, i, 0, "", c[0], none, F.to_json(F.struct(c.alias("cycle"))))),
        "dead_ends": lambda: each(reached, lambda n: ~has(graph.names_of("listed", "tid"), n) & ~has(F.col("ending"), n), lambda n: issue("dead_end", _say("%s has no path to a terminal node.", n), 7, 0, 0, n, n)),
        "fallthroughs": lambda: each(sources, lambda s: yes(branches(s)) & ~yes(falls(s)), lambda s: issue("missing_fallthrough", _say("Branching source %s has no fallthrough edge.", s), 8, 0, 0, s, s, none, F.to_json(F.struct(out(s).alias("outgoing_edges"))))),
    }
    return F.array_sort(F.concat(*[find() for name, find in found.items() if name not in without]))


def by_survey(corpus: Corpus, without: Collection[str] = (), texts: bool = True) -> tuple[DataFrame, Corpus | None]:
    """(survey_key, issues: array of ISSUE, in their order) of surveys that are one row, found without a join or a shuffle of their own, and the rest of the corpus."""

    asked = [NEEDED.get(name, EDGE) for name in CHECKS if name not in without]
    fields = tuple(f for f in EDGE if any(f in x for x in asked))

    def issues(rows: DataFrame) -> DataFrame:
        name = lambda e: e.withField("edge_id", F.coalesce(e["edge_id"], F.lit(UNKNOWN)))
        rows = graph.with_nodes(rows).withColumn("named", F.transform("edges", name) if "edge_id" in fields else F.col("edges"))
        if {"reachability", "dead_ends"} - set(without):
            rows = graph.with_ending(graph.with_reached(rows))
        if "conditions" not in without:
            rows = _with_parts(rows)
        if "cycles" not in without:
            rows = _with_cycles(rows)
        return rows.select("survey_key", _row_issues(texts, without).alias("issues"), "small")

    return graph.by_row(corpus, fields, issues, "issues")


def found_by(corpus: Corpus, name: str) -> DataFrame:
    """Issues of one of CHECKS that asks for nothing but the tables: told in place where surveys come as rows, by joins of the tables where not."""
    if corpus.rows is None:
        return CHECKS[name](corpus, None)
    rows, large = by_survey(corpus, [x for x in CHECKS if x != name])
    every = rows.where("size(issues) > 0").select("survey_key", F.inline("issues"))
    return every if large is None else every.unionByName(CHECKS[name](large, None))


def _by_tables(corpus: Corpus, without: Collection[str]) -> DataFrame:
    """The same issues by joins of tables, for surveys of any size."""
    corpus = corpus.landed(land)
    reached = land(graph.reachable_by_joins(corpus), "reachable") if {"reachability", "dead_ends"} - set(without) else None
    parts = [check(corpus, reached) for name, check in CHECKS.items() if name not in without]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def unnumbered(corpus: Corpus, with_schema: bool = True, without: Collection[str] = (), schema: dict | bool | str | None = None, texts: bool = True) -> DataFrame:
    """Issues of all CHECKS but those named in ``without``, which are not run at all. Without ``texts``, messages and evidence may be empty."""
    rows, large = by_survey(corpus, without, texts)
    every = rows.select("survey_key", F.inline("issues"))
    if large is not None:
        every = every.unionByName(_by_tables(large, without))
    if with_schema and corpus.documents is not None:
        every = every.unionByName(schema_issues(corpus, schema))
    return every


def numbered(corpus: Corpus, with_schema: bool = True, without: Collection[str] = (), schema: dict | bool | str | None = None, texts: bool = True) -> DataFrame:
    """The same issues with ``issue_no``, from 1 in each survey. A survey that is one row has them in order already; others, and those with issues of their documents, are sorted."""
    order = F.row_number().over(W.partitionBy("survey_key").orderBy(*ORDER, "type", "message"))
    if with_schema and corpus.documents is not None:
        return unnumbered(corpus, True, without, schema, texts).withColumn("issue_no", order)
    rows, large = by_survey(corpus, without, texts)
    every = rows.select("survey_key", F.posexplode("issues").alias("at", "i")).select("survey_key", "i.*", (F.col("at") + 1).alias("issue_no"))
    return every if large is None else every.unionByName(_by_tables(large, without).withColumn("issue_no", order))


def validate(corpus: Corpus, with_schema: bool = True, schema: dict | bool | str | None = None) -> DataFrame:
    """All issues of all surveys: survey_key, issue_no, id, severity, type, node_id, edge_id, message, evidence (JSON), recommendation_ids, status.
    ``schema`` is a draft-07 schema, or the path of one, to be used instead of the built-in document rules."""
    return numbered(corpus, with_schema, schema=schema).select(
        "survey_key", "issue_no", F.format_string("ISSUE_%04d", F.col("issue_no")).alias("id"), F.lit("error").alias("severity"), "type", "node_id", "edge_id", "message", "evidence",
        F.array().cast("array<string>").alias("recommendation_ids"), F.lit("open").alias("status"),
    )
