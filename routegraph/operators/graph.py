"""Order, closure, cycles and paths over the edges of many surveys at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routegraph.schema import NO_PRIORITY
from routegraph.sources.documents import Corpus
from routegraph.store import land


def edge_order(edge_id: str = "edge_id") -> list[Column]:
    """The order of edges that leave a node: priority (or 999), id, position."""
    return [F.coalesce(F.col("priority"), F.lit(NO_PRIORITY)), F.coalesce(F.col(edge_id), F.lit("")), F.col("ord")]


def outgoing_ranks(edges: DataFrame) -> DataFrame:
    """``edges`` with ``rank``, from 1, among the edges of their source."""
    return edges.where("source is not null").withColumn("rank", F.row_number().over(W.partitionBy("survey_key", "source").orderBy(*edge_order())))


def incoming_ranks(edges: DataFrame) -> DataFrame:
    """``edges`` with ``rank``, from 1, among the edges of their target: by id, then position."""
    return edges.where("target is not null").withColumn("rank", F.row_number().over(W.partitionBy("survey_key", "target").orderBy(F.coalesce("edge_id", F.lit("")), "ord")))


def known_edges(corpus: Corpus) -> DataFrame:
    """Edges whose two ends are nodes."""
    nodes = corpus.nodes().select("survey_key", "node")
    kept = corpus.edges.join(nodes.withColumnRenamed("node", "source"), ["survey_key", "source"], "left_semi")
    return kept.join(nodes.withColumnRenamed("node", "target"), ["survey_key", "target"], "left_semi")


#: Surveys of up to so many rows (starts and steps) are folded as one row each; larger ones are walked by joins, a job for each hop.
PACKED = 4096


def _key_type(df: DataFrame) -> str:
    return df.schema["survey_key"].dataType.simpleString()


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of surveys that fit in one row, and landed rows of larger ones, if there are any."""
    rows = land(rows, "steps")
    large = land(rows.groupBy("survey_key").agg(F.count("*").alias("n")).where(F.col("n") > PACKED).select("survey_key"), "large-surveys")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "survey_key", "left_anti"), land(rows.join(large, "survey_key", "left_semi"), "large-steps")


def _folded(starts: Column, steps: Column) -> Column:
    """Nodes that ``steps`` (array of source and target) lead to from ``starts``: hop by hop, each hop one more array of new nodes."""

    def hop(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        met = F.transform(F.filter(steps, lambda s: F.array_contains(last, s["source"])), lambda s: s["target"])
        return F.when(F.size(last) == 0, levels).otherwise(F.array_append(levels, F.array_except(met, F.flatten(levels))))

    return F.aggregate(F.sequence(F.lit(0), F.size(steps)), F.array(starts), hop, F.flatten)


def _joined(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(survey_key, node) of all nodes met, by a join of the newest nodes with the steps for each hop. ``steps`` is a landed table."""
    seen = front = land(starts.select("survey_key", "node").distinct(), "front")
    hops = 0
    while not front.isEmpty():
        met = front.withColumnRenamed("node", "source").join(steps, ["survey_key", "source"]).select("survey_key", F.col("target").alias("node")).distinct()
        front = land(met.join(seen, ["survey_key", "node"], "left_anti"), "front")
        hops += 1
        seen = seen.unionByName(front)
        if hops % 10 == 0:
            seen = land(seen, "seen")
    return seen


def closure(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(survey_key, node) of all nodes that ``steps`` (survey_key, source, target) lead to from ``starts`` (survey_key, node),
    starts included. Surveys of bounded size are one row each, folded without Python or further shuffles, however
    deep they are; the rest are walked by joins, so that no survey has to fit in a task."""
    rows = steps.select("survey_key", "source", "target").unionByName(starts.select("survey_key", F.col("node").alias("source"), F.lit(None).cast("string").alias("target"))).distinct()
    small, large = _by_size(rows)
    begins = F.col("target").isNull()
    packed = small.groupBy("survey_key").agg(F.collect_list(F.when(begins, F.col("source"))).alias("starts"), F.collect_list(F.when(~begins, F.struct("source", "target"))).alias("steps"))
    met = packed.select("survey_key", F.explode(_folded(F.col("starts"), F.col("steps"))).alias("node"))
    if large is None:
        return met
    return met.unionByName(_joined(large.where(begins).select("survey_key", F.col("source").alias("node")), large.where(~begins)))


def _listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """(survey_key, ``name``: ``fields`` of a survey's rows as an array, in order of the first field, their position; whole_``name``: false if they
    are more than PACKED, and then not all listed, so that no survey has to fit in a task)."""
    kept = F.sort_array(F.collect_list(F.when(F.col(fields[0]).between(0, PACKED), F.struct(*fields))))
    return rows.groupBy("survey_key").agg(kept.alias(name), F.count("*").alias("n")).select("survey_key", name, ((F.size(name) == F.col("n")) & (F.col("n") <= PACKED)).alias(f"whole_{name}"))


def _gathered(corpus: Corpus, fields: tuple[str, ...]) -> DataFrame:
    """What ``Corpus.rows`` describes, from its tables."""
    parts = {
        "edges": _listed(corpus.edges, "edges", "ord", *[f for f in fields if f != "ord"]), "questions": _listed(corpus.questions, "questions", "ord", "qid"),
        "terminals": _listed(corpus.terminals, "terminals", "ord", "tid"), "listed": _listed(corpus.dag_terminals, "listed", "pos", "tid"),
    }
    rows = corpus.surveys.select("survey_key", "survey_id", "entry_node")
    for part in parts.values():
        rows = rows.join(part, "survey_key", "left")
    small = F.col("survey_key").isNotNull()
    for name in parts:
        small = small & F.coalesce(f"whole_{name}", F.lit(True))
    rows = rows.withColumn("small", small)
    none = {name: F.array().cast(rows.schema[name].dataType) for name in parts}
    return rows.select("survey_key", "survey_id", "entry_node", *[F.when(F.col("small"), F.coalesce(name, none[name])).otherwise(none[name]).alias(name) for name in parts], "small")


def by_row(corpus: Corpus, fields: tuple[str, ...], compute: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, Corpus | None]:
    """What ``compute`` makes of surveys that come as one row each (``Corpus.rows``) with ``fields`` of their edges, landed. The rest, surveys of many rows and those without a
    key, come as tables, if there are any. ``compute`` keeps survey_key and ``small``."""
    rows = land(compute(_gathered(corpus, fields) if corpus.rows is None else corpus.rows(*fields)), name)
    large = rows.where("not small").select("survey_key")
    return rows.where("small").drop("small"), None if large.isEmpty() else corpus.of(land(large, "large-surveys"))


def has(names: Column, name: Column) -> Column:
    """Whether ``name`` is among ``names``, which are no nulls; a null never is."""
    return F.coalesce(F.array_contains(names, name), F.lit(False))


def names_of(column: str, field: str) -> Column:
    """The different values of a field of packed rows, without null."""
    return F.array_distinct(F.array_compact(F.col(column)[field]))


def with_nodes(rows: DataFrame) -> DataFrame:
    """Packed rows with ``nodes``: the ids of questions and terminals, each once."""
    return rows.withColumn("nodes", F.array_union(names_of("questions", "qid"), names_of("terminals", "tid")))


def _steps(holds: Callable[[Column], Column], source: str = "source", target: str = "target") -> Column:
    return F.array_distinct(F.transform(F.filter("edges", holds), lambda e: F.struct(e[source].alias("source"), e[target].alias("target"))))


def with_reached(rows: DataFrame) -> DataFrame:
    """Packed rows that have ``nodes`` with ``reached``: the nodes met from the entry."""
    starts = F.when(has(F.col("nodes"), F.col("entry_node")), F.array("entry_node")).otherwise(F.array().cast("array<string>"))
    steps = _steps(lambda e: e["source"].isNotNull() & has(F.col("nodes"), e["target"]))
    return rows.withColumn("steps", steps).withColumn("reached", _folded(starts, F.col("steps"))).drop("steps")


def with_ending(rows: DataFrame) -> DataFrame:
    """Packed rows that have ``nodes`` with ``ending``: the nodes that lead to a listed terminal that exists."""
    known = lambda e: has(F.col("nodes"), e["source"]) & has(F.col("nodes"), e["target"])
    starts = F.array_intersect(names_of("listed", "tid"), F.col("nodes"))
    return rows.withColumn("steps", _steps(known, "target", "source")).withColumn("ending", _folded(starts, F.col("steps"))).drop("steps")


def reachable(corpus: Corpus) -> DataFrame:
    """(survey_key, node) reached from the entry; conditions do not matter, and walks go on through terminals. A survey of bounded size is folded as
    one row, without a join of its edges and nodes."""
    rows, large = by_row(corpus, ("source", "target"), lambda rows: with_reached(with_nodes(rows)).select("survey_key", "reached", "small"), "reached")
    met = rows.select("survey_key", F.explode("reached").alias("node"))
    return met if large is None else met.unionByName(reachable_by_joins(large))


def reachable_by_joins(corpus: Corpus) -> DataFrame:
    entries = corpus.surveys.select("survey_key", F.col("entry_node").alias("node")).join(corpus.nodes(), ["survey_key", "node"], "left_semi")
    targets = corpus.nodes().select("survey_key", F.col("node").alias("target"))
    return closure(entries, corpus.edges.where("source is not null").join(targets, ["survey_key", "target"], "left_semi"))


def reaching_terminals(corpus: Corpus) -> DataFrame:
    """(survey_key, node) from which a listed terminal that exists can be reached."""
    ends = corpus.dag_terminals.select("survey_key", F.col("tid").alias("node")).join(corpus.nodes(), ["survey_key", "node"], "left_semi")
    return closure(ends, known_edges(corpus).select("survey_key", F.col("target").alias("source"), F.col("source").alias("target")))


def _on_cycles(after: dict[str, list[str]]) -> set[str]:
    """Nodes of one survey that lie on a cycle: those in a strongly connected part of several nodes, or with a loop."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    closed: set[str] = set()
    found = {n for n, t in after.items() if n in t}
    for root in after:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        open_.append(root)
        stack = [(root, iter(after[root]))]
        while stack:
            node, targets = stack[-1]
            target = next(targets, None)
            if target is not None:
                if target not in index:
                    index[target] = low[target] = len(index)
                    open_.append(target)
                    stack.append((target, iter(after.get(target, ()))))
                elif target not in closed:
                    low[node] = min(low[node], index[target])
                continue
            stack.pop()
            if stack:
                low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
            if low[node] == index[node]:
                part = []
                while not part or part[-1] != node:
                    part.append(open_.pop())
                closed.update(part)
                if len(part) > 1:
                    found.update(part)
    return found


def after_of(sources: list[str], targets: list[str]) -> dict[str, list[str]]:
    after: dict[str, list[str]] = {}
    for source, target in zip(sources, targets, strict=True):
        after.setdefault(source, []).append(target)
    return after


_after = after_of  # as the tests of cycles call it


def _cyclic_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of ``batches`` is one survey."""
    for rows in batches:
        found = [(r.survey_key, n) for r in rows.itertuples(index=False) for n in sorted(_on_cycles(after_of(r.sources, r.targets)))]
        yield pd.DataFrame(found, columns=["survey_key", "node"])


def _ends(steps: DataFrame, *columns: str) -> DataFrame:
    return steps.select("survey_key", F.explode(F.array(*columns)).alias("node")).distinct()


def _cyclic_by_joins(steps: DataFrame) -> DataFrame:
    """Nodes on cycles of surveys of any size. Steps whose source nothing leads to, or whose target leads nowhere, go until
    none is left to go. Then each node takes the largest name that reaches it; the nodes that lead back to the owner of their name,
    through nodes of that name, are one strongly connected part with it. Found parts go, and it begins anew."""
    found = [steps.where("source = target").select("survey_key", F.col("source").alias("node"))]
    left = land(steps.where("source <> target").distinct(), "cyclic")
    while not left.isEmpty():
        while True:
            before = left.count()
            left = left.join(left.select("survey_key", F.col("source").alias("target")).distinct(), ["survey_key", "target"], "left_semi")
            left = land(left.join(left.select("survey_key", F.col("target").alias("source")).distinct(), ["survey_key", "source"], "left_semi"), "cyclic")
            if left.count() == before:
                break
        names = land(_ends(left, "source", "target").withColumn("name", F.col("node")), "names")
        while True:
            passed = left.join(names.withColumnRenamed("node", "source"), ["survey_key", "source"]).groupBy("survey_key", F.col("target").alias("node")).agg(F.max("name").alias("more"))
            names = land(names.join(passed, ["survey_key", "node"], "left").select("survey_key", "node", F.greatest("name", "more").alias("name"), (F.col("more") > F.col("name")).alias("new")), "names")
            if names.where("new").isEmpty():
                names = names.drop("new")
                break
            names = names.drop("new")
        of = lambda end: names.select("survey_key", F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
        inside = left.join(of("source"), ["survey_key", "source"]).join(of("target"), ["survey_key", "target"]).where("source_name = target_name")
        back = land(inside.select("survey_key", F.col("target").alias("source"), F.col("source").alias("target")), "back")
        part = land(_joined(names.where("node = name").select("survey_key", "node"), back), "part")
        sizes = part.join(names, ["survey_key", "node"]).groupBy("survey_key", "name").agg(F.count("*").alias("n")).where("n > 1")
        found.append(land(part.join(names, ["survey_key", "node"]).join(sizes, ["survey_key", "name"], "left_semi").select("survey_key", "node"), "found"))
        left = left.join(part.withColumnRenamed("node", "source"), ["survey_key", "source"], "left_anti")
        left = land(left.join(part.withColumnRenamed("node", "target"), ["survey_key", "target"], "left_anti"), "cyclic")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def cyclic_nodes(corpus: Corpus) -> DataFrame:
    """(survey_key, node) that a walk leads back to, without passing a terminal."""
    open_ = corpus.nodes().where("not is_terminal").select("survey_key", "node")
    steps = known_edges(corpus).join(open_.withColumnRenamed("node", "source"), ["survey_key", "source"], "left_semi")
    steps = steps.join(open_.withColumnRenamed("node", "target"), ["survey_key", "target"], "left_semi").select("survey_key", "source", "target").distinct()
    small, large = _by_size(steps)
    packed = small.groupBy("survey_key").agg(F.collect_list(F.struct("source", "target")).alias("steps")).select("survey_key", F.col("steps.source").alias("sources"), F.col("steps.target").alias("targets"))
    met = packed.mapInPandas(_cyclic_rows, f"survey_key {_key_type(steps)}, node string")
    return met if large is None else met.unionByName(_cyclic_by_joins(large))


def depth_first_cycles(nodes: list[str], ends: set[str], after: dict[str, list[str]]) -> list[list[str]]:
    """Back edges of a depth-first search, each with the stretch of path that it closes. The search keeps a stack of
    open edge lists, so depth is bounded by memory only."""
    done, found = set(), []
    for root in nodes:
        if root in done or root in ends:
            continue
        path, at, todo = [root], {root: 0}, [iter(after.get(root, ()))]
        while todo:
            node = next(todo[-1], None)
            if node is None:
                todo.pop()
                gone = path.pop()
                del at[gone]
                done.add(gone)
            elif node in at:
                found.append([*path[at[node] :], node])
            elif node not in done and node not in ends:
                at[node] = len(path)
                path.append(node)
                todo.append(iter(after.get(node, ())))
    return found


def _cycle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [
            (r.survey_key, i, c)
            for r in rows.itertuples(index=False)
            for i, c in enumerate(depth_first_cycles(sorted(r.nodes), set(r.ends), after_of(r.sources, r.targets)))
        ]
        yield pd.DataFrame(found, columns=["survey_key", "cycle_ix", "cycle"])


def cycles(corpus: Corpus) -> DataFrame:
    """(survey_key, cycle_ix, cycle): one row for each back edge, in the order of a depth-first search from the sorted
    nodes. That order makes the search of one survey a walk of one task; many surveys share one, and only surveys that
    have a cyclic node are searched."""
    hit = land(cyclic_nodes(corpus).select("survey_key").distinct(), "cyclic")
    nodes = corpus.nodes().join(hit, "survey_key", "left_semi").groupBy("survey_key").agg(F.collect_list("node").alias("nodes"), F.collect_list(F.when(F.col("is_terminal"), F.col("node"))).alias("ends"))
    ranked = outgoing_ranks(known_edges(corpus).join(hit, "survey_key", "left_semi"))
    steps = ranked.groupBy("survey_key").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "target"))).alias("steps"))
    rows = nodes.join(steps, "survey_key").select("survey_key", "nodes", "ends", F.col("steps.source").alias("sources"), F.col("steps.target").alias("targets"))
    return rows.mapInPandas(_cycle_rows, f"survey_key {_key_type(rows)}, cycle_ix int, cycle array<string>")


def block_order(corpus: Corpus) -> DataFrame:
    """(survey_key, ord, qid): questions as blocks list them, by the blocks' order, then those in no block. A question in
    two blocks comes twice."""
    listed = corpus.block_questions.join(corpus.blocks, ["survey_key", "bid"]).join(corpus.questions.select("survey_key", "qid"), ["survey_key", "qid"], "left_semi")
    first = listed.select("survey_key", "qid", F.lit(0).alias("part"), F.col("block_order").cast("long").alias("a"), F.col("ord").alias("b"), F.col("pos").alias("c"))
    rest = corpus.questions.join(corpus.block_questions.select("survey_key", "qid"), ["survey_key", "qid"], "left_anti")
    rest = rest.select("survey_key", "qid", F.lit(1).alias("part"), F.col("ord").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    order = W.partitionBy("survey_key").orderBy("part", "a", "b", "c")
    return first.unionByName(rest).select("survey_key", (F.row_number().over(order) - 1).alias("ord"), "qid")


def next_questions(order: DataFrame) -> DataFrame:
    """(survey_key, qid, next_qid): what follows a question's first place in the order."""
    after = order.withColumn("next_qid", F.lead("qid").over(W.partitionBy("survey_key").orderBy("ord")))
    return after.groupBy("survey_key", "qid").agg(F.min_by(F.struct("next_qid"), "ord").alias("n")).select("survey_key", "qid", F.col("n.next_qid"))


def nearest_predecessors(order: DataFrame, reached: DataFrame) -> DataFrame:
    """(survey_key, qid, predecessor): the last reachable question before a question's first place; null if there is none."""
    marked = order.join(reached.select("survey_key", F.col("node").alias("qid"), F.lit(True).alias("hit")), ["survey_key", "qid"], "left")
    before = W.partitionBy("survey_key").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    seen = marked.withColumn("predecessor", F.last(F.when(F.col("hit"), F.col("qid")), ignorenulls=True).over(before))
    return seen.groupBy("survey_key", "qid").agg(F.min_by(F.struct("predecessor"), "ord").alias("p")).select("survey_key", "qid", F.col("p.predecessor"))


def _paths_of(entry: str, ends: set[str], after: dict[str, list[tuple[str, str]]]) -> Iterator[tuple[list[str], list[str]]]:
    """Walks in depth-first order; the stack holds what is left to try at each node of the current path."""
    path, ids = [entry], []
    todo: list[Iterator[tuple[str, str]]] = []
    leaf = entry in ends or not after.get(entry)
    if leaf:
        yield [entry], []
        return
    todo.append(iter(after[entry]))
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            path.pop()
            ids and ids.pop()
            continue
        target, edge_id = step
        if target in path or target in ends or not after.get(target):
            yield [*path, target], [*ids, edge_id]
        else:
            path.append(target)
            ids.append(edge_id)
            todo.append(iter(after[target]))


@dataclass
class Steps:
    """One survey as rows carry it: nodes that end a walk, and each node's (target, edge id) in the order in which they are tried."""

    survey_key: Any
    entry: str
    ends: set[str]
    after: dict[str, list[tuple[str, str]]]

    @classmethod
    def of(cls, row: Any) -> Steps:
        after: dict[str, list[tuple[str, str]]] = {}
        for source, target, edge_id in zip(row.sources, row.targets, row.ids, strict=True):
            after.setdefault(source, []).append((target, edge_id))
        return cls(row.survey_key, row.entry_node, set(row.ends), after)

    def paths(self, most: int | None = None) -> Iterator[tuple[list[str], list[str]]]:
        return islice(_paths_of(self.entry, self.ends, self.after), most)


def framed(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    """Rows of many surveys as frames of ``size`` rows; what a survey gives is never held as a whole."""
    while batch := list(islice(rows, size)):
        yield pd.DataFrame(batch, columns=columns)


def packed_steps(corpus: Corpus, nodes: bool = False) -> DataFrame:
    """One row for each survey with an entry: survey_key, entry_node, sources, targets, ids (each source's in the order in which they are tried), ends and, if asked for,
    nodes. Surveys that come as rows are packed in place, without a join."""
    if corpus.rows is None:
        return _packed_steps_by_joins(corpus, nodes)
    kept = ["survey_key", "entry_node", "sources", "targets", "ids", "ends", *(["nodes"] if nodes else [])]
    step = lambda e: F.struct(F.coalesce(e["priority"], F.lit(NO_PRIORITY)).alias("p"), F.coalesce(e["edge_id"], F.lit("")).alias("edge_id"), e["ord"].alias("ord"), e["source"].alias("source"), e["target"].alias("target"))

    def packed(rows: DataFrame) -> DataFrame:
        steps = F.array_sort(F.transform(F.filter("edges", lambda e: e["source"].isNotNull() & e["target"].isNotNull()), step))
        rows = (with_nodes(rows) if nodes else rows).withColumn("steps", steps).withColumn("ends", names_of("terminals", "tid"))
        return rows.withColumns({"sources": F.col("steps.source"), "targets": F.col("steps.target"), "ids": F.col("steps.edge_id")}).select(*kept, "small")

    rows, large = by_row(corpus, ("ord", "edge_id", "source", "target", "priority"), packed, "packed-steps")
    rows = rows.where("entry_node is not null")
    return rows if large is None else rows.unionByName(_packed_steps_by_joins(large, nodes).select(*kept))


def _packed_steps_by_joins(corpus: Corpus, nodes: bool) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "source", "target", F.coalesce("edge_id", F.lit("")).alias("edge_id"))))
    steps = outgoing_ranks(corpus.edges).where("target is not null").groupBy("survey_key").agg(listed.alias("steps"))
    ends = corpus.terminals.groupBy("survey_key").agg(F.collect_set("tid").alias("ends"))
    rows = corpus.surveys.where("entry_node is not null").select("survey_key", "entry_node").join(steps, "survey_key", "left").join(ends, "survey_key", "left")
    none = F.array().cast("array<string>")
    listed = {"sources": F.col("steps.source"), "targets": F.col("steps.target"), "ids": F.col("steps.edge_id"), "ends": F.col("ends")}
    if nodes:
        rows = rows.join(corpus.nodes().groupBy("survey_key").agg(F.collect_list("node").alias("nodes")), "survey_key", "left")
        listed["nodes"] = F.col("nodes")
    return rows.select("survey_key", "entry_node", *[F.coalesce(c, none).alias(k) for k, c in listed.items()])


PATH_COLUMNS = ["survey_key", "path_ix", "path", "edge_ids"]


def simple_paths(corpus: Corpus, max_paths: int | None = None) -> DataFrame:
    """(survey_key, path_ix, path, edge_ids): all walks from the entry to a terminal, to a node without edges, or to a
    node met before (which closes the path), in depth-first order. Their number can be exponential in a survey's size; they are
    given out in batches, never held. With ``max_paths``, the first so many of each survey; ``truncated_surveys`` tells which have more."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surveys = (Steps.of(r) for rows in batches for r in rows.itertuples(index=False))
        yield from framed(((s.survey_key, i, *p) for s in surveys for i, p in enumerate(s.paths(max_paths))), PATH_COLUMNS)

    rows = packed_steps(corpus)
    return rows.mapInPandas(listed, f"survey_key {_key_type(rows)}, path_ix int, path array<string>, edge_ids array<string>")


def truncated_surveys(corpus: Corpus, max_paths: int) -> DataFrame:
    """(survey_key) of surveys with more than ``max_paths`` paths; no survey is walked further than that."""

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surveys = (Steps.of(r) for rows in batches for r in rows.itertuples(index=False))
        yield from framed(((s.survey_key,) for s in surveys if sum(1 for _ in s.paths(max_paths + 1)) > max_paths), ["survey_key"])

    rows = packed_steps(corpus)
    return rows.mapInPandas(more, f"survey_key {_key_type(rows)}")


def first_walks(entry: str, ends: set[str], after: dict[str, list[tuple[str, str]]]) -> dict[str, tuple[str, int] | None]:
    """For each node met: the node before it, and the rank of the edge taken, on the first path in depth-first order that holds it.

    A search that enters every node once finds just these. Say a simple path to v came before the search's own, leaving it at y by
    an earlier edge. When the search takes that edge, v is not met yet, so some node of the rest is done already (else v would be met from
    there); take the last such one: its successor was met before it was done, and is neither done nor on the path to y, as that
    path is simple. There is no such node."""
    came: dict[str, tuple[str, int] | None] = {entry: None}
    todo = [(entry, iter(enumerate(() if entry in ends else after.get(entry, ()))))]
    while todo:
        node, steps = todo[-1]
        step = next(steps, None)
        if step is None:
            todo.pop()
            continue
        rank, (target, _) = step
        if target not in came:
            came[target] = (node, rank)
            if target not in ends:
                todo.append((target, iter(enumerate(after.get(target, ())))))
    return came


def first_path(item: tuple[str, int | None], came: dict[str, tuple[str, int] | None], ends: set[str], after: dict[str, list[tuple[str, str]]]) -> tuple[int, ...]:
    """Ranks of the first path that holds a node (node, None) or takes the edge (source, rank): the first walk to it, then always the
    first edge until the path ends or closes."""
    node, rank = item
    ranks: list[int] = []
    met = {node}
    at = came[node]
    while at is not None:
        ranks.append(at[1])
        met.add(at[0])
        at = came[at[0]]
    ranks.reverse()
    while node not in ends and after.get(node):
        rank = 0 if rank is None else rank
        ranks.append(rank)
        node, rank = after[node][rank][0], None
        if node in met:
            break
        met.add(node)
    return tuple(ranks)


def _first_fit(s: Steps, items: set[str], by_node: bool) -> Iterator[tuple]:
    """(survey_key, test_no, path, edge_ids) of one survey, in depth-first order."""
    came = first_walks(s.entry, s.ends, s.after)
    first: dict[str, tuple[int, ...]] = {}
    places = [(n, (n, None)) for n in came] if by_node else [(edge_id, (n, k)) for n in came if n not in s.ends for k, (_, edge_id) in enumerate(s.after.get(n, ()))]
    for name, place in places:
        if name in items:
            found = first_path(place, came, s.ends, s.after)
            first[name] = min(first.get(name, found), found)
    for number, ranks in enumerate(sorted(set(first.values()))):
        path, ids = [s.entry], []
        for rank in ranks:
            target, edge_id = s.after[path[-1]][rank]
            path.append(target)
            ids.append(edge_id)
        yield s.survey_key, number, path, ids


def first_fit_paths(corpus: Corpus, items: DataFrame, by_node: bool) -> DataFrame:
    """(survey_key, path_ix, path, edge_ids): for every item (survey_key, item: node or edge id), the first simple path in depth-first order
    that holds it, each once, numbered in that order. These are the paths that a first-fit pass over all simple paths chooses, found
    without listing them: a search of each survey that is linear in its edges, and a path for each item at most, however many paths there are."""

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surveys = ((Steps.of(r), set(r.items)) for rows in batches for r in rows.itertuples(index=False))
        yield from framed((row for s, wanted in surveys for row in _first_fit(s, wanted, by_node)), PATH_COLUMNS)

    wanted = items.groupBy("survey_key").agg(F.collect_set("item").alias("items"))
    rows = packed_steps(corpus).join(wanted, "survey_key")
    return rows.mapInPandas(chosen, f"survey_key {_key_type(rows)}, path_ix int, path array<string>, edge_ids array<string>")


WAYS = "decimal(38,0)"


def _ways_by_fold(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(survey_key, hop, leaf ways) of surveys of bounded size, and the ways still under way after as many hops as there are steps."""
    step = F.struct("source", "target", "leaf", "k")
    packed = starts.join(steps.groupBy("survey_key").agg(F.collect_list(step).alias("steps")), "survey_key")
    zero, one = F.lit(0).cast(WAYS), F.lit(1).cast(WAYS)
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: (a + x["n"]).cast(WAYS))

    def hop(acc: Column, number: Column) -> Column:
        moved = F.filter(F.transform("steps", lambda s: F.struct(s["target"].alias("node"), s["leaf"].alias("leaf"), (total(F.filter(acc["front"], lambda f: f["node"] == s["source"])) * s["k"]).cast(WAYS).alias("n"))), lambda m: m["n"] > 0)
        ended = total(F.filter(moved, lambda m: m["leaf"]))
        on = F.filter(moved, lambda m: ~m["leaf"])
        front = F.transform(F.array_distinct(F.transform(on, lambda m: m["node"])), lambda t: F.struct(t.alias("node"), total(F.filter(on, lambda m: m["node"] == t)).alias("n")))
        done = F.when(ended > 0, F.array_append(acc["done"], F.struct(number.alias("hop"), ended.alias("n")))).otherwise(acc["done"])
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(front.alias("front"), done.alias("done")))

    begin = F.struct(F.array(F.struct(F.col("entry_node").alias("node"), one.alias("n"))).alias("front"), F.array().cast(f"array<struct<hop:int,n:{WAYS}>>").alias("done"))
    walked = packed.select("survey_key", F.aggregate(F.sequence(F.lit(1), F.size("steps") + 1), begin, hop).alias("w"))
    open_ = F.size("w.front") > 0
    ends = [F.when(~open_, x) for x in (total(F.col("w.done")), F.array_min(F.transform("w.done", lambda x: x["hop"])), F.array_max(F.transform("w.done", lambda x: x["hop"])))]
    return walked.select("survey_key", ends[0].alias("paths"), ends[1].alias("shortest"), ends[2].alias("longest"))


def _ways_by_joins(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """The same for surveys of any size: a join and a sum for each hop, over all of them at once."""
    most = steps.groupBy("survey_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    front = land(starts.select("survey_key", F.col("entry_node").alias("node"), F.lit(1).cast(WAYS).alias("n")), "ways")
    done = None
    for number in range(1, most + 2):
        if front.isEmpty():
            break
        moved = front.withColumnRenamed("node", "source").join(steps, ["survey_key", "source"]).groupBy("survey_key", F.col("target").alias("node"), "leaf").agg(F.sum((F.col("n") * F.col("k")).cast(WAYS)).cast(WAYS).alias("n"))
        moved = land(moved, "ways")
        ended = moved.where("leaf").groupBy("survey_key").agg(F.sum("n").cast(WAYS).alias("n")).withColumn("hop", F.lit(number))
        done = ended if done is None else done.unionByName(ended)
        if number % 10 == 0:
            done = land(done, "ended")
        front = moved.where("not leaf").select("survey_key", "node", "n")
    open_ = front.select("survey_key").distinct().withColumn("open", F.lit(True))
    counted = done.groupBy("survey_key").agg(F.sum("n").cast(WAYS).alias("paths"), F.min("hop").alias("shortest"), F.max("hop").alias("longest"))
    every = starts.select("survey_key").join(open_, "survey_key", "left").join(counted, "survey_key", "left")
    return every.select("survey_key", *[F.when(F.col("open").isNull(), F.col(c)).alias(c) for c in ("paths", "shortest", "longest")])


def path_counts(corpus: Corpus) -> DataFrame:
    """(survey_key, paths, shortest, longest): the number of ``simple_paths`` of each survey with an entry and the fewest and most edges of
    one, without listing them: ways to each node are summed hop by hop, in exact decimals (a sum beyond 38 digits is an error). Where a walk can
    come to a cycle, all three are null, as simple paths cannot be summed there."""
    edges = corpus.edges.where("source is not null and target is not null")
    ends = corpus.terminals.select("survey_key", F.col("tid").alias("node")).distinct()
    onward = edges.select("survey_key", F.col("source").alias("node")).distinct().join(ends, ["survey_key", "node"], "left_anti").withColumn("on", F.lit(True))
    steps = edges.groupBy("survey_key", "source", "target").agg(F.count("*").alias("k")).join(onward.select("survey_key", F.col("node").alias("source")), ["survey_key", "source"], "left_semi")
    steps = steps.join(onward.select("survey_key", F.col("node").alias("target"), "on"), ["survey_key", "target"], "left").withColumn("leaf", F.col("on").isNull()).drop("on")
    entries = land(corpus.surveys.where("entry_node is not null").select("survey_key", "entry_node"), "entries")
    moving = entries.join(onward.withColumnRenamed("node", "entry_node"), ["survey_key", "entry_node"], "left_semi")
    still = entries.join(moving.select("survey_key"), "survey_key", "left_anti").select("survey_key", F.lit(1).cast(WAYS).alias("paths"), F.lit(0).alias("shortest"), F.lit(0).alias("longest"))
    small, large = _by_size(steps)
    out = still.unionByName(_ways_by_fold(moving, small))
    return out if large is None else out.unionByName(_ways_by_joins(land(moving.join(large, "survey_key", "left_semi"), "moving"), large))
