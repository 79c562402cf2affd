"""Coverage tests: answers are made up for every path, checked by simulation, and a first-fit set is chosen.

Paths are worked on independently of each other, each with its survey's edges beside it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.operators.covers import minimal_cover
from routegraph.operators.graph import Steps, by_row, first_fit_paths, framed, names_of, packed_steps, truncated_surveys, with_nodes
from routegraph.operators.routes import ordered_edges
from routegraph.sources.documents import Corpus
from routegraph.store import land

# The operator that holds where another does not, and answers to try when a list is to be avoided.
OPPOSITE = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<", "in": "not_in", "not_in": "in"}
AVOIDING = (0, 1, 2, "OTHER", True, False, None)


def another_value(value: Any) -> Any:
    """An answer that differs from ``value``, or from all its elements if it is a list."""
    match value:
        case list():
            return next((x for x in AVOIDING if x not in value), "__OTHER__")
        case bool():
            return not value
        case int() | float():
            return value + 1
        case str():
            return value + "_OTHER"
        case None:
            return "__NON_NULL__"
    return "__OTHER__"


def satisfying(op: str, literal: Any) -> list[Any]:
    """The answer that makes ``op literal`` true, as a list of one, or an empty list where none is known."""
    number = isinstance(literal, int | float)
    if op in (">", "<"):
        return [literal + (1 if op == ">" else -1)] if number and not isinstance(literal, bool) else []
    if op in (">=", "<="):
        return [literal] if number else []
    if op in ("in", "not_in"):
        if not isinstance(literal, list) or (op == "in" and not literal):
            return []
        return [literal[0] if op == "in" else another_value(literal)]
    return [another_value(literal) if op == "!=" else literal]


class Answers(dict):
    """Answers made up so far. The first value of a question stays; later ones must equal it."""

    def put(self, name: str, value: Any) -> bool:
        return self.setdefault(name, value) == value

    def holds(self, node: list, want: bool) -> bool:
        try:
            return evaluate(node, self) == want
        except ConditionError:
            return False

    def settle(self, node: Any, want: bool) -> bool:
        """Make ``node`` come out as ``want``; False if that is not possible without going back."""
        if node is None:
            return want
        if not isinstance(node, list) or not node:
            return bool(node) is want
        op, rest = node[0], node[1:]
        if op in ("TRUE", "FALSE"):
            return not rest and (op == "TRUE") is want
        if op == "NOT":
            return len(rest) == 1 and self.settle(rest[0], not want)
        if op in ("AND", "OR"):
            return bool(rest) and (self._all(node, want) if (op == "AND") is want else self._any(rest, want))
        if not isinstance(op, str) or len(rest) != 2 or not isinstance(rest[0], str):
            return False
        return self._compare(node, want)

    def _any(self, parts: list, want: bool) -> bool:
        for part in parts:
            trial = Answers(self)
            if trial.settle(part, want):
                self.clear()
                self.update(trial)
                return True
        return False

    def _all(self, node: list, want: bool) -> bool:
        parts = node[1:]
        equalities = [p for p in parts if isinstance(p, list) and len(p) == 3 and p[0] == "=" and isinstance(p[1], str)]
        if not want and len(equalities) == len(parts) and len({p[1] for p in parts}) == 1:
            # one question that must equal none of several values
            name = parts[0][1]
            return self.holds(node, False) if name in self else self.put(name, another_value([p[2] for p in parts]))
        return all(self.settle(p, want) for p in parts)

    def _compare(self, node: list, want: bool) -> bool:
        op, name, literal = node
        if name in self and self.holds(node, want):
            return True
        if op == "contains":
            if want:
                return self.put(name, [literal])
            given = self.get(name)
            return (isinstance(given, list) and literal not in given) or (name not in self and self.put(name, []))
        if op not in OPPOSITE:
            return False
        return any(self.put(name, v) for v in satisfying(op if want else OPPOSITE[op], literal))


def made_up(edge_ids: list[str], edges: list[dict[str, Any]], by_source: dict[str, list[dict]]) -> dict | None:
    """Answers under which each edge of a path is the one taken; None if some edge cannot be made so."""
    last_with = {str(e.get("id", "")): e for e in edges}
    answers = Answers()
    for edge_id in edge_ids:
        edge = last_with.get(edge_id)
        if edge is None or not answers.settle(edge.get("condition"), True):
            return None
        siblings = by_source.get(edge.get("source"), [])
        own = next((i for i, e in enumerate(siblings) if str(e.get("id", "")) == edge_id), len(siblings))
        if not all(answers.settle(e.get("condition"), False) for e in siblings[:own]):
            return None
        first = next((i for i, e in enumerate(siblings[: own + 1]) if evaluate(e.get("condition"), answers)), None)
        if first != own:
            return None
    return dict(answers)


#: A route that comes to a node again goes round until it has so many edges.
MAX_STEPS = 1000


def simulate(entry: str, by_source: dict[str, list[dict]], terminals: set[str], answers: dict[str, Any]) -> tuple[list[str], list[str], int]:
    """Path and edges of one route in one survey until it ends or comes to a node again, as answers are fixed and it goes round from there; the place of that node in
    the path, or -1."""
    path, taken, at = [entry], [], {entry: 0}
    while len(taken) < MAX_STEPS and path[-1] not in terminals:
        edge = next((e for e in by_source.get(path[-1], ()) if evaluate(e.get("condition"), answers)), None)
        if edge is None or not isinstance(edge.get("target"), str):
            break
        path.append(edge["target"])
        taken.append(str(edge.get("id", "")))
        if path[-1] in at:
            return path, taken, at[path[-1]] if len(taken) < MAX_STEPS else -1
        at[path[-1]] = len(taken)
    return path, taken, -1


VERIFIED = ["survey_key", "path_ix", "path", "edge_ids", "responses", "reason", "actual_path", "actual_edge_ids"]
#: As tasks give them: ``loop`` is the place from which the actual path goes round.
LOOPED = [*VERIFIED, "loop"]


def _gone_round(found: DataFrame) -> DataFrame:
    """LOOPED rows with the actual paths of routes that go round told in full, MAX_STEPS edges."""
    times = F.floor(F.lit(MAX_STEPS) / (F.size("actual_edge_ids") - F.col("loop"))).cast("int")

    def whole(column: str, skip: int) -> Column:
        again = F.slice(column, F.col("loop") + 1 + skip, F.size(column))
        return F.when(F.col("loop") >= 0, F.slice(F.concat(column, F.flatten(F.array_repeat(again, times))), 1, MAX_STEPS + skip)).otherwise(F.col(column)).alias(column)

    return found.withColumns({"actual_path": whole("actual_path", 1), "actual_edge_ids": whole("actual_edge_ids", 0)}).drop("loop")

_condition = lru_cache(10_000)(json.loads)


def parsed(row: Any) -> tuple[list[dict[str, Any]], dict[str, list[dict]]]:
    """Edges of one survey in document order, and by source in the order in which they are tried."""
    edges = [dict(e, condition=_condition(e["condition"]) if e.get("condition") else None) for e in json.loads(row.edges)]
    return edges, ordered_edges(edges)


def _verified(row: Any, edges: list[dict[str, Any]], by_source: dict[str, list[dict]], paths: Iterator[tuple[int, list[str], list[str]]]) -> Iterator[tuple]:
    """Paths of one survey, each with answers that lead along it or the reason why there are none."""
    terminals = set(row.ends)
    for number, path, ids in paths:
        answers, actual, taken, reason, loop = None, None, None, None, -1
        try:
            answers = made_up(ids, edges, by_source)
            if answers is None:
                reason = "unsynthesizable"
            else:
                walked, followed, loop = simulate(path[0], by_source, terminals, answers)
                if loop >= 0 or (walked, followed) != (path, ids):
                    actual, taken, reason = walked, followed, "simulation_mismatch"
        except ConditionError as error:
            reason = str(error)
        yield row.survey_key, number, path, ids, None if reason else json.dumps(answers), reason, actual, taken, loop


def _with_edges(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """``rows``, one for each survey, with all its ``edges`` as JSON in document order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("edge_id", F.lit("")).alias("id"), "source", "target", "condition", "priority")))
    edges = corpus.edges.groupBy("survey_key").agg(F.to_json(listed).alias("edges"))
    return rows.join(edges, "survey_key", "left").withColumn("edges", F.coalesce("edges", F.lit("[]")))


class FirstFit:
    """A first-fit pass over the paths of one survey: a path is chosen if it holds an item that none chosen before it holds."""

    def __init__(self, items: Any) -> None:
        self.left = set(items)

    def chooses(self, held: list[str]) -> bool:
        fresh = self.left.intersection(held)
        self.left -= fresh
        return bool(fresh)


#: What a pass over the verified paths of a survey tells: its paths (``test_no`` 0 where they are not chosen), and then, as path -1, what is covered.
PASSED = [*LOOPED, "test_no", "node_covered", "edge_covered", "n_unverified", "uncovered_nodes", "uncovered_edges", "survey_id", "node_total", "edge_total", "small"]


_LIST, _LONG = pa.list_(pa.string()), pa.int64()
PASSED_TYPES = [pa.int32(), _LIST, _LIST, pa.string(), pa.string(), _LIST, _LIST, pa.int32(), pa.int32(), _LONG, _LONG, _LONG, _LIST, _LIST, pa.string(), _LONG, _LONG, pa.bool_()]


class Packed(NamedTuple):
    """One survey as the pass takes it."""

    survey_key: Any
    survey_id: str
    entry_node: str | None
    edges: str
    ends: list[str]
    nodes: list[str]
    node_total: int
    small: bool


def _passed(row: Packed, target: str, max_paths: int | None) -> Iterator[tuple]:
    """The pass over one survey, whose edges are sent and parsed once; a row that is not ``small`` only tells that it is not. Of the paths that are not chosen, those
    with answers are not told."""
    if not row.small:
        yield row.survey_key, -1, *[None] * 6, -1, 0, 0, 0, 0, None, None, None, 0, 0, False
        return
    edges, by_source = parsed(row)
    after = {source: [(e["target"], e["id"]) for e in tried if isinstance(e.get("target"), str)] for source, tried in by_source.items()}
    paths = Steps(row.survey_key, row.entry_node, set(row.ends), after).paths(max_paths) if row.entry_node is not None else iter(())
    ids = {e["id"] for e in edges}
    fit = FirstFit(row.nodes if target == "node" else ids)
    tests, unverified = 0, 0
    met_nodes: set[str] = set()
    met_edges: set[str] = set()
    for found in _verified(row, edges, by_source, ((i, *p) for i, p in enumerate(paths))):
        path, taken, reason = found[2], found[3], found[5]
        if reason is not None:
            unverified += 1
            yield *found, 0, 0, 0, 0, None, None, None, 0, 0, True
        elif fit.chooses(path if target == "node" else taken):
            tests += 1
            met_nodes.update(path)
            met_edges.update(taken)
            yield *found, tests, 0, 0, 0, None, None, None, 0, 0, True
    left = sorted(set(row.nodes) - met_nodes), sorted(ids - met_edges)
    yield row.survey_key, -1, *[None] * 6, -1, 0, len(met_nodes), len(met_edges), unverified, *left, row.survey_id, row.node_total, len(ids), True


def _packed_rows(rows: DataFrame) -> DataFrame:
    """Surveys that come as one row each (``Corpus.rows``) as the pass takes them."""
    edge = lambda e: F.struct(F.coalesce(e["edge_id"], F.lit("")).alias("id"), *[e[c].alias(c) for c in ("source", "target", "condition", "priority")])
    listed = F.to_json(F.transform("edges", edge)).alias("edges")
    return with_nodes(rows).select("survey_key", "survey_id", "entry_node", listed, names_of("terminals", "tid").alias("ends"), "nodes", F.size("nodes").cast("long").alias("node_total"), "small")


def _packed_tables(corpus: Corpus) -> DataFrame:
    """The same from the tables, for surveys of any size."""
    ends = corpus.terminals.groupBy("survey_key").agg(F.collect_set("tid").alias("ends"))
    nodes = corpus.nodes().groupBy("survey_key").agg(F.collect_list("node").alias("nodes"), F.count("*").alias("node_total"))
    rows = _with_edges(corpus, corpus.surveys.select("survey_key", "survey_id", "entry_node").join(ends, "survey_key", "left").join(nodes, "survey_key", "left"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"ends": F.coalesce("ends", none), "nodes": F.coalesce("nodes", none), "node_total": F.coalesce("node_total", F.lit(0)), "small": F.lit(True)})


def passed_surveys(corpus: Corpus, target: str, max_paths: int | None = None) -> DataFrame:
    """Columns PASSED but ``small``, landed: the tests that a first-fit pass over the verified simple paths (or the first ``max_paths``) of each survey chooses, the paths
    without answers, with the ``reason``, and a row for each survey that tells what the tests cover. A survey is passed over where its paths are listed: what is
    held at once are its edges and what is met of them, and its paths, which can be many, are neither shuffled nor kept unless they are told."""
    if target not in ("node", "edge"):
        raise ValueError(f"Unknown coverage target: {target}")
    schema = _verified_schema(corpus) + ", test_no int, node_covered long, edge_covered long, n_unverified long, uncovered_nodes array<string>, uncovered_edges array<string>, survey_id string, node_total long, edge_total long, small boolean"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("survey_key").type, *PASSED_TYPES]
            surveys = map(Packed._make, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            rows = (x for r in surveys for x in _passed(r, target, max_paths))
            while some := list(islice(rows, 2000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], PASSED)

    def over(rows: DataFrame) -> DataFrame:
        return rows.select(*Packed._fields).mapInArrow(told, schema)

    def tables(c: Corpus) -> DataFrame:
        return land(over(_packed_tables(c.landed(land))).drop("small"), "passed")

    if corpus.rows is None:
        return tables(corpus)
    rows, large = by_row(corpus, ("ord", "edge_id", "source", "target", "condition", "priority"), lambda rows: over(_packed_rows(rows)), "passed")
    return rows if large is None else rows.unionByName(tables(large))


def first_fit_numbers(corpus: Corpus, target: str) -> DataFrame:
    """(survey_key, path_ix) of the simple paths that a first-fit pass over all of them chooses, found as they are listed: a survey's listing ends with the path that
    holds the last item that is left, as none after it can be chosen."""
    if target not in ("node", "edge"):
        raise ValueError(f"Unknown coverage target: {target}")

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from framed((x for frame in batches for r in frame.itertuples(index=False) for x in _chosen_numbers(r, target)), ["survey_key", "path_ix"])

    rows = packed_steps(corpus, nodes=target == "node")
    return rows.mapInPandas(chosen, f"survey_key {rows.schema['survey_key'].dataType.simpleString()}, path_ix int")


def _chosen_numbers(row: Any, target: str) -> Iterator[tuple]:
    fit = FirstFit(row.nodes if target == "node" else row.ids)
    for number, (path, ids) in enumerate(Steps.of(row).paths()):
        if fit.chooses(path if target == "node" else ids):
            yield row.survey_key, number
        if not fit.left:
            return


def verified_first_fit(corpus: Corpus, target: str) -> DataFrame:
    """The first path of each node or edge alone, verified: polynomial, where listing all paths is exponential."""
    return verified_given(corpus, first_fit_paths(corpus, universe(corpus, target), target == "node"))


def verified_minimal(corpus: Corpus) -> DataFrame:
    """As ``verified_given``, for the walks of a minimal cover and, after them, the first path of each edge, to take the place of walks that no
    answers lead along. A first path that is a walk of the cover comes once."""
    walks = minimal_cover(corpus)
    first = first_fit_paths(corpus, universe(corpus, "edge"), False)
    both = walks.withColumn("part", F.lit(0)).unionByName(first.withColumn("part", F.lit(1)))
    once = both.groupBy("survey_key", "path", "edge_ids").agg(F.min(F.struct("part", "path_ix")).alias("at"))
    place = F.row_number().over(W.partitionBy("survey_key").orderBy("at")) - 1
    return verified_given(corpus, once.select("survey_key", place.alias("path_ix"), "path", "edge_ids"))


def verified_given(corpus: Corpus, paths: DataFrame) -> DataFrame:
    """Given paths (survey_key, path_ix, path, edge_ids), each with ``responses`` (JSON) that lead along it, or the ``reason`` why there are none."""
    each = land(paths, "given-paths").groupBy("survey_key").agg(F.array_sort(F.collect_list(F.struct("path_ix", "path", "edge_ids"))).alias("paths"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in batches for r in frame.itertuples(index=False))
        yield from framed((x for r in rows for x in _verified(r, *parsed(r), ((p["path_ix"], list(p["path"]), list(p["edge_ids"])) for p in r.paths))), LOOPED)

    ends = corpus.terminals.groupBy("survey_key").agg(F.collect_set("tid").alias("ends"))
    rows = _with_edges(corpus, each.join(ends, "survey_key", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<string>"))))
    return _gone_round(rows.mapInPandas(listed, _verified_schema(corpus)))


def _verified_schema(corpus: Corpus) -> str:
    kind = corpus.surveys.schema["survey_key"].dataType.simpleString()
    return f"survey_key {kind}, path_ix int, path array<string>, edge_ids array<string>, responses string, reason string, actual_path array<string>, actual_edge_ids array<string>, loop int"


def universe(corpus: Corpus, target: str) -> DataFrame:
    """(survey_key, item): the nodes, or the edge ids, that tests should cover."""
    if target == "node":
        return corpus.nodes().select("survey_key", F.col("node").alias("item"))
    if target != "edge":
        raise ValueError(f"Unknown coverage target: {target}")
    return corpus.edges.select("survey_key", F.coalesce("edge_id", F.lit("")).alias("item")).distinct()


def chosen_tests(candidates: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """Of candidates (survey_key, path_ix, array ``column``), those a first-fit pass over them in order would choose: a
    candidate is chosen exactly if it is the first to hold some item."""
    held = candidates.select("survey_key", "path_ix", F.explode(F.array_distinct(column)).alias("item")).join(items, ["survey_key", "item"], "left_semi")
    first = held.groupBy("survey_key", "item").agg(F.min("path_ix").alias("path_ix")).select("survey_key", "path_ix").distinct()
    return candidates.join(first, ["survey_key", "path_ix"], "left_semi")


def percent(covered: str, of: str):
    """Whole percent, halves to even; 100 of nothing."""
    return F.when(F.col(of) == 0, 100).otherwise(F.bround(F.col(covered) / F.col(of) * 100).cast("int"))


def coverage(corpus: Corpus, target: str = "edge", max_paths: int | None = None, first_only: bool = False, minimal: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests (survey_key, id, responses, expected_path, covered_edges), unverified paths, and a summary for each survey.

    All simple paths are candidates, whose number can be exponential. With ``max_paths`` the first so many of a survey are, and the
    summary tells by ``truncated`` where there are more. With ``first_only`` the first path of each item is, so that
    the work is polynomial; an item whose first path no answers lead along stays uncovered then. With ``minimal`` (edges only) the fewest walks that
    take every edge come first and first paths fill in for those that answers cannot lead along: as few tests as there can be where all walks verify
    and edge ids are unique. Of the paths without answers, only those with an edge that is left uncovered are given as unverified then."""
    if minimal and target != "edge":
        raise ValueError("A minimal cover is one of edges: the coverage target must be edge")
    if not (first_only or minimal):
        return _coverage_of_all(corpus, target, max_paths)
    corpus = corpus.landed(land)
    items = universe(corpus, target)
    found = land(verified_minimal(corpus) if minimal else verified_first_fit(corpus, target), "paths")
    chosen = chosen_tests(found.where("reason is null"), items, "path" if target == "node" else "edge_ids")
    number = F.row_number().over(W.partitionBy("survey_key").orderBy("path_ix"))
    tests = land(chosen.select("survey_key", F.format_string("TEST_%04d", number).alias("id"), "responses", F.col("path").alias("expected_path"), F.col("edge_ids").alias("covered_edges")), "tests")
    unverified = found.where("reason is not null").drop("responses")
    if minimal:
        met = tests.groupBy("survey_key").agg(F.array_distinct(F.flatten(F.collect_list("covered_edges"))).alias("met"))
        open_ = F.col("met").isNull() | (F.size(F.array_except("edge_ids", "met")) > 0)
        unverified = unverified.join(met, "survey_key", "left").where(open_).drop("met")
    return tests, unverified, coverage_summary(corpus, target, tests, unverified)


def _coverage_of_all(corpus: Corpus, target: str, max_paths: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``coverage`` with all simple paths, or the first ``max_paths`` of each survey, as candidates."""
    if corpus.rows is None:
        corpus = corpus.landed(land)
    found = passed_surveys(corpus, target, max_paths)
    tests = found.where("test_no > 0").select("survey_key", F.format_string("TEST_%04d", F.col("test_no")).alias("id"), "responses", F.col("path").alias("expected_path"), F.col("edge_ids").alias("covered_edges"))
    unverified = _gone_round(found.where("reason is not null").select(*[c for c in LOOPED if c != "responses"]))
    counts = found.where("path_ix = -1").select("survey_key", "survey_id", *COUNTS)
    summary = _shares(counts, target)
    if max_paths is not None:
        summary = summary.join(truncated_surveys(corpus, max_paths).withColumn("truncated", F.lit(True)), "survey_key", "left").na.fill(False, ["truncated"])
    return tests, unverified, summary


COUNTS = ("node_total", "node_covered", "uncovered_nodes", "edge_total", "edge_covered", "uncovered_edges", "n_unverified")


def coverage_summary(corpus: Corpus, target: str, tests: DataFrame, unverified: DataFrame) -> DataFrame:
    """Percentages, what is left uncovered, and whether coverage is complete. Covered nodes are counted as the tests meet
    them, defined or not, so a share may exceed 100."""
    def side(kind: str, column: str) -> DataFrame:
        every = universe(corpus, kind)
        met = tests.select("survey_key", F.explode(column).alias("item")).distinct()
        total = every.groupBy("survey_key").agg(F.count("*").alias(f"{kind}_total"))
        covered = met.groupBy("survey_key").agg(F.count("*").alias(f"{kind}_covered"))
        left = every.join(met, ["survey_key", "item"], "left_anti").groupBy("survey_key").agg(F.array_sort(F.collect_list("item")).alias(f"uncovered_{kind}s"))
        return total.join(covered, "survey_key", "full").join(left, "survey_key", "left")

    counts = corpus.surveys.select("survey_key", "survey_id").join(side("node", "expected_path"), "survey_key", "left").join(side("edge", "covered_edges"), "survey_key", "left")
    bad = unverified.groupBy("survey_key").agg(F.count("*").alias("n_unverified"))
    counts = counts.join(bad, "survey_key", "left").na.fill(0, ["node_total", "node_covered", "edge_total", "edge_covered", "n_unverified"])
    return _shares(counts, target)


def _shares(counts: DataFrame, target: str) -> DataFrame:
    none = F.array().cast("array<string>")
    shares = counts.withColumns(
        {
            "node_percent": percent("node_covered", "node_total"), "edge_percent": percent("edge_covered", "edge_total"),
            "uncovered_nodes": F.coalesce("uncovered_nodes", none), "uncovered_edges": F.coalesce("uncovered_edges", none), "coverage_target": F.lit(target),
        }
    )
    complete = (F.col(f"{target}_percent") == 100) & (F.size(f"uncovered_{target}s") == 0) & ((F.col("n_unverified") == 0) | F.lit(target == "node"))
    return shares.withColumn("complete", complete)
