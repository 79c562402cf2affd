import json
import random

import pytest
from pyspark.sql import functions as F
from surveys import VALID, corpus, edge, survey

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.functions.conditions import json_answers
from routegraph.operators import coverage, graph, routes
from routegraph.streaming.respondents import gathered_answers, routed_stream


def random_survey(seed):
    r = random.Random(seed)
    qs = [f"Q{i}" for i in range(1, 6)]
    edges = []
    for i in range(12):
        condition = r.choice([None, ["=", r.choice(qs), r.randint(0, 2)], [">", r.choice(qs), 1], ["in", r.choice(qs), [1, 2]], ["NOT", ["=", r.choice(qs), 1]], ["~", "Q1", 1], ["OR", ["=", "Q1", 1], ["=", "Q1", 2]]])
        edges.append(edge(f"E{i}", r.choice(qs), r.choice([*qs, "END", "END", "GONE", 5]), condition, r.choice([1, 2, 3, 1.5, None])))
    return survey(edges, questions=qs)


def by_hand(doc, answers, max_steps=1000):
    body = doc["survey"]
    tried = lambda e: (e["priority"] if type(e["priority"]) is int else 999, e["id"])
    path, taken = [body["dag"]["entry_node"]], []
    for _ in range(max_steps):
        if path[-1] in body["terminal_nodes"]:
            return path, taken, "terminal"
        try:
            e = next((e for e in sorted((e for e in body["dag"]["edges"] if e["source"] == path[-1]), key=tried) if evaluate(e["condition"], answers)), None)
        except ConditionError as error:
            return path, taken, str(error)
        if e is None:
            return path, taken, "no_matching_edge"
        if not isinstance(e["target"], str):
            return path, taken, "invalid_edge"
        looped = e["target"] in path
        path, taken = [*path, e["target"]], [*taken, e["id"]]
        if looped:
            return path, taken, "max_steps"
    return path, taken, "max_steps"


@pytest.mark.parametrize("seed", range(3))
def test_compiled_and_data_driven_routes_agree_with_a_walk(spark, seed):
    doc = random_survey(seed)
    r = random.Random(seed)
    people = [(0, i, json.dumps({f"Q{k}": r.randint(0, 3) for k in range(1, 6) if r.random() < 0.8})) for i in range(25)]
    frame = spark.createDataFrame(people, "survey_key int, respondent int, answers string")
    want = {i: by_hand(doc, json.loads(a)) for _, i, a in people}
    body = doc["survey"]["dag"]
    parsed = frame.withColumn("m", json_answers(F.col("answers")))
    compiled = routes.compiled_routes(parsed, "Q1", body["edges"], ["END"], lambda q: F.col("m")[q])
    data = routes.corpus_routes(frame, corpus(spark, doc))
    for rows in (compiled, data):
        assert {x["respondent"]: (x["path"], x["edge_ids"], x["reason"]) for x in rows.collect()} == want
    assert "Exchange" not in compiled._jdf.queryExecution().executedPlan().toString()


def test_step_limits_and_missing_entry(spark):
    frame = spark.createDataFrame([(0, 1, "{}")], "survey_key int, respondent int, answers string")
    edges = VALID["survey"]["dag"]["edges"]
    for limit, want in ((0, ["Q1"]), (1, ["Q1", "Q2"]), (2, ["Q1", "Q2", "END"])):
        r = routes.compiled_routes(frame, "Q1", edges, ["END"], lambda q: F.lit(None), limit).first()
        assert (r["path"], r["reason"]) == (want, "max_steps")
        r = routes.corpus_routes(frame, corpus(spark, VALID), limit).first()
        assert (r["path"], r["reason"]) == (want, "max_steps")
    assert routes.compiled_routes(frame, None, edges, ["END"], lambda q: F.lit(None)).first()["reason"] == "missing_entry_node"
    assert routes.corpus_routes(frame, corpus(spark, survey([], entry=None))).first()["reason"] == "missing_entry_node"


def paths_by_hand(doc):
    body = doc["survey"]
    tried = lambda e: (e[1]["priority"] if type(e[1]["priority"]) is int else 999, e[1]["id"], e[0])
    out = []

    def go(path, ids):
        after = [e for _, e in sorted((x for x in enumerate(body["dag"]["edges"]) if x[1]["source"] == path[-1]), key=tried)]
        if path[-1] in body["terminal_nodes"] or not after or path[-1] in path[:-1]:
            out.append((path, ids))
            return
        for e in after:
            go([*path, e["target"]], [*ids, e["id"]])

    go([body["dag"]["entry_node"]], [])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_come_in_depth_first_order(spark, seed):
    doc = random_survey(seed + 10)
    for e in doc["survey"]["dag"]["edges"]:
        e["target"] = e["target"] if isinstance(e["target"], str) else "END"
    rows = graph.simple_paths(corpus(spark, doc)).orderBy("path_ix").collect()
    assert [(r["path"], r["edge_ids"]) for r in rows] == paths_by_hand(doc)


def test_first_fit_is_the_fold(spark):
    r = random.Random(0)
    rows = [(k, i, [str(r.randint(0, 12)) for _ in range(r.randint(0, 5))]) for k in range(20) for i in range(8)]
    items = [(k, str(x)) for k in range(20) for x in range(10)]
    got = coverage.chosen_tests(spark.createDataFrame(rows, "survey_key int, path_ix int, held array<string>"), spark.createDataFrame(items, "survey_key int, item string"), "held")
    want = set()
    for k in range(20):
        left = {x for s, x in items if s == k}
        for s, i, held in rows:
            if s == k and left & set(held):
                want.add((k, i))
                left -= set(held)
    assert {(x["survey_key"], x["path_ix"]) for x in got.collect()} == want


def test_coverage_of_a_branch(spark):
    doc = survey([edge("E1", "Q1", "Q2", ["OR", ["=", "Q1", 1], ["=", "Q1", 2]], 1), edge("E2", "Q1", "END", None, 999), edge("E3", "Q2", "END", [">", "Q2", 4], 1), edge("E4", "Q2", "Q1", None, 2)])
    tests, unverified, summary = coverage.coverage(corpus(spark, doc), "edge")
    got = [(t["id"], json.loads(t["responses"]), t["expected_path"]) for t in tests.orderBy("id").collect()]
    assert got == [("TEST_0001", {"Q1": 1, "Q2": 5}, ["Q1", "Q2", "END"]), ("TEST_0002", {"Q1": 0}, ["Q1", "END"])]
    bad = unverified.collect()
    assert [(b["path"], b["reason"]) for b in bad] == [(["Q1", "Q2", "Q1"], "simulation_mismatch")]
    s = summary.first()
    assert (s["node_percent"], s["edge_percent"], s["uncovered_edges"], s["complete"]) == (100, 75, ["E4"], False)
    assert coverage.coverage(corpus(spark, VALID), "node")[2].first()["complete"]
    with pytest.raises(ValueError, match="Unknown coverage target"):
        coverage.coverage(corpus(spark, VALID), "leaf")


@pytest.mark.parametrize("op", ["=", "!=", ">", "<", ">=", "<=", "in", "not_in", "contains"])
@pytest.mark.parametrize("want", [True, False])
def test_made_up_answers_hold(op, want):
    for literal in ([[1, 2], [None], ["OTHER", 0, 1, 2]] if op in ("in", "not_in") else [3, 2.5] if op in (">", "<", ">=", "<=") else [3, "x", None, True, [1]]):
        answers = coverage.Answers()
        node = [op, "Q", literal]
        assert answers.settle(node, want) and evaluate(node, answers) is want
        assert coverage.Answers().settle(["NOT", node], want) and coverage.Answers().settle(["AND", ["TRUE"], node], want)


def test_contradictions_and_branches():
    assert not coverage.Answers().settle(["AND", ["=", "Q", 1], ["=", "Q", 2]], True)
    a = coverage.Answers()
    assert a.settle(["OR", ["AND", ["=", "Q", 1], ["=", "Q", 2]], ["=", "R", 5]], True) and a == {"R": 5}
    assert not coverage.Answers().settle(None, False) and not coverage.Answers().settle(["in", "Q", []], True) and not coverage.Answers().settle([">", "Q", True], True)


def test_streams(spark, tmp_path):
    frame = spark.createDataFrame([("a", '{"Q1": 1}'), ("b", "{}")], "respondent string, answers string")
    frame.write.json(str(tmp_path / "in"))
    doc = survey([edge("E1", "Q1", "Q2", ["=", "Q1", 1], 1), edge("E2", "Q1", "END", None, 2), edge("E3", "Q2", "END")])
    stream = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    q = routed_stream(stream, "Q1", doc["survey"]["dag"]["edges"], ["END"]).writeStream.format("memory").queryName("routed").start()
    q.processAllAvailable()
    q.stop()
    assert {r["respondent"]: ">".join(r["path"]) for r in spark.table("routed").collect()} == {"a": "Q1>Q2>END", "b": "Q1>END"}
    events = spark.sql("SELECT 'a' AS respondent, timestamp'2026-01-01 00:00:00' AS ts, 'Q1' AS question, '1' AS answer UNION ALL SELECT 'a', timestamp'2026-01-01 00:05:00', 'Q1', '2' UNION ALL SELECT 'a', timestamp'2026-01-01 00:06:00', 'Q2', '\"x\"' UNION ALL SELECT 'a', timestamp'2026-01-01 05:00:00', 'Q1', '3'")
    got = sorted(r["answers"] for r in gathered_answers(events).collect())
    assert [json.loads(x) for x in got] == [{"Q1": 2, "Q2": "x"}, {"Q1": 3}]


def test_coverage_queries_verify_every_order(spark, tmp_path):
    from routegraph.plans.derived import order_corpus
    from routegraph.plans.queries import QUERIES

    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string, l_returnflag string"
    # order 1: E001 needs Q1 = 1, E002 always holds, E003 comes after E002 and can never be taken; order 2: one edge
    lines = [(1, 1, 4, 7, 1.0), (1, 1, 1, 1, 2.0), (1, 1, 5, 1, 3.0), (1, 2, 1, 1, 1.0), (1, 3, 1, 1, 1.0), (2, 1, 1, 1, 1.0)]
    rows = [(*x, float(i), 0.0, 0.0, "d", "A" if i == 0 else "R") for i, x in enumerate(lines)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    c, d = order_corpus(spark, str(tmp_path)), str(tmp_path)
    edges, entry = {}, {r["survey_key"]: r["entry_node"] for r in c.surveys.collect()}
    for e in c.edges.orderBy("survey_key", "ord").collect():
        edges.setdefault(e["survey_key"], []).append({"id": e["edge_id"], "source": e["source"], "target": e["target"], "condition": json.loads(e["condition"]) if e["condition"] else None, "priority": e["priority"]})
    found = {}
    for k in edges:  # brute force over the answers that the conditions can tell apart
        body = {"survey": {"dag": {"entry_node": entry[k], "edges": edges[k]}, "terminal_nodes": ["END"]}}
        asked = sorted({e["condition"][1] for e in edges[k] if e["condition"]})
        found[k] = {tuple(by_hand(body, {q: v for q in asked})[1]) for v in (0, 1, 2, 3)}
    tests = QUERIES["coverage_tests"](spark, d).collect()
    assert {r["survey_key"] for r in tests} == {1, 2}
    for r in tests:
        body = {"survey": {"dag": {"entry_node": entry[r["survey_key"]], "edges": edges[r["survey_key"]]}, "terminal_nodes": ["END"]}}
        path, taken, reason = by_hand(body, json.loads(r["responses"]))
        assert (">".join(path), ">".join(taken), reason) == (r["path"], r["edge_ids"], "terminal")
    for r in QUERIES["coverage_verified_summary"](spark, d).collect():
        k = r["survey_key"]
        assert r["edge_percent"] == round(len({e for t in found[k] for e in t}) / len(edges[k]) * 100)
        assert r["complete"] == (k == 2) and (r["n_unverified"] > 0) == (k == 1)
    assert {r["survey_key"] for r in QUERIES["coverage_tests_nodes"](spark, d).collect()} == {1, 2}
