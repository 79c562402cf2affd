"""Routes through many surveys: by one fold for each respondent, and by hops, against a walk in Python."""

import json
import random

import pytest
from surveys import corpus, edge, survey

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.operators import routes


def walk(document, answers, max_steps=1000):
    dag, ends = document["survey"]["dag"], document["survey"]["terminal_nodes"]
    node = dag["entry_node"]
    if not node:
        return [], [], "missing_entry_node"
    order = sorted(enumerate(dag["edges"]), key=lambda e: (e[1]["priority"], e[1]["id"], e[0]))
    path, taken = [node], []
    for _ in range(max_steps):
        if node in ends:
            return path, taken, "terminal"
        try:
            step = next((e for _, e in order if e["source"] == node and evaluate(e["condition"], answers)), None)
        except ConditionError as error:
            return path, taken, str(error)
        if step is None:
            return path, taken, "no_matching_edge"
        if step["target"] is None:
            return path, taken, "invalid_edge"
        node = step["target"]
        path, taken = [*path, node], [*taken, step["id"]]
        if node in path[:-1]:
            return path, taken, "max_steps"
    return path, taken, "max_steps"


def drawn(r, k):
    conditions = [None, None, ["=", "Q1", 1], [">", "Q2", 1], ["NOT", ["=", "Q3", 2]], ["in", "Q1", [0, 2]], ["~", "Q1", 1], ["OR", ["=", "Q1", 0], ["<", "Q2", "x"]]]
    edges = [edge(f"E{r.randrange(9)}", f"Q{r.randrange(1, 5)}", r.choice(["Q1", "Q2", "Q3", "Q4", "END", "LOST", None]), r.choice(conditions), r.randrange(1, 4)) for _ in range(r.randrange(9))]
    return survey(edges, questions=("Q1", "Q2", "Q3", "Q4"), entry=r.choice(["Q1", "Q1", "Q2", "END", None]))


@pytest.mark.parametrize(("packed", "max_steps"), [(4096, 1000), (3, 1000), (0, 2), (4096, 2), (4096, 0)])
def test_routes_equal_a_walk(spark, monkeypatch, packed, max_steps):
    monkeypatch.setattr(routes, "PACKED", packed)
    r = random.Random(packed + max_steps)
    documents = [drawn(r, k) for k in range(30)]
    people = [(k, f"p{i}", {f"Q{j}": r.choice([0, 1, 2, None]) for j in range(1, 4) if r.random() < 0.8}) for k in range(30) for i in range(3)]
    people.append((3, "silent", None))
    given = spark.createDataFrame([(k, p, None if a is None else json.dumps(a)) for k, p, a in people] + [(99, "no survey", "{}")], "survey_key int, respondent string, answers string")
    got = {(x["survey_key"], x["respondent"]): (x["path"], x["edge_ids"], x["reason"]) for x in routes.corpus_routes(given, corpus(spark, *documents), max_steps).collect()}
    assert got == {(k, p): walk(documents[k], a or {}, max_steps) for k, p, a in people}


def test_a_fold_needs_no_job_for_a_hop(spark):
    chain = survey([edge(f"E{i}", f"Q{i}", f"Q{i + 1}") for i in range(300)], questions=[f"Q{i}" for i in range(301)], entry="Q0")
    given = spark.createDataFrame([(0, i, "{}") for i in range(50)], "survey_key int, respondent int, answers string")
    rows = routes.corpus_routes(given, corpus(spark, chain)).collect()
    assert len(rows) == 50 and all(len(r["path"]) == 301 and r["reason"] == "no_matching_edge" for r in rows)
