import random

import pytest
from surveys import corpus, edge, survey
from test_first_fit import diamonds

from routegraph.operators import graph


@pytest.mark.parametrize("packed", [4096, 5, 0])
def test_counts_equal_listed_paths(spark, monkeypatch, packed):
    monkeypatch.setattr(graph, "PACKED", packed)
    r = random.Random(packed)
    documents = []
    for _ in range(25):
        edges = [edge(f"E{i}", f"Q{r.randrange(1, 6)}", r.choice(["Q2", "Q3", "Q4", "Q5", "END", "LOST"]), None, i) for i in range(r.randrange(9))]
        if r.random() < 0.6:  # forward only: no cycles
            edges = [e for e in edges if e["target"][0] != "Q" or e["source"] < e["target"]]
        documents.append(survey(edges, questions=[f"Q{i}" for i in range(1, 6)], entry=r.choice(["Q1", "Q1", "END", "Q9", None])))
    documents.append(survey([edge("E1", "Q1", "Q2"), edge("E2", "Q2", "Q1"), edge("E3", "Q1", "END", None, 2)]))
    c = corpus(spark, *documents)
    listed = {}
    for x in graph.simple_paths(c).collect():
        listed.setdefault(x["survey_key"], []).append(x["path"])
    want = {}
    for k, paths in listed.items():
        sizes = [len(p) - 1 for p in paths]
        closed = any(len(set(p)) < len(p) for p in paths)
        want[k] = (None, None, None) if closed else (len(paths), min(sizes), max(sizes))
    assert {v[0] is None for v in want.values()} == {True, False}
    assert {x["survey_key"]: (x["paths"] and int(x["paths"]), x["shortest"], x["longest"]) for x in graph.path_counts(c).collect()} == want


def test_sixty_diamonds_have_two_to_the_sixtieth_paths(spark):
    got = graph.path_counts(corpus(spark, diamonds(60))).first()
    assert (int(got["paths"]), got["shortest"], got["longest"]) == (2**60, 121, 121)
