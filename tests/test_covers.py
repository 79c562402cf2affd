"""The fewest walks that take every edge: against the largest set of edges of which no walk takes two, and in coverage tests."""

import time
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from surveys import LOOP, corpus, edge, survey
from test_first_fit import diamonds

from routegraph.operators import coverage, covers, graph

NODES = ["A", "B", "C", "D", "E"]


def largest_antichain(edges):
    """Brute force over all sets of edges (source, target, id) that can be reached from A."""
    reach = {n: {n} for n in {x for e in edges for x in e[:2]} | {"A"}}
    for _ in edges:
        for source, target, _name in edges:
            for seen in reach.values():
                if source in seen and source != "END":
                    seen.add(target)
    live = [e for e in edges if e[0] in reach["A"] and e[0] != "END"]
    after = {(a, b) for a in live for b in live if b[0] in reach[a[1]] and a[1] != "END"}
    for n in range(len(live), 0, -1):
        if any(all((a, b) not in after and (b, a) not in after for a, b in combinations(s, 2)) for s in combinations(live, n)):
            return n, live
    return 1, live


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([*NODES, "END"]), st.sampled_from([*NODES, "END", "LOST"])), max_size=8))
def test_as_few_as_the_largest_set_of_edges_apart(pairs):
    edges = [(s, t, f"e{i}") for i, (s, t) in enumerate(pairs)]
    after = {}
    for s, t, name in edges:
        after.setdefault(s, []).append((t, name))
    steps = graph.Steps(1, "A", {"END"}, after)
    walks = list(covers.fewest_walks(steps))
    number, live = largest_antichain(edges)
    assert len(walks) == number
    known = {name: (s, t) for s, t, name in edges}
    for path, ids in walks:
        assert path[0] == "A" and [known[x] for x in ids] == list(zip(path, path[1:], strict=False))
        assert path[-1] == "END" or not after.get(path[-1]) or path[-1] in path[:-1]
    assert {x for _, ids in walks for x in ids} == {e[2] for e in live}
    greedy = list(graph._first_fit(steps, set(known), False))
    assert len(walks) <= max(1, len(greedy))
    if all(len(set(p)) == len(p) for p, _ in steps.paths()):
        every = list(steps.paths())
        assert all(w in every for w in walks)


def wide(n):
    """A first-fit pass takes n + n - 1 paths of the two layers of n parallel edges; n are enough."""
    return survey([edge(f"{x}{i:04d}", s, t, ["=", s, i], i) for x, s, t in (("A", "Q1", "Q2"), ("B", "Q2", "END")) for i in range(n)])


def test_layers_diamonds_cycles_and_empty_surveys(spark):
    c = corpus(spark, wide(40), diamonds(60), LOOP, survey([], entry="Q1"), survey([edge("E1", "Q1", "END")], entry=None), survey([edge("E1", "END", "Q1"), edge("E2", "Q1", "END")]))
    rows = covers.minimal_cover(c).collect()
    got = {k: [r for r in rows if r["survey_key"] == k] for k in range(6)}
    assert {k: len(v) for k, v in got.items()} == {0: 40, 1: 2, 2: 1, 3: 1, 4: 0, 5: 1}
    assert got[2][0]["path"] == ["Q1", "Q2", "Q1"] and got[3][0]["path"] == ["Q1"] and got[5][0]["path"] == ["Q1", "END"]
    assert graph.first_fit_paths(c, coverage.universe(c, "edge"), False).where("survey_key = 0").count() == 79


def test_a_wide_survey_takes_seconds():
    n = 1500
    after = {"S": [(f"M{i % 30}", f"a{i}") for i in range(n)]} | {f"M{j}": [(f"N{(j * 7 + i) % 30}", f"b{j}-{i}") for i in range(20)] for j in range(30)} | {f"N{j}": [("END", f"c{j}")] for j in range(30)}
    began = time.time()
    walks = list(covers.fewest_walks(graph.Steps(1, "S", {"END"}, after)))
    assert len(walks) == n and time.time() - began < 20


@pytest.mark.parametrize("minimal", [False, True])
def test_verified_tests(spark, minimal):
    loop = survey([edge("E1", "Q1", "Q2"), edge("E2", "Q2", "Q1", ["=", "Q2", 1]), edge("E3", "Q2", "END", None, 2)])
    # of the two walks that are enough for the edges, one asks Q1 to be two things at once; first-fit paths take its place
    clash = survey([edge("E1", "Q1", "Q2", ["=", "Q1", 1]), edge("E2", "Q1", "Q2", None, 2), edge("E3", "Q2", "END", ["=", "Q1", 2]), edge("E4", "Q2", "END", None, 2)])
    c = corpus(spark, diamonds(8), loop, clash, wide(5))
    tests, unverified, summary = coverage.coverage(c, "edge", first_only=True, minimal=minimal)
    count = {r["survey_key"]: r["n"] for r in tests.groupBy("survey_key").count().withColumnRenamed("count", "n").collect()}
    share = {r["survey_key"]: (r["edge_percent"], r["complete"]) for r in summary.collect()}
    assert (count[0], count[3]) == ((2, 5) if minimal else (9, 9))
    assert share[0] == share[3] == (100, True)
    assert count[1] == 1 and share[1] == (67, False)
    left = {r["survey_key"] for r in unverified.collect()}
    assert left >= {1} and not left & {0, 3}


def test_nodes_have_no_minimal_cover(spark):
    with pytest.raises(ValueError, match="edge"):
        coverage.coverage(corpus(spark, LOOP), "node", minimal=True)
