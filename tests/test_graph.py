import random

import pytest

from routegraph.operators import graph


def random_steps(seed, surveys=6, nodes=9):
    r = random.Random(seed)
    steps = {(k, f"N{r.randrange(nodes)}", f"N{r.randrange(nodes)}") for k in range(surveys) for _ in range(r.randrange(1, 14))}
    starts = {(k, f"N{r.randrange(nodes)}") for k in range(surveys + 1) for _ in range(r.randrange(3))}
    return sorted(steps), sorted(starts)


def walked(steps, starts):
    seen = set(starts)
    while more := {(k, b) for k, a, b in steps if (k, a) in seen} - seen:
        seen |= more
    return seen


@pytest.mark.parametrize("packed", [4096, 4, 0])
def test_closure_by_fold_and_by_joins(spark, monkeypatch, packed):
    monkeypatch.setattr(graph, "PACKED", packed)
    steps, starts = random_steps(packed)
    got = graph.closure(spark.createDataFrame(starts, "survey_key int, node string"), spark.createDataFrame(steps, "survey_key int, source string, target string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(steps, starts)


def test_closure_of_a_deep_survey_and_of_none(spark):
    chain = [(1, f"N{i}", f"N{i + 1}") for i in range(600)]
    steps = spark.createDataFrame(chain, "survey_key int, source string, target string")
    assert graph.closure(spark.createDataFrame([(1, "N0")], "survey_key int, node string"), steps).count() == 601
    none = spark.createDataFrame([], "survey_key int, node string")
    assert graph.closure(none, steps.where("false")).count() == 0 and graph.closure(none, steps).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_nodes_on_cycles_by_walk_and_by_joins(spark, seed):
    steps, _ = random_steps(seed + 20)
    want = {(k, a) for k, a, _ in steps if (k, a) in walked(steps, {(j, b) for j, x, b in steps if (j, x) == (k, a)})}
    frame = spark.createDataFrame(steps, "survey_key int, source string, target string")
    joined = [tuple(r) for r in graph._cyclic_by_joins(frame).collect()]
    assert len(joined) == len(set(joined)) and set(joined) == want
    found = {(k, n) for k in {s[0] for s in steps} for n in graph._on_cycles(graph._after([a for j, a, _ in steps if j == k], [b for j, _, b in steps if j == k]))}
    assert found == want
