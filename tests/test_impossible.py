"""Impossible conditions, against trying all answers of a small domain."""

import json
import time
from itertools import combinations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from surveys import corpus, edge, survey

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.functions import domains
from routegraph.functions.domains import Judge, satisfiable, verdicts
from routegraph.operators import impossible

LISTED = [0, 1, "b", "c"]
#: Every way in which an answer can stand to the literals below: at, between and beyond them, and all lists of their elements.
ANSWERS = [None, -1, 0, 0.5, 1, 2, "", "a", "b", "bb", "c", "d", {"x": 1}, *[list(s) for n in range(5) for s in combinations(LISTED, n)], [1, "b", "b"], ["z"], ["z", 0, 1, "b", "c"]]
comparison = st.one_of(
    st.tuples(st.sampled_from(["=", "!="]), st.sampled_from("PQ"), st.sampled_from([0, 1, True, "b", "c", None, [1, "b"]])),
    st.tuples(st.sampled_from(["<", ">", "<=", ">="]), st.sampled_from("PQ"), st.sampled_from([0, 1, "b", "c"])),
    st.tuples(st.sampled_from(["in", "not_in"]), st.sampled_from("PQ"), st.lists(st.sampled_from([0, 1, "b", "c", None]), max_size=3)),
    st.tuples(st.just("contains"), st.sampled_from("PQ"), st.sampled_from(LISTED)),
    st.sampled_from([("TRUE",), ("FALSE",), ("~", "P", 1), ("=", "P"), ("in", "P", 3), ("AND",)]),
).map(list)
condition = st.recursive(
    comparison,
    lambda inner: st.one_of(
        st.tuples(st.just("NOT"), inner).map(list), st.tuples(st.sampled_from(["AND", "OR"]), inner, inner).map(list), st.tuples(st.sampled_from(["AND", "OR"]), inner, inner, inner).map(list)
    ),
    max_leaves=5,
)


def comes_out(goals, answers):
    try:
        return all(evaluate(node, answers) is want for node, want in goals)
    except ConditionError:
        return False


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(condition, st.booleans()), min_size=1, max_size=3))
def test_exact_against_trying_all_answers(goals):
    assert satisfiable(goals) == any(comes_out(goals, {"P": p, "Q": q}) for p, q in product(ANSWERS, ANSWERS))


@pytest.mark.parametrize(
    ("conditions", "want"),
    [
        ([["AND", [">", "A", 3], ["<", "A", 3]]], ["never"]),
        ([["AND", [">", "A", 3], ["<", "A", 4]]], ["possible"]),  # 3.5
        ([["<", "A", 3], [">=", "A", 3], ["=", "A", "x"], ["=", "A", None]], ["possible", "possible", "shadowed", "possible"]),  # a text errs at the first
        ([["in", "A", [1, 2]], ["=", "A", True], ["=", "A", 2.0], None, ["TRUE"]], ["possible", "shadowed", "shadowed", "possible", "shadowed"]),
        ([["AND", ["contains", "A", 1], ["contains", "A", 2]], ["AND", ["contains", "A", 1], ["=", "A", [1]]], ["AND", ["contains", "A", 2], ["=", "A", [1]]]], ["possible", "possible", "never"]),
        ([["AND", [">", "A", "m"], ["<", "A", "m\x00"]], ["AND", [">", "A", "m"], ["<", "A", "n"]], ["AND", ["<", "A", ""], ["!=", "A", None]]], ["never", "possible", "never"]),
        ([["UNPARSED", "see above"], None], ["never", "shadowed"]),
        ([0, [], 1, "no"], ["never", "never", "possible", "shadowed"]),
        ([["AND", [">", "A", 9007199254740992], ["<", "A", 9007199254740994]], ["AND", ["=", "A", 9007199254740993], ["=", "A", 9007199254740992]]], ["possible", "never"]),
    ],
)
def test_cases(conditions, want):
    assert verdicts([None if c is None else json.dumps(c) for c in conditions]) == want


def test_many_siblings_and_deep_conditions():
    began = time.time()
    assert verdicts([json.dumps(["=", "A", i]) for i in range(150)])[-1] == "possible"
    assert verdicts([json.dumps(["AND", ["=", f"A{i}", 1], ["=", f"B{i}", 1]]) for i in range(60)] + [None]) == ["possible"] * 61
    deep = ["=", "A", 1]
    for _ in range(400):
        deep = ["NOT", deep]
    assert satisfiable([(deep, True)]) and not satisfiable([(deep, True), (deep, False)])
    assert time.time() - began < 20


SHARED = Judge()


@settings(max_examples=600, deadline=None)
@given(st.lists(condition, min_size=1, max_size=5))
def test_a_judge_of_many_sources_says_what_the_search_says(conditions):
    texts = [json.dumps(c) for c in conditions]
    assert SHARED.verdicts(texts) == Judge().verdicts(texts) == verdicts(texts)


def test_a_judge_whose_grids_are_too_small_begins_anew_or_searches(monkeypatch):
    monkeypatch.setattr(domains, "MOST_BITS", 30)
    judge, cases = Judge(), [[["=", "A", i], ["in", "A", [i, i + 1]], ["AND", ["=", "A", i], ["=", "B", 2]], None] for i in range(5)]
    deep = ["=", "A", 1]
    for _ in range(400):
        deep = ["NOT", deep]
    for case in [*cases, *[c[:2] for c in cases], [["=", "A", 1], deep], []]:
        texts = [None if c is None else json.dumps(c) for c in case]
        assert judge.verdicts(texts) == verdicts(texts)


def test_each_different_condition_is_evaluated_once_over_many_sources(monkeypatch):
    searched = []
    monkeypatch.setattr(domains, "satisfiable", lambda goals: searched.append(goals) or satisfiable(goals))
    judge, began = Judge(), time.time()
    # 9,000 different sources of 30 conditions
    for a, b, c in combinations(range(39), 3):
        judge.verdicts([json.dumps(x) for x in (["<", "A", a % 10], [">=", "A", b % 10], ["=", "B", c % 10])])
    assert not searched and len(next(iter(judge.shared.values())).known) == 30
    assert time.time() - began < 20


def test_edges_of_surveys(spark):
    one = survey([edge("E3", "Q1", "END", None, 3), edge("E2", "Q1", "Q2", ["<", "Q1", 5], 2), edge("E1", "Q1", "Q2", ["<=", "Q1", 5], 1), edge("E4", "Q2", "END", ["FALSE"]), edge("E5", "Q2", "END", None, 4)])
    two = survey([edge("E1", "Q1", "END"), edge("E1", "Q1", "Q2", ["=", "Q2", 1], 2), edge("E9", None, "END")])
    rows = impossible.impossible_edges(corpus(spark, one, two, survey([]))).collect()
    assert sorted((r["survey_key"], r["edge_id"], r["rank"], r["verdict"]) for r in rows) == [(0, "E2", 2, "shadowed"), (0, "E4", 1, "never"), (1, "E1", 2, "shadowed")]
