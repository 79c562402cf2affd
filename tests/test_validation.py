import copy
import json

import pytest
from surveys import DANGLING, LOOP, NO_DEFAULT, ORPHAN, VALID, corpus, edge, survey

from routegraph.operators.validation import validate


def found(spark, *documents, schema=False):
    rows = validate(corpus(spark, *documents), schema).orderBy("survey_key", "issue_no").collect()
    return [[r for r in rows if r["survey_key"] == k] for k in range(len(documents))]


def test_one_issue_list_for_each_kind_of_damage(spark):
    got = [[(r["type"], r["node_id"], r["edge_id"]) for r in x] for x in found(spark, VALID, ORPHAN, NO_DEFAULT, DANGLING, LOOP, schema=True)]
    assert got == [
        [],
        [("missing_outgoing_edge", "Q2", None), ("orphan_node", "Q2", None)],
        [("missing_fallthrough", "Q1", None)],
        [("missing_edge_target", "NOWHERE", "E1"), ("unreachable_terminal", "END", None), ("orphan_node", "Q2", None), ("dead_end", "Q1", None)],
        [("unreachable_terminal", "END", None), ("cycle_detected", "Q1", None), ("dead_end", "Q1", None), ("dead_end", "Q2", None)],
    ]


def test_ids_messages_and_evidence(spark):
    rows = found(spark, LOOP)[0]
    assert [r["id"] for r in rows] == [f"ISSUE_{i:04d}" for i in range(1, 5)]
    assert all(r["severity"] == "error" and r["status"] == "open" and r["recommendation_ids"] == [] for r in rows)
    assert json.loads(rows[1]["evidence"]) == {"cycle": ["Q1", "Q2", "Q1"]}
    assert rows[0]["message"] == "Terminal node END is not reachable from the entry node."


def test_references_conditions_and_priorities(spark):
    edges = [
        edge("A", "Q1", "Q2", ["AND", ["=", "Q9", 1], ["~", "Q1", 2], ["NOT", ["UNPARSED", "x"]], ["in", "Q8", ["=", "Q7"]]], 1), edge("B", "Q1", "END", None, 1), edge("C", "GONE", "END", None, 2),
        edge("D", "Q2", "END", [5, "Q1"], True), edge("E", "Q2", "END", None, True), edge("F", "Q2", "END", None, 1.0), edge("G", "Q2", "END", None, 1),
    ]
    rows = found(spark, survey(edges, entry="NOPE", listed=["END", "LOST", 5, "Q1"]))[0]
    got = [(r["type"], r["node_id"], r["edge_id"]) for r in rows]
    assert got[:11] == [
        ("missing_entry_node", "NOPE", None), ("missing_terminal_node", "LOST", None), ("missing_terminal_node", "Q1", None), ("missing_edge_source", "GONE", "C"),
        ("unknown_condition_operator", None, "A"), ("unparsed_condition", None, "A"), ("missing_condition_variable", "Q8", "A"), ("missing_condition_variable", "Q9", "A"),
        ("unknown_condition_operator", None, "D"), ("duplicate_priority", "Q1", None), ("unreachable_terminal", "END", None),
    ]
    assert json.loads(rows[9]["evidence"]) == {"priority": 1, "edge_ids": ["A", "B"]}


@pytest.mark.parametrize("item", [None, 123, "text", []])
def test_items_that_are_no_edges_are_passed_over(spark, item):
    doc = copy.deepcopy(VALID)
    doc["survey"]["dag"]["edges"].append(item)
    assert found(spark, doc)[0] == []


def test_wrong_containers_are_empty(spark):
    docs = [survey([]) for _ in range(5)]
    docs[0]["survey"]["dag"]["edges"] = "x"
    docs[1]["survey"]["dag"]["terminal_nodes"] = {"a": 1}
    docs[2]["survey"]["questions"] = [1]
    docs[3]["survey"]["dag"] = None
    docs[4] = []
    got = [[r["type"] for r in x] for x in found(spark, *docs)]
    assert got[0] == ["missing_outgoing_edge"] * 2 + ["unreachable_terminal", "orphan_node", "dead_end"]
    assert got[2][0] == "missing_entry_node" and got[3][0] == "missing_entry_node" and got[4] == ["missing_entry_node"]


def test_disconnected_cycle_terminals_and_self_loops(spark):
    edges = [edge("E1", "Q1", "END", kind="terminal"), edge("E2", "Q2", "Q3"), edge("E3", "Q3", "Q2"), edge("E4", "Q4", "Q4"), edge("E5", "END", "Q1")]
    rows = found(spark, survey(edges, questions=("Q1", "Q2", "Q3", "Q4")))[0]
    assert [json.loads(r["evidence"])["cycle"] for r in rows if r["type"] == "cycle_detected"] == [["Q2", "Q3", "Q2"], ["Q4", "Q4"]]
    assert not [r for r in rows if r["type"] == "dead_end"]


def test_schema_issues_come_first(spark):
    doc = copy.deepcopy(ORPHAN)
    doc["survey"]["metadata"]["created_date"] = "2026-13-40T00:00:00Z"
    rows = found(spark, doc, schema=True)[0]
    assert rows[0]["type"] == "schema_invalid" and json.loads(rows[0]["evidence"]) == {"path": ["survey", "metadata", "created_date"]}
