import copy
import json

import pytest
from surveys import DANGLING, LOOP, NO_DEFAULT, ORPHAN, VALID, corpus, edge, survey

from routegraph import __version__, cli
from routegraph.operators import convert, healing, patching, report
from routegraph.operators.validation import validate
from routegraph.store import land


def advice(spark, doc):
    c = corpus(spark, doc)
    issues = land(validate(c, False), "issues")
    rows = land(healing.recommend(c, issues), "recommendations")
    return c, issues, rows


def added(row):
    e = row["patch"][0]["edge"]
    return row["type"], e["id"], e["source"], e["target"], e["priority"], e["type"]


def test_fallthrough_orphan_and_exit(spark):
    _, _, rows = advice(spark, NO_DEFAULT)
    assert [added(r) for r in rows.collect()] == [("add_fallthrough_edge", "E_AUTO_0001", "Q1", "Q2", 999, "fallthrough")]
    _, issues, rows = advice(spark, ORPHAN)
    got = rows.orderBy("rec_no").collect()
    assert [added(r) for r in got] == [("connect_orphan_node", "E_AUTO_0001", "Q1", "Q2", 999, "fallthrough"), ("add_terminal_exit", "E_AUTO_0002", "Q2", "END", 999, "terminal")]
    linked = healing.link(issues, rows).orderBy("issue_no").collect()
    assert [(r["status"], r["recommendation_ids"]) for r in linked] == [("recommended", ["REC_0002"]), ("recommended", ["REC_0001"])]


def test_taken_numbers_are_skipped(spark):
    doc = survey([edge("E_AUTO_0001", "Q1", "Q2", ["=", "Q1", 1], 1), edge("E2", "Q1", "Q3", ["=", "Q1", 2], 999), edge("E3", "Q2", "END", None, 4), edge("E4", "Q3", "END")], questions=("Q1", "Q2", "Q3", "Q4"))
    _, _, rows = advice(spark, doc)
    got = [added(r) for r in rows.orderBy("rec_no").collect()]
    assert got == [("connect_orphan_node", "E_AUTO_0002", "Q3", "Q4", 999, "fallthrough"), ("add_fallthrough_edge", "E_AUTO_0002", "Q1", "Q2", 1000, "fallthrough"), ("add_terminal_exit", "E_AUTO_0003", "Q4", "END", 999, "terminal")]


def test_orphan_goes_before_the_first_unconditional_edge(spark):
    doc = survey([edge("E1", "Q1", "END", None, 3), edge("E2", "Q1", "END", ["=", "Q1", 1], 2, "other")])
    _, _, rows = advice(spark, doc)
    assert added(rows.orderBy("rec_no").first())[4] == 1


def test_duplicate_priorities_move_up(spark):
    doc = survey([edge("A", "Q1", "Q2", None, 1), edge("B", "Q1", "Q2", None, 1), edge("C", "Q1", "END", None, 2), edge("D", "Q1", "END", None, 1), edge("E", "Q2", "END")])
    c, _, rows = advice(spark, doc)
    patch = rows.first()["patch"]
    assert [(p["op"], p["edge_id"], p["priority"]) for p in patch] == [("update_edge", "B", 3), ("update_edge", "D", 4)]
    decisions = spark.createDataFrame([(0, 0, "REC_0001", "approved", "me", "ok"), (0, 1, "REC_0001", "approved", "me", "again"), (0, 2, "REC_0009", "rejected", "me", "no")], "survey_key int, pos int, recommendation_id string, decision string, approver string, rationale string")
    patched, log, counts = patching.apply_patches(c, rows, decisions)
    assert {r["edge_id"]: r["priority"] for r in patched.edges.collect()} == {"A": 1, "B": 3, "C": 2, "D": 4, "E": 1}
    assert tuple(counts.first())[1:] == (3, 1, 2, 3)
    assert [(r["issue_id"], r["decision"]) for r in log.orderBy("pos").collect()] == [("ISSUE_0001", "approved"), ("ISSUE_0001", "approved"), (None, "rejected")]
    again, _, counts = patching.apply_patches(patched, rows, decisions)
    assert counts.first()["applied_count"] == 0 and again.edges.count() == 5


def test_decision_errors(spark):
    columns = "survey_key int, pos int, recommendation_id string, decision string, approver string, rationale string"
    rows = [(0, 0, "R", "approved", "a", "r"), (1, 0, "R", "pending", "a", "r"), (2, 0, "R", "rejected", " ", "r"), (3, 1, None, "approved", "a", "r")]
    got = {r["survey_key"]: r["error"] for r in patching.decision_errors(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: "Decision must be approved or rejected before apply", 2: "Decision field approver must be a non-empty string", 3: "Decision field recommendation_id must be a non-empty string"}


def test_reports(spark):
    c = corpus(spark, VALID, NO_DEFAULT)
    texts = {r["survey_key"]: r["report"] for r in report.markdown_reports(c, validate(c, False)).collect()}
    head = "# Validation Report: small_survey\n\n- Entry node: `Q1`\n- Questions: 2\n- Terminal nodes: 1\n- Edges: 2\n- Issues: {}\n\n"
    assert texts[0] == head.format(0) + "## Result\n\nNo validation issues found.\n"
    assert texts[1] == head.format(1) + "## Issues\n\n### ISSUE_0001: missing_fallthrough\n\n- Severity: `error`\n- Status: `open`\n- Node: `Q1`\n- Edge: none\n- Message: Branching source Q1 has no fallthrough edge.\n"


@pytest.fixture
def run(spark, tmp_path, capsys):
    def go(command, document, *more):
        path = tmp_path / "in.json"
        path.write_text(document if isinstance(document, str) else json.dumps(document), "utf-8")
        code = cli.main([command, str(path), *map(str, more)], spark)
        return code, json.loads(capsys.readouterr().out)

    return go


def test_validate_command(run, tmp_path):
    assert run("validate", VALID) == (0, {"survey_id": "small_survey", "status": "valid", "issue_count": 0, "issues": []})
    code, out = run("validate", DANGLING, "--report", tmp_path / "r.md")
    assert code == 1 and out["issues"][0] == {"id": "ISSUE_0001", "severity": "error", "type": "missing_edge_target", "node_id": "NOWHERE", "edge_id": "E1", "message": "Edge E1 target NOWHERE does not exist.", "evidence": {}, "recommendation_ids": [], "status": "open"}
    assert (tmp_path / "r.md").read_text().startswith("# Validation Report: small_survey")
    doc = copy.deepcopy(VALID)
    del doc["survey"]["id"]
    assert run("validate", doc)[1]["survey_id"] == "<unknown>"
    assert run("validate", "{broken")[0] == 2


def test_heal_apply_and_test_commands(run, tmp_path):
    code, out = run("heal", ORPHAN, "--decisions-template", tmp_path / "d.json", "--output", tmp_path / "h.json")
    assert code == 0 and out["recommendation_count"] == 2 and json.loads((tmp_path / "h.json").read_text())["recommendation_count"] == 2
    decisions = json.loads((tmp_path / "d.json").read_text())
    assert [d["decision"] for d in decisions] == ["pending"] * 2
    assert run("apply", ORPHAN, tmp_path / "d.json", "--output", tmp_path / "o.json")[0] == 2
    (tmp_path / "d.json").write_text(json.dumps([d | {"decision": "approved", "approver": "me"} for d in decisions]))
    code, out = run("apply", ORPHAN, tmp_path / "d.json", "--output", tmp_path / "o.json")
    patched = json.loads((tmp_path / "o.json").read_text())
    log = patched["survey"]["metadata"]["decision_log"]
    assert out["applied_count"] == 2 and [x["issue_id"] for x in log] == ["ISSUE_0002", "ISSUE_0001"] and log[0]["timestamp"].endswith("Z")
    assert code == 0 and out["post_validation_status"] == "valid"
    code, out = run("test", VALID)
    assert code == 0 and out["coverage"] == {"node_percent": 100, "edge_percent": 100} and out["coverage_status"] == "complete"
    assert run("test", LOOP, "--coverage", "node")[0] == 1


def test_convert_command(run, tmp_path):
    doc = {"survey": {"id": "x", "blocks": {"b": {"order": 1, "questions": ["B", "A", "GONE"]}}, "questions": {"A": {"text": "a", "universe": {"expression": "B > 2 AND B = 3", "dependencies": ["B", "GONE"]}}, "B": {"text": "b"}, "C": {"n": 1, "universe": {"expression": "see above", "dependencies": ["A"]}}}}}
    for bare in (doc, doc["survey"]):
        code, out = run("convert", bare, tmp_path / "v3.json")
        got = json.loads((tmp_path / "v3.json").read_text())["survey"]
        assert code == 0 and out["edges"] == 2 and out["unparsed"] == 1
        assert [(e["id"], e["source"], e["target"], e["condition"], e["type"]) for e in got["dag"]["edges"]] == [("E001", "B", "A", ["AND", [">", "B", 2], ["=", "B", 3]], "branch"), ("E002", "A", "C", ["UNPARSED", "see above"], "branch")]
        assert got["questions"]["A"] == {"text": "a"} and got["version"] == "3.0" and got["metadata"] == {"schema_version": "3.0"} and got["dag"]["metadata"]["source_version"] == "2.0"


def test_expressions(spark):
    cases = {
        "always_show": None, "All Respondents": None, "": None, "D11 > 0": [">", "D11", 0], "D12 not includes 007": ["NOT_IN", "D12", 7], "A includes 1": ["IN", "A", 1], "(A = 1) OR (B != 2)": ["OR", ["=", "A", 1], ["!=", "B", 2]],
        "A=1 AND B=2 AND C=3": ["=", "A", 1], "A = 1 AND B = 2 OR C = 3 AND D <= 4": ["OR", ["AND", ["=", "A", 1], ["=", "B", 2]], ["AND", ["=", "C", 3], ["<=", "D", 4]]], "no idea": ["UNPARSED", "no idea"], 'say "x"': ["UNPARSED", 'say "x"'],
    }
    rows = convert.with_condition(spark.createDataFrame([(k,) for k in cases], "e string"), "e").collect()
    assert {r["e"]: r["condition"] and json.loads(r["condition"]) for r in rows} == cases


def test_version():
    assert __version__ == "0.1.0"
