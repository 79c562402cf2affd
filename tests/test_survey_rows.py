"""Surveys that come as one row each give what joins of their tables give."""

import random
from dataclasses import replace

import pytest
from surveys import corpus, edge, survey

from routegraph.operators import graph, healing, patching, validation
from routegraph.plans import derived
from routegraph.store import land

ISSUE = [*validation.ORDER, "type", "message", "node_id", "edge_id", "evidence"]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def documents(n, seed=3):
    pick = random.Random(seed)
    conditions = [None, None, ["=", "Q1", 1], ["AND", ["~", "Q2", 1], [">", "Q9", 2]], ["NOT", ["UNPARSED", "x"]], 5]
    ids, ends = ["Q1", "Q2", "Q3", "Q4", "T1", "GONE", None], ["END", "T1"]
    for _ in range(n):
        edges = [edge(pick.choice(["A", "B", "C", None]), pick.choice(ids), pick.choice([*ids, "END", "END"]), pick.choice(conditions), pick.choice([1, 2, None, "x"]), pick.choice([None, "fallthrough"])) for _ in range(pick.randrange(9))]
        yield survey(edges, pick.sample(ids[:5], 3), pick.sample(ends, pick.randrange(3)), pick.choice(["Q1", "Q2", "NOPE", None, "END"]), pick.choice([None, ["END", "LOST", "Q2"]]))


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Orders of a few lines, one of 600, one line without a key and one without a number."""
    at = str(tmp_path_factory.mktemp("lines"))
    rows = spark.range(900).selectExpr("if(id < 600, 4L, id % 60) l_orderkey", "id * 7 % 31 l_partkey", "id * 11 % 13 l_suppkey", "cast(1 + id % 7 as int) l_linenumber", "cast(id % 50 as double) l_quantity",
        "cast(id as double) l_extendedprice", "0.1d l_discount", "0.2d l_tax", "element_at(array('A', 'R', 'N'), cast(1 + id % 3 as int)) l_returnflag", "timestamp'2026-01-01' l_shipdate")
    odd = rows.where("l_extendedprice = 700").selectExpr("cast(null as long) l_orderkey", "* except (l_orderkey)").unionByName(rows.where("l_extendedprice = 701").selectExpr("* except (l_linenumber)", "cast(null as int) l_linenumber"))
    rows.unionByName(odd).write.parquet(f"{at}/lineitem.parquet")
    return at


def test_issues_of_documents(spark):
    c = corpus(spark, *documents(150))
    rows, large = validation.by_survey(c)
    assert large is None
    got = rows_of(rows.selectExpr("survey_key", "inline(issues)"))
    assert got == rows_of(validation._by_tables(c, ()).select("survey_key", *ISSUE)) and len(got) > 500


@pytest.mark.parametrize("make", [derived.order_corpus, derived.damaged_corpus])
def test_issues_of_orders_few_and_many_lines(spark, lines, make):
    c = make(spark, lines)
    assert rows_of(validation.unnumbered(c)) == rows_of(validation._by_tables(c, ()).select("survey_key", *ISSUE))
    by_tables = replace(c, rows=None)
    assert rows_of(graph.reachable(c)) == rows_of(graph.reachable(by_tables)) == rows_of(graph.reachable_by_joins(c))


def test_numbers_follow_the_order_of_issues(spark, lines):
    c = derived.order_corpus(spark, lines)
    rows = validation.validate(c).select("survey_key", "issue_no", "type", "node_id", "edge_id", "message", "evidence")
    every = validation._by_tables(c, ())
    every.createOrReplaceTempView("every_issue")
    want = spark.sql("select survey_key, row_number() over (partition by survey_key order by stage, o1, o2, o3, type, message) issue_no, type, node_id, edge_id, message, evidence from every_issue")
    assert rows_of(rows) == rows_of(want)


def test_issues_of_small_surveys_are_told_without_another_shuffle(spark, lines, tmp_path):
    spark.read.parquet(f"{lines}/lineitem.parquet").where("l_orderkey > 4 and l_linenumber is not null").write.parquet(f"{tmp_path}/lineitem.parquet")
    for df in (validation.numbered(derived.order_corpus(spark, str(tmp_path))), graph.reachable(derived.order_corpus(spark, str(tmp_path)))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_patched_surveys_are_walked_by_their_new_edges(spark, lines):
    c = derived.order_corpus(spark, lines)
    entry = c.surveys.where("survey_key = 10").first()["entry_node"]
    patch = f"array(named_struct('op', 'add_edge', 'edge', named_struct('id', 'NEW', 'source', '{entry}', 'target', 'Q9', 'condition', cast(null as string), 'condition_text', '', 'priority', 99L, 'type', 'fallthrough'), 'edge_id', cast(null as string), 'priority', cast(null as long)))"
    advice = spark.range(1).selectExpr("10L survey_key", "1 rec_no", "'REC_0001' id", "'ISSUE_0001' issue_id", f"{patch} patch")
    decisions = spark.range(1).selectExpr("10L survey_key", "1 pos", "'REC_0001' recommendation_id", "'approved' decision", "'me' approver", "'so' rationale")
    patched = patching.apply_patches(c, advice, decisions)[0]
    assert "Q9" in [r["node"] for r in graph.reachable(patched).where("survey_key = 10").collect()]
    assert "Q9" not in [r["node"] for r in graph.reachable(c).where("survey_key = 10").collect()]


def test_only_what_issues_ask_for_is_computed(spark, lines, monkeypatch):
    c = derived.order_corpus(spark, lines).landed(land)
    assert c.landed(land) is c
    issues = land(validation.priority_issues(c).selectExpr("*", "1 issue_no", "'ISSUE_0001' id"), "issues")
    monkeypatch.setattr(graph, "reachable", lambda *_: pytest.fail("no issue asks for it"))
    monkeypatch.setattr(graph, "block_order", lambda *_: pytest.fail("no issue asks for it"))
    kinds = {r["type"] for r in healing.recommend(c, issues).select("type").distinct().collect()}
    assert kinds == {"adjust_duplicate_priority"}


@pytest.mark.parametrize("name", ["entries", "terminals", "sources", "targets"])
def test_issues_of_one_check_are_those_of_the_tables(spark, lines, name):
    c = derived.damaged_corpus(spark, lines)
    got = rows_of(validation.found_by(c, name).select("survey_key", *ISSUE))
    assert got == rows_of(validation.CHECKS[name](c, None).select("survey_key", *ISSUE)) and got


def test_entries_of_small_surveys_are_told_without_another_shuffle(spark, lines, tmp_path):
    spark.read.parquet(f"{lines}/lineitem.parquet").where("l_orderkey > 4 and l_linenumber is not null").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = validation.found_by(derived.damaged_corpus(spark, str(tmp_path)), "entries")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
