"""Coverage of surveys in one pass: the same as by joins of their tables, without a shuffle of the paths."""

from dataclasses import replace

import pytest
from surveys import corpus, edge, survey
from test_survey_rows import documents, lines, rows_of  # noqa: F401

from routegraph.operators import coverage, graph
from routegraph.plans import derived
from routegraph.store import land


def by_joins(c, target):
    """Tests, unverified paths and the summary from the paths as a table: chosen by a group-by, summed up by joins."""
    c = replace(c, rows=None).landed(land)
    found = land(coverage.verified_given(c, graph.simple_paths(c)), "paths")
    chosen = coverage.chosen_tests(found.where("reason is null"), coverage.universe(c, target), "path" if target == "node" else "edge_ids")
    tests = land(chosen.selectExpr("survey_key", "format_string('TEST_%04d', row_number() over (partition by survey_key order by path_ix)) id", "responses", "path expected_path", "edge_ids covered_edges"), "tests")
    unverified = found.where("reason is not null").drop("responses")
    return tests, unverified, coverage.coverage_summary(c, target, tests, unverified)


@pytest.mark.parametrize(("source", "target"), [("documents", "edge"), ("orders", "node"), ("damaged", "edge")])
def test_one_pass_gives_what_joins_give(spark, lines, source, target):  # noqa: F811
    if source == "documents":
        c = corpus(spark, *documents(120))
    else:
        few = spark.read.parquet(f"{lines}/lineitem.parquet").where("l_orderkey is null or l_orderkey <> 4")
        few.write.mode("overwrite").parquet(f"{lines}/few/lineitem.parquet")
        c = (derived.order_corpus if source == "orders" else derived.damaged_corpus)(spark, f"{lines}/few")
    for got, want in zip(coverage.coverage(c, target), by_joins(c, target), strict=True):
        assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert rows_of(got) == rows_of(want) and got.count() > 0
    paths = land(graph.simple_paths(replace(c, rows=None)), "paths")
    wanted = coverage.chosen_tests(paths, coverage.universe(c, target), "path" if target == "node" else "edge_ids")
    assert rows_of(coverage.first_fit_numbers(c, target)) == rows_of(wanted.select("survey_key", "path_ix"))
    assert rows_of(graph.simple_paths(c)) == rows_of(paths)


def test_tests_of_rows_are_not_shuffled(spark, lines, tmp_path):  # noqa: F811
    spark.read.parquet(f"{lines}/lineitem.parquet").where("l_orderkey > 4 and l_linenumber is not null").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = derived.order_corpus(spark, str(tmp_path))
    for df in (*coverage.coverage(c, "edge"), coverage.first_fit_numbers(c, "node"), graph.packed_steps(c)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_route_that_goes_round_is_told_in_full(spark):
    loop = survey([edge("E1", "Q1", "Q2"), edge("E2", "Q2", "Q3"), edge("E3", "Q3", "Q2")], questions=("Q1", "Q2", "Q3"))
    for more in ({}, {"first_only": True}):
        found = coverage.coverage(corpus(spark, loop), "edge", **more)[1].first()
        assert found["path"] == ["Q1", "Q2", "Q3", "Q2"] and found["reason"] == "simulation_mismatch"
        assert found["actual_path"] == ["Q1", *["Q2", "Q3"] * 500] and found["actual_edge_ids"] == ["E1", *["E2", "E3"] * 500][:1000]
    by_source = {f"Q{i}": [{"id": f"E{i}", "target": f"Q{i + 1}"}] for i in range(1, 2000)}
    path, taken, place = coverage.simulate("Q1", by_source, set(), {})
    assert (len(path), len(taken), place) == (1001, 1000, -1)
    assert len(coverage.simulate("Q1", {"Q1": [{"id": "E", "target": "Q1"}]}, set(), {})[0]) == 2
