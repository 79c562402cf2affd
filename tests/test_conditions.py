import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routegraph.functions import ast
from routegraph.functions.conditions import dialect_v3, json_answers, status, token

LITERALS = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 2.0, 1e9, 123456789.25]), st.sampled_from(["a", "b", ""]))
NAMES = st.sampled_from(["N", "S", "L", "B", "MISSING"])
LEAVES = st.one_of(
    st.tuples(st.sampled_from(["=", "!=", ">", "<", ">=", "<=", "contains"]), NAMES, LITERALS).map(list),
    st.tuples(st.sampled_from(["in", "not_in"]), NAMES, st.lists(LITERALS, max_size=3)).map(list),
    st.sampled_from([["TRUE"], ["FALSE"], ["~", "N", 1], ["=", "N"], ["=", 5, 1], ["in", "N", 3], ["TRUE", 1], [5], None, True, "", "x", [], 0]),
)
TREES = st.recursive(LEAVES, lambda x: st.one_of(st.lists(x, max_size=3).map(lambda p: ["AND", *p]), st.lists(x, max_size=3).map(lambda p: ["OR", *p]), x.map(lambda p: ["NOT", p])), max_leaves=6)
ANSWERS = [{"N": 1, "S": "a", "L": [1, "a", None], "B": True}, {"N": 2.0, "S": "", "L": [], "B": False}, {"N": None, "S": "b"}, {}, {"N": 123456789.25, "S": "zz", "L": [0.5, True]}]


def expected(node, answers):
    try:
        return "T" if ast.evaluate(node, answers) else "F"
    except ast.ConditionError as error:
        return f"E:{error}"


@settings(max_examples=12, deadline=None)
@given(st.lists(TREES, min_size=6, max_size=12))
def test_columns_agree_with_evaluation(spark, nodes):
    frame = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(ANSWERS)], "i int, answers string").withColumn("m", json_answers(F.col("answers")))
    rows = frame.select("i", *[status(n, lambda name: F.col("m")[name]).alias(f"c{k}") for k, n in enumerate(nodes)]).collect()
    for r in rows:
        for k, n in enumerate(nodes):
            assert r[f"c{k}"] == expected(n, ANSWERS[r["i"]]), (n, ANSWERS[r["i"]])


@pytest.mark.parametrize(("node", "answers", "result"), [
    (["!=", "Q", 5], {}, True), (["=", "Q", None], {}, True), ([">", "Q", 1], {}, False), (["NOT", [">", "Q", 1]], {}, True), (["not_in", "Q", [1, None]], {}, False),
    (["=", "Q", True], {"Q": 1}, True), (["=", "Q", "1"], {"Q": 1}, False), (["contains", "Q", 2], {"Q": [1, 2]}, True), (["OR", ["TRUE"], ["~"]], {}, True), (["AND", ["FALSE"], [7]], {}, False),
])
def test_two_valued_logic(node, answers, result):
    assert ast.evaluate(node, answers) is result


@pytest.mark.parametrize(("node", "message"), [
    (["AND"], "Malformed condition for operator AND: expected at least 1 operands"), (["NOT"], "Malformed condition for operator NOT: expected 1 operands"), (["=", "Q"], "Malformed condition for operator =: expected 2 operands"),
    (["=", 1, 2], "Malformed condition for operator =: variable must be a string"), (["no", 1], "Unknown condition operator: no"), ([3], "Unknown condition operator: 3"),
])
def test_errors(node, message):
    with pytest.raises(ast.ConditionError, match=message.replace("(", r"\(")):
        ast.evaluate(node, {"Q": 1})


def test_tokens_of_numbers_match_spark(spark):
    values = [0, -0.0, 1, True, 0.1, 1e-3, 1e-4, 1e7, 9999999.0, 12345678901.5, -2.5e-8, 1e300, 3]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select(F.concat(F.lit("n:"), (F.col("x") + 0.0).cast("string")).alias("t")).collect()
    assert [r["t"] for r in rows] == [token(v) for v in values]


def test_later_dialect():
    answers = {"L": [1, 2], "Q": 5}
    cases = [(["IN", "L", 2], True), (["NOT_IN", "L", 2], False), (["ANY", "L", [9, 1]], True), (["ALL", "L", [1, 3]], False), (["ALWAYS"], True), (["NEVER"], False), (["<", "MISSING", 3], True), ([">", "MISSING", 3], False)]
    assert [ast.evaluate(dialect_v3(n), answers) for n, _ in cases] == [r for _, r in cases]


def test_walk_and_variables():
    node = ["AND", ["=", "A", ["=", "B", 1]], ["OR", ["in", "C", []], [7, "D"]], ["~", "E", 1]]
    assert ast.walk(node) == ["AND", "=", "OR", "in", 7, "~"]
    assert ast.variables(node) == {"A", "C"}
