import json

import pytest
from surveys import VALID, corpus

from routegraph.functions.ast import ConditionError, evaluate
from routegraph.functions.conditions import json_answers, status
from routegraph.operators import convert, patching


def by_hand(node, answers):
    try:
        return "T" if evaluate(node, answers) else "F"
    except ConditionError as error:
        return f"E:{error}"


def test_large_integers_and_objects_compare_as_values_do(spark):
    people = [{"A": 9007199254740993}, {"A": 9007199254740992}, {"A": 9007199254740992.0}, {"A": -9007199254740993}, {"A": {"x": 1}}, {"A": 1e22}, {"A": [9007199254740993, {"y": 2}]}, {"A": 9223372036854775807}, {}]
    nodes = [["=", "A", 9007199254740993], ["!=", "A", 9007199254740992], ["in", "A", [9007199254740992, -9007199254740993]], ["=", "A", None], ["=", "A", 9223372036854775807], ["=", "A", {"x": 1}]]
    nodes += [[">", "A", 1], ["contains", "A", 9007199254740993]]
    frame = spark.createDataFrame([(json.dumps(a),) for a in people], "answers string")
    answers = frame.withColumn("m", json_answers(frame.answers)).select(*[status(n, lambda q: __import__("pyspark.sql.functions", fromlist=["col"]).col("m")[q]).alias(f"c{i}") for i, n in enumerate(nodes)])
    for got, given in zip(answers.collect(), people, strict=True):
        for i, node in enumerate(nodes):
            assert got[f"c{i}"] == by_hand(node, given), (node, given)


def test_names_in_any_alphabet_are_converted(spark):
    frame = spark.createDataFrame([("Größe > 3",), ("été includes 07",), ("\u0434\u0430 = 1",)], "e string")
    got = [r["condition"] for r in convert.with_condition(frame, "e").collect()]
    assert got == ['[">","Größe",3]', '["IN","été",7]', '["=","\u0434\u0430",1]']


def test_unknown_patch_operations_fail(spark):
    ops = spark.createDataFrame([(0, 0, 0, "drop_edge", None, "E1", 1)], "survey_key int, pos int, step int, op string, edge struct<id:string>, edge_id string, priority long")
    with pytest.raises(Exception, match="Unsupported patch operation: drop_edge"):
        patching.effective(corpus(spark, VALID), ops).collect()
