"""Documents judged as they pass: without a table of values, and as by the walk of all documents level by level."""

import json

import pytest
from surveys import VALID
from test_document_rules import DOCUMENTS, OWN

from routegraph.operators import document_rules
from routegraph.operators.document_judge import Judge, read
from routegraph.operators.document_rules import built_in_schema, compile_schema, schema_breaks

ODD = [
    '{"id":"a\\u0001\\"\\\\é/","tree":[1.50,1e400,-0.0,1E10,12345678901234567890123]}', '{"id":7,"tree":[[],{"b":1.0,"a":"x\\ny"}]} and more', ' {"id":"x","tree":[3.0,3]}', '{"a":1,"a":2}', '{"id":NaN}', "", "{broken",
    '{"id":"Infinity","tree":["-Infinity",0.0000001]}', "-1e400", '{"id":1e999,"tree":["Infinity"]}', '"\\ud83d\\ude00"', '{"id":"x","tree":' + "[" * 5 + "]" * 5 + "}", "[" * 1100 + "]" * 1100, '{"z":-1,"id":"x","tree":null,"b":true,"more":{"c":[null]}}',
]
LIMITED = {
    "minProperties": 2, "maxProperties": 3, "uniqueItems": True, "enum": [1, "b", None], "pattern": "^b", "minLength": 2, "maxLength": 3, "minItems": 1, "maxItems": 2, "not": {"type": ["array", "null"]},
    "anyOf": [{"minimum": 3}, {"exclusiveMaximum": 2}], "maximum": 4, "exclusiveMinimum": 1, "multipleOf": 0.5, "allOf": [{"required": ["k", "l", "k"]}, {"properties": {"k": False, "l": True}, "additionalProperties": False}],
}
VALUES = [1, "b", None, 2.25, 5, "bcde", "é", [], [1, 1], [1, 2, 3], {}, {"k": 1}, {"k": 1, "m": 2, "n": 3, "l": 4}, True, 1.0]


def rows(frame):
    return sorted([repr(tuple(r)) for r in frame.collect()])


@pytest.mark.parametrize("schema, documents", [(OWN, [*map(json.dumps, DOCUMENTS), *ODD]), (LIMITED, [*map(json.dumps, VALUES), *ODD]), (built_in_schema(), [json.dumps(VALID), json.dumps(VALID).replace("fallthrough", "jump").replace('"priority": 1', '"priority": 0.5'), *ODD])])
def test_judged_as_by_levels_without_a_table_of_values(spark, monkeypatch, schema, documents):
    docs = spark.createDataFrame(list(enumerate(documents)), "survey_key int, doc string")
    want = rows(document_rules._by_levels(docs, compile_schema(schema)))
    assert want
    monkeypatch.setattr(document_rules, "land", lambda *_: pytest.fail("a table of values is written"))
    got = schema_breaks(docs, schema)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert rows(got) == want
    assert rows(schema_breaks(docs, schema, texts=False).drop("message")) == rows(got.drop("message"))


def test_patterns_that_only_java_reads(spark):
    docs = spark.createDataFrame([(1, '"é"'), (2, '"1"')], "survey_key int, doc string")
    assert [r["survey_key"] for r in schema_breaks(docs, {"pattern": r"^\p{L}$"}).collect()] == [2]


def test_equal_values_however_they_are_written():
    breaks = lambda schema, text: [b[3] for b in Judge(compile_schema(schema)).breaks(read(text))]
    assert breaks({"enum": [1e17, {"a": 1.0}]}, "1.0E17") == breaks({"enum": [1e17, {"a": 1.0}]}, '{"a":1}') == []
    assert breaks({"uniqueItems": True}, "[1,1.0]") == ["uniqueItems"] and breaks({"uniqueItems": True}, "[1,true,[1],[true]]") == []
    assert breaks({"const": True}, "1") == ["const"] and breaks({"type": "integer"}, "1.0E300") == []
