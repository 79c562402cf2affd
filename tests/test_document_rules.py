"""Draft-07 schemas compiled to tables of rules, against a small judge in Python."""

import copy
import json
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from surveys import VALID, corpus

from routegraph.operators import document_rules
from routegraph.operators.document_rules import built_in_schema, compile_schema, schema_breaks
from routegraph.operators.validation import validate

KINDS = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool), "integer": lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x == int(x),
}


def same(a, b):
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def judge(schema, x, root, path=()):
    """(path, keyword) of what a value breaks, by the words of the standard."""
    if isinstance(schema, bool):
        return [] if schema else [(path, "false")]
    if "$ref" in schema:
        node = root
        for key in schema["$ref"].split("/")[1:]:
            node = node[key]
        return judge(node, x, root, path)
    out, is_number = [], KINDS["number"](x)
    ok = lambda s: not judge(s, x, root, path)
    size = {"L": len(x) if isinstance(x, str) else None, "I": len(x) if isinstance(x, list) else None, "P": len(x) if isinstance(x, dict) else None}
    for k, v in schema.items():
        broken = 0
        if k == "type":
            broken = not any(KINDS[t](x) for t in ([v] if isinstance(v, str) else v))
        elif k in ("enum", "const"):
            broken = not any(same(x, y) for y in (v if k == "enum" else [v]))
        elif k == "required" and isinstance(x, dict):
            broken = len([y for y in v if y not in x])
        elif k == "pattern" and isinstance(x, str):
            broken = not re.search(v, x)
        elif k == "format" and isinstance(x, str):
            try:
                broken = not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", x) or not datetime.fromisoformat(x.upper().replace("Z", "+00:00"))
            except ValueError:
                broken = 1
        elif k in ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum") and is_number:
            broken = {"minimum": x < v, "exclusiveMinimum": x <= v, "maximum": x > v, "exclusiveMaximum": x >= v}[k]
        elif k in ("minLength", "minItems", "minProperties", "maxLength", "maxItems", "maxProperties") and size[k[3]] is not None:
            broken = size[k[3]] < v if k[:3] == "min" else size[k[3]] > v
        elif k == "uniqueItems" and isinstance(x, list):
            broken = len({json.dumps(y, sort_keys=True) for y in x}) < len(x)
        elif k == "additionalProperties" and isinstance(x, dict):
            more = [y for y in x if y not in schema.get("properties", {})]
            if v is False:
                broken = bool(more)
            else:
                out += [b for y in more for b in judge(v, x[y], root, (*path, y))]
        elif k == "properties" and isinstance(x, dict):
            out += [b for y, s in v.items() if y in x for b in judge(s, x[y], root, (*path, y))]
        elif k == "items" and isinstance(x, list):
            out += [b for i, y in enumerate(x) for b in judge(v, y, root, (*path, i))]
        elif k == "allOf":
            out += [b for s in v for b in judge(s, x, root, path)]
        elif k in ("oneOf", "anyOf"):
            n = sum(map(ok, v))
            broken = n != 1 if k == "oneOf" else n == 0
        elif k == "not":
            broken = ok(v)
        out += [(path, k)] * int(broken)
    return out


def found(spark, schema, *documents, dump=json.dumps):
    docs = spark.createDataFrame([(i, dump(d)) for i, d in enumerate(documents)], "survey_key int, doc string")
    out = [[] for _ in documents]
    for r in schema_breaks(docs, schema).collect():
        out[r["survey_key"]].append((tuple(p["key"] if p["is_key"] else p["pos"] for p in r["path"]), r["keyword"]))
    return [sorted(x, key=repr) for x in out]


OWN = {
    "type": "object", "required": ["id", "tree"], "additionalProperties": {"$ref": "#/definitions/leaf"},
    "properties": {
        "id": {"type": ["string", "integer"], "not": {"enum": ["bad", 7]}}, "tree": {"$ref": "#/definitions/node"}, "when": {"format": "date-time", "title": "a time"},
        "closed": {"type": "object", "additionalProperties": False, "properties": {"a": True, "b": False}, "minProperties": 1}, "same": {"const": {"x": [1, None]}},
    },
    "definitions": {
        "leaf": {"anyOf": [{"type": "null"}, {"type": "number", "minimum": 0, "exclusiveMaximum": 5}, {"type": "string", "minLength": 2, "pattern": "^a"}]},
        "node": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"oneOf": [{"$ref": "#/definitions/node"}, {"allOf": [{"$ref": "#/definitions/leaf"}, {"not": {"type": "null"}}]}, {"const": 3}]}},
    },
}

DOCUMENTS = [
    {"id": "x", "tree": []}, {"id": 7, "tree": [1, "ab", [2, ["a"]]]}, {"id": 7.0, "tree": [3]}, {"tree": [None, [None], [[[]]]], "id": "bad"}, {"id": 1.5}, [], None, 3, "text", True,
    {"id": "é", "tree": [1, 1, 2, 3], "more": 9, "other": "b", "third": None, "fourth": {}}, {"id": "x", "tree": [[[[[[4.5], -1]]]]], "when": "2026-02-30T00:00:00Z"}, {"id": "x", "tree": {}, "when": "2026-02-28t01:02:03.5+01:00", "closed": {}},
    {"id": "x", "tree": ["a"], "closed": {"a": 1, "b": 2, "c": 3}, "same": {"x": [1, None]}}, {"id": "x", "tree": ["aa"], "same": {"x": [None, 1]}, "when": 5, "closed": []},
]


def test_a_schema_of_ones_own(spark):
    want = [sorted(judge(OWN, d, OWN), key=repr) for d in DOCUMENTS]
    assert sum(map(bool, want)) >= 11
    assert found(spark, OWN, *DOCUMENTS) == want


def test_a_schema_file(spark, tmp_path):
    at = tmp_path / "own.json"
    at.write_text(json.dumps({"properties": {"survey": {"required": ["colour"], "properties": {"title": {"enum": ["Big"]}}}}}))
    rows = validate(corpus(spark, VALID), schema=str(at)).orderBy("issue_no").collect()
    assert [(r["type"], r["message"], json.loads(r["evidence"])) for r in rows] == [
        ("schema_invalid", "'colour' is a required property", {"path": ["survey"]}), ("schema_invalid", "'Small' is not one of ['Big']", {"path": ["survey", "title"]}),
    ]
    assert validate(corpus(spark, VALID)).count() == 0


def test_built_in_rules(spark):
    doc = copy.deepcopy(VALID)
    body = doc["survey"]
    del body["version"]
    body["id"], body["title"], body["metadata"]["created_date"], body["metadata"]["total_blocks"] = "Upper Case", 5, "yesterday", 0
    body["questions"]["Q1"]["type"], body["terminal_nodes"]["END"]["type"] = "essay", "end"
    body["dag"]["edges"][0]["condition"], body["dag"]["edges"][1]["priority"] = [], True
    body["dag"]["edges"].append({**body["dag"]["edges"][0], "condition": ["=", {"a": 1}]})
    schema = built_in_schema()
    assert found(spark, None, doc, VALID) == [sorted(judge(schema, doc, schema), key=repr), []]
    assert len(judge(schema, doc, schema)) == 10
    messages = {r["message"] for r in schema_breaks(spark.createDataFrame([(1, json.dumps(doc))], "survey_key int, doc string")).collect()}
    assert {"'version' is a required property", "'yesterday' is not a 'date-time'", "0 is less than the minimum of 1", "True is not of type 'integer'", "5 is not of type 'string'", "'terminal' was expected"} <= messages


def test_what_is_no_json_or_no_schema(spark):
    assert found(spark, {"type": "string"}, "{broken", "", '{"a":1,"a":2}', dump=str) == [[], [], []]
    assert found(spark, True, {}, 1) == [[], []] and found(spark, False, {}) == [[((), "false")]]
    assert schema_breaks(spark.createDataFrame([], "survey_key int, doc string"), OWN).count() == 0
    for bad in ({"dependencies": {}}, {"items": [True]}, {"properties": {"a": {"$ref": "#/nowhere"}}}, {"$ref": "other.json"}, {"allOf": [{"$ref": "#"}]}, {"patternProperties": {}}, 5):
        with pytest.raises(ValueError):
            compile_schema(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from([{"type": "null"}, {"type": "string"}, {"minimum": 2}, True, {"enum": [1, "a"]}]), lambda s: st.one_of(st.builds(lambda x: {"items": x}, s), st.builds(lambda x: {"properties": {"k": x}, "required": ["k"]}, s), st.builds(lambda x: {"oneOf": x}, st.lists(s, min_size=1, max_size=2))), max_leaves=5))
def test_compiling_gives_each_choice_a_number_of_its_own(schema):
    compiled = compile_schema(schema)
    assert len({c[2] for c in compiled.choices}) == len(compiled.choices) and len({s[0] for s in compiled.spots}) == len(compiled.spots)


def test_texts_of_messages_are_made_only_where_they_are_asked_for(spark):
    rows = spark.createDataFrame([(t,) for t in ('"a"', "null", "true", "1", "1.5", "[1]", '{"k":1}')], "doc string").select(F.try_parse_json("doc").alias("value"))
    facts = document_rules._facts(rows)
    assert not {"json", "shown"} & set(facts.columns)
    got = facts.select("kind", document_rules._shown().alias("shown")).collect()
    assert [tuple(r) for r in got] == [("string", "'a'"), ("null", "None"), ("boolean", "True"), ("integer", "1"), ("number", "1.5"), ("array", "[1]"), ("object", '{"k":1}')]
