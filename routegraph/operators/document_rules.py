"""Documents against a draft-07 schema file.

``compile_schema`` turns a schema into a few small tables: ``spots`` (a schema at which a value can be judged, with the spots of its members),
``rules`` (what a value at a spot must meet) and ``choices`` (oneOf, anyOf, not). ``schema_breaks`` reads the documents once: Spark parses them, and ``document_judge`` judges each as it
passes, without a join, a shuffle or a table of values. References are followed by name, so schemas may be recursive.

Only a schema with a pattern that Java can search for and Python cannot is walked in Spark alone (``_by_levels``): the documents as VARIANT columns, all
of them a level at a time (in one plan, if the schema does not contain itself). Each value is exploded into its members, the members are joined with the spots that their schema gives
them, and rules are columns over kind, number, text and keys of a value. There, a branch of a choice is
judged like anything else, but what it breaks counts within the branch; choices are settled from the innermost outwards.

Keywords: $ref, type, enum, const, required, properties, additionalProperties, items (one schema), minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, minLength, maxLength, pattern, format (date-time; other formats are remarks), minItems, maxItems, uniqueItems, minProperties,
maxProperties, allOf, anyOf, oneOf, not, true and false. Any other keyword that restricts values is refused when the schema is compiled,
so nothing goes unchecked in silence. Messages show strings, true, false and null as Python does, arrays and objects as JSON. Numbers
are compared as doubles; objects of an enum, in the walk by levels, by their JSON with sorted keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.operators.document_judge import judged, readable
from routegraph.schema import DOCUMENT_RULES
from routegraph.store import land

# Keywords of draft-07 that restrict nothing, and those that take a number or a text.
REMARKS = ("$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "readOnly", "writeOnly", "contentEncoding", "contentMediaType")
NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"

PATH = "array<struct<is_key:boolean,pos:int,key:string>>"
SCOPES = "array<struct<depth:int,choice:int,branch:int>>"
TARGETS = "array<struct<spot:int,scopes:array<struct<choice:int,branch:int>>>>"
BREAK = f"path {PATH}, rule_no int, item_no int, keyword string, message string"


@dataclass
class Compiled:
    """Rows of the three tables, and the spots of a whole document."""

    root: list[tuple] = field(default_factory=list)
    spots: list[tuple] = field(default_factory=list)  # spot, members by name, other members, items
    rules: list[tuple] = field(default_factory=list)  # spot, rule_no, keyword, words, number, text
    choices: list[tuple] = field(default_factory=list)  # spot, rule_no, choice, keyword, branches


    def levels(self) -> int | None:
        """How many levels below the document values can be judged at; None if the schema contains itself."""
        below = {spot: {t for ts in (*named.values(), other or (), items or ()) for t, _ in ts} for spot, named, other, items in self.spots}
        left, n = {t for t, _ in self.root}, 0
        while left and n <= len(below):
            left, n = set().union(*(below[t] for t in left)), n + 1
        return None if left else n - 1


def _json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def compile_schema(schema: Any) -> Compiled:
    out = Compiled()
    numbers: dict[str, int] = {}
    branches: dict[str, list[tuple[int, int, str]]] = {}
    todo: list[tuple[str, Any]] = []

    def resolved(pointer: str, node: Any) -> tuple[str, Any]:
        seen = set()
        while isinstance(node, dict) and "$ref" in node:
            pointer = node["$ref"]
            if not pointer.startswith("#") or pointer in seen:
                raise ValueError(f"Unsupported reference in schema: {pointer}")
            seen.add(pointer)
            node = schema
            for key in [k.replace("~1", "/").replace("~0", "~") for k in pointer[1:].split("/")[1:]]:
                if not isinstance(node, dict | list) or (isinstance(node, dict) and key not in node):
                    raise ValueError(f"Reference without a target in schema: {pointer}")
                node = node[int(key)] if isinstance(node, list) else node[key]
        return pointer, node

    def targets(pointer: str, node: Any, inside: tuple = ()) -> list[tuple]:
        """The spot of a schema and those of its allOf, and of every branch of its choices, at the same value."""
        pointer, node = resolved(pointer, node)
        if pointer in inside:
            raise ValueError(f"A schema contains itself at the same value: {pointer}")
        if not isinstance(node, dict | bool):
            raise ValueError(f"No schema at {pointer}")
        if pointer not in numbers:
            numbers[pointer] = len(numbers)
            todo.append((pointer, node))
        found = [(numbers[pointer], [])]
        if isinstance(node, dict):
            for i, part in enumerate(node.get("allOf", [])):
                found += targets(f"{pointer}/allOf/{i}", part, (*inside, pointer))
            if pointer not in branches:
                groups = [(k, node[k] if k != "not" else [node[k]]) for k in ("anyOf", "oneOf", "not") if k in node]
                first = sum(map(len, branches.values()))
                branches[pointer] = [(first + i, len(g), k) for i, (k, g) in enumerate(groups)]
            for choice, _, keyword in branches[pointer]:
                for i, part in enumerate(node[keyword] if keyword != "not" else [node[keyword]]):
                    found += [(spot, [(choice, i), *scopes]) for spot, scopes in targets(f"{pointer}/{keyword}/{i}", part, (*inside, pointer))]
        return found

    out.root = targets("#", schema)
    while todo:
        pointer, node = todo.pop(0)
        spot, number = numbers[pointer], 0

        def rule(keyword: str, words: list[str] | None = None, number_: float | None = None, text: str | None = None) -> None:
            nonlocal number
            number += 1
            out.rules.append((spot, number, keyword, words, None if number_ is None else float(number_), text))  # noqa: B023

        if isinstance(node, bool):
            if not node:
                rule("false")
            out.spots.append((spot, {}, None, None))
            continue
        named = {k: targets(f"{pointer}/properties/{k}", x) for k, x in node.get("properties", {}).items()}
        other = items = None
        for keyword, value in node.items():
            if keyword == "type":
                kinds = [value] if isinstance(value, str) else list(value)
                rule("type", kinds, text=", ".join(repr(k) for k in kinds))
            elif keyword in ("enum", "const"):
                allowed = value if keyword == "enum" else [value]
                rule(keyword, [f"n{float(x)!r}" if isinstance(x, int | float) and not isinstance(x, bool) else _json(x) for x in allowed], text=repr(value))
            elif keyword == "required":
                rule("required", list(value))
            elif keyword == "additionalProperties" and value is False:
                rule("additionalProperties", list(named))
            elif keyword == "additionalProperties":
                other = targets(f"{pointer}/additionalProperties", value)
            elif keyword == "items" and not isinstance(value, list):
                items = targets(f"{pointer}/items", value)
            elif keyword in NUMBERS:
                rule(keyword, number_=value, text=str(value))
            elif keyword == "pattern":
                rule("pattern", text=value)
            elif keyword == "format":
                if value == "date-time":
                    rule("format", text=value)
            elif keyword == "uniqueItems":
                if value:
                    rule("uniqueItems")
            elif keyword in ("anyOf", "oneOf", "not"):
                number += 1
                choice = next(b for b in branches[pointer] if b[2] == keyword)
                out.choices.append((spot, number, choice[0], keyword, choice[1]))
            elif keyword not in ("properties", "allOf", *REMARKS):
                raise ValueError(f"Unsupported keyword in schema: {keyword} at {pointer}")
        out.spots.append((spot, named, other, items))
    return out


def read_schema(spark: SparkSession, schema: dict | bool | str) -> Any:
    """A schema as it is, or from a file that Spark can read."""
    if not isinstance(schema, str):
        return schema
    return json.loads(spark.read.text(schema, wholetext=True).first()["value"])


def _built_in(rule: Any) -> Any:
    """One rule of ``schema.DOCUMENT_RULES`` as draft-07."""
    if rule == "condition":
        literal = [{"type": t} for t in ("string", "number", "boolean", "array", "null")]
        return {"oneOf": [{"type": "null"}, {"type": "array", "minItems": 1, "items": {"oneOf": literal}}]}
    if isinstance(rule, str):
        return {"type": rule}
    if isinstance(rule, tuple):
        return {"type": rule[0], **rule[1]}
    if isinstance(rule, list):
        return {"type": "array", "items": _built_in({rule[0]} if rule[0] in DOCUMENT_RULES else rule[0])}
    if isinstance(rule, dict):
        return {"type": "object", "additionalProperties": _built_in({rule["*"]})}
    return {"$ref": f"#/definitions/{next(iter(rule))}"}


def built_in_schema() -> dict:
    """The document rules as a draft-07 schema, for documents that come with no schema of their own."""
    kinds = {k: {"type": "object", "required": required, "properties": {name: _built_in(rule) for name, rule in known.items()}} for k, (required, known) in DOCUMENT_RULES.items()}
    return {"$ref": "#/definitions/Document", "definitions": kinds}


def _facts(rows: DataFrame) -> DataFrame:
    """``rows`` with what rules look at: kind, number, text, keys and items of the value. What only messages ask for is left to ``_shown``."""
    v, whole = F.col("value"), F.col("whole")
    number = F.when(whole.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    kind = (
        F.when(whole.startswith("OBJECT"), "object").when(whole.startswith("ARRAY"), "array").when(whole == "STRING", "string").when(whole == "BOOLEAN", "boolean").when(whole == "VOID", "null")
        .when(F.col("number") == F.floor("number"), "integer").otherwise("number")
    )
    typed = rows.withColumn("whole", F.schema_of_variant(v)).withColumn("number", number).withColumn("kind", kind).drop("whole")
    text = F.when(F.col("kind") == "string", F.try_variant_get(v, "$", "string"))
    keys = F.when(F.col("kind") == "object", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    items = F.when(F.col("kind") == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
    return typed.withColumns({"text": text, "keys": keys, "items": items})


def _shown() -> Column:
    """A value of ``_facts`` as a message shows it."""
    kind, json_ = F.col("kind"), F.to_json("value")
    return F.when(kind == "string", F.concat(F.lit("'"), F.col("text"), F.lit("'"))).when(kind == "null", "None").when(kind == "boolean", F.initcap(json_)).otherwise(json_)


def _broken() -> Column:
    """Messages of what a value breaks of the rule beside it: rows of ``_facts`` joined with rules (columns with ``r_``)."""
    keyword, limit, words, shown = F.col("r_keyword"), F.col("r_number"), F.col("r_words"), _shown()
    kind, number, none = F.col("kind"), F.col("number"), F.array().cast("array<string>")
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    is_number = kind.isin("integer", "number")
    among = F.array_contains(words, F.when(is_number, F.concat(F.lit("n"), _double_text(number))).otherwise(F.to_json("value")))
    typed = F.array_contains(words, kind) | (F.array_contains(words, F.lit("number")) & (kind == "integer"))
    moment = F.col("text").rlike(DATE_TIME) & F.try_to_timestamp(F.substring("text", 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    size = F.when(keyword.isin("minLength", "maxLength"), F.length("text")).when(keyword.isin("minItems", "maxItems"), F.size("items")).when(keyword.isin("minProperties", "maxProperties"), F.size("keys"))
    size = F.when(size >= 0, size)
    extra = F.array_except("keys", words)
    one = lambda broken, says: F.when(F.coalesce(broken, F.lit(False)), F.array(says)).otherwise(none)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    bound = F.col("r_text")
    return (
        F.when(keyword == "type", one(~typed, say(shown, " is not of type ", bound)))
        .when(keyword == "required", F.transform(F.coalesce(F.array_except(words, "keys"), none), lambda k: F.concat(quoted(k), F.lit(" is a required property"))))
        .when(keyword == "enum", one(~among, say(shown, " is not one of ", bound)))
        .when(keyword == "const", one(~among, say(bound, " was expected")))
        .when(keyword == "pattern", one(~F.expr("text rlike r_text"), say(shown, " does not match ", quoted(bound))))
        .when(keyword == "format", one(F.col("text").isNotNull() & ~moment, say(shown, " is not a ", quoted(bound))))
        .when(keyword == "minimum", one(number < limit, say(shown, " is less than the minimum of ", bound)))
        .when(keyword == "maximum", one(number > limit, say(shown, " is greater than the maximum of ", bound)))
        .when(keyword == "exclusiveMinimum", one(number <= limit, say(shown, " is less than or equal to the minimum of ", bound)))
        .when(keyword == "exclusiveMaximum", one(number >= limit, say(shown, " is greater than or equal to the maximum of ", bound)))
        .when(keyword == "multipleOf", one(F.try_mod(number, limit) != 0, say(shown, " is not a multiple of ", bound)))
        .when(keyword.isin("minLength", "minItems"), one(size < limit, say(shown, " is too short")))
        .when(keyword.isin("maxLength", "maxItems"), one(size > limit, say(shown, " is too long")))
        .when(keyword == "minProperties", one(size < limit, say(shown, " does not have enough properties")))
        .when(keyword == "maxProperties", one(size > limit, say(shown, " has too many properties")))
        .when(keyword == "uniqueItems", one(F.size("items") > F.size(F.array_distinct("items")), say(shown, " has non-unique elements")))
        .when(keyword == "additionalProperties", one(F.size(extra) > 0, say("Additional properties are not allowed (", F.array_join(F.transform(extra, quoted), ", "), F.when(F.size(extra) == 1, " was").otherwise(" were"), " unexpected)")))
        .when(keyword == "false", F.array(say("False schema does not allow ", shown)))
        .otherwise(none)
    )


def _double_text(number: Column) -> Column:
    """A number as ``repr(float)`` writes it, up to 10 ** 16 and down to 10 ** -3; enums beyond that are compared by Java's notation."""
    return number.cast("double").cast("string")


def _entries(targets: list[tuple] | None) -> list[tuple] | None:
    return None if targets is None else [(spot, list(scopes)) for spot, scopes in targets]


def schema_breaks(docs: DataFrame, schema: dict | bool | str | None = None, texts: bool = True) -> DataFrame:
    """(survey_key, path, rule_no, item_no, keyword, message) of everything in ``docs`` (survey_key, doc) that breaks ``schema``: a draft-07 schema, the
    path of a file, or None for the built-in rules. Text that is no JSON has no rows here. ``path`` is an array of (is_key, pos, key). Without ``texts``,
    messages may be null."""
    compiled = compile_schema(built_in_schema() if schema is None else read_schema(docs.sparkSession, schema))
    if not readable(compiled):
        return _by_levels(docs, compiled)
    text = F.to_json(F.try_parse_json("doc"))
    # a number beyond all doubles is written as a string
    parsed = docs.select("survey_key", text.alias("text"), F.when(text.contains('Infinity"'), F.col("doc")).alias("source"))
    return parsed.mapInArrow(judged(compiled, texts), f"survey_key {docs.schema['survey_key'].dataType.simpleString()}, {BREAK}")


def _by_levels(docs: DataFrame, compiled: Compiled) -> DataFrame:
    """``schema_breaks`` by joins, a level of all documents at a time."""
    spark = docs.sparkSession
    # the tables are as large as the schema, which the driver has just read whole
    spots = F.broadcast(spark.createDataFrame([(s, {k: _entries(t) for k, t in named.items()}, _entries(other), _entries(items)) for s, named, other, items in compiled.spots if named or other or items], f"spot int, named map<string,{TARGETS}>, other {TARGETS}, item {TARGETS}"))
    rules = F.broadcast(spark.createDataFrame(compiled.rules, "spot int, r_no int, r_keyword string, r_words array<string>, r_number double, r_text string"))
    choices = F.broadcast(spark.createDataFrame(compiled.choices, "spot int, r_no int, choice int, r_keyword string, branches int"))
    root = F.from_json(F.lit(json.dumps([{"spot": s, "scopes": [{"choice": c, "branch": b} for c, b in scopes]} for s, scopes in compiled.root])), TARGETS)
    at = lambda depth: F.transform(F.col("t.scopes"), lambda s: F.struct(depth.cast("int").alias("depth"), s["choice"].alias("choice"), s["branch"].alias("branch")))

    def members(level: DataFrame) -> DataFrame:
        outer = level.join(spots, "spot").select("survey_key", "path", "scopes", "named", "other", "item", F.col("value").alias("whole"))
        inner = outer.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        target = F.when(F.col("key").isNotNull(), F.coalesce(F.try_element_at("named", F.col("key")), F.col("other"))).otherwise(F.col("item"))
        # the members of an object have no order, so their positions are no part of a path
        step = F.array_append("path", F.struct(F.col("key").isNotNull().alias("is_key"), F.when(F.col("key").isNull(), F.col("pos").cast("int")).alias("pos"), F.col("key").alias("key")))
        met = inner.select("survey_key", step.cast(PATH).alias("path"), "scopes", "value", F.explode(target).alias("t"))
        return met.select("survey_key", "path", F.col("t.spot").alias("spot"), F.concat("scopes", at(F.size("path"))).cast(SCOPES).alias("scopes"), "value")

    start = docs.select("survey_key", F.try_parse_json("doc").alias("value")).where("value is not null").select("survey_key", "value", F.explode(root).alias("t"))
    level = start.select("survey_key", F.array().cast(PATH).alias("path"), F.col("t.spot").alias("spot"), at(F.lit(0)).cast(SCOPES).alias("scopes"), "value")
    depth, rows = compiled.levels(), level
    if depth is None:  # as deep as the documents: a job for each level
        while not (level := land(members(level), "level")).isEmpty():
            rows = rows.unionByName(level)
    else:
        for _ in range(depth):
            level = members(level)
            rows = rows.unionByName(level)
    rows = land(rows, "values")
    ruled = rules.select("spot").distinct()
    judged = _facts(rows.join(F.broadcast(ruled), "spot", "left_semi")).join(rules, "spot").select("survey_key", "path", "scopes", "r_no", "r_keyword", F.posexplode(_broken()).alias("item_no", "message"))
    breaks = land(judged.select("survey_key", "path", "scopes", F.col("r_no").alias("rule_no"), "item_no", F.col("r_keyword").alias("keyword"), "message"), "breaks")
    if compiled.choices:
        breaks = _settled(breaks, _facts(rows.join(choices, "spot")).select("survey_key", "path", "scopes", "r_no", "choice", "r_keyword", "branches", _shown().alias("shown")))
    return breaks.where(F.size("scopes") == 0).drop("scopes")


def _settled(breaks: DataFrame, instances: DataFrame) -> DataFrame:
    """``breaks`` with those of the choices that hold in too few or too many branches, from the innermost choice outwards."""
    instances = land(instances, "choices")
    deepest = instances.agg(F.max(F.size("scopes"))).first()[0]  # no deeper than the documents
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        last = F.try_element_at("scopes", F.lit(-1))
        inside = breaks.where(F.size("scopes") == depth + 1).select("survey_key", F.slice("path", F.lit(1), last["depth"]).alias("path"), F.slice("scopes", F.lit(1), F.lit(depth)).alias("scopes"), last["choice"].alias("choice"), last["branch"].alias("branch"))
        failed = inside.distinct().groupBy("survey_key", "path", "scopes", "choice").agg(F.count("*").alias("failed"))
        here = instances.where(F.size("scopes") == depth).join(failed, ["survey_key", "path", "scopes", "choice"], "left")
        holds = F.col("branches") - F.coalesce("failed", F.lit(0))
        says = (
            F.when((F.col("r_keyword") != "not") & (holds == 0), F.concat("shown", F.lit(" is not valid under any of the given schemas")))
            .when((F.col("r_keyword") == "oneOf") & (holds > 1), F.concat("shown", F.lit(" is valid under more than one of the given schemas")))
            .when((F.col("r_keyword") == "not") & (holds == 1), F.concat("shown", F.lit(" should not be valid under the given schema")))
        )
        found = here.withColumn("message", says).where("message is not null").select("survey_key", "path", "scopes", F.col("r_no").alias("rule_no"), F.lit(0).alias("item_no"), F.col("r_keyword").alias("keyword"), "message")
        breaks = breaks.unionByName(found)
        if depth:
            breaks = land(breaks, "breaks")
    return breaks


def path_json(path: str) -> Column:
    """A path as a JSON array of names and positions."""
    return F.concat(F.lit("["), F.array_join(F.transform(path, lambda p: F.when(p["is_key"], _quoted(p["key"])).otherwise(p["pos"].cast("string"))), ","), F.lit("]"))


def _quoted(key: Column) -> Column:
    text = F.to_json(F.array(key))
    return F.substring(text, F.lit(2), F.length(text) - 2)
