"""Conditions compiled to Spark columns.

An answer is a struct: ``kind`` (n number, s string, l list, o object, null if missing), ``num``, ``str``, ``token`` (a string that is
equal for equal values, as 1, 1.0 and true are) and ``items`` (tokens of a list's elements). A condition becomes a
status column: ``T``, ``F`` or an error text that begins with ``E:``. Errors are values, so short-circuit evaluation
keeps its meaning although Spark promises no order of evaluation.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from routegraph.functions.ast import ConditionError, operands
from routegraph.schema import COMPARISON

Lookup = Callable[[str], Column]
MISSING = "z"


#: From here on not every integer is a double; such numbers are told apart as integers, as long as they fit in 64 bits.
EXACT, LARGEST = 2**53, 2**63


def number_token(x: Column) -> Column:
    double = x.cast("double") + F.lit(0.0)
    return F.concat(F.lit("n:"), F.coalesce(F.when(F.abs(double) >= EXACT, x.try_cast("long").cast("string")), double.cast("string")))


def token(value: Any) -> str:
    """The token of a literal, as Spark writes the token of an equal answer."""
    if value is None:
        return MISSING
    if isinstance(value, bool | int | float):
        if EXACT <= abs(value) < LARGEST:
            return f"n:{int(value)}"
        x = float(value)
        if x == 0:
            return "n:0.0"
        text = repr(x)
        if 1e-3 <= abs(x) < 1e7 or x != x or x in (float("inf"), float("-inf")):
            return "n:" + {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}.get(text, text)
        digits, exponent = f"{x:.17e}".split("e")
        for n in range(17):  # the fewest digits that give the same number, as Java writes them
            digits, exponent = f"{x:.{n}e}".split("e")
            if float(f"{digits}e{exponent}") == x:
                break
        return f"n:{digits if '.' in digits else digits + '.0'}E{int(exponent)}"
    if isinstance(value, list):
        return "l:" + json.dumps([token(x) for x in value], separators=(",", ":"), ensure_ascii=False)
    return "s:" + value if isinstance(value, str) else "o:" + json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _answer(kind: Column, num: Column, text: Column, tok: Column, items: Column) -> Column:
    return F.struct(kind.alias("kind"), num.cast("double").alias("num"), text.cast("string").alias("str"), tok.alias("token"), items.cast("array<string>").alias("items"))


def number_answer(x: Column) -> Column:
    none = F.lit(None)
    return F.when(x.isNotNull(), _answer(F.lit("n"), x, none, number_token(x), none))


def string_answer(x: Column) -> Column:
    none = F.lit(None)
    return F.when(x.isNotNull(), _answer(F.lit("s"), none, x, F.concat(F.lit("s:"), x), none))


def list_answer(x: Column, element: Callable[[Column], Column]) -> Column:
    """A list answer; ``element`` gives the token of an element, such as ``number_token``."""
    none = F.lit(None)
    items = F.transform(x, lambda v: F.coalesce(element(v), F.lit(MISSING)))
    return F.when(x.isNotNull(), _answer(F.lit("l"), none, none, F.concat(F.lit("l:"), F.to_json(items)), items))


def json_answers(answers: Column) -> Column:
    """map<string, answer> of a JSON object of answers (scalars and lists of scalars)."""
    def tok(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(v.isNull() | F.is_variant_null(v), F.lit(MISSING))
            .when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string")))
            .when(kind == "BOOLEAN", number_token(F.try_variant_get(v, "$", "boolean").cast("int")))
            .when(kind == "BIGINT", number_token(F.try_variant_get(v, "$", "long")))
            .when(kind.startswith("OBJECT"), F.concat(F.lit("o:"), F.to_json(v)))
            .otherwise(number_token(F.try_variant_get(v, "$", "double")))
        )

    def answer(_: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        none = F.lit(None)
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), tok)
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        return (
            F.when(F.is_variant_null(v), none)
            .when(kind.startswith("ARRAY"), _answer(F.lit("l"), none, none, F.concat(F.lit("l:"), F.to_json(listed)), listed))
            .when(kind == "STRING", _answer(F.lit("s"), none, F.try_variant_get(v, "$", "string"), tok(v), none))
            .when(kind.startswith("OBJECT"), _answer(F.lit("o"), none, none, tok(v), none))
            .otherwise(_answer(F.lit("n"), number, none, tok(v), none))
        )

    return F.transform_values(F.try_variant_get(F.try_parse_json(answers), "$", "map<string,variant>"), answer)


def _truth(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), F.lit("T")).otherwise(F.lit("F"))


def _error(text: Any) -> Column:
    return F.lit(f"E:{text}")


def _first_other(parts: list[Column], passing: str) -> Column:
    """The first part that is not ``passing``; ``passing`` if there is none."""
    return F.coalesce(*[F.when(p != passing, p) for p in parts], F.lit(passing))


def status(node: Any, answer: Lookup) -> Column:
    """T, F or an error, as evaluation from left to right with short circuit would give."""
    if node is None:
        return F.lit("T")
    if not isinstance(node, list) or not node:
        return F.lit("T" if node else "F")
    op = node[0]
    try:
        if op in ("TRUE", "FALSE"):
            operands(node, 0, 0)
            return F.lit(op[0])
        if op in ("AND", "OR"):
            return _first_other([status(x, answer) for x in operands(node, 1, None)], "T" if op == "AND" else "F")
        if op == "NOT":
            inner = status(operands(node, 1, 1)[0], answer)
            return F.when(inner == "T", "F").when(inner == "F", "T").otherwise(inner)
        if not isinstance(op, str) or op not in COMPARISON:
            return _error(f"Unknown condition operator: {op}")
        name, literal = operands(node, 2, 2)
        if not isinstance(name, str):
            return _error(f"Malformed condition for operator {op}: variable must be a string")
    except ConditionError as error:
        return _error(error)
    return _comparison(op, answer(name), literal)


def _comparison(op: str, a: Column, literal: Any) -> Column:
    tok, kind = F.coalesce(a["token"], F.lit(MISSING)), a["kind"]
    if op == "=":
        return _truth(tok == token(literal))
    if op == "!=":
        return _truth(tok != token(literal))
    if op in ("in", "not_in"):
        if not isinstance(literal, list):
            return _error(f"Unsupported operands for condition operator {op}: right operand must be a list")
        found = tok.isin([token(x) for x in literal]) if literal else F.lit(False)
        return _truth(found if op == "in" else ~found)
    if op == "contains":
        wrong = _error("Unsupported operands for condition operator contains: left operand must be a list")
        return F.when(kind.isNull(), "F").when(kind != "l", wrong).otherwise(_truth(F.array_contains(a["items"], token(literal))))
    wanted = "s" if isinstance(literal, str) else "n" if isinstance(literal, bool | int | float) else "-"
    left = a["str"] if wanted == "s" else a["num"]
    right = F.lit(literal if wanted == "s" else float(literal) if wanted == "n" else None)
    held = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
    return F.when(kind.isNull(), "F").when(kind != wanted, _error(f"Unsupported operands for condition operator {op}")).otherwise(_truth(held))


def predicate(node: Any, answer: Lookup) -> Column:
    """A Boolean column for conditions that cannot err, with every null settled at the leaves, never above them."""
    return status(node, answer) == "T"


def dialect_v3(node: Any) -> Any:
    """A condition of the later dialect in the operators of this one: a missing answer counts as 0 in inequalities,
    IN, NOT_IN, ANY and ALL ask for elements of a list answer, ALWAYS and NEVER are constants."""
    if not isinstance(node, list) or not node:
        return node
    op, *rest = node
    if op in ("AND", "OR", "NOT"):
        return [op, *map(dialect_v3, rest)]
    if op in ("ALWAYS", "NEVER"):
        return ["TRUE" if op == "ALWAYS" else "FALSE"]
    if op == "IN":
        return ["contains", *rest]
    if op == "NOT_IN":
        return ["NOT", ["contains", *rest]]
    if op in ("ANY", "ALL"):
        name, literals = rest
        return ["OR" if op == "ANY" else "AND", *[["contains", name, x] for x in literals]]
    if op in (">", "<", ">=", "<=") and len(rest) == 2 and isinstance(rest[1], int | float):
        zero = {">": 0 > rest[1], "<": 0 < rest[1], ">=": 0 >= rest[1], "<=": 0 <= rest[1]}[op]
        return ["OR", ["=", rest[0], None], node] if zero else node
    return node
