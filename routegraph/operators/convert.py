"""Universe expressions (text) converted to condition edges, for many surveys at once.

The rules keep their narrowness: an expression is a conjunction or a disjunction of exactly two parts, or one
comparison of a name with an unsigned integer, of which only the beginning is read; everything else is UNPARSED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routegraph.operators.graph import block_order
from routegraph.sources.documents import Corpus

# Expressions that always hold, and the spellings of comparisons in the order in which they are tried. Names may have
# letters of any alphabet; numbers have ASCII digits.
ALWAYS = ("always_show", "all respondents", "always", "entry point question")
LEAVES = (
    (r"(?iU)^(\w+)\s+not\s+includes\s+([0-9]+)", "NOT_IN"), (r"(?iU)^(\w+)\s+includes\s+([0-9]+)", "IN"),
    (r"(?U)^(\w+)\s*==\s*([0-9]+)", "="), (r"(?U)^(\w+)\s*!=\s*([0-9]+)", "!="), (r"(?U)^(\w+)\s*>=\s*([0-9]+)", ">="), (r"(?U)^(\w+)\s*<=\s*([0-9]+)", "<="),
    (r"(?U)^(\w+)\s*>\s*([0-9]+)", ">"), (r"(?U)^(\w+)\s*<\s*([0-9]+)", "<"), (r"(?U)^(\w+)\s*=\s*([0-9]+)", "="),
)


def _leaf(text: Column) -> Column:
    """The condition of one comparison, as JSON; null where the expression always holds."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    out = F.when(F.coalesce(text, F.lit("")) == "", None).when(F.lower(trimmed).isin(*ALWAYS), None)
    for pattern, op in LEAVES:
        number = F.regexp_replace(F.regexp_extract(trimmed, pattern, 2), r"^0+(?=\d)", "")
        found = F.concat(F.lit(f'["{op}","'), F.regexp_extract(trimmed, pattern, 1), F.lit('",'), number, F.lit("]"))
        out = out.when(trimmed.rlike(pattern), found)
    quoted = F.to_json(F.array(F.lit("UNPARSED"), trimmed))
    return out.otherwise(quoted)


def _halves(text: Column, op: str) -> Column:
    """The two parts of an expression around its only ``op``; null if there are not two."""
    parts = F.split(text, rf"(?i)\s+{op}\s+")
    bare = F.transform(parts, lambda x: F.btrim(x, F.lit("() ")))
    return F.when(F.upper(text).contains(f" {op} ") & (F.size(parts) == 2), bare)


def with_condition(df: DataFrame, text: str, out: str = "condition") -> DataFrame:
    """``df`` with the condition, as JSON, of the expression in column ``text``; null where it always holds.

    Two levels of splitting hold all there is: a part of a pair of ANDs has no AND, one of a pair of ORs no OR. All
    texts that can be comparisons stand in one array, so each rule is planned once."""
    rows = df.withColumn("_t", F.btrim(F.col(text), F.lit(" \t\n\r\f\x0b")))
    rows = rows.withColumns({"_a": _halves(F.col("_t"), "AND"), "_o": _halves(F.col("_t"), "OR")})
    a, o = [F.get("_a", F.lit(i)) for i in (0, 1)], [F.get("_o", F.lit(i)) for i in (0, 1)]
    rows = rows.withColumns({"_a0": _halves(a[0], "OR"), "_a1": _halves(a[1], "OR"), "_o0": _halves(o[0], "AND"), "_o1": _halves(o[1], "AND")})
    inner = [F.get(c, F.lit(i)) for c in ("_a0", "_a1", "_o0", "_o1") for i in (0, 1)]
    rows = rows.withColumn("_leaves", F.transform(F.array(F.col("_t"), *a, *o, *inner), _leaf))
    leaf = lambda i: F.get("_leaves", F.lit(i))

    def pair(op: str, left: Column, right: Column) -> Column:
        return F.concat(F.lit(f'["{op}",'), left, F.lit(","), right, F.lit("]"))  # null if either is

    def node(i: int, op: str, j: int) -> Column:
        return F.when(leaf(i).isNotNull(), F.coalesce(pair(op, leaf(j), leaf(j + 1)), leaf(i)))

    rows = rows.withColumn("_n", F.array(node(1, "OR", 5), node(2, "OR", 7), node(3, "AND", 9), node(4, "AND", 11)))
    n = [F.get("_n", F.lit(i)) for i in range(4)]
    return rows.withColumn(out, F.when(leaf(0).isNotNull(), F.coalesce(pair("AND", n[0], n[1]), pair("OR", n[2], n[3]), leaf(0)))).drop("_t", "_a", "_o", "_a0", "_a1", "_o0", "_o1", "_leaves", "_n")


def universes(corpus: Corpus) -> DataFrame:
    """(survey_key, qid, expression, dependencies) of the documents of a corpus of the earlier format."""
    survey = F.coalesce(F.get_json_object("doc", "$.survey"), F.col("doc"))
    rows = corpus.documents.select("survey_key", F.explode(F.map_entries(F.from_json(F.get_json_object(survey, "$.questions"), "map<string,string>"))).alias("e"))
    universe = F.from_json(F.get_json_object("e.value", "$.universe"), "expression string, dependencies array<string>")
    return rows.select("survey_key", F.col("e.key").alias("qid"), F.coalesce(universe["expression"], F.lit("always_show")).alias("expression"), universe["dependencies"].alias("dependencies"))


def universe_edges(order: DataFrame, universe: DataFrame) -> DataFrame:
    """Edges (survey_key, ord, edge_id, source, target, condition, condition_text, priority, type): one branch from each
    dependency that exists, then a fallthrough to each unconditional question from the one before it."""
    told = with_condition(universe, "expression")
    placed = order.join(told, ["survey_key", "qid"], "left")
    known = universe.select("survey_key", F.col("qid").alias("source"))
    branches = placed.where("condition is not null").select("survey_key", F.col("ord").alias("a"), "qid", "condition", "expression", F.posexplode("dependencies").alias("b", "source")).join(known, ["survey_key", "source"], "left_semi")
    before = F.lag("qid").over(W.partitionBy("survey_key").orderBy("ord"))
    falls = placed.withColumn("source", before).where("source is not null and condition is null")
    every = branches.select("survey_key", F.lit(0).alias("part"), "a", "b", "source", F.col("qid").alias("target"), "condition", F.col("expression").alias("condition_text"), F.lit(1).cast("long").alias("priority"), F.lit("branch").alias("type")).unionByName(
        falls.select("survey_key", F.lit(1).alias("part"), F.col("ord").alias("a"), F.lit(0).alias("b"), "source", F.col("qid").alias("target"), F.lit(None).cast("string").alias("condition"), F.lit("fallthrough").alias("condition_text"), F.lit(999).cast("long").alias("priority"), F.lit("fallthrough").alias("type"))
    )
    number = F.row_number().over(W.partitionBy("survey_key").orderBy("part", "a", "b"))
    return every.withColumn("no", number).select("survey_key", (F.col("no") - 1).alias("ord"), F.format_string("E%03d", F.col("no")).alias("edge_id"), "source", "target", "condition", "condition_text", "priority", "type")


def converted_edges(corpus: Corpus) -> DataFrame:
    return universe_edges(block_order(corpus), universes(corpus))


def converted_documents(corpus: Corpus) -> DataFrame:
    """(survey_key, doc): documents of the later format, without universes and with the edges above."""
    edge = F.struct(F.col("edge_id").alias("id"), "source", "target", F.coalesce("condition", F.lit("null")).alias("condition"), "condition_text", "priority", "type")
    text = lambda e: F.concat(
        F.lit('{"id":'), _quote(e["id"]), F.lit(',"source":'), _quote(e["source"]), F.lit(',"target":'), _quote(e["target"]), F.lit(',"condition":'), e["condition"],
        F.lit(',"condition_text":'), _quote(e["condition_text"]), F.lit(',"priority":'), e["priority"].cast("string"), F.lit(',"type":'), _quote(e["type"]), F.lit("}"),
    )
    edges = converted_edges(corpus).groupBy("survey_key").agg(F.array_sort(F.collect_list(F.struct("ord", edge.alias("e")))).alias("es"))
    survey = F.from_json(F.coalesce(F.get_json_object("doc", "$.survey"), F.col("doc")), "map<string,string>")
    rows = corpus.documents.withColumn("s", survey).join(edges, "survey_key", "left").withColumn("es", F.coalesce("es", F.array().cast(edges.schema["es"].dataType)))
    part = lambda name, other: F.coalesce(F.col("s")[name], F.lit(other))
    questions = F.map_entries(F.from_json(part("questions", "{}"), "map<string,string>"))
    bare = lambda q: _object(F.map_filter(F.from_json(q, "map<string,string>"), lambda k, _: k != "universe"), q)
    shown = F.array_join(F.transform(questions, lambda e: F.concat(_quote(e["key"]), F.lit(":"), bare(e["value"]))), ",")
    metadata = F.from_json(part("metadata", "{}"), "map<string,string>")
    version = F.coalesce(metadata["schema_version"], F.lit("2.0"))
    stamped = F.map_concat(F.map_filter(metadata, lambda k, _: k != "schema_version"), F.create_map(F.lit("schema_version"), F.lit("3.0")))
    listed = F.array_join(F.transform("es", lambda x: text(x["e"])), ",")
    return rows.select(
        "survey_key",
        F.concat(
            F.lit('{"survey":{"id":'), _quote(part("id", "unknown")), F.lit(',"title":'), _quote(part("title", "")), F.lit(',"version":"3.0","metadata":'), _object(stamped, part("metadata", "{}")),
            F.lit(',"blocks":'), part("blocks", "{}"), F.lit(',"questions":{'), shown, F.lit('},"dag":{"edges":['), listed, F.lit('],"metadata":{"total_edges":'), F.size("es").cast("string"),
            F.lit(',"generated_from":"universe expressions","source_version":'), _quote(version), F.lit("}}}}"),
        ).alias("doc"),
    )


def _quote(x: Column) -> Column:
    """A JSON string: what to_json writes of an array of one, without its brackets."""
    shown = F.to_json(F.array(x))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def _object(entries: Column, source: Column) -> Column:
    """A JSON object of map<string, JSON text>. Strings have lost their quotes in the map; ``source`` tells which were strings."""
    def shown(e: Column) -> Column:
        kind = F.schema_of_variant(F.get(F.map_values(F.map_filter(F.try_variant_get(F.try_parse_json(source), "$", "map<string,variant>"), lambda k, _: k == e["key"])), F.lit(0)))
        return F.concat(_quote(e["key"]), F.lit(":"), F.when(e["value"].isNull(), F.lit("null")).when(kind.isNull() | (kind == "STRING"), _quote(e["value"])).otherwise(e["value"]))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(entries), shown), ","), F.lit("}"))
