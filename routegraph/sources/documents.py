"""Survey documents as normalised tables.

Reading never fails on shape: whatever has the wrong type counts as empty, as absent or as a default. Maps
keep the order of their keys, arrays their positions. Text that is not JSON is reported in ``invalid``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.schema import NO_PRIORITY, UNKNOWN


@dataclass
class Corpus:
    """Tables of many surveys, told apart by ``survey_key``."""

    surveys: DataFrame  # survey_key, survey_id, entry_node
    questions: DataFrame  # survey_key, ord, qid
    terminals: DataFrame  # survey_key, ord, tid
    dag_terminals: DataFrame  # survey_key, pos, tid
    blocks: DataFrame  # survey_key, ord, bid, block_order
    block_questions: DataFrame  # survey_key, bid, pos, qid
    edges: DataFrame  # survey_key and schema.EDGE; condition as JSON, null if there is none
    documents: DataFrame | None = None  # survey_key, doc
    #: The same surveys as one row each, with the named fields of edges, from sources that can give them so without a join: survey_key, survey_id, entry_node, edges,
    #: questions, terminals, listed (arrays of structs of the columns above, in document order, listed being dag_terminals) and small, false where they are too many to be one
    #: row, or the key is null, and the arrays are empty.
    rows: Callable[..., DataFrame] | None = None
    is_landed: bool = False

    def nodes(self) -> DataFrame:
        """survey_key, node, is_terminal: every defined id once; an id defined as both is terminal."""
        q = self.questions.select("survey_key", F.col("qid").alias("node"), F.lit(False).alias("t"))
        t = self.terminals.select("survey_key", F.col("tid").alias("node"), F.lit(True).alias("t"))
        return q.unionByName(t).groupBy("survey_key", "node").agg(F.bool_or("t").alias("is_terminal"))

    def _tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("documents", "rows", "is_landed")}

    def of(self, keys: DataFrame) -> Corpus:
        """The surveys of ``keys`` (survey_key) alone; a null is a key too."""
        told = keys.select(F.col("survey_key").alias("_key")).distinct()
        kept = lambda x: x.join(told, F.col("survey_key").eqNullSafe(F.col("_key")), "left_semi")
        return Corpus(**{k: kept(x) for k, x in self._tables().items()}, documents=None if self.documents is None else kept(self.documents))

    def landed(self, land, *names: str) -> Corpus:
        """The same tables, each written once, for plans that read them many times; with ``names``, those tables alone, where the others are read once at most."""
        return self if self.is_landed else replace(self, **{k: land(x, k) for k, x in self._tables().items() if not names or k in names}, is_landed=True)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(survey_key, doc): one JSON document per file; the key is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("survey_key"), F.col("value").alias("doc"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(survey_key, pos, recommendation_id, decision, approver, rationale) of a JSON list of decisions per file; what is no string is null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("survey_key"), "value")
    return decisions_of(files.select("survey_key", F.col("value").alias("decisions")))


def decisions_of(texts: DataFrame) -> DataFrame:
    rows = texts.select("survey_key", F.posexplode(F.from_json("decisions", "array<variant>")).alias("pos", "v"))
    return rows.select("survey_key", "pos", *[_string("v", f"$.{c}").alias(c) for c in ("recommendation_id", "decision", "approver", "rationale")])


def invalid(docs: DataFrame) -> DataFrame:
    """Documents whose text is not JSON."""
    return docs.where(F.try_parse_json("doc").isNull()).select("survey_key", F.lit("invalid_json").alias("error"))


def _string(v: str | Column, path: str) -> Column:
    """The string at ``path``; null for anything else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def _object(text: Column) -> Column:
    """map<string, JSON text> of a JSON object, in the order of its keys; an empty map for anything else."""
    return F.when(F.substring(F.ltrim(text), 1, 1) == "{", F.from_json(text, "map<string,string>"))


def _entries(df: DataFrame, column: Column, *names: str) -> DataFrame:
    return df.select("survey_key", F.posexplode(F.map_entries(column)).alias("ord", "e")).select("survey_key", "ord", F.col("e.key").alias(names[0]), F.col("e.value").alias(names[1]))


def normalise(docs: DataFrame) -> Corpus:
    """Corpus of (survey_key, doc)."""
    top = docs.select("survey_key", "doc", F.try_parse_json("doc").alias("v"), _object(_object(F.col("doc"))["survey"]).alias("survey"))
    parts = top.select("survey_key", "v", "survey", _object(F.col("survey")["dag"]).alias("dag"))
    surveys = parts.select("survey_key", F.coalesce(F.nullif(_string("v", "$.survey.id"), F.lit("")), F.lit(UNKNOWN)).alias("survey_id"), F.nullif(_string("v", "$.survey.dag.entry_node"), F.lit("")).alias("entry_node"))
    listed = parts.select("survey_key", F.posexplode(F.from_json(F.col("dag")["terminal_nodes"], "array<variant>")).alias("pos", "t"))
    blocks = _entries(parts, _object(F.col("survey")["blocks"]), "bid", "block").where(F.schema_of_variant(F.try_parse_json("block")).startswith("OBJECT"))
    order = F.try_variant_get(F.try_parse_json("block"), "$.order", "variant")
    in_blocks = blocks.select("survey_key", "ord", "bid", F.posexplode(F.try_variant_get(F.try_parse_json("block"), "$.questions", "array<variant>")).alias("pos", "q"))
    raw = parts.select("survey_key", F.posexplode(F.from_json(F.col("dag")["edges"], "array<variant>")).alias("ord", "e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    condition, priority, name = (F.try_variant_get("e", f"$.{c}", "variant") for c in ("condition", "priority", "id"))
    return Corpus(
        surveys=surveys,
        questions=_entries(parts, _object(F.col("survey")["questions"]), "qid", "x").drop("x"),
        terminals=_entries(parts, _object(F.col("survey")["terminal_nodes"]), "tid", "x").drop("x"),
        dag_terminals=listed.select("survey_key", "pos", _string("t", "$").alias("tid")).where("tid is not null"),
        blocks=blocks.select("survey_key", "ord", "bid", F.when(F.schema_of_variant(order) == "BIGINT", F.try_variant_get(order, "$", "long")).otherwise(NO_PRIORITY).alias("block_order")),
        block_questions=in_blocks.select("survey_key", "bid", "pos", _string("q", "$").alias("qid")).where("qid is not null"),
        edges=raw.select(
            "survey_key", "ord",
            F.when(F.schema_of_variant(name) == "VOID", "None").otherwise(F.when(name.isNotNull(), F.coalesce(F.try_variant_get(name, "$", "string"), F.to_json(name)))).alias("edge_id"),
            _string("e", "$.source").alias("source"),
            _string("e", "$.target").alias("target"),
            F.when(~F.is_variant_null(condition), F.to_json(condition)).alias("condition"),
            _string("e", "$.condition_text").alias("condition_text"),
            F.when(F.schema_of_variant(priority) == "BIGINT", F.try_variant_get(priority, "$", "long")).alias("priority"),
            _string("e", "$.type").alias("type"),
        ),
        documents=docs,
    )
