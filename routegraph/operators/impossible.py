"""Edges that no respondent can take, whatever is answered, because of their conditions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routegraph.functions.domains import Judge
from routegraph.operators.graph import outgoing_ranks
from routegraph.sources.documents import Corpus


@F.pandas_udf(T.ArrayType(T.StringType()))
def condition_verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``verdicts`` of each array. A task has one judge, so each different condition is evaluated once a task."""
    judge = Judge()
    for conditions in batches:
        yield pd.Series([judge.verdicts(list(texts)) for texts in conditions], dtype=object)


def edge_verdicts(corpus: Corpus) -> DataFrame:
    """(survey_key, source, rank, edge_id, condition, verdict) of every edge with a source: ``never``, ``shadowed`` or ``possible``, see ``verdicts``.

    Answers may be any JSON values, whatever the question's type; answers to different questions are free of each other, and so are the edges of different
    sources. One shuffle, by source; a source's edges meet in one row."""
    ranked = outgoing_ranks(corpus.edges.where("source is not null"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "edge_id", "condition")))
    packed = ranked.groupBy("survey_key", "source").agg(listed.alias("edges"))
    judged = packed.withColumn("verdicts", condition_verdicts(F.transform("edges", lambda e: e["condition"])))
    each = judged.select("survey_key", "source", F.explode(F.arrays_zip("edges", "verdicts")).alias("e"))
    return each.select("survey_key", "source", "e.edges.rank", "e.edges.edge_id", "e.edges.condition", F.col("e.verdicts").alias("verdict"))


def impossible_edges(corpus: Corpus) -> DataFrame:
    """``edge_verdicts`` of the edges that cannot be taken."""
    return edge_verdicts(corpus).where("verdict <> 'possible'")
