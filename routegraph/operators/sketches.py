"""Distinct counts and quantiles from sketches that are stored for each part of a table and merged over parts and runs.

A part (a day, a load) is read once; its sketches, a few kilobytes for each group, answer for any set of parts later. Adding a part again
replaces it, so a run that is repeated counts once. Sketches are made in each task before the shuffle, so a group that holds most
rows is a sketch from each task like any other.

Errors: a distinct count has a relative standard error of 1.04 / sqrt(2 ** DISTINCT_BITS), 0.8 %; the rank of a quantile is off by less than
RANK_ERROR of the group's values in 99 of 100 cases. Nulls count as rows, not as values; a group without values has
quantiles of null and a distinct count of 0. Values that are no numbers are not ranked (NaN).
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTINCT_BITS, DISTINCT_ERROR = 14, 1.04 / 2**7
RANKS_KEPT, RANK_ERROR = 400, 0.008
PART_NAME = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass
class StoredSketches:
    """Sketches under ``place`` for groups of ``keys``: of the different values of ``distinct``, and of the ranks of ``value``."""

    place: str
    keys: Sequence[str]
    distinct: str
    value: str

    def add(self, part: str, rows: DataFrame) -> None:
        """Read ``rows`` and store their sketches as ``part``, in place of what it held."""
        if not PART_NAME.fullmatch(part):
            raise ValueError(f"a part's name is made of letters, digits, '_', '.' and '-': {part!r}")
        number = F.col(self.value).cast("double")
        sketched = rows.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.hll_sketch_agg(F.col(self.distinct).cast("string"), DISTINCT_BITS).alias("distinct_sketch"),
            F.kll_sketch_agg_double(F.when(~F.isnan(number), number), RANKS_KEPT).alias("rank_sketch"),
        )
        sketched.write.mode("overwrite").parquet(f"{self.place}/part={part}")

    def merged(self, spark: SparkSession, quantiles: Sequence[float] = (0.5,), parts: Collection[str] | None = None) -> DataFrame:
        """keys, n_rows, n_distinct, and an array with the value at each of ``quantiles``, over all parts or those named."""
        stored = spark.read.parquet(self.place)
        if parts is not None:
            stored = stored.where(F.regexp_extract(F.col("_metadata.file_path"), "/part=([^/]+)/", 1).isin(*parts))
        rows = stored.groupBy(*self.keys).agg(
            F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"), F.kll_merge_agg_double("rank_sketch").alias("_ranks")
        )
        at = [F.kll_sketch_get_quantile_double("_ranks", F.lit(float(q))) for q in quantiles]
        values = F.when(F.kll_sketch_get_n_double("_ranks") > 0, F.array(*at)).otherwise(F.lit([None] * len(at)).cast(T.ArrayType(T.DoubleType())))
        return rows.select(*self.keys, "n_rows", "n_distinct", values.alias("quantiles"))


def rank_holds(below: Column, not_above: Column, n: Column, quantile: float, error: float) -> Column:
    """Whether a value may stand at ``quantile`` of n values, ``below`` of them less and ``not_above`` at most it, within ``error`` of n."""
    return (below <= n * (quantile + error)) & (not_above >= n * (quantile - error))
