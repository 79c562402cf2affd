"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is a share of all words by weight, at most ``cap`` times its own words; the excess is
reshared by weight. A source at ratio r of target to own words takes every document floor(r) times, and
one more time with probability r - floor(r): that draw is balanced. The flight phase moves the vector of
probabilities through the null space of two constraints, the number of documents and the number of
words, until at most two of them are left undecided. Chunks of bounded size fly apart; what they leave
undecided flies on together, level by level; the landing decides the last dozen of a source.

Defined results: a null text has size 0; rows without a source are a source of their own, last in order;
repeated rows, and rows without an id, are told apart by a number and drawn one by one; a corpus without words takes each document as its ratio (0) says; an
empty table gives an empty result. ``decisions`` reads doc_id, text and source; ``mix`` keeps all columns.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, n_words, numbered_copies, positions

CHUNK_ROWS = 2_000
#: Numbers of copies are broadcast up to this many rows (12 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Units that wait for the landing, besides the two that the flight leaves.
HELD = 10
EPSILON = 1e-9


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """A landed table of doc_id, source, size and ``keep``, with the task that wrote each row and a hash of what the row is drawn by."""
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), *keep)
    return land(rows.withColumns({"part": F.spark_partition_id(), "row_hash": F.xxhash64("doc_id", "source", "size")}), "sizes")


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target. Weights repeat over the sources in code-point order, null last.

    Targets are min(cap * size, level * weight); the level rises by one small aggregate for each
    time that some source reaches its cap, so sources are never collected."""
    totals = land(positions(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), F.asc_nulls_last("source")), "sources")
    totals = totals.withColumns({"weight": F.element_at(F.lit([float(w) for w in weights]), (F.col("position") % len(weights)).cast("int") + 1), "most": cap * F.col("source_size")})
    everything, weight = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, full = (everything / weight if weight else 0.0), -1
    while weight:
        capped = F.col("most") <= level * F.col("weight")
        n, taken, left = totals.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not left:
            break
        full, level = n, (everything - taken) / left
    return totals.select("source", "source_size", "n_docs", F.least("most", level * F.col("weight")).alias("target"))


def fly(p: list[float], x: list[float], draw: random.Random) -> list[float]:
    """The flight phase for the constraints sum(p) and sum(p * x): three undecided units at a time move along the
    null vector of their two constraints, up or down with the odds that keep each probability, until one is
    decided. At most two stay undecided."""
    p, active, n, at = list(p), [], len(p), 0
    while True:
        while len(active) < 3 and at < n:
            if EPSILON < p[at] < 1 - EPSILON:
                active.append(at)
            at += 1
        if len(active) < 3:
            return p
        i, j, k = active
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if max(map(abs, u)) < EPSILON:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / v if v > 0 else p[a] / -v for a, v in zip(active, u, strict=True) if v)
        down = min(p[a] / v if v > 0 else (1 - p[a]) / -v for a, v in zip(active, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for a, v in zip(active, u, strict=True):
            p[a] += step * v
            if p[a] < EPSILON:
                p[a] = 0.0
            elif p[a] > 1 - EPSILON:
                p[a] = 1.0
        active = [a for a in active if 0 < p[a] < 1]


def land_last(p: list[float], x: list[float]) -> list[float]:
    """The landing: of all ways to decide the few open units, the one whose words and documents come
    nearest to the balance."""
    open_ = [i for i, v in enumerate(p) if EPSILON < v < 1 - EPSILON]
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choices - np.array([p[i] for i in open_])
    best = choices[np.argmin((off @ np.array([x[i] for i in open_])) ** 2 + 0.01 * off.sum(1) ** 2)] if open_ else []
    out = [float(round(v)) for v in p]
    for i, c in zip(open_, best, strict=True):
        out[i] = float(c)
    return out


def _flight(level: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source, chunk, last = key
        rows = rows.sort_values(["tie", "size"], kind="stable")
        x = (rows["size"] / max(rows["size"].mean(), 1e-12)).tolist()
        draw = random.Random(zlib.crc32(f"{seed}/{level}/{source}/{chunk}".encode()))
        p = rows["p"].tolist()
        if not last:
            return rows.assign(p=fly(p, x, draw))
        # a few units of all sizes wait for the landing, so that it can meet the balance closely
        open_ = sorted((i for i, v in enumerate(p) if EPSILON < v < 1 - EPSILON), key=lambda i: x[i])
        wait = {open_[int(q * (len(open_) - 1))] for q in np.linspace(0, 1, HELD)} if open_ else set()
        fly_ = [i for i in range(len(p)) if i not in wait]
        for i, v in zip(fly_, fly([p[i] for i in fly_], [x[i] for i in fly_], draw), strict=True):
            p[i] = v
        return rows.assign(p=land_last(p, x))

    return run


def decisions(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns ``keep``, for every row of ``docs``."""
    rows = sized(docs, *keep)
    goals = targets(rows, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = numbered_copies(rows, "row_hash").join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", *keep, "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("p"),
        F.xxhash64("row_hash", "copy", F.lit(seed)).alias("tie"),
        "n_docs",
    )
    n_chunks = F.ceil(F.col("n_docs") / CHUNK_ROWS)
    units = units.withColumns({"chunks": n_chunks.cast("long"), "chunk": F.pmod("tie", n_chunks.cast("long"))}).drop("n_docs")
    done, level = [], 0
    while True:
        flown = units.withColumn("last", F.col("chunks") == 1).groupBy("source", "chunk", "last").applyInPandas(_flight(level, seed), T.StructType([*units.schema.fields, T.StructField("last", T.BooleanType())]))
        flown = land(flown, "flight")
        done.append(flown.where("last or p <= 0 or p >= 1"))
        left = flown.where("not last and p > 0 and p < 1").drop("last")
        if left.isEmpty():
            break
        # each chunk leaves two units at most
        fewer = F.ceil(2 * F.col("chunks") / CHUNK_ROWS).cast("long")
        units, level = left.withColumn("chunks", fewer).withColumn("chunk", F.pmod("tie", fewer)).select(*units.columns), level + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = F.col("whole") + F.round("p").cast("int")
    return every.select("doc_id", "source", "size", *keep, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, in all its columns, each as often as the mix takes it (from 0 times to ``cap``). Rows get a number
    when they are landed; only numbers and copies move, unless there are too many of them to broadcast."""
    held = land(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_id")), "to-mix")
    taken = decisions(held.select("row.doc_id", "row.source", "row.text", "row_id"), weights, cap, keep=("row_id",)).where("copies > 0").select("row_id", F.col("copies").alias("n"))
    taken = land(taken, "copies")
    chosen = held.join(F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken, "row_id")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
