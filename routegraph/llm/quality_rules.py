"""Quality rules: isolation forests over rule statistics of whole documents.

``rule_statistics`` counts, for every document, what the rules look at. ``fit_forest`` grows random
isolation trees over a bounded sample of those statistics (subsampling is what the forest's path
lengths are defined on; the bound is the parameter ``per_tree * trees``). There is a forest for how a text is written and one
for how it repeats itself, as a repeated line alone sets a document apart and would hide other oddities in a common forest.
``calibrate`` reads every labelled row and picks the anomaly threshold of a forest. ``judge`` scores each document by its mean
path lengths; one that either forest finds anomalous goes.

Defined results: a null or empty text has no words, so it fails the base rules; null ids stay null
and are judged like any other row; repeated rows are judged one by one; with no labelled rows, or
labels of one kind only, the threshold is one that no score reaches, so only the base rules decide;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so extra columns of any
name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, land

STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FORESTS = {"writing": ("symbol_share", "mean_word_length"), "repetition": ("dup_line_share", "repeat_word_share")}
FEATURES = tuple(f for names in FORESTS.values() for f in names)
#: A threshold must catch this much more of all labelled bad rows than of the good ones, or the forest decides nothing: it would
#: cost good rows for the few bad ones that the forest before has left.
LEAST_GAIN = 0.02


def _repeat_words(words: list[list[str]], window: int = WINDOW) -> np.ndarray:
    """For each document, its words that lie in a window found twice or more in that document.

    Windows of 2, 4 and 8 words are numbered in turn by equality of their two halves, so equal
    numbers mean equal words; nothing is hashed.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    total = int(lengths.sum())
    if total == 0:
        return out
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(x, len(ids)) for w in words for x in w), np.int64, total)
    doc = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(total)  # words from here to the end of the document
    at, width = np.arange(total), 1
    while width < window:
        at = at[left[at] >= 2 * width]
        if not len(at):
            return out
        key = code[at] * (int(code.max()) + 1) + code[at + width]
        _, inverse = np.unique(key, return_inverse=True)
        code = np.zeros(total, np.int64)
        code[at] = inverse
        width *= 2
    _, inverse, count = np.unique(code[at] * len(words) + doc[at], return_inverse=True, return_counts=True)
    starts = at[count[inverse] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.bincount(doc, np.cumsum(edge)[:total] > 0, len(words)).astype(np.int64)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch):
            texts = [x or "" for x in part.column("text").to_pylist()]
            words = [WORD.findall(x) for x in texts]
            lines = list(map(_lines, texts))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sum(map(len, w)) for w in words], pa.int64()),
                    pa.array([sum(map(x.count, SYMBOLS)) for x in texts], pa.int64()),
                    pa.array([d for _, d in lines], pa.int64()),
                    pa.array(_repeat_words(words), pa.int64()),
                    pa.array([n for n, _ in lines], pa.int64()),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
            )


def _pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row for each document, from its whole text; no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, STATISTICS)


def features(stats: DataFrame) -> DataFrame:
    """What the forests split on, each from 0 to about 1: symbols against the characters of words, the mean word length in units of 50 at
    most, repeated lines among the lines, and words in repeated windows among the words."""
    some = F.greatest("n_words", F.lit(1))
    return stats.withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), "mean_word_length": F.least(F.col("word_chars") / some, F.lit(50.0)) / 50.0,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_word_share": F.col("n_repeat_words") / some,
        }
    )


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points, the usual normaliser of path lengths."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[list[np.ndarray]]:
    """A tree of random splits as parallel arrays: feature (-1 at a leaf), cut, left, right, path length at the leaf."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for a, v in zip((feature, cut, left, right, path), (-1, 0.0, me, me, depth + _average_path(len(rows))), strict=True):
            a.append(v)
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(points.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            c = float(rng.uniform(low[f], high[f]))
            feature[me], cut[me] = f, c
            left[me] = node(rows[rows[:, f] < c], depth + 1)
            right[me] = node(rows[rows[:, f] >= c], depth + 1)
        return me

    node(points, 0)
    return [np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path), limit]


def forest_sample(feats: DataFrame, trees: int = 100, per_tree: int = 256, seed: int = 7) -> pd.DataFrame:
    """The features of at most ``trees * per_tree`` documents (of those with 20 words or more), taken by a
    hash of the id and the statistics so that reruns and other partitionings draw the same rows."""
    need = trees * per_tree
    eligible = feats.where("n_words >= 20")
    # a share that leaves somewhat more than is needed, so that what reaches the driver is bounded whatever the number of tasks
    share = min(1.0, 1.2 * need / max(eligible.count(), 1))
    return (
        eligible.select(*FEATURES, F.xxhash64("doc_id", "n_words", "word_chars", F.lit(seed)).alias("_draw"))
        .where(F.pmod("_draw", F.lit(1_000_000_007)) <= share * 1_000_000_007)
        .orderBy("_draw", *FEATURES)
        .limit(need)
        .toPandas()
    )


def fit_forest(points: np.ndarray, trees: int = 100, per_tree: int = 256, seed: int = 7) -> dict:
    """Trees, each over ``per_tree`` of the points drawn at random."""
    rng = np.random.default_rng(seed)
    grown = [grow_tree(points[rng.choice(len(points), min(per_tree, len(points)), replace=False)], rng) for _ in range(trees)] if len(points) else []
    return {"trees": grown, "normal": _average_path(min(per_tree, max(len(points), 1))) or 1.0}


def anomaly(points: np.ndarray, forest: dict) -> np.ndarray:
    """2 ** (-mean path / normal), near 1 for points that few random splits set apart."""
    if not forest["trees"] or not len(points):
        return np.full(len(points), 0.5)
    total = np.zeros(len(points))
    for feature, cut, left, right, path, limit in forest["trees"]:
        at = np.zeros(len(points), np.int64)
        for _ in range(limit):
            f = feature[at]
            low = points[np.arange(len(points)), np.maximum(f, 0)] < cut[at]
            at = np.where(f < 0, at, np.where(low, left[at], right[at]))
        total += path[at]
    return 2.0 ** (-total / len(forest["trees"]) / forest["normal"])


def score(feats: DataFrame, forests: dict[str, dict]) -> DataFrame:
    """``feats`` with a column ``anomaly_<name>`` for each forest. A forest has a fixed number of trees of bounded size, so it is broadcast."""
    sent = feats.sparkSession.sparkContext.broadcast(forests)

    @F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in forests]))
    def path_scores(*columns: pa.Array) -> pa.Array:
        given = dict(zip(FEATURES, columns, strict=True))
        scores = [anomaly(np.column_stack([given[f].to_numpy(zero_copy_only=False) for f in FORESTS[name]]), forest) for name, forest in sent.value.items()]
        return pa.StructArray.from_arrays(list(map(pa.array, scores)), list(sent.value))

    scored = feats.withColumn("_scores", path_scores(*FEATURES))
    return scored.withColumns({f"anomaly_{name}": F.col(f"_scores.{name}") for name in forests}).drop("_scores")


def calibrate(scored: DataFrame, labels: DataFrame, column: str, left: Column, keep_good: float = 0.99, bins: int = 2000) -> float:
    """The threshold of the scores in ``column`` that best separates labelled good from bad rows, never below the one that keeps
    ``keep_good`` of the good ones. Every labelled row of ``scored`` counts; those that are not ``left`` have been decided, the others fall
    into ``bins`` score bins. 2, which no score reaches, if no threshold gains LEAST_GAIN."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).where("_quality in (0, 1)")
    counts = (
        scored.select("doc_id", F.when(left, F.floor(F.col(column) * bins)).otherwise(-1).cast("int").alias("_bin"))
        .join(known, F.col("doc_id") == F.col("_id"))
        .groupBy("_bin")
        .agg(F.sum("_quality").alias("good"), F.count("*").alias("n"))
        .collect()
    )
    good, bad, all_good, all_bad = np.zeros(bins + 1), np.zeros(bins + 1), 0, 0
    for r in counts:
        all_good, all_bad = all_good + r["good"], all_bad + r["n"] - r["good"]
        if r["_bin"] >= 0:
            good[r["_bin"]] += r["good"]
            bad[r["_bin"]] += r["n"] - r["good"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost_good, caught_bad = (good.sum() - np.cumsum(good)) / all_good, (bad.sum() - np.cumsum(bad)) / all_bad
    gain = np.where(lost_good <= 1 - keep_good, caught_bad - lost_good, -9)
    best = int(np.argmax(gain))
    return (best + 1) / bins if gain[best] >= LEAST_GAIN else 2.0


def judge(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Base counts, base verdict, anomaly scores and the kept flag of every document."""
    feats = features(land(rule_statistics(docs), "rule-statistics") if stats is None else stats)
    sample = forest_sample(feats)
    scored = score(feats, {name: fit_forest(sample[list(columns)].to_numpy(float)) for name, columns in FORESTS.items()})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = land(scored.withColumn("base_failed", failed), "rule-scores")
    # a forest's verdict matters only where neither the base rules nor a forest before it decide
    left, thresholds = ~F.col("base_failed"), {}
    for name in FORESTS:
        thresholds[name] = calibrate(scored.where("not base_failed"), labels, f"anomaly_{name}", left)
        left = left & (F.col(f"anomaly_{name}") < thresholds[name])
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", left.alias("kept"),
        *[c for name in FORESTS for c in (F.col(f"anomaly_{name}"), F.lit(thresholds[name]).alias(f"threshold_{name}"))],
    )
