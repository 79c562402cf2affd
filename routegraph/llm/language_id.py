"""Language identification with a string kernel.

The kernel of two texts is the number of 1-, 2- and 3-grams of their space-padded lower-cased words that both
contain (a blended spectrum of presences), normalised. Nystroem landmarks give a finite feature space; one-versus-rest kernel ridge
regression on it gives one decision function for each learned language. Documents are scored in batches: presence
matrix times landmark matrix times coefficients.

The classifier is fitted on a bounded sample of labelled rows: of every labelled language PER_LANGUAGE different texts, those with
the least hashes, or fewer where there are so many languages that they would be more than ALL_SAMPLED, but one at least. LANDMARKS of
each language, ALL_LANDMARKS at most, are landmarks. Everything is predicted from whole texts alone.

Defined results: a null text, and a text without a letter, is ``und`` with score 0; with nothing to learn from, every
text is ``und``; a row without an id is never learned from and is not held out; copies of a text are learned from once and
get equal predictions; an empty table gives an empty result. Only doc_id, text and lang are read; ``predict`` keeps all columns
but one of its own name, ``verdict``.

The decision values of a text sum to 2 - K over K languages, so the best one says which language is likeliest, not
that the text is in any: ``accepted`` also asks how many of a text's grams the landmarks know, and holds that share
against the labelled rows of the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import fold, land

UNDETERMINED = "und"
#: Labelled texts of each language that are learned from, and of all languages together.
PER_LANGUAGE, ALL_SAMPLED = 250, 25_000
#: Landmarks of each language, and of all languages together.
LANDMARKS, ALL_LANDMARKS = 32, 1024
RIDGE = 1e-2
LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose grams a task remembers; longer words are not remembered.
REMEMBERED, LONG_WORD = 60_000, 24
#: What a text must know of its grams: NEAR_LOW of the share that all but LOW of the labelled texts of its language know,
#: but HALF of their median at least, so that junk among them cannot switch the test off; SIGMAS of chance are allowed.
LOW, NEAR_LOW, HALF, SIGMAS = 0.01, 0.8, 0.5, 3


def word_grams(word: str) -> set[int]:
    """1-, 2- and 3-grams of the padded word, as numbers of 21 bits a letter, so that none collide."""
    c = [32, *map(ord, word), 32]
    pairs = [a | b << 21 for a, b in zip(c, c[1:], strict=False)]
    return {*c[1:-1], *pairs, *(p | b << 42 for p, b in zip(pairs, c[2:], strict=False))}


def letter_words(text: str | None) -> set[str]:
    """Distinct runs of letters, lower-cased; empty if the text has no letter."""
    found = set(LETTERS.findall(text.lower())) if text else set()
    return found if any(any(map(str.isalpha, w)) for w in found) else set()


def sample_texts(train: DataFrame, per_language: int = PER_LANGUAGE, most: int = ALL_SAMPLED) -> DataFrame:
    """(lang, draw, text): different texts of each language, those of the least hashes; ``per_language`` of each, or an equal share of
    ``most`` where that is less, but one at least. Copies meet in an aggregate that begins in each task, and a task passes on its
    least hashes of a language, so neither a common text nor a common language comes to one task."""
    rows = train.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("draw"))
    texts = land(rows.select("lang", "draw").distinct(), "labelled-texts")
    share = max(1, min(per_language, most // max(1, texts.select("lang").distinct().count())))
    chosen = land(texts.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= share).select("lang", "draw"), "sample")
    chosen = F.broadcast(chosen) if chosen.count() <= most else chosen
    return rows.join(chosen, ["lang", "draw"], "left_semi").groupBy("lang", "draw").agg(F.min("text").alias("text"))


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [sorted(set().union(*map(word_grams, letter_words(t)))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(grams, pa.list_(pa.int64()))], ["lang", "draw", "grams"])


def training_sample(train: DataFrame, per_language: int = PER_LANGUAGE, most: int = ALL_SAMPLED) -> list[tuple[str, np.ndarray]]:
    """(language, grams) of the texts of ``sample_texts``, at most ``most`` or one of each language, in the driver."""
    drawn = sample_texts(train, per_language, most).mapInArrow(_sample_grams, "lang string, draw long, grams array<long>").toPandas().sort_values(["lang", "draw"])
    return [(lang, np.asarray(g, np.int64)) for lang, g in zip(drawn["lang"], drawn["grams"], strict=True) if len(g)]


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 5) -> dict | None:
    """``landmarks`` of each language, the inverse root of their kernel matrix, and ridge coefficients, folded into one matrix of a column for each language."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by = {lang: [i for i, (x, _) in enumerate(sample) if x == lang] for lang in languages}
    share = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    marks = [int(i) for lang in languages for i in rng.permutation(by[lang])[:share]]
    if len(marks) > ALL_LANDMARKS:  # more languages than landmarks
        marks = sorted(rng.permutation(marks)[:ALL_LANDMARKS].tolist())
    grams = np.unique(np.concatenate([sample[i][1] for i in marks]))
    column = {int(g): k for k, g in enumerate(grams)}

    def presence(rows: list[int]) -> np.ndarray:
        x = np.zeros((len(rows), len(grams)), np.float32)
        for r, i in enumerate(rows):
            at = np.searchsorted(grams, sample[i][1])
            at = at[at < len(grams)]
            hit = at[np.isin(grams[at], sample[i][1])]
            x[r, hit] = 1
        return x / np.sqrt(np.array([[len(sample[i][1])] for i in rows], np.float32))

    mark = presence(marks)
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([presence(list(range(i, min(i + 256, len(sample))))) @ mark.T for i in range(0, len(sample), 256)]).astype(float) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    weight = np.array([1.0 / len(by[lang]) for lang, _ in sample])[:, None]  # languages count alike
    # a text's target is 1 for its language and -1 for the others, so Z'WY is twice the language's own sum less the sum of all
    own = np.stack([z[by[x]].mean(0) for x in languages], 1)
    target = 2 * own - own.sum(1, keepdims=True)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(z.T @ (weight * z) + penalty, target)
    return {"languages": languages, "column": column, "marks": mark.T.copy(), "coefficients": (root @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("grams", T.LongType()), T.StructField("known", T.LongType())])


def verdict(spark: SparkSession, model: dict | None, text: str = "text") -> Column:
    """struct<lang_pred, score, grams, known> of a text column: with the number of its distinct grams, and of those that
    some landmark has. Only texts go to Python; the model's size is bounded by the sample, so it is broadcast."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("grams"), F.lit(0).cast("long").alias("known"))
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        column = model["column"]
        known: dict[str, list[int]] = {}

        def coded(word: str) -> list[int]:
            # a gram's column, or a negative number for grams that no landmark has
            got = [column.get(g, -g) for g in word_grams(word)]
            if len(word) <= LONG_WORD:
                known[word] = got
            return got

        def scored(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
            x = np.zeros((len(texts), len(column)), np.float32)
            found = np.zeros(len(texts), bool)
            counts = np.zeros((2, len(texts)), np.int64)
            for r, text in enumerate(texts):
                words = letter_words(text)
                if words:
                    grams = set().union(*[known.get(w) or coded(w) for w in words])
                    at = np.fromiter(grams, np.int64, len(grams))
                    hit = at[at >= 0]
                    x[r, hit] = 1 / np.sqrt(len(grams))
                    found[r] = True
                    counts[:, r] = len(grams), len(hit)
            decision = (x @ model["marks"]) @ model["coefficients"] + model["bias"]
            best = decision.argmax(1)
            score = np.clip((decision[np.arange(len(best)), best].astype(float) + 1) / 2, 0, 1)
            return [model["languages"][b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)], np.where(found, score, 0.0), counts

        for batch in batches:
            names: list[str] = []
            scores, counts = [np.zeros(0)], [np.zeros((2, 0), np.int64)]
            for start in range(0, len(batch), 256):
                if len(known) > REMEMBERED:
                    known.clear()
                told, score, count = scored(batch.slice(start, 256).to_pylist())
                names += told
                scores.append(score)
                counts.append(count)
            grams, hits = np.concatenate(counts, 1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(grams), pa.array(hits)], VERDICT.names)

    return classify(text)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``verdict``, a struct of lang_pred, score, grams and known."""
    return docs.withColumn("verdict", verdict(docs.sparkSession, model))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose fold is not 0."""
    remainder = fold("doc_id", folds)
    model = fit(training_sample(docs.where(remainder != 0)))
    rows = docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "verdict.lang_pred", "verdict.score")


def least_known(rows: DataFrame) -> DataFrame:
    """(lang, limit): for each language, the share of its grams that a long text must know, from all of ``rows`` (lang, text_hash,
    grams, known); copies of a text count once."""
    texts = rows.groupBy("lang", "text_hash").agg(F.first(F.col("known") / F.col("grams")).alias("share"))
    of = texts.groupBy("lang").agg(F.percentile_approx("share", [LOW, 0.5], 10_000).alias("q"))
    return of.select("lang", F.greatest(NEAR_LOW * F.col("q")[0], HALF * F.col("q")[1]).alias("limit"))


def accepted(docs: DataFrame, folds: int = 5, least: float = 0.25) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose language was told: some decision function claims them (score of
    ``least`` or more), and they know as many of their grams as labelled rows of that language do (``least_known``), or miss
    that by no more than chance."""
    held_in = fold("doc_id", folds) != 0
    model = fit(training_sample(docs.where(held_in)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(held_in & F.col("lang").isNotNull(), F.lit(False)).alias("labelled"), F.xxhash64("text").alias("text_hash"), "text")
    told = land(predict(rows, model).drop("text"), "told").where(F.col("verdict.lang_pred") != UNDETERMINED)
    limits = land(least_known(told.where("labelled").select("row.lang", "text_hash", "verdict.grams", "verdict.known")), "limits")
    if len(model["languages"] if model else ()) <= ALL_SAMPLED:  # so there are no more limits than that, 100 bytes each
        limits = F.broadcast(limits)
    met = told.join(limits, F.col("verdict.lang_pred") == F.col("lang"))
    limit, grams, unknown = F.col("limit"), F.col("verdict.grams"), F.col("verdict.grams") - F.col("verdict.known")
    chance = SIGMAS * F.sqrt(grams * limit * (1 - limit))
    return met.where((F.col("verdict.score") >= least) & (unknown <= grams * (1 - limit) + chance)).select("row.*")
