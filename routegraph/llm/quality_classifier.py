"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

``word_sums`` reads every whole text once: each token adds the sparse random index vectors (two entries of +1 or -1 each) of the tokens up to
REACH places before and behind it in its text to its own row. Rows are BUCKETS hash buckets of DIMENSIONS whole numbers, so a task's sums and the model
have a fixed size whatever the corpus, and the sums over tasks are exact in any order. ``word_vectors`` centres and normalises the rows
and weighs frequent tokens down. ``pool`` reads the texts again and gives each document the weighted mean and spread of its tokens' vectors and a
few figures of the pooling itself. ``fit`` trains a two-layer network on a bounded sample of labelled documents (``per_label`` of each
label; their weights restore the labels' shares of all labelled rows) and then divides its logits by the temperature that makes the
probabilities of rows kept back likeliest.

Tokens are runs of letters (ASCII or any character beyond ASCII, case kept), of digits, or of other signs.

Labels come from rows whose fold (crc32 of the id, modulo 3) is not 1. A document labelled both ways is not learned from; of several
documents with one id, one is. Without rows of both labels the score is the share of good ones among those known, smoothed towards 0.5.

Defined results: a null or empty text has no tokens, its pooled figures are 0 and it is scored like any other; a null id is in no fold
(``held_out`` is null) and has no label. Repeated rows are scored one by one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, land

TOKEN = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\x00-\x20\x7F-\U0010FFFF]+")
BUCKETS, DIMENSIONS, REACH = 1 << 15, 64, 2
#: Tokens of one step, in the first and the second reading, and of the words that a task remembers the hash of.
COUNT_STEP, POOL_STEP, REMEMBERED = 1 << 20, 1 << 15, 400_000
#: Weight of a token of share p: RARE / (RARE + p). A text is pooled with PRIOR of weight that is of no kind, so that a few tokens say little.
RARE, PRIOR = 1e-3, 3.0
HIDDEN, ROUNDS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-4, 256
FOLDS, HELD_OUT, CALIBRATION = 3, 1, 5


class Hashes(dict):
    """Hashes of the tokens met, forgotten all at once when there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two entries of each token's index vector: place and sign, from other bits than the bucket's."""
    out = []
    for shift in (20, 40):
        bits = hashes >> np.uint64(shift)
        out.append(((bits & np.uint64(DIMENSIONS - 1)).astype(np.int64), 1.0 - 2.0 * ((bits >> np.uint64(12)) & np.uint64(1)).astype(np.float64)))
    return out


def add_contexts(sums: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> None:
    """Add to ``sums``, flat rows of the buckets, what each token's neighbours in the same text give it."""
    own, entries = bucket(hashes) * DIMENSIONS, index_vectors(hashes)
    for reach in range(1, REACH + 1):
        same = text[:-reach] == text[reach:]
        for place, sign in entries:
            for mine, near in ((slice(None, -reach), slice(reach, None)), (slice(reach, None), slice(None, -reach))):
                np.add.at(sums, (own[mine] + place[near])[same], sign[near][same].astype(np.int64))


def _runs(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens of whole texts, and how many of each text: at least ``step`` tokens at a time but the last."""
    tokens, sizes = [], []
    for batch in batches:
        for text in batch.column("text"):
            found = tokens_of(text.as_py())
            tokens += found
            sizes.append(len(found))
            if len(tokens) >= step:
                yield tokens, sizes
                tokens, sizes = [], []
    if tokens:
        yield tokens, sizes


def word_sums(docs: DataFrame) -> DataFrame:
    """(bucket, n, v0, v1, ...): the tokens of each bucket and the sum of their contexts, over all documents."""
    names = [f"v{d}" for d in range(DIMENSIONS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, known = np.zeros(BUCKETS * DIMENSIONS, np.int64), np.zeros(BUCKETS, np.int64), Hashes()
        for tokens, sizes in _runs(batches, COUNT_STEP):
            hashes = known.of(tokens)
            add_contexts(sums, hashes, np.repeat(np.arange(len(sizes)), sizes))
            n += np.bincount(bucket(hashes), minlength=BUCKETS)
        sums, used = sums.reshape(BUCKETS, DIMENSIONS), np.flatnonzero(n)
        for at in range(0, len(used), 1024):
            rows = used[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n[rows]), *(pa.array(x) for x in np.ascontiguousarray(sums[rows].T))], ["bucket", "n", *names])

    counted = docs.select("text").mapInArrow(count, ", ".join(f"{c} long" for c in ["bucket", "n", *names]))
    return counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def word_vectors(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A vector of length 1 (0 where nothing is known) and a weight for each bucket. BUCKETS rows at most reach the driver."""
    rows = sums.toPandas()
    at, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    vectors, weights = np.zeros((BUCKETS, DIMENSIONS), np.float32), np.ones(BUCKETS, np.float32)
    if len(at):
        found = rows[[f"v{d}" for d in range(DIMENSIONS)]].to_numpy(np.float64)
        found = found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-9)
        found -= np.average(found, axis=0, weights=np.sqrt(n))
        vectors[at] = found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-9)
        weights[at] = RARE / (RARE + n / n.sum())
    return vectors, weights


def pooled(vectors: np.ndarray, weights: np.ndarray, tokens: list[str], sizes: list[int], known: Hashes) -> np.ndarray:
    """Per text: weighted mean of its tokens' vectors, their spread around it, the mean's length, how often a token repeats the one before it,
    the mean weight and the number of tokens."""
    at, text = bucket(known.of(tokens)), np.repeat(np.arange(len(sizes)), sizes)
    total, first, second, same = np.zeros(len(sizes)), np.zeros((len(sizes), DIMENSIONS)), np.zeros((len(sizes), DIMENSIONS)), np.zeros(len(sizes))
    for begin in range(0, len(at), POOL_STEP):
        a, t = at[begin : begin + POOL_STEP], text[begin : begin + POOL_STEP]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        v, w = vectors[a], weights[a][:, None]
        first[t[starts]] += np.add.reduceat(w * v, starts)
        second[t[starts]] += np.add.reduceat(w * v * v, starts)
        total[t[starts]] += np.add.reduceat(w[:, 0], starts)
    again = (at[1:] == at[:-1]) & (text[1:] == text[:-1])
    same += np.bincount(text[1:][again], minlength=len(sizes))
    mean = first / (total + PRIOR)[:, None]
    spread = np.sqrt(np.maximum((second + PRIOR / DIMENSIONS) / (total + PRIOR)[:, None] - mean * mean, 0))
    n = np.array(sizes)
    return np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), same / (n + PRIOR), total / (n + PRIOR), np.log1p(n)]).astype(np.float32)


def pool(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, pooled): the features of each document as float32 bytes; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [tokens_of(x.as_py()) for x in part.column("text")]
                rows = pooled(*sent.value, [t for f in found for t in f], list(map(len, found)), known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "pooled"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(features, "doc_id long, pooled binary")


def labelled_sample(pooled_docs: DataFrame, labels: DataFrame, per_label: int = 12_000) -> tuple[pd.DataFrame, dict[int, int]]:
    """Pooled features and labels of at most ``per_label`` documents of each label, drawn by a hash of the id, and the number of all
    such documents of each label."""
    given = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    usable = land(given.where((F.col("quality") == F.col("_other")) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "quality", F.xxhash64("doc_id").alias("draw")), "usable-labels")
    all_of = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label, n in sorted(all_of.items()):
        share = min(1.0, 1.2 * per_label / n)  # what is sorted is bounded too
        part = usable.where((F.col("quality") == label) & (F.pmod("draw", F.lit(1_000_000_007)) <= share * 1_000_000_007)).orderBy("draw", "doc_id").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return pd.DataFrame({"quality": [], "draw": [], "pooled": []}), {}
    drawn = land(drawn, "drawn-labels")
    one = pooled_docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality", "draw").agg(F.min("pooled").alias("pooled"))  # two times per_label rows
    return one.toPandas().sort_values(["draw", "doc_id"]), all_of


def forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - model["mean"]) / model["scale"]) @ model["w1"] + model["b1"])
    return hidden, hidden @ model["w2"] + model["b2"]


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "w1" not in model:
        return np.full(len(x), model["share"])
    return 1 / (1 + np.exp(-np.clip(forward(model, x)[1] / model["temperature"], -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.average(np.logaddexp(0, logits) - y * logits, weights=weight))


def fit(sample: pd.DataFrame, all_of: dict[int, int], seed: int = 11) -> dict:
    """The network, trained by Adam on all sampled rows but each CALIBRATION-th, and the temperature found on those."""
    if len(set(sample["quality"])) < 2:
        good, bad = all_of.get(1, 0), all_of.get(0, 0)
        return {"share": (good + 1) / (good + bad + 2)}
    x = np.vstack([np.frombuffer(p, np.float32) for p in sample["pooled"]]).astype(np.float64)
    y = sample["quality"].to_numpy(np.float64)
    have = {label: max(int((y == label).sum()), 1) for label in (0, 1)}
    weight = np.where(y == 1, all_of[1] / have[1], all_of[0] / have[0])
    weight = weight / weight.mean()
    kept_back = np.zeros(len(y), bool)
    for label in (0, 1):
        kept_back[np.flatnonzero(y == label)[CALIBRATION - 1 :: CALIBRATION]] = True
    train, rng = np.flatnonzero(~kept_back), np.random.default_rng(seed)
    model = {"mean": x[train].mean(0), "scale": x[train].std(0) + 1e-3}
    shapes = {"w1": (x.shape[1], HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN,), "b2": ()}
    model |= {k: rng.normal(0, 1 / math.sqrt(s[0]), s) if k[0] == "w" else np.zeros(s) for k, s in shapes.items()}
    moments, step = {k: [0.0, 0.0] for k in shapes}, 0
    for _ in range(ROUNDS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            z = (x[rows] - model["mean"]) / model["scale"]
            hidden, logits = forward(model, x[rows])
            error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(error, model["w2"]) * (1 - hidden * hidden)
            for k, g in {"w1": z.T @ back, "b1": back.sum(0), "w2": hidden.T @ error, "b2": error.sum()}.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                move = (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                model[k] = model[k] - RATE * (move + (DECAY * model[k] / RATE if k[0] == "w" else 0))
    model["temperature"] = 1.0
    back = np.flatnonzero(kept_back)
    if len(set(y[back])) == 2:
        logits = forward(model, x[back])[1]
        low, high = math.log(0.25), math.log(16)
        for _ in range(40):  # the loss has one minimum in the logarithm of the temperature
            a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(logits / math.exp(a), y[back], weight[back]) <= loss(logits / math.exp(b), y[back], weight[back]) else (a, high)
        model["temperature"] = math.exp((low + high) / 2)
    return model


def score(pooled_docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted). The model has a fixed size."""
    sent = pooled_docs.sparkSession.sparkContext.broadcast(model)
    width = 2 * DIMENSIONS + 4

    @F.arrow_udf("double")
    def probability(features: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(features.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
        return pa.array(probabilities(sent.value, x), pa.float64())

    scored = pooled_docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), probability("pooled").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_label: int = 12_000) -> DataFrame:
    """The probability of every document that its quality label is 1."""
    vectors, weights = word_vectors(land(word_sums(docs), "word-sums"))
    pooled_docs = land(pool(docs, vectors, weights), "pooled")
    return score(pooled_docs, fit(*labelled_sample(pooled_docs, labels, per_label)))
