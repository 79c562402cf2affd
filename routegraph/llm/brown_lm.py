"""LM scoring with a Brown class-based bigram model.

    P(word | word before) = P(class | class before) * P(word | class)

Exchange clustering assigns units to classes: a unit is a word of LEAST_COUNT training tokens or more, and of FREQUENT of all
tokens or more (so there are at most 1 / FREQUENT of them, whose classes can be broadcast: 64 bytes a word, 128 MB at most), or one of
SHAPES buckets of endings, which stands for all other words that end so, known or not. The commonest words begin in classes of their own,
the others in the class of their ending. The first round counts, over all training texts, which classes stand before and after each unit, and moves every
unit to the class where the likelihood of the class bigrams gains most. A later round moves a share of the units (by hash), and counts anew only
beside the tokens whose class has changed. As units move together, a round can lose: then its moves are taken
back. When the likelihood of a token rises by less than LEAST_RISE, a smaller share moves; rounds end when that does not help either
(MOST_ROUNDS is a guard that is not met in practice).

Class transitions are smoothed towards class frequencies. Within a class, counts are discounted by d = n1 / (n1 + 2 n2);
the mass that this frees is the probability of a word not seen in training. The probabilities of
all known words and one unknown word of each class sum to one. Perplexity is 10 to the minus score by token.

Counts cover every training text. Words are told apart by 128-bit hashes. Words of at least FREQUENT of all
tokens are scored where they stand; counts of all others come by a join on the word.

Defined results: a null or empty text is one end token; a row without an id is neither learned from nor
held out; repeated rows are scored one by one; with nothing to learn from, every token is unknown; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, land

CLASSES = 64
END = CLASSES  # the end of a text has a class of its own, which also stands before the first word
SHAPES = 1024
#: Units: the endings, then the end of a text, then words by falling count.
END_UNIT, FIRST_WORD = SHAPES, SHAPES + 1
LEAST_COUNT, FREQUENT = 5, 5e-7
MOST_ROUNDS, LEAST_RISE = 24, 1e-2
#: The commonest words that begin in classes of their own.
APART = 16 * CLASSES
#: How a task counts neighbours: those of the first DENSE units in an array, those of the others by sorting UNSORTED at a time.
DENSE, UNSORTED = 1 << 14, 1 << 20
#: Units whose counts are one row.
BUCKET = 16
SMOOTHING = 20.0
HELD = 400_000


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """Words of each text in UTF-8. Bytes know no other spaces than the six that part words, and no other capitals than A to Z."""
    return [t.lower().split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """Two 64-bit values of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(n, 2)


def ending(word: bytes) -> int:
    """The bucket of a word's last two letters."""
    return xxhash.xxh32_intdigest(word.decode()[-2:]) % SHAPES


class _Numbers(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        h = word_hashes(counts, len(counts)).view(np.int64)
        columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(map(ending, counts)), pa.int32()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "word2", "shape", "n"])
        counts.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, 50):
            for words in words_of(batch.column("text").slice(start, 50)):
                counts.update(words)
            if len(counts) > HELD:
                yield from flush()
    if counts:
        yield from flush()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, word2, shape, n) of every word of ``train``."""
    return train.select("text").mapInArrow(_count, "word long, word2 long, shape int, n long").groupBy("word", "word2").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


def _words_of(frequent: pd.DataFrame, clustered: int) -> dict:
    """Frequent words in order of their hashes, with their counts and units: the ``clustered`` first are units, the others have their ending's."""
    h = frequent[["word", "word2"]].to_numpy().view(np.uint64)
    order = np.argsort(h[:, 0])
    unit = np.where(np.arange(len(frequent)) < clustered, FIRST_WORD + np.arange(len(frequent)), frequent["shape"].to_numpy())
    return {"hash": h[order, 0], "hash2": h[order, 1], "n": frequent["n"].to_numpy()[order], "unit": unit[order]}


ENCODED = (
    "doc_id long, held_out boolean, train boolean, n_tokens long, n_frequent long, log_counts double, log_discounted double, units binary, "
    "rare_word array<long>, rare_word2 array<long>, rare_shape array<int>, rare_times array<long>"
)


def _encoder(sent, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        known = table["hash"]
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                ids = _Numbers()
                words = words_of(part.column("text"))
                lengths = np.array([len(w) for w in words], np.int64)
                token = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
                h = word_hashes(ids, len(ids))
                shape = np.fromiter(map(ending, ids), np.int64, len(ids))
                is_frequent, unit, n = np.zeros(len(h), bool), shape, np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h[:, 0]), len(known) - 1)
                    is_frequent = (known[at] == h[:, 0]) & (table["hash2"][at] == h[:, 1])
                    unit, n = np.where(is_frequent, table["unit"][at], shape), np.where(is_frequent, table["n"][at], 0)
                doc = np.repeat(np.arange(len(words)), lengths)
                often = is_frequent[token]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sums = [np.bincount(doc[often], v[token[often]], len(words)).astype(float) for v in (np.log10(n + 1.0), np.log10(n - discount))]
                pairs, times = np.unique(doc[~often] * max(len(ids), 1) + token[~often], return_counts=True)
                rare_doc, rare = np.divmod(pairs, max(len(ids), 1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare_doc, minlength=len(words)))]), pa.int32())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                units = unit[token].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "held_out", "train")),
                        pa.array(lengths + 1),
                        pa.array(np.bincount(doc[often], minlength=len(words)).astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([units[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(h[rare, 0].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(h[rare, 1].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(shape[rare].astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ],
                    [c.split()[0] for c in ENCODED.split(", ")],
                )

    return run


COUNTS = "bucket int, code binary, before binary, after binary, bigrams array<long>"
K, SPAN = CLASSES + 1, BUCKET * (CLASSES + 1)


def _summed(key: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return (key[first], np.add.reduceat(before[order], first), np.add.reduceat(after[order], first)) if len(key) else (key, before, after)


def _packed(key: np.ndarray, before: np.ndarray, after: np.ndarray, bigrams: np.ndarray | None = None) -> pa.RecordBatch:
    """COUNTS: a row for each bucket of units, of keys (unit * K + class) in order; the class bigrams are in a row of bucket -1."""
    bucket = key // SPAN
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    extra = int(bigrams is not None)

    def binary(values: np.ndarray, kind: str) -> pa.Array:
        values = np.ascontiguousarray(values, kind)
        ends = np.concatenate([first, [len(key)] * (1 + extra)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(first) + extra, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

    columns = [binary(key - bucket * SPAN, "<u2"), binary(before, "<i8"), binary(after, "<i8")]
    more = pa.array([None] * len(first) + [bigrams.tolist()] * extra if extra else [None] * len(first), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.append(bucket[first], [-1] * extra).astype(np.int32)), *columns, more], ["bucket", "code", "before", "after", "bigrams"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = batch.column("code").to_pylist()
    lengths = [len(c) // 2 for c in codes]
    key = np.repeat(batch.column("bucket").to_numpy().astype(np.int64) * SPAN, lengths) + np.frombuffer(b"".join(codes), "<u2")
    return key, *(np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("before", "after"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of equal buckets, which are all in this task; it holds no more than its units' classes, and UNSORTED counts."""
    none = np.zeros(0, np.int64)
    whole, held = (none, none, none), []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _summed(*map(np.concatenate, zip(whole, *held, strict=True)))

    for batch in batches:
        held.append(_unpacked(batch))
        if sum(len(h[0]) for h in held) > max(UNSORTED, len(whole[0])):
            whole = joined()
            held.clear()
    key, before, after = joined()
    some = (before != 0) | (after != 0)
    yield _packed(key[some], before[some], after[some])


def _neighbours(sent):
    """COUNTS of how often each class stands before and after each unit or, given older classes, of by how much that differs from what it
    was; and the class bigrams, always in full. A bucket may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, older = sent.value
        dense = min(DENSE, len(classes)) * K
        counts, bigrams = np.zeros((2, dense), np.int64), np.zeros(K * K, np.int64)
        held: list[np.ndarray] = []

        def sparse() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            n = np.where(code & 1, -n, n)
            return _packed(*_summed(code >> 2, np.where(code & 2, 0, n), np.where(code & 2, n, 0)))

        for unit in _streams(batches):
            c, unit = classes[unit].astype(np.int64), unit.astype(np.int64)
            bigrams += np.bincount(c[:-1] * K + c[1:], minlength=K * K)
            was = None if older is None else older[unit].astype(np.int64)
            at = np.arange(len(c)) if older is None else np.flatnonzero(c != was)
            for side, i, beside in ((0, at[at < len(c) - 1], 1), (1, at[at > 0], -1)):
                for lost, of in enumerate((c,) if was is None else (c, was)):
                    key = unit[i + beside] * K + of[i]
                    low = key < dense
                    np.add.at(counts[side], key[low], -1 if lost else 1)
                    held.append(key[~low] << 2 | side << 1 | lost)
            if sum(map(len, held)) > UNSORTED:
                yield sparse()
        if held:
            yield sparse()
        key = np.flatnonzero(counts.any(0))
        yield _packed(key, counts[0, key], counts[1, key], bigrams)

    return run


def _streams(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[np.ndarray]:
    """Units of some texts at a time, with an end before, between and after them."""
    end = np.array([END_UNIT], "<u4").tobytes()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield np.frombuffer(end + end.join(batch.slice(start, rows).column("units").to_pylist()) + end, "<u4")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(own: int, before: np.ndarray, after: np.ndarray, bigrams: np.ndarray) -> int:
    """The class to which a unit now in ``own`` is best moved: where the sum of N log N over class bigrams,
    less that over class counts, gains most. ``before`` and ``after`` are the unit's counts by neighbouring class. Only
    classes that stand beside the unit change a term."""
    m = bigrams.astype(float)
    m[own, :] = np.maximum(m[own, :] - after, 0)
    m[:, own] = np.maximum(m[:, own] - before, 0)
    first, second = m.sum(1), m.sum(0)
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    to, of = m[:, a], m[b, :]
    gain = (_xlogx(to + after[None, a]) - _xlogx(to)).sum(1) + (_xlogx(of + before[b, None]) - _xlogx(of)).sum(0)
    gain -= _xlogx(first + after.sum()) - _xlogx(first) + _xlogx(second + before.sum()) - _xlogx(second)
    gain[END] = -np.inf
    return int(np.argmax(gain)) if np.max(gain) > gain[own] + 1e-9 else own


def drawn(unit: int, turn: int, share: float) -> bool:
    return xxhash.xxh32_intdigest(unit.to_bytes(4, "little"), turn) % 1024 < 1024 * share


def _movers(sent, turn: int, share: float):
    """(unit, better): the better class of each unit that is drawn and is not in its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bigrams = sent.value
        for batch in batches:
            key, *counts = _unpacked(batch)
            unit, cls = np.divmod(key, K)
            first = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(unit))
            units, better = [], []
            for a, b in zip(first, first[1:], strict=False):
                u = int(unit[a])
                if u != END_UNIT and drawn(u, turn, share):
                    beside = np.zeros((2, K))
                    beside[0, cls[a:b]], beside[1, cls[a:b]] = counts[0][a:b], counts[1][a:b]
                    best = best_class(int(classes[u]), *beside, bigrams)
                    if best != classes[u]:
                        units.append(u)
                        better.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(better, pa.int32())], ["unit", "better"])

    return run


def _class_bigrams(counts: DataFrame) -> np.ndarray:
    bigrams = np.zeros(K * K, np.int64)
    for r in counts.where("bucket = -1").select(F.posexplode("bigrams")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        bigrams[r["pos"]] = r["n"]
    return bigrams.reshape(K, K)


def likelihood(bigrams: np.ndarray) -> float:
    """What the class bigrams add to the log likelihood of a token."""
    m = bigrams.astype(float)
    return float((_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum()) / max(m.sum(), 1))


def exchange(train: DataFrame, endings: np.ndarray, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all units, the class bigram counts, and the likelihood of each round that was kept. ``endings`` has the bucket of each
    word that is a unit. A step brings only the units that move to the driver."""
    sc = train.sparkSession.sparkContext
    n_units = FIRST_WORD + len(endings)
    classes = (np.arange(n_units) % CLASSES).astype(np.uint8)
    classes[FIRST_WORD + APART :] = classes[endings[APART:]]
    classes[END_UNIT] = END

    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_units * K >> 20)

    def counted(classes: np.ndarray, older: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
        counts = land(train.select("units").mapInArrow(_neighbours(sc.broadcast((classes, older))), COUNTS), "counts")
        return counts, _class_bigrams(counts)

    def merged(counts: DataFrame) -> DataFrame:
        """One row for each bucket of 16 units: a task passes on at most 1040 counts of a bucket at a time, however common its words."""
        return land(counts.where("bucket >= 0").repartition(parts, "bucket").mapInArrow(_merge, COUNTS), "merged")

    counts, bigrams = counted(classes)
    beside = merged(counts)
    course, share = [likelihood(bigrams)], 1.0
    for k in range(rounds):
        moved = beside.mapInArrow(_movers(sc.broadcast((classes, bigrams)), k, share), "unit int, better int").toPandas()
        if not len(moved):
            break
        trial = classes.copy()
        trial[moved["unit"].to_numpy()] = moved["better"].to_numpy()
        # where all units may move, as in the first round, nearly all counts change: counting in full is less than the difference
        changes, trial_bigrams = counted(trial, None if share == 1 else classes)
        rise = likelihood(trial_bigrams) - course[-1]
        whole = share == 1
        if rise > 0:
            classes, bigrams = trial, trial_bigrams
            course.append(course[-1] + rise)
            share = min(share, 0.5)
        if rise < LEAST_RISE:
            if share <= 1 / 8:
                break
            share /= 2
        if rise > 0:
            beside = merged(changes if whole else beside.unionByName(changes))
    return classes, bigrams, course


def _transitions(bigrams: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed towards the classes' own frequencies."""
    total = bigrams.sum()
    own = (bigrams.sum(0) + 1.0) / (total + len(bigrams))
    return np.log10((bigrams + SMOOTHING * own[None, :]) / (bigrams.sum(1, keepdims=True) + SMOOTHING))


def _class_scorer(sent):
    @F.pandas_udf(T.DoubleType())
    def score(units: pd.Series) -> pd.Series:
        classes, steps, per_token = sent.value
        out = np.zeros(len(units))
        for i, packed in enumerate(units):
            c = classes[np.frombuffer(packed, "<u4")]
            c = np.concatenate([[END], c, [END]])
            out[i] = steps[c[:-1], c[1:]].sum() + per_token[c[1:-1]].sum()
        return pd.Series(out)

    return score


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of ``docs``."""
    spark = docs.sparkSession
    remainder = fold("doc_id", folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("train"), "text")
    counts = land(word_counts(rows.where("train")), "word-counts")
    n_train = rows.where("train").count()
    tokens, types, ones, twos = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    total, vocabulary = tokens + n_train, types + (n_train > 0)
    discount = min(0.95, max(0.1, ones / (ones + 2.0 * twos) if ones else 0.5))
    frequent = counts.where(F.col("n") >= max(1.0, FREQUENT * total)).toPandas().sort_values(["n", "word", "word2"], ascending=[False, True, True], kind="stable")
    clustered = int((frequent["n"] >= LEAST_COUNT).sum())
    table = _words_of(frequent, clustered)
    # ids of rows are drawn once, when the table is written, and then are stored values
    encoded = land(rows.mapInArrow(_encoder(spark.sparkContext.broadcast(table), discount), ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    classes, bigrams, _ = exchange(encoded.where("train"), frequent["shape"].to_numpy()[:clustered])

    class_tokens = bigrams.sum(0)
    unclustered = (F.col("n") < LEAST_COUNT) | (F.col("n") < FREQUENT * total)
    by_shape = {r["shape"]: r["k"] for r in counts.where(unclustered).groupBy("shape").agg(F.count("*").alias("k")).collect()}
    class_types = np.bincount(classes[FIRST_WORD:], minlength=CLASSES + 1) + np.bincount(classes[:SHAPES], [by_shape.get(s, 0) for s in range(SHAPES)], CLASSES + 1)
    per_token = np.where(class_tokens > 0, -np.log10(np.maximum(class_tokens, 1)), 0.0)
    unseen = np.where(class_tokens > 0, np.log10(np.maximum(discount * class_types, 1e-9)), 0.0)
    shape_unseen = [float(unseen[c]) for c in classes[:SHAPES]]

    rare = encoded.select("row", F.explode(F.arrays_zip("rare_word", "rare_word2", "rare_shape", "rare_times")).alias("r")).select("row", F.col("r.rare_word").alias("word"), F.col("r.rare_word2").alias("word2"), F.col("r.rare_shape").alias("shape"), F.col("r.rare_times").alias("times"))
    less = counts.where(F.col("n") < max(1.0, FREQUENT * total)).select("word", "word2", "n")
    found = F.coalesce("n", F.lit(0))
    sums = (
        rare.join(less, ["word", "word2"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(found > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(found + 1.0)).alias("more_counts"),
            F.sum(F.col("times") * F.when(found > 0, F.log10(found - F.lit(discount))).otherwise(_shape(shape_unseen))).alias("more_discounted"),
        )
    )
    sent = spark.sparkContext.broadcast((classes, _transitions(bigrams), per_token))
    per_class = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "log_counts", "log_discounted", _class_scorer(sent)("units").alias("class_score"))
    base_end = float(np.log10(n_train + 1.0))
    base_all = float(np.log10(total + 1.0 * (vocabulary + 1)))
    scored = per_class.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_train > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("more_counts", F.lit(0.0)) + F.lit(base_end) - F.col("n_tokens") * F.lit(base_all)).alias("base_score"),
        (F.col("class_score") + F.col("log_discounted") + F.coalesce("more_discounted", F.lit(0.0))).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _shape(values: list[float]) -> Column:
    return F.element_at(F.lit(values), F.col("shape") + 1)
