import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from routegraph.llm import brown_lm as b
from routegraph.llm.common import words


@pytest.fixture
def corpus(frame, prose):
    r = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(f"The {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} now." for _ in range(r.randint(1, 12))), "en", "s") for i in range(220)]
    rows += [(800, None, None, None), (801, "", "en", "s"), (802, prose(8000, 3), "en", "s"), (7, rows[7][1], "en", "s"), (None, "the unlearned", "en", "s"), (803, "qq zz unheard", "en", "s")]
    return rows


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)] + [None]


@pytest.mark.parametrize("frequent", [5e-7, 2e-3])
def test_base_counts_match_brute_force(frame, corpus, monkeypatch, frequent):
    monkeypatch.setattr(b, "FREQUENT", frequent)
    monkeypatch.setattr(b, "LEAST_COUNT", 12)
    got = b.score(frame(corpus)).collect()
    assert len(got) == len(corpus)
    train = Counter()
    for k, text, *_ in corpus:
        if k is not None and crc32(str(k).encode()) % 7 != 2:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    text_of = {r[0]: r[1] for r in corpus}
    for r in got:
        t = tokens(text_of[r["doc_id"]])
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["score"] < 0 and abs(math.log10(r["perplexity"]) + r["score"] / len(t)) < 1e-9
    held = [r for r in got if r["held_out"] and r["doc_id"] < 220]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(frame, corpus):
    """Over all known words and one unknown word a class, after any class, by scoring texts of one word."""
    docs = frame(corpus)
    train = [r for r in corpus if r[0] is not None and crc32(str(r[0]).encode()) % 7 != 2]
    total, known = 0.0, sorted({w for r in train for w in tokens(r[1]) if w})
    probe = frame([(k, w, "en", "s") for k, w in zip((i for i in range(10_000, 90_000) if crc32(str(i).encode()) % 7 == 2), known, strict=False)])
    got = {r["doc_id"]: r for r in b.score(docs.unionByName(probe)).collect() if r["doc_id"] and r["doc_id"] >= 10_000}
    assert len(got) == len(known) and all(r["n_known"] == 2 for r in got.values())
    # P(word) * P(end | its class) is at most P(word), so the sum over one-word texts is below one and above none
    total = sum(10 ** r["score"] for r in got.values())
    assert 0 < total < 1


def test_exchange_moves_a_unit_to_its_like():
    k = b.CLASSES + 1
    bigrams = np.zeros((k, k), np.int64)
    bigrams[0, 1] = bigrams[1, 2] = 1000
    bigrams[0, 5] = bigrams[5, 2] = 40  # the unit, in a class of others that stand elsewhere
    bigrams[3, 5] = bigrams[5, 4] = 1000
    before, after = np.zeros(k), np.zeros(k)
    before[0], after[2] = 40, 40
    assert b.best_class(5, before, after, bigrams) == 1


def test_nothing_to_learn_from(frame):
    rows = b.score(frame([(None, "a b", None, None)])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(3, 0, 0, 0.0)]
    assert b.score(frame([])).count() == 0


def test_reruns_agree(frame, corpus):
    key = lambda df: sorted((str(r["doc_id"]), round(r["score"], 6)) for r in df.collect())
    assert key(b.score(frame(corpus))) == key(b.score(frame(corpus).repartition(3)))


@pytest.mark.parametrize(("dense", "apart"), [(1 << 14, 1024), (1030, 1024), (1, 20)])
def test_exchange_raises_the_likelihood_and_finds_word_classes(spark, dense, apart, monkeypatch):
    monkeypatch.setattr(b, "DENSE", dense)
    monkeypatch.setattr(b, "APART", apart)
    monkeypatch.setattr(b, "UNSORTED", 1000)
    r = random.Random(5)
    kinds = [[b.FIRST_WORD + 3 * i + k for i in range(100)] for k in range(3)]
    texts = [np.array([r.choice(kinds[j % 3]) for j in range(60)], "<u4").tobytes() for _ in range(800)]
    train = spark.createDataFrame([(x,) for x in texts], "units binary")
    classes, bigrams, course = b.exchange(train, np.arange(300))
    assert course == sorted(course) and course[-1] > course[0] + 0.8, course
    # words of one kind share classes that no other kind has, but for a few words
    most = Counter((c, k) for k in range(3) for c in classes[kinds[k]])
    assert sum(max(most[c, k] for k in range(3)) for c in set(classes[b.FIRST_WORD :])) >= 270
    want = np.zeros_like(bigrams)
    for t in texts:
        row = [b.END, *classes[np.frombuffer(t, "<u4")], b.END]
        for x, y in zip(row, row[1:], strict=False):
            want[x, y] += 1
    want[b.END, b.END] = bigrams[b.END, b.END]
    assert (bigrams == want).all()


@pytest.mark.parametrize("dense", [1 << 14, 1060, 1])
def test_changed_neighbours_are_the_difference_of_full_counts(dense, monkeypatch):
    import pyarrow as pa
    import pyarrow.compute

    monkeypatch.setattr(b, "DENSE", dense)
    monkeypatch.setattr(b, "UNSORTED", 200)
    r = np.random.default_rng(3)
    older = (np.arange(b.FIRST_WORD + 60) % b.CLASSES).astype(np.uint8)
    older[b.END_UNIT] = b.END
    newer = older.copy()
    newer[b.FIRST_WORD + 5 : b.FIRST_WORD + 30] = 7
    texts = [r.integers(b.FIRST_WORD - 20, b.FIRST_WORD + 60, n).astype("<u4") for n in (0, 1, 400, 30, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["units"])
    ends = np.concatenate([[b.END_UNIT], *[np.append(t, b.END_UNIT) for t in texts]])

    def counts(classes, past):
        rows = list(b._neighbours(type("Sent", (), {"value": (classes, past)}))([batch]))
        bigrams = [x["bigrams"] for r in rows for x in r.to_pylist() if x["bucket"] == -1]
        key, before, after = b._unpacked(next(b._merge(r.filter(pa.compute.greater_equal(r.column("bucket"), 0)) for r in rows)))
        got = Counter({(int(k) // b.K, int(k) % b.K, "before"): int(n) for k, n in zip(key, before, strict=True)})
        got.update({(int(k) // b.K, int(k) % b.K, "after"): int(n) for k, n in zip(key, after, strict=True)})
        got.update({(i // b.K - b.K, i % b.K, "after"): n for i, n in enumerate(np.sum(bigrams, 0).tolist())})
        return got

    def brute(classes):
        got = Counter()
        for x, y in zip(ends, ends[1:], strict=False):
            got[y, classes[x], "before"] += 1
            got[x, classes[y], "after"] += 1
            got[int(classes[x]) - b.CLASSES - 1, classes[y], "after"] += 1
        return got

    full, changes, past = counts(newer, None), counts(newer, older), brute(older)
    assert {k: n for k, n in full.items() if n} == dict(brute(newer))
    assert all(n == full[k] - past[k] for k, n in changes.items() if k[0] >= 0)
    assert all(full[k] == past[k] + changes[k] for k in (full | past) if k[0] >= 0)


def test_score_equals_the_model_by_definition(frame, corpus, monkeypatch):
    """Scores from the classes and counts of the exchange, with plain dictionaries."""
    monkeypatch.setattr(b, "DENSE", 1040)
    seen = {}
    whole = b.exchange

    def kept(train, endings):
        seen["model"] = whole(train, endings)
        return seen["model"]

    monkeypatch.setattr(b, "exchange", kept)
    rows = b.score(frame(corpus)).collect()
    classes, bigrams, _ = seen["model"]
    train = Counter(w for k, text, *_ in corpus if k is not None and crc32(str(k).encode()) % 7 != 2 for w in tokens(text) if w)
    key = lambda w: tuple(b.word_hashes([w.encode()], 1).view(np.int64)[0].tolist())
    units = {w: b.FIRST_WORD + i for i, w in enumerate(sorted((w for w in train if train[w] >= b.LEAST_COUNT), key=lambda w: (-train[w], *key(w))))}
    cls = lambda w: b.END if w is None else int(classes[units.get(w, b.ending(w.encode()))])
    ones, twos = (sum(n == k for n in train.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    types = Counter(map(cls, train))
    steps, per_class = b._transitions(bigrams), bigrams.sum(0)
    text_of = {r[0]: r[1] for r in corpus}
    for r in rows:
        t = tokens(text_of[r["doc_id"]])
        want = sum(steps[x, y] for x, y in zip([b.END, *map(cls, t)], map(cls, t), strict=False))
        for w in t[:-1]:
            want += math.log10((train[w] - d if train[w] else d * types[cls(w)]) / per_class[cls(w)]) if per_class[cls(w)] else 0
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want)), r


def test_words_in_bytes_are_the_words():
    import pyarrow as pa

    texts = [None, "", "Ab\tÄB \x1cx\x85y\u2028z\xa0\x0b\x0cQ\r\n ", "\u0130I ſK", "a" * 100_000]
    assert [[w.decode() for w in x] for x in b.words_of(pa.array(texts))] == [[w for w in tokens(t) if w] for t in texts]
