import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routegraph.llm import lexical_search as s
from routegraph.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, queries, k=10):
    """Every query against every document, by the definition of the score."""
    full = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, length = len(full), sum(len(w) for _, w in full)
    df = Counter(t for _, w in full for t in set(w))
    asked = {}
    for item, text in dict.fromkeys(queries):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, w in full:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // length
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, n in wanted.items())
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -score) for r, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force_over_several_shards(spark, frame, items, prose, monkeypatch):
    texts = [prose(5 + i % 90, i % 60) for i in range(200)]  # copies, so equal scores at the tenth place
    docs = frame(texts).repartition(3)
    queries = [(i, prose(1 + i, 500 + i, ("ba", "do", "ri"))) for i in range(12)]
    want = brute(list(enumerate(texts)), queries)
    assert found(s.search(docs, items(queries))) == want
    monkeypatch.setattr(s, "BLOCK_TERMS", 20)  # several passes
    assert found(s.search(docs, items(queries))) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=12), min_size=1, max_size=40), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6), st.integers(1, 3), st.integers(1, 7))
def test_threshold_algorithm_loses_no_tie(docs, query, k, cut):
    vocabulary = {t: i for i, t in enumerate("abcdef")}
    weights = np.array([5, 4, 3, 2, 1, 0], np.int64)
    wanted = Counter(query)
    q, n = np.array([vocabulary[t] for t in wanted]), np.array(list(wanted.values()))
    per_term = np.zeros(6, np.int64)
    per_term[q] = n
    length = sum(map(len, docs))

    def shard(at):
        import pyarrow as pa

        rows = [Counter(docs[i]) for i in at]
        return s.Shard(pa.array(at, pa.int64()), np.array([len(docs[i]) for i in at]), np.array([len(r) for r in rows]), np.array([vocabulary[t] for r in rows for t in r]), np.array([x for r in rows for x in r.values()]), weights, len(docs), length)

    best = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    for at in ([*range(i, min(i + cut, len(docs)))] for i in range(0, len(docs), cut)):
        one = shard(at)
        best, _ = one.top(q, n, per_term, best, k)
        assert not one.met.any()
    scores = []
    for i, d in enumerate(docs):
        tf, m = Counter(d), 25 + 75 * len(d) * len(docs) // length
        scores.append((-sum(c * int(weights[vocabulary[t]]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in wanted.items() if tf[t]), i))
    want = [(i, -x) for x, i in sorted(scores)[:k] if x < 0]
    assert list(zip(best[2].tolist(), best[0].tolist(), strict=True)) == want


def test_reading_stops_early():
    import pyarrow as pa

    n = 5000
    one = s.Shard(pa.array(range(n), pa.int64()), np.arange(1, n + 1) * 10, np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.array([1000]), n, 10 * n * (n + 1) // 2)
    best, looked_up = one.top(np.array([0]), np.array([1]), np.array([1]), (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)), 10)
    assert best[2].tolist() == list(range(10)) and looked_up < 100


def test_odd_rows(spark, frame, items, prose):
    long = prose(30_000, 3)
    rows = [(None, "alpha beta", None, None), (1, None, "en", "s"), (2, "", "en", "s"), (3, "ALPHA É alpha", "en", "s"), (3, "ALPHA É alpha", "en", "s"), (4, "é É 42-42 alpha_beta", "en", "s"), (5, long, "en", "s"), (None, "alpha beta", None, None)]
    queries = [(7, "Alpha alpha É"), (7, "Alpha alpha É"), (7, "42"), (None, "beta"), (8, None), (9, " \n"), (10, "nowhere"), (11, long[:5000])]
    docs = frame(rows).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).withColumn("query", F.lit(0))
    got = found(s.search(docs, items(queries).withColumn("count", F.lit(1)).withColumn("term", F.lit("t"))))
    assert got == brute([(r[0], r[1]) for r in rows], [(i, t) for i, t in queries if t is not None])
    for _, ranks in groupby(sorted((str(r[0]), r[1]) for r in got), key=lambda r: r[0]):
        assert [r for _, r in ranks] == list(range(1, 1 + sum(1 for x in got if str(x[0]) == _)))


def test_empty_tables(spark, frame, items):
    assert found(s.search(frame([]), items([(1, "a")]))) == []
    assert found(s.search(frame(["a b"]), items([]))) == []
    assert s.search(frame([]), items([])).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    queries = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op11_lexical_search"](spark, sf)) == brute(docs, queries)
