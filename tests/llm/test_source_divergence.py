import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routegraph.llm import source_divergence as s
from routegraph.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    """Every pair of sources over every kept term, by definition."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for *_, w in mine for t in set(w))
        kept = [t for t in df if df[t] >= 3]
        count = {source: Counter() for _, source, _ in mine}
        for _, source, w in mine:
            count[source].update(t for t in w if df[t] >= 3)
        total = sum(count.values(), Counter())
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c.values()))
        p, q = {x: share(c) for x, c in count.items()}, share(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for source in count:
            pairs = [(-sum(f(p[source][t], p[x][t]) for t in kept), x) for x in count if x != source]
            own = [(-f(p[source][t], q[t]), t) for t in kept if count[source][t] and p[source][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, source, part, item, -value, r) for r, (value, item) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "text").collect()]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=20), st.integers(1, 10**15), st.integers(0, 10**9))
def test_shares_are_exact(counts, n, v):
    counts = [min(c, n) for c in counts]
    assert s.shares(np.array(counts), np.int64(n), v).tolist() == [1 + 10**9 * (c + 1) // (n + v) for c in counts] or n + v < max(counts) + 1


@pytest.fixture
def corpus(frame, prose):
    syllables = ("ba", "do", "ri", "É", "ß")
    return frame([(i, prose(30 + i % 50, i, syllables[: 3 + i % 3]), ("en", "fr", "de")[i % 3 % 2 + (i % 7 == 0)], f"s{i * i % 11}") for i in range(150)])


def test_equals_brute_force(corpus):
    want = brute(rows_of(corpus))
    assert found(s.audit(corpus)) == want
    assert found(s.audit(corpus.repartition(5), top_terms=3)) == brute(rows_of(corpus), 3)


def test_tiles_and_flushes_change_nothing(corpus, monkeypatch):
    want = brute(rows_of(corpus))
    for name, value in (("BLOCK", 2), ("HELD_TILES", 3), ("HELD_TERMS", 50), ("STEP", 10)):
        monkeypatch.setattr(s, name, value)
    assert found(s.audit(corpus)) == want


def test_vectors_are_met_once(spark, frame):
    docs = frame([(i, "a b c", "en", f"s{i % 2}") for i in range(6)])
    terms = s.count_vectors(docs)
    assert terms.count() == 3 and s.distinct_vectors(terms).select("terms").first()[0] == 3 and s.distinct_vectors(terms).count() == 1


def test_odd_rows(spark, frame, prose):
    long = prose(20_000, 5)
    rows = [(0, None, None, None), (1, "", "en", "a"), (None, "x y x", "en", None), (2, "X-y_3É", "en", "b"), (2, "X-y_3É", "en", "b"), (3, "x É é", "en", "b"), (4, "only here", "xx", "lonely"), (5, long, "en", "c"), (6, long, "en", "d"), (7, long, "en", "c"), (8, "rare words here", "fr", "a"), (9, "other ones", "fr", "b")]
    docs = frame(rows).withColumn("item", F.lit(1)).withColumn("value", F.lit(1)).withColumn("n", F.lit(1)).withColumn("blocks", F.lit(2))
    got = found(s.audit(docs))
    assert got == brute([(r[2], r[3], r[1]) for r in rows])
    assert [r[3:] for r in got if r[0] == "fr"] == [("b", 0, 1), ("a", 0, 1)]  # no kept terms: all values 0


def test_empty_table(frame):
    assert found(s.audit(frame([]))) == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    assert found(QUERIES["op13_source_divergence"](spark, sf)) == brute(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
