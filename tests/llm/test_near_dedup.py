import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routegraph.llm import common as common_
from routegraph.llm import near_dedup as n
from routegraph.llm.common import WORD, ascii_lower
from routegraph.llm.components import connected_components


def shingles(text, width):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    """Smallest id reachable over all pairs."""
    sets = {}
    for k, text in rows:
        if k is not None:
            sets.setdefault(k, []).append(shingles(text, width))
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in ids}


def edited(words, r, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture
def rows(prose):
    r = random.Random(2)
    out, i = [], 0
    for family in range(6):
        words = prose(r.choice((30, 80, 150)), 50 + family).split()
        for k in range(14):
            out.append((i, edited(words, r, k // 2)))
            i += 1
    out += [(i + k, prose(60, 200 + k)) for k in range(20)]
    out += [(500, None), (501, ""), (502, " \n "), (503, "one two"), (504, "ONE two"), (505, "one"), (506, prose(30000, 7)), (507, prose(30000, 7) + " tail")]
    out += [out[3], out[3], (None, out[3][1]), (None, None), (600, out[3][1].upper()), (601, out[3][1].replace(" ", "\t\n"))]
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80)])
def test_components_match_brute_force(spark, frame, rows, width, percent):
    got = n.near_duplicates(frame([(k, t, "en", "s") for k, t in rows]), width, percent).collect()
    want = brute(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert all(sizes[k] == len(shingles(t, width)) for k, t in rows if k is not None)


def test_blocks_alone_find_what_stars_miss(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 3)
    monkeypatch.setattr(n, "WIDE_BLOCK", 5)
    monkeypatch.setattr(n, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common_, "SALTED_ROWS", 2)
    got = n.near_duplicates(frame([(k, t, "en", "s") for k, t in rows]), 4, 80).collect()
    want = brute(rows, 4, 80)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_profiles_bound_what_sets_share(common, a, b):
    x, y = (np.array(sorted(common | s), np.uint64) for s in (a, b))
    most = n.most_shared([n.profile(x), n.profile(y)], np.array([0]), np.array([1]))[0]
    assert most >= len(np.intersect1d(x, y))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3), (7, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 260)]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_without_near_duplicates_keeps_columns(frame, rows):
    docs = frame([(k, t, "en", "s") for k, t in rows]).selectExpr("*", "1 as component_id", "2 as _gone", "3 as text_hash", "4 as row", "5 as key", "6 as part", "7 as copy")
    out = n.without_near_duplicates(docs, 5, 80)
    want = brute(rows, 5, 80)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert set(kept) == {k for k in want if want[k] == k} | {None}
    assert len([k for k in kept if k is not None]) == len(set(kept) - {None})  # repeated rows stay once
    assert n.near_duplicates(frame([])).count() == 0


@pytest.mark.parametrize("salted", [500, 3])
def test_salted_joins_and_hubs(spark, monkeypatch, salted):
    monkeypatch.setattr(common_, "SALTED_ROWS", salted)
    rows = spark.createDataFrame([(i % 3 if i < 40 else i, i) for i in range(60)], "k long, v long")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(50)], "k long, fact string")
    got = sorted(tuple(r) for r in common_.salted_join(rows, facts, "k", "v").select("k", "v", "fact").collect())
    assert got == sorted((r["k"], r["v"], f"f{r['k']}") for r in rows.collect() if r["k"] < 50)
    star = spark.createDataFrame([(9, k) for k in range(100, 160)], "a long, b long")
    assert {r["component"] for r in connected_components(star, "a", "b").collect()} == {9}


def test_texts_of_one_id_are_judged_apart_and_low_similarities_refused(frame, prose):
    docs = frame([(1, prose(40, 1), "en", "s"), (5, prose(40, 1), "en", "s"), (5, prose(40, 2), "en", "s")])
    assert sorted(r["doc_id"] for r in n.without_near_duplicates(docs).collect()) == [1, 5]
    with pytest.raises(ValueError):
        n.near_duplicates(docs, percent=70)


def sketched(sets):
    import pyarrow as pa

    text = [" ".join(f"w{x}" for x in sorted(t)) for t in sets]  # one word is one shingle
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text), pa.array(range(len(text)), pa.int64())], ["doc_id", "text", "text_hash"])
    out = pa.Table.from_batches(n._sketcher(1)(iter([batch])))
    low = np.frombuffer(b"".join(out.column("bytes").to_pylist()), np.uint8).reshape(len(text), -1)
    return low, np.array(out.column("bands").to_pylist())


def test_every_pair_is_compared_in_the_first_bucket_that_both_are_in():
    r = random.Random(5)
    pairs = []
    for _ in range(1500):
        shared, a, b = (r.sample(range(k, k + 10**6), m) for k, m in ((0, 80), (2 * 10**6, 10), (4 * 10**6, 10)))
        pairs += [shared + a, shared + b]  # 80 of 100 shingles
    low, bands = sketched(pairs)
    x, y = (low[::2], bands[::2]), (low[1::2], bands[1::2])
    in_a_bucket = (x[1] == y[1]).any(1) & ((x[0] == y[0]).sum(1) >= n.MIN_EQUAL_BYTES)
    compared = np.stack([n._close(x, y, k) & (x[1][:, k] == y[1][:, k]) for k in range(n.BANDS)], 1)
    assert in_a_bucket.sum() > 1400 and (compared.sum(1) == in_a_bucket).all()
    # four equal minima and a fifth with an equal byte: no common bucket there, whatever the bytes say
    one, other = (low[:1].copy(), bands[:1].copy()), (low[:1].copy(), bands[:1].copy())
    other[1][0, 0] += 1
    assert n._close(one, other, 0).tolist() == [False] and n._close(one, other, 1).tolist() == [True]
