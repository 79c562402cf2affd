import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routegraph.llm import decontamination as d
from routegraph.llm.fm_index import Bits, FMIndex, suffix_order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_counts_and_locates_like_brute_force(docs, patterns):
    index = FMIndex([np.array(x, np.int64) for x in docs], 4)
    width = max(map(len, patterns))
    table = np.full((len(patterns), width), -2, np.int64)
    for i, p in enumerate(patterns):
        table[i, width - len(p) :] = [x if x < 4 and any(x in y for y in docs) else -1 for x in p]
    low, high = index.ranges(table)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = sorted(int(index.starts[k]) + i for k, x in enumerate(docs) for i in range(len(x) - len(p) + 1) if x[i : i + len(p)] == p)
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_of_long_repeats():
    text = np.array([1, 2, 3] * 200 + [0], np.int64)
    text[-1] = 0
    order = suffix_order(text, 4).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_rank():
    bits = np.random.default_rng(1).integers(0, 2, 1000).astype(bool)
    at = np.arange(1001)
    assert Bits(bits).rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()


def brute(text, items):
    w = d.item_words(text)
    hit, found = set(), set()
    for item, phrase in items:
        p = d.item_words(phrase)
        m = min(10, len(p))
        for k in range(max(1, len(p) - 9) if p else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.fixture
def case(spark, frame, prose):
    r = random.Random(4)
    items = [(i, prose(r.randint(10, 30), 100 + i)) for i in range(12)] + [(50, "Two Words"), (51, ""), (52, None), (None, prose(12, 900)), (3, prose(15, 103))]
    docs = [prose(80, i) for i in range(10)] + [None, "", "!!! ???", "two, words two", prose(9000, 5)]
    docs += [f"{prose(20, 60)} {items[2][1].upper()}! {prose(9, 61)} {items[2][1]}", items[4][1], items[4][1], " ".join(items[5][1].split()[:9]), items[-2][1], "x" * 3000 + " two words"]
    return frame(docs), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("windows, pieces, blocks", [(1024, 128, 8), (5, 3, 2), (2, 1, 5)])
def test_digest_matches_brute_force(case, monkeypatch, windows, pieces, blocks):
    docs, bench, texts, items = case
    for name, value in (("PIECE_WINDOWS", windows), ("BLOCK_PIECES", pieces), ("PASS_BLOCKS", blocks)):
        monkeypatch.setattr(d, name, value)
    rows = {r["doc_id"]: r for r in d.digest(docs, bench).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute(t, items), i
        assert r["contaminated"] == (r["n_hit"] > 0)


def searched(texts, block):
    shard = d.Shard()
    for t in texts:
        shard.add(t)
    return [(f.tolist(), s) for f, s in shard.search([block])]


def test_small_shards_give_the_same(case):
    _, _, texts, items = case
    block = d.query_block([("" if i is None else str(i), d.item_words(t)) for i, t in items])
    assert searched(texts, block) == [x for t in texts for x in searched([t], block)]


def test_blocks_are_bounded_and_compact(spark):
    items = spark.range(300).selectExpr("id AS item_id", "array_join(transform(sequence(1, 2000), i -> concat('w', CAST(pmod(i * 7919 + id * 31, 5000) AS STRING))), ' ') AS text")
    blocks = list(d.blocks_of(items))
    assert len(blocks) == 5 and all(len(b["windows"]) <= d.PIECE_WINDOWS * d.BLOCK_PIECES for b in blocks)
    import pickle

    assert max(len(pickle.dumps(b)) for b in blocks) < 12 << 20


def test_empty_benchmark_and_tables(spark, frame, case):
    _, bench, _, _ = case
    none = bench.where("false")
    assert [r["contaminated"] for r in d.digest(frame(["a b"]), none).collect()] == [False]
    assert d.digest(frame([]), bench).count() == 0


def test_decontaminate_keeps_columns_and_clean_rows(case):
    docs, bench, _, _ = case
    named = docs.selectExpr("*", "doc_id as spans", "'x' as items", "1 as n_words", "2 as found", "3 as row")
    kept = d.decontaminate(named, bench)
    assert kept.columns == named.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(13)) | {14, 18}


def test_spans_are_cut_from_the_text():
    text = "Aa bb, cc dd! Ee"
    assert d.remove_spans(text, [(1, 3)]) == "Aa  dd! Ee"
    assert d.remove_spans(text, []) == text and d.remove_spans(None, [(0, 1)]) is None
