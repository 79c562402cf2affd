import zlib

import pytest

from routegraph.llm import kd_sharding as k


@pytest.fixture
def docs(frame, prose):
    rows = [(i, prose(5 + i % 90, i), ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 5 else None) for i in range(400)]
    return [*rows, (900, None, "en", "s"), (901, "", None, None), (902, "é" * 100, "en", "s"), *[(1000 + i, "same text here", "en", "s0") for i in range(200)], rows[7], rows[7], (None, "no id", "en", "s")]


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_near_equal_and_slots_gapless(frame, docs, shards):
    rows = k.kd_shards(frame(docs), shards).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(shards))
    mean = sum(r["size"] for r in rows) / shards
    largest = max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in x) - mean) <= 2 * max(largest, mean / k.GROUP_SHARE) for x in by.values())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    text = {d[0]: d[1] for d in docs}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_small_slot_parts_and_reruns(frame, docs, monkeypatch):
    first = sorted((str(r["doc_id"]), r["shard"]) for r in k.kd_shards(frame(docs), 8).collect())
    monkeypatch.setattr(k, "SLOT_ROWS", 7)
    rows = k.kd_shards(frame(docs).repartition(5), 8).collect()
    assert first == sorted((str(r["doc_id"]), r["shard"]) for r in rows)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_target_bytes_and_degenerate_tables(frame, docs):
    total = sum(len((d[1] or "").encode()) + 1 for d in docs)
    assert k.kd_shards(frame(docs), target_bytes=total // 3).select("shard").distinct().count() == 4
    assert k.kd_shards(frame([]), 4).count() == 0
    assert k.kd_shards(frame([(1, None, None, None)]), 4).count() == 1
    assert k.kd_shards(frame([(1, "x", "a", "b")] * 9), 4).count() == 9


def test_no_python_on_the_main_path(frame, docs):
    plan = k.kd_shards(frame(docs), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_columns(frame, docs):
    named = frame(docs).selectExpr("*", "1 as size", "2 as node", "3 as tie", "4 as shard", "5 as part", "6 as whole", "7 as copy")
    assert k.kd_shards(named, 4).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "whole_group"]


def test_equal_texts_stay_together_and_large_groups_are_split(frame, prose):
    pairs = [(i, prose(20, i // 2), ("en", "fr")[i % 2], f"s{i % 5}") for i in range(600)]
    rows = k.kd_shards(frame([*pairs, *[(5000 + i, "a text that a third of all rows has, word for word", "en", "s") for i in range(2000)]]), 8)
    found = rows.collect()
    by = {}
    for r in found:
        by.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert sum(len(x) > 1 for x in by.values()) == 1 == k.split_groups(rows).count()
    assert {r["whole_group"] for r in found if r["doc_id"] >= 5000} == {False} and all(r["whole_group"] for r in found if r["doc_id"] < 600)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    assert max(sizes) < 1.06 * min(sizes)


def test_one_row_repeated_ten_thousand_times(spark, frame):
    same = spark.range(10_000).selectExpr("7L AS doc_id", "'the same row' AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    rows = k.kd_shards(same.unionByName(frame([(i, "x" * (i % 30), "fr", "t") for i in range(1000)])), 16).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert len(rows) == 11_000 and max(sizes) - min(sizes) <= 0.03 * max(sizes)


def test_two_thousand_shards(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('ab ', CAST(5 + id % 7 AS INT)) || id AS text", "'en' AS lang", "'s' AS source")
    rows = k.kd_shards(docs, 2000)
    sizes = [r["n"] for r in rows.groupBy("shard").agg({"size": "sum"}).toDF("shard", "n").collect()]
    assert len(sizes) == 2000 and max(sizes) <= 2 * sum(sizes) / 2000


def test_cuts_are_weighted_medians(spark):
    import random

    r = random.Random(4)
    data = [(0, r.randrange(1 << 40), r.randrange(1, 50)) for _ in range(300)] + [(1, 5, 10)] * 4
    rows = spark.createDataFrame(data, "node long, place long, size long")
    got = {x["node"]: x["cut"] for x in k._cuts(rows, spark.createDataFrame([(0, 3000.0), (1, 15.0), (2, 1.0)], "node long, wanted double")).collect()}
    below = lambda cut: sum(s for n, p, s in data if n == 0 and p < cut)
    assert abs(below(got[0]) - 3000) == min(abs(below(p + 1) - 3000) for n, p, _ in data if n == 0)
    assert got[1] in (5, 6)
