import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, frame, prose, tmp_path):
    r = random.Random(3)
    items = [(i, prose(25, 500 + i)) for i in range(6)]
    rows = [(i, prose(r.randint(40, 90), i), "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    rows += [(300 + i, rows[20 + i][1] + " x", "en", "s1") for i in range(10)]  # near copies
    rows += [(400 + i, f"{prose(20, 700 + i)} {items[i][1]} {prose(20, 800 + i)}", "en", "s2") for i in range(6)]  # benchmark passages
    rows += [(500, None, None, "s0"), (501, "123 !!", "en", "s1"), (502, "", None, None)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    want = [
        {r[0] for r in rows} - {500, 501, 502},
        {r[0] for r in rows if r[0] < 200 or r[0] >= 400} - {500, 501, 502},
        set(range(150)),
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        if k < 4:
            assert docs.columns == COLUMNS, name
            path = f"{at}/stage{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        if k < 3:
            assert {r["doc_id"] for r in docs.collect()} == want[k], name
        if k == 3:
            words = {}
            for r in docs.collect():
                words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
            total = sum(len(r[1].split()) for r in rows if r[0] in want[2])
            assert all(abs(words[f"s{i}"] - total * (i + 1) / 6) < 0.02 * total for i in range(3))
            mixed = docs.count()
    out = docs.collect()
    assert len(out) == mixed and {r["shard"] for r in out} == set(range(16))


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
