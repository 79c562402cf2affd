import zlib

import numpy as np
from pyspark.sql import functions as F

from routegraph.llm import quality_classifier as q
from routegraph.llm.queries import QUERIES

LABELS = "doc_id long, quality int"


def test_contexts_by_definition():
    texts = [["a", "b", "a", "c"], ["b"], ["c", "c", "a"]]
    hashes = q.Hashes().of([t for w in texts for t in w])
    sums = np.zeros(q.BUCKETS * q.DIMENSIONS, np.int64)
    q.add_contexts(sums, hashes, np.repeat(np.arange(3), [4, 1, 3]))
    vector = {}
    for t in "abc":
        h = q.Hashes().of([t])
        vector[t] = np.zeros(q.DIMENSIONS)
        for place, sign in q.index_vectors(h):
            vector[t][place[0]] += sign[0]
    want = {t: np.zeros(q.DIMENSIONS) for t in "abc"}
    for w in texts:
        for i, t in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    want[t] += vector[w[j]]
    for t in "abc":
        at = int(q.bucket(q.Hashes().of([t]))[0])
        assert sums.reshape(q.BUCKETS, -1)[at].tolist() == want[t].tolist()


def test_sums_do_not_depend_on_the_parts(spark, frame, prose):
    docs = frame([prose(50, i) for i in range(30)])
    rows = lambda df: sorted(map(tuple, q.word_sums(df).collect()))
    assert rows(docs.coalesce(1)) == rows(docs.repartition(7))


def test_pooling_in_steps_is_pooling_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, weights = rng.normal(size=(q.BUCKETS, q.DIMENSIONS)).astype(np.float32), rng.random(q.BUCKETS).astype(np.float32)
    tokens, sizes = [str(x) for x in rng.integers(0, 9, 40)], [0, 7, 0, 1, 20, 12, 0]
    whole = q.pooled(vectors, weights, tokens, sizes, q.Hashes())
    monkeypatch.setattr(q, "POOL_STEP", 5)
    assert np.allclose(whole, q.pooled(vectors, weights, tokens, sizes, q.Hashes()), atol=1e-5)
    mine = q.bucket(q.Hashes().of(tokens[8:28]))
    w = weights[mine][:, None].astype(float)
    assert np.allclose(whole[4, : q.DIMENSIONS], (w * vectors[mine]).sum(0) / (w.sum() + q.PRIOR), atol=1e-5)


def corpus(prose):
    good = [prose(30 + i % 80, i) for i in range(240)]
    bad = [" ".join(w + ("###", " |")[i % 2] for w in prose(40 + i % 50, 1000 + i).split()) for i in range(80)]
    return [(i, t, "en", "s") for i, t in enumerate(good + bad)]


def test_held_out_rows_are_told_apart(spark, frame, prose):
    rows = corpus(prose)
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(320)], LABELS)
    got = {r["doc_id"]: r for r in q.classify(frame(rows), labels).collect()}
    assert len(got) == 320 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] < 240) for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    # labels of held-out rows, languages, sources and repeated label rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = q.classify(frame([(i, t, None, f"x{i}") for i, t, *_ in rows]).repartition(5), flipped.union(labels.where("doc_id = 3")))
    same = {r["doc_id"]: r["score"] for r in other.collect()}
    assert all(abs(same[i] - r["score"]) < 1e-6 for i, r in got.items())


def test_temperature_does_not_worsen_the_rows_kept_back():
    rng = np.random.default_rng(3)
    import pandas as pd

    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    x[:, 0] += y * 1.5
    model = q.fit(pd.DataFrame({"quality": y, "draw": range(600), "pooled": [r.tobytes() for r in x]}), {0: 300, 1: 300})
    back = np.r_[np.flatnonzero(y == 0)[q.CALIBRATION - 1 :: q.CALIBRATION], np.flatnonzero(y == 1)[q.CALIBRATION - 1 :: q.CALIBRATION]]
    logits, one = q.forward(model, x[back].astype(float))[1], np.ones(len(back))
    assert q.loss(logits / model["temperature"], y[back], one) <= q.loss(logits, y[back], one) + 1e-3
    for other in (0.5, 0.8, 1.25, 2):
        assert q.loss(logits / model["temperature"], y[back], one) <= q.loss(logits / (model["temperature"] * other), y[back], one) + 1e-9


def test_odd_rows(spark, frame, prose):
    rows = [*corpus(prose), (None, "some text", None, None), (900, None, "en", "s"), (901, "", "en", "s"), (902, " \n\t", "en", "s"), (903, prose(25_000, 9), "en", "s"), (0, prose(30, 0), "en", "s"), (904, "é|É 12", "en", "s")]
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(320)] + [(None, 1), (900, None), (2, 0), (901, 0)], LABELS).withColumn("pooled", F.lit(1)).withColumn("score", F.lit(1))
    docs = frame(rows).withColumn("quality", F.lit(0)).withColumn("score", F.lit("x")).withColumn("pooled", F.lit(2))
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert next(r for r in got if r["doc_id"] == 903)["predicted"] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_without_labels_or_rows(spark, frame):
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in q.classify(frame(["a b", None]), none).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(i, 1) for i in range(9)], LABELS)
    assert {round(r["score"], 3) for r in q.classify(frame(["a b"] * 9), one).collect()} <= {round((n + 1) / (n + 2), 3) for n in range(10)}
    assert q.classify(frame([]), one).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_quality_classifier"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.96 and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
