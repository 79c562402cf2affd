"""Windowed counts of a stream: equal to a batch over all rows, with late rows told apart exactly as by hand, also when a batch runs twice."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from routegraph.streaming.windows import WindowedCounts

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, kind string, amount double, batch int, row string"


def batches(seed):
    r = random.Random(seed)
    out, at = [], 0
    for number in range(5):
        rows = []
        for i in range(r.randrange(1, 40)):
            at += r.randrange(0, 9)
            ts = None if r.random() < 0.05 else START + timedelta(minutes=max(0, at - r.choice([0, 0, 0, 10, 45, 70, 200])))
            rows.append((ts, r.choice(["a", "b", None]), float(i), 7, f"{number}-{i}"))
        out.append(rows)
    return out


def by_hand(parts, minutes):
    seen, late = None, set()
    for rows in parts:
        late |= {x[4] for x in rows if x[0] is None or (seen is not None and x[0] < seen - timedelta(minutes=minutes))}
        seen = max([x[0] for x in rows if x[0] is not None] + ([seen] if seen else []))
    return late, seen


def plain(df):
    return sorted(((r["start"], r["end"], r["kind"] or "", r["n"], r["total"]) for r in df.collect()))


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_stream_equals_batch_with_late_rows_apart(spark, tmp_path, slide):
    parts = batches(3)
    w = WindowedCounts(f"{tmp_path}/out", "30 minutes", slide, "1 hour", ("kind",), value="amount")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        if i in (1, 4):  # stopped and started again from the checkpoint
            assert w.start(stream, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(100)
    late, seen = by_hand(parts, 60)
    got = w.late_rows(spark).select("row.row").collect()
    assert len(late) > 3 and sorted(r[0] for r in got) == sorted(late)
    everything = spark.createDataFrame([x for rows in parts for x in rows], SCHEMA)
    assert plain(w.corrected(spark)) == plain(w.counted(everything))
    on_time = w.counted(everything.where(~F.col("row").isin(list(late))))
    assert plain(w.counts(spark)) == plain(on_time)
    assert plain(w.final(spark)) == plain(on_time.where(F.col("end") <= F.lit(seen - timedelta(hours=1))))
    w.take(spark.createDataFrame(parts[2], SCHEMA), 2)  # a batch that runs again after a failure
    assert plain(w.counts(spark)) == plain(on_time)


def test_empty_batches(spark, tmp_path):
    w = WindowedCounts(str(tmp_path), "30 minutes", keys=("kind",))
    w.take(spark.createDataFrame([], SCHEMA), 0)
    w.take(spark.createDataFrame([(START, "a", 1.0, 0, "x")], SCHEMA), 1)
    w.take(spark.createDataFrame([], SCHEMA), 2)
    w.take(spark.createDataFrame([(START - timedelta(hours=2), "a", 1.0, 0, "y")], SCHEMA), 3)
    assert [(r["n"], r["total"]) for r in w.counts(spark).collect()] == [(1, None)]
    assert [(r["row"]["row"], r["batch"], r["watermark"]) for r in w.late_rows(spark).collect()] == [("y", 3, START - timedelta(hours=1))]
