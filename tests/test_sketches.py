"""Stored sketches: merged over parts they are as near to the exact answer as stated; a part added again counts once."""

import random

import pytest
from pyspark.sql import functions as F

from routegraph.operators.sketches import DISTINCT_ERROR, RANK_ERROR, StoredSketches

SCHEMA = "kind string, who string, amount double, load string"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(r.choice("aaab"), f"u{r.randrange(9000)}", r.gauss(0, 50), f"2024-0{r.randrange(1, 5)}") for _ in range(60_000)]
    data += [("c", "one", None, "2024-01"), ("c", None, float("nan"), "2024-02"), (None, "x", 1.0, "2024-03"), (None, "x", 1.0, "2024-03")]
    return spark.createDataFrame(data, SCHEMA).cache()


def stored(tmp_path, rows):
    kept = StoredSketches(str(tmp_path), ["kind"], "who", "amount")
    for load in ("2024-01", "2024-02", "2024-03", "2024-04"):
        kept.add(load, rows.where(F.col("load") == load))
    return kept


@pytest.mark.parametrize("parts", [None, ["2024-01", "2024-04"]])
def test_merged_sketches_are_as_near_as_stated(spark, rows, tmp_path, parts):
    kept = stored(tmp_path, rows)
    kept.add("2024-01", rows.where("load = '2024-01'"))  # a run that is repeated
    got = {r["kind"]: r for r in kept.merged(spark, (0.1, 0.5, 0.99), parts).collect()}
    exact = [r for r in rows.collect() if parts is None or r["load"] in parts]
    assert set(got) == {r["kind"] for r in exact}
    for kind, r in got.items():
        own = [x for x in exact if x["kind"] == kind]
        assert r["n_rows"] == len(own)
        want = len({x["who"] for x in own} - {None})
        assert abs(r["n_distinct"] - want) <= max(1, 4 * DISTINCT_ERROR * want)
        values = [x["amount"] for x in own if x["amount"] is not None and x["amount"] == x["amount"]]
        if not values:
            assert r["quantiles"] == [None] * 3
            continue
        for q, at in zip((0.1, 0.5, 0.99), r["quantiles"], strict=True):
            below, upto = sum(v < at for v in values), sum(v <= at for v in values)
            assert below <= (q + 2 * RANK_ERROR) * len(values) and upto >= (q - 2 * RANK_ERROR) * len(values)


def test_without_keys_and_without_rows(spark, rows, tmp_path):
    kept = StoredSketches(str(tmp_path), [], "who", "amount")
    kept.add("none", rows.where("false"))
    assert [tuple(r) for r in kept.merged(spark).collect()] == [(0, 0, [None])]
    kept.add("some", rows.where("kind is null"))
    assert [tuple(r) for r in kept.merged(spark).collect()] == [(2, 1, [1.0])]
    with pytest.raises(ValueError):
        kept.add("../x", rows)
