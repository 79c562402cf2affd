"""Respondents followed by state: the same final routes as in batch, whatever the order of events, also across a restart."""

import json
import random
from datetime import datetime, timedelta

import pytest
from surveys import edge

from routegraph.operators.routes import ordered_edges
from routegraph.streaming.live import _Sessions, live_routes, progress
from routegraph.streaming.respondents import gathered_answers, routed_stream

EDGES = [
    edge("E1", "Q1", "Q2", ["=", "Q1", 1], 1), edge("E2", "Q1", "Q3", ["=", "Q1", 2], 2), edge("E3", "Q1", "END", None, 3),
    edge("E4", "Q2", "Q3", [">", "Q2", 1]), edge("E5", "Q3", "Q1", ["=", "Q3", 0], 1), edge("E6", "Q3", "END", None, 2),
]
START = datetime(2024, 1, 1)
SCHEMA = "respondent long, ts timestamp, question string, answer string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def events_of(seed):
    r = random.Random(seed)
    out = []
    for who in range(6):
        at = START
        for _ in range(r.randrange(1, 12)):
            at += timedelta(minutes=r.choice([0, 1, 5, 30, 31, 90]))
            out.append((who, at, r.choice(["Q1", "Q2", "Q3"]), r.choice(["0", "1", "2", '"x"', None])))
    return out


def run(spark, folder, parts, place):
    """Each part is one file and one batch; the query stops and starts again from its checkpoint between the two lists of parts."""
    for number, files in enumerate(parts):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{place}-{number}-{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        routes = live_routes(stream, "Q1", EDGES, ["END"], late="2 days")
        started = routes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query = started.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
        assert query.awaitTermination(150)
    return spark.read.parquet(f"{folder}/out").collect()


def test_same_routes_as_in_batch_in_any_order_and_after_a_restart(rocks, tmp_path):
    rows = events_of(9)
    batch = rocks.createDataFrame(rows, SCHEMA)
    routed = routed_stream(gathered_answers(batch), "Q1", EDGES, ["END"]).selectExpr("respondent", "session.start AS start", "path", "edge_ids", "reason").collect()
    want = sorted((r["respondent"], r["start"], r["path"], r["edge_ids"], r["reason"]) for r in routed)
    random.Random(1).shuffle(rows)
    third = len(rows) // 3
    # the last event passes the watermark over everything; rows of its own session stay open
    flush = [(99, START + timedelta(days=9), "Q1", "1")]
    got = run(rocks, tmp_path, [[rows[:third], rows[third : 2 * third]], [rows[2 * third :], flush, [(99, START + timedelta(days=9), "Q2", "5")], [(0, START, "Q1", "2")]]], "a")
    closed = sorted((r["respondent"], r["session_start"], r["path"], r["edge_ids"], r["reason"]) for r in got if r["closed"] and r["reason"] != "merged")
    assert closed == want and len({x[4] for x in want}) >= 3
    # moved at once: the flushing respondent stands at Q2 before, and has passed it after the next batch; the late row (0, START) is dropped
    last = [r for r in sorted(got, key=lambda r: r["batch"]) if r["respondent"] == 99 and not r["closed"]]
    assert [(r["path"], r["reason"]) for r in last] == [(["Q1", "Q2"], "waiting"), (["Q1", "Q2", "Q3"], "waiting")]
    assert not [r for r in got if r["respondent"] == 0 and r["path"] and r["batch"] > 5]


@pytest.mark.parametrize("seed", range(40))
def test_sessions_do_not_depend_on_order(seed):
    r = random.Random(seed)
    events = [(r.randrange(0, 200), r.choice("ABC"), r.choice(["1", "2", None])) for _ in range(r.randrange(1, 15))]
    seen = set()
    for _ in range(5):
        r.shuffle(events)
        s = _Sessions(None, 10)
        for e in events:
            s.add(*e)
            s = _Sessions(s.text(), 10)
        seen.add(json.dumps([{**x, "last": sorted(x["last"].items())} for x in s.open]))
    assert len(seen) == 1
    times = sorted({e[0] for e in events})
    assert len(json.loads(seen.pop())) == 1 + sum(b - a > 10 for a, b in zip(times, times[1:], strict=False))


@pytest.mark.parametrize(
    ("answers", "closed", "want"),
    [
        ({}, False, (["Q1"], "waiting")), ({}, True, (["Q1", "END"], "terminal")), ({"Q1": None}, False, (["Q1", "END"], "terminal")),
        ({"Q1": 1}, False, (["Q1", "Q2"], "waiting")), ({"Q1": 1}, True, (["Q1", "Q2"], "no_matching_edge")),
        ({"Q1": 1, "Q2": "x"}, False, (["Q1", "Q2"], "Unsupported operands for condition operator >")), ({"Q1": 2, "Q3": 0}, False, (["Q1", "Q3", "Q1"], "max_steps")),
    ],
)
def test_progress(answers, closed, want):
    path, ids, reason = progress("Q1", ordered_edges(EDGES), {"END"}, answers, closed)
    assert (path, reason) == want and len(ids) == len(path) - 1
    assert progress(None, {}, set(), answers, closed) == ([], [], "missing_entry_node")
