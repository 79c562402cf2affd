"""Respondents followed while they answer.

``gathered_answers`` waits for a session's end. Here every answer moves its respondent at once, as far as the answers so far decide, and
the watermark closes the session with its final route. The state of a respondent is the last answer to each question of every open session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from routegraph.functions.ast import ConditionError, evaluate, variables
from routegraph.operators.routes import ordered_edges

ROUTE = "session_start timestamp, path array<string>, edge_ids array<string>, reason string, closed boolean"


def progress(entry: str | None, by_source: dict[str, list[dict[str, Any]]], terminals: set[str], answers: dict[str, Any], closed: bool) -> tuple[list[str], list[str], str]:
    """Path, edges and reason. While the session is open a route waits at a condition that asks for a question without an answer; once it is closed such an
    answer counts as missing, and the route is that of ``compiled_routes``."""
    if not entry:
        return [], [], "missing_entry_node"
    path, ids = [entry], []
    while True:
        if path[-1] in path[:-1]:
            return path, ids, "max_steps"
        if path[-1] in terminals:
            return path, ids, "terminal"
        chosen = None
        for edge in by_source.get(path[-1], []):
            if not closed and variables(edge.get("condition")) - answers.keys():
                return path, ids, "waiting"
            try:
                if evaluate(edge.get("condition"), answers):
                    chosen = edge
                    break
            except ConditionError as error:
                return path, ids, str(error)
        if chosen is None:
            return path, ids, "no_matching_edge"
        if not isinstance(chosen.get("target"), str):
            return path, ids, "invalid_edge"
        path.append(chosen["target"])
        ids.append(str(chosen.get("id", "")))


def _json(text: str | None) -> Any:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _later(a: list, b: list) -> list:
    """Of two answers [time, text], the later one; at the same time the greater text, and no text last of all."""
    return max(a, b, key=lambda x: (x[0], x[1] is not None, x[1] or ""))


class _Sessions:
    """Open sessions of one respondent, by start; times in microseconds. Order of arrival does not matter: sessions that touch are merged."""

    def __init__(self, kept: str | None, gap: int) -> None:
        self.gap = gap
        self.open: list[dict[str, Any]] = json.loads(kept) if kept else []

    def add(self, at: int, question: str, answer: str | None) -> tuple[int, list[int]]:
        """The start of the session that the event is in, and the starts of sessions that are no more."""
        one = {"start": at, "end": at + self.gap, "last": {question: [at, answer]}}
        apart = []
        gone = []
        for s in self.open:
            if s["start"] > one["end"] or one["start"] > s["end"]:
                apart.append(s)
                continue
            gone.append(s["start"])
            one["start"], one["end"] = min(one["start"], s["start"]), max(one["end"], s["end"])
            for q, said in s["last"].items():
                one["last"][q] = _later(one["last"].get(q, said), said)
        self.open = sorted([*apart, one], key=lambda s: s["start"])
        return one["start"], [x for x in gone if x != one["start"]]

    def close(self, until: int) -> list[dict[str, Any]]:
        done = [s for s in self.open if s["end"] <= until]
        self.open = [s for s in self.open if s["end"] > until]
        return done

    def text(self) -> str:
        return json.dumps(self.open)


class _Follow(StatefulProcessor):
    def __init__(self, key: str, entry: str | None, edges: list[dict[str, Any]], terminals: list[str], gap: int) -> None:
        self.key, self.entry, self.by_source, self.terminals, self.gap = key, entry, ordered_edges(edges), set(terminals), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "open string")

    def _kept(self) -> _Sessions:
        kept = self.sessions.get() if self.sessions.exists() else None
        return _Sessions(kept[0] if kept else None, self.gap)

    def _keep(self, s: _Sessions) -> None:
        if s.open:
            self.sessions.update((s.text(),))
        else:
            self.sessions.clear()

    def _row(self, key: Any, s: dict[str, Any], closed: bool) -> tuple:
        answers = {q: _json(said[1]) for q, said in s["last"].items()}
        return (key[0], pd.Timestamp(s["start"], unit="us"), *progress(self.entry, self.by_source, self.terminals, answers, closed), closed)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "session_start", "path", "edge_ids", "reason", "closed"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._kept()
        known = {x["start"] for x in s.open}
        moved: set[int] = set()
        gone: set[int] = set()
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            for at, question, answer in zip(times, frame["question"], frame["answer"], strict=True):
                start, merged = s.add(int(at), question, answer)
                moved.add(start)
                gone.update(merged)
        now = {x["start"]: x for x in s.open}
        out = [(key[0], pd.Timestamp(x, unit="us"), [], [], "merged", True) for x in sorted(gone & known - now.keys())]
        out += [self._row(key, now[x], False) for x in sorted(moved & now.keys())]
        for x in s.open:
            self.handle.registerTimer(-(-x["end"] // 1000))
        self._keep(s)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._kept()
        done = s.close(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._keep(s)
        if done:
            yield self._frame([self._row(key, x, True) for x in done])


def live_routes(events: DataFrame, entry: str | None, edges: list[dict[str, Any]], terminals: list[str], gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(respondent, session_start, path, edge_ids, reason, closed) of a stream of events (respondent, ts, question, answer as JSON), in update mode.

    A batch with events of a session gives its route so far (``waiting`` where an answer is needed). When the watermark has passed ``gap_minutes`` after a session's last
    event, its final row comes, with ``closed``: the route of ``routed_stream`` over ``gathered_answers``, in whatever order events arrived. A session
    that an event joins to an earlier one is closed as ``merged``. Events later than ``late`` are dropped, from the batch after the one in which the watermark passes them; an answer that is not JSON counts as none; events without a
    respondent, time or question are left out. Needs the RocksDB state store."""
    whole = events.where("respondent is not null and ts is not null and question is not null").select("respondent", "ts", "question", "answer")
    kind = events.schema["respondent"].dataType.simpleString()
    follow = _Follow("respondent", entry, edges, terminals, gap_minutes * 60_000_000)
    return whole.withWatermark("ts", late).groupBy("respondent").transformWithStateInPandas(follow, f"respondent {kind}, {ROUTE}", "Update", "EventTime")
