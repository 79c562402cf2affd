"""The fewest walks that take every edge of a survey.

Edges that no walk can take after one another need a walk each. By Dilworth's theorem as many walks as the largest set of such
edges are enough; a minimum flow finds them. Nodes that can reach each other are one component, which a single walk can tour,
so the flow runs over the components, each edge between two of them carrying at least one walk.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from routegraph.operators.graph import PATH_COLUMNS, Steps, framed, packed_steps
from routegraph.sources.documents import Corpus

Live = dict[str, list[tuple[str, str]]]


class Arc(NamedTuple):
    """An edge that leads from one component to another."""

    home: int
    into: int
    source: str
    target: str
    edge_id: str


def components(entry: str, live: Live) -> dict[str, int]:
    """The component of each node that can be reached. Edges lead to the same or a lower number; the entry has the highest."""
    met: dict[str, int] = {}
    low: dict[str, int] = {}
    home: dict[str, int] = {}
    pending: list[str] = []
    todo: list[tuple[str, Iterator]] = []

    def enter(node: str) -> None:
        met[node] = low[node] = len(met)
        pending.append(node)
        todo.append((node, iter(live.get(node, ()))))

    enter(entry)
    count = 0
    while todo:
        node, steps = todo[-1]
        fresh = None
        for target, _ in steps:
            if target not in met:
                fresh = target
                break
            if target not in home:
                low[node] = min(low[node], met[target])
        if fresh is not None:
            enter(fresh)
            continue
        todo.pop()
        if todo:
            before = todo[-1][0]
            low[before] = min(low[before], low[node])
        if low[node] == met[node]:
            last = None
            while last != node:
                last = pending.pop()
                home[last] = count
            count += 1
    return home


def least_flow(size: int, arcs: list[Arc]) -> list[int]:
    """How many walks take each arc, one at least, so that the fewest leave component ``size - 1``. Walks may end anywhere.

    A flow that is enough comes first: the first arc into a component brings what leaves it beyond its other arcs. It is then lowered along paths on which
    walks that end early take over what other walks were sent for, until there are none."""
    into: list[list[int]] = [[] for _ in range(size)]
    out: list[list[int]] = [[] for _ in range(size)]
    for i, arc in enumerate(arcs):
        out[arc.home].append(i)
        into[arc.into].append(i)
    flow = [1] * len(arcs)
    spare = [0] * size
    for c in range(size - 1):
        left = len(into[c]) - sum(flow[i] for i in out[c])
        flow[into[c][0]] += max(0, -left)
        spare[c] = max(0, left)
    while True:
        came: dict[int, tuple[int, int, int] | None] = {c: None for c in range(size - 1) if spare[c]}
        queue = deque(came)
        while queue and size - 1 not in came:
            c = queue.popleft()
            for i in into[c]:
                if flow[i] > 1 and arcs[i].home not in came:
                    came[arcs[i].home] = (c, i, -1)
                    queue.append(arcs[i].home)
            for i in out[c]:
                if arcs[i].into not in came:
                    came[arcs[i].into] = (c, i, 1)
                    queue.append(arcs[i].into)
        if size - 1 not in came:
            return flow
        moves, at = [], size - 1
        while (step := came[at]) is not None:
            moves.append(step[1:])
            at = step[0]
        less = min([spare[at], *(flow[i] - 1 for i, sign in moves if sign < 0)])
        spare[at] -= less
        for i, sign in moves:
            flow[i] += sign * less


class _Walker:
    """Walks of one survey, taken one after the other until the flow is used up."""

    def __init__(self, steps: Steps) -> None:
        self.entry = steps.entry
        self.live: Live = {n: s for n, s in steps.after.items() if n not in steps.ends}
        self.home = components(self.entry, self.live)
        self.arcs: list[Arc] = []
        self.inner: dict[int, dict[tuple[str, int], tuple[str, str]]] = {}
        for node, home in self.home.items():
            for rank, (target, edge_id) in enumerate(self.live.get(node, ())):
                if self.home[target] == home:
                    self.inner.setdefault(home, {})[node, rank] = (target, edge_id)
                else:
                    self.arcs.append(Arc(home, self.home[target], node, target, edge_id))
        self.left = least_flow(self.home[self.entry] + 1, self.arcs)
        self.leaving: dict[int, deque[int]] = {}
        for i, arc in enumerate(self.arcs):
            self.leaving.setdefault(arc.home, deque()).append(i)

    def _go(self, path: list[str], ids: list[str], goal: str) -> None:
        """On to ``goal`` within the component by the fewest edges."""
        home, came = self.home[goal], {path[-1]: None}
        queue = deque(came)
        while goal not in came:
            node = queue.popleft()
            for rank, (target, edge_id) in enumerate(self.live[node]):
                if self.home[target] == home and target not in came:
                    came[target] = (node, rank, edge_id)
                    queue.append(target)
        back, at = [], goal
        while came[at] is not None:
            node, rank, edge_id = came[at]
            back.append((at, edge_id))
            self.inner.get(home, {}).pop((node, rank), None)
            at = node
        for target, edge_id in reversed(back):
            path.append(target)
            ids.append(edge_id)

    def _tour(self, path: list[str], ids: list[str]) -> None:
        """Every edge within the component that no walk has taken."""
        inner = self.inner.get(self.home[path[-1]], {})
        while inner:
            here = next((k for k in inner if k[0] == path[-1]), None)
            if here is None:
                self._go(path, ids, next(iter(inner))[0])
                continue
            target, edge_id = inner.pop(here)
            path.append(target)
            ids.append(edge_id)

    def walk(self) -> tuple[list[str], list[str]]:
        path, ids = [self.entry], []
        while True:
            self._tour(path, ids)
            leaving = self.leaving.get(self.home[path[-1]])
            if not leaving:
                break
            i = leaving[0]
            arc = self.arcs[i]
            self.left[i] -= 1
            if not self.left[i]:
                leaving.popleft()
            self._go(path, ids, arc.source)
            path.append(arc.target)
            ids.append(arc.edge_id)
        self._finish(path, ids)
        return path, ids

    def _finish(self, path: list[str], ids: list[str]) -> None:
        """By first edges to a node that ends it, or to one met before."""
        met = set(path[:-1])
        while path[-1] not in met and self.live.get(path[-1]):
            met.add(path[-1])
            target, edge_id = self.live[path[-1]][0]
            path.append(target)
            ids.append(edge_id)

    def walks(self) -> Iterator[tuple[list[str], list[str]]]:
        yield self.walk()
        while self.leaving.get(self.home[self.entry]):
            yield self.walk()


def fewest_walks(steps: Steps) -> Iterator[tuple[list[str], list[str]]]:
    """(path, edge ids) of as few walks as can take every edge that a walk from the entry can take."""
    return _Walker(steps).walks()


def minimal_cover(corpus: Corpus) -> DataFrame:
    """(survey_key, path_ix, path, edge_ids): for each survey with an entry, the fewest walks from it that take every edge that can be reached; each
    goes on to a terminal, to a node without edges, or to a node met before. Edges count one by one, also where they share an id. A survey without
    edges has one walk, its entry. Where no cycle can be entered all walks are ``simple_paths``; elsewhere a walk
    may come to a node again, which no fixed answers lead to (``coverage`` takes first-fit paths for what it cannot verify). A survey costs its edges for each walk that is
    saved; surveys are independent of each other."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surveys: Iterator[Any] = (Steps.of(r) for rows in batches for r in rows.itertuples(index=False))
        yield from framed(((s.survey_key, i, *w) for s in surveys for i, w in enumerate(fewest_walks(s))), PATH_COLUMNS)

    rows = packed_steps(corpus)
    return rows.mapInPandas(listed, f"survey_key {rows.schema['survey_key'].dataType.simpleString()}, path_ix int, path array<string>, edge_ids array<string>")
