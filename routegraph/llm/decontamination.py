"""Benchmark decontamination by an FM-index per shard of training documents.

Each task cuts its rows into shards of about ``SHARD_WORDS`` words, indexes a shard, searches all windows
of the benchmark backwards through the index, locates their occurrences and merges them into removal
spans. Documents are never shuffled. The benchmark is a stated query set: its items are cut into pieces of a bounded number
of windows, and these are dealt to blocks. The blocks of a pass are broadcast and searched in the same indexes; a larger benchmark
takes more passes, between which what was found is landed and the blocks of the pass before are forgotten.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: null, empty or wordless texts have no words, no spans and no items; null or wordless
items have no window; an item without an id goes by the empty id; rows of one item id are one item;
repeated documents are judged one by one; an empty benchmark or table leaves nothing contaminated. Columns
of ``docs`` other than ``doc_id`` and ``text`` are ignored by ``find_passages`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, land, positions
from .fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_WORDS = 1 << 19
#: Windows of a piece of an item, pieces of a block, and blocks of a pass: at most 131,072 windows are collected at a time,
#: and 1,048,576 are broadcast (40 bytes and the numbers of their items each, and their distinct words).
PIECE_WINDOWS, BLOCK_PIECES, PASS_BLOCKS = 1024, 128, 8


def item_words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def _cutter(windows: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of items in pieces of at most ``windows`` windows; neighbours share WINDOW - 1 words, so no window is lost."""
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                w = item_words(text)
                rows += [(item, w[i : i + windows + WINDOW - 1]) for i in range(0, max(1, len(w) - WINDOW + 1) if w else 0, windows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["item", "words"])

    return pieces


def query_block(pieces: list[tuple[str, list[str]]], window: int = WINDOW) -> dict:
    """Distinct windows as rows of numbers of distinct words, -2 before a shorter one's first word, and which items hold each: those of
    row r are ``items[holders[starts[r]:starts[r + 1]]]``."""
    words: dict[str, int] = {}
    names = sorted({item for item, _ in pieces})
    number = {x: i for i, x in enumerate(names)}
    rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
    for item, w in pieces:
        code = np.array([words.setdefault(x, len(words)) for x in w], np.int32)
        if len(code):
            code = np.concatenate([np.full(max(0, window - len(code)), -2, np.int32), code])
            rows.append(np.lib.stride_tricks.sliding_window_view(code, window))
            owner.append(np.full(len(rows[-1]), number[item], np.int32))
    distinct, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([at.ravel(), np.concatenate(owner)], 1), axis=0)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return {"words": list(words), "windows": distinct, "lengths": (distinct >= 0).sum(1), "items": names, "starts": starts, "holders": pairs[:, 1].astype(np.int32)}


class Shard:
    """Documents under way: words become numbers as they come, so each distinct word is held once."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.documents: list[np.ndarray] = []
        self.n_words = 0

    def add(self, text: str | None) -> None:
        w, number = item_words(text), self.vocabulary
        self.documents.append(np.fromiter([number.setdefault(x, len(number)) for x in w], np.int32, len(w)))
        self.n_words += len(w)

    def search(self, blocks: list[dict]) -> list[tuple[np.ndarray, set[str]]]:
        """For each document: a flag for each word, whether it lies in an occurrence, and the items found."""
        hits = [(np.zeros(len(d), bool), set()) for d in self.documents]
        full = [i for i, d in enumerate(self.documents) if len(d)]
        if not full or not any(len(b["windows"]) for b in blocks):
            return hits
        index = FMIndex([self.documents[i] for i in full], len(self.vocabulary))
        edge = np.zeros(index.n + 1, np.int64)
        touched: set[int] = set()
        for block in blocks:
            to_shard = np.array([self.vocabulary.get(x, -1) for x in block["words"]] + [-2], np.int64)  # -2 in a window picks the last
            low, high = index.ranges(to_shard[np.where(block["windows"] < 0, len(to_shard) - 1, block["windows"])])
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            count = (high - low)[found]
            rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            window = np.repeat(found, count)
            position = index.locate(rows)
            np.add.at(edge, position, 1)
            np.add.at(edge, position + block["lengths"][window], -1)
            doc = np.searchsorted(index.starts, position, "right") - 1
            for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                hits[full[d]][1].update(block["items"][h] for h in block["holders"][block["starts"][w] : block["starts"][w + 1]])
            touched.update(doc.tolist())
        flagged = np.cumsum(edge) > 0
        for d in touched:
            start = index.starts[d]
            hits[full[d]][0][:] = flagged[start : start + len(hits[full[d]][0])]
        return hits


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def passages(sent: list[Broadcast], text: str | Column, earlier: str | Column) -> Column:
    """struct<n_words, spans, items> of a text column: what the blocks find, and what ``earlier`` passes did. Only
    texts go to Python, and results come back when their shard is full."""

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shard, before = Shard(), []
        blocks = [x.value for x in sent]

        def results() -> pa.Array:
            out = []
            for d, (flags, items), old in zip(shard.documents, shard.search(blocks), before, strict=True):
                if old is not None:
                    for s in old["spans"]:
                        flags[s["start"] : s["end"]] = True
                    items = items.union(old["items"])
                out.append({"n_words": len(d), "spans": _spans(flags), "items": sorted(items)})
            return pa.array(out, FOUND_ARROW)

        for texts, olds in batches:
            for text, old in zip(texts, olds, strict=True):
                shard.add(text.as_py())
                before.append(old.as_py())
                if shard.n_words >= SHARD_WORDS:
                    yield results()
                    shard, before = Shard(), []
        yield results()

    return find(text, earlier)


def blocks_of(benchmark: DataFrame) -> Iterator[dict]:
    """The benchmark as query blocks of at most BLOCK_PIECES pieces, one in the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("phrase")).where("phrase is not null")
    pieces = land(positions(items.mapInArrow(_cutter(PIECE_WINDOWS), "item string, words array<string>"), F.col("item"), F.col("words")), "benchmark-pieces")
    for b in range(max(1, -(-pieces.count() // BLOCK_PIECES))):
        part = pieces.where(F.floor(F.col("position") / BLOCK_PIECES) == b)
        yield query_block([(r["item"], r["words"]) for r in part.select("item", "words").collect()])


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``found``: n_words, the ``spans`` of word positions to remove, and the sorted ids of ``items``. A column of
    that name is replaced."""
    sc = docs.sparkSession.sparkContext
    rows, earlier, sent = docs, F.lit(None).cast(FOUND), []
    for block in blocks_of(benchmark):
        if len(sent) == PASS_BLOCKS:
            rows = land(rows.withColumn("found", passages(sent, "text", earlier)), "found")
            for x in sent:
                x.destroy()
            earlier, sent = F.col("found"), []
        sent.append(sc.broadcast(block))
    return rows.withColumn("found", passages(sent, "text", earlier))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, in all its columns, without the rows in which any passage occurs."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return find_passages(packed, benchmark).where(F.size("found.spans") == 0).select("row.*")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*out, text[end:]])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_passages(docs.select("doc_id", "text"), benchmark).select("doc_id", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), query AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM low, (SELECT DISTINCT m FROM query) WHERE len(w) >= m)
), hit AS (
  SELECT r, i, p.m, item FROM place p JOIN query q ON p.m = q.m AND p.phrase = q.phrase
), word AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, m - 1)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""
