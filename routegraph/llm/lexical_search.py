"""Ranked lexical search: Fagin's threshold algorithm over shards of the documents.

``forward_index`` reads every whole text once and keeps, for each document, its number of terms and how often each query term occurs.
Corpus statistics (documents, terms, document frequencies) are aggregates over that landed table. ``search`` then lets each task walk its
rows in shards of bounded size: a shard has an impact-sorted list for every query term and the forward rows for random access. For
each query the lists are read in turn from the top, every document met is looked up and scored in full at once, and reading stops
when the threshold, the best score that an unmet document could still have, falls strictly below the k-th score so far; equal
scores are thus all met. A task carries its k best of each query from shard to shard, and the best of all tasks are ranked together, so
nothing but k rows for each query and task is ever shuffled.

The queries are broadcast in blocks of about BLOCK_TERMS (query, term) pairs; each block is a pass of its own over the documents.

Defined results: null and empty texts have no terms: such documents are never found and count in no statistic, such queries give no rows.
Equal rows of the query table count once; different texts of one id are one query, their terms added up. A null query id is an id.
Every document row is ranked by itself, repeated ones too; equal scores go by ascending doc_id, null ids last. Empty tables give an
empty result. Only ``doc_id`` and ``text`` (of queries: ``item_id`` and ``text``) are read, so extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import ascii_lower, land

#: A term is a run of ASCII letters, digits and characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: (query, term) pairs of a block at about most: some 20 MB where it is broadcast.
BLOCK_TERMS = 500_000
#: Postings after which a task closes a shard: about 40 bytes each.
SHARD_POSTINGS = 1_000_000
#: Rounds of sorted access between two looks at the threshold: they double from the first to the second.
FIRST_ROUNDS, MOST_ROUNDS = 4, 256

INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(ascii_lower(text)) if text else []


def query_terms(queries: DataFrame) -> DataFrame:
    """Each query's terms and their numbers, with the ``block`` that a query belongs to."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = Counter(terms_of(batch.column("text")[i].as_py()))
                ids = pa.nulls(len(counts), batch.column("item_id").type) if not batch.column("item_id")[i].is_valid else pa.array([batch.column("item_id")[i].as_py()] * len(counts), batch.column("item_id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["item_id", "term", "count"])

    kind = queries.schema["item_id"].dataType.simpleString()
    counted = queries.select("item_id", "text").where("text is not null").distinct().mapInArrow(cut, f"item_id {kind}, term string, count long")
    pairs = land(counted.groupBy("item_id", "term").agg(F.sum("count").alias("count")), "query-terms")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    return pairs.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(blocks)))


class Queries:
    """One block: a number for each query and each term, and the terms of each query with their numbers."""

    def __init__(self, rows: list[tuple[object, str, int]]):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        number = {x: i for i, x in enumerate(self.ids)}
        self.vocabulary = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        of = np.array([number[r[0]] for r in rows], np.int64)
        self.starts = np.searchsorted(of, np.arange(len(self.ids) + 1))
        self.terms = np.array([self.vocabulary[r[1]] for r in rows], np.int64)
        self.counts = np.array([r[2] for r in rows], np.int64)


def forward_index(docs: DataFrame, queries: Queries) -> DataFrame:
    """For each document with a term: its number of terms, and the query terms in it with their numbers; landed."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                known = Counter(map(number, found))
                known.pop(None, 0)
                ids.append(doc_id)
                sizes.append(len(found))
                terms.append(list(known))
                tfs.append(list(known.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return land(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX), "forward-index")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_weights(index: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each query term, the documents with a term, and all their terms: over the whole index."""
    n_docs, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a query term at most
        df[term] = count
    return np.array([term_weight(n_docs, int(x)) for x in df], np.int64), int(n_docs), int(length)


class Shard:
    """Forward rows and impact-sorted lists of some documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, length: int):
        self.ids, self.no_id = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        # 75 * n * N passes 64 bits for no text and corpus that fit on a disk together
        m = 25 + (75 * n * n_docs) // max(length, 1)
        doc = np.repeat(np.arange(len(n)), lengths)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        some = impact > 0
        doc, self.term, self.impact = doc[some], terms[some], impact[some]
        self.rows = np.searchsorted(doc, np.arange(len(n) + 1))
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(self.term[order], np.arange(len(weights) + 1))
        self.met = np.zeros(len(n), bool)

    def full_scores(self, docs: np.ndarray, per_term: np.ndarray) -> np.ndarray:
        """Random access: the whole score of each document, which has a posting at least, from its forward row."""
        begin, size = self.rows[docs], self.rows[docs + 1] - self.rows[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        return np.add.reduceat(per_term[self.term[at]] * self.impact[at], ends - size)

    def top(self, terms: np.ndarray, counts: np.ndarray, per_term: np.ndarray, best: tuple, k: int) -> tuple[tuple, int]:
        """The threshold algorithm for one query: ``best`` (scores, no_id, ids; best first) with what this shard adds, and the number of
        documents looked up. ``per_term`` has the counts of the query's terms at their places."""
        begin, end = self.lists[terms], self.lists[terms + 1]
        begin, end, counts = (x[end > begin] for x in (begin, end, counts))
        depth, rounds, looked_up, touched = 0, FIRST_ROUNDS, 0, []
        while len(begin):
            places = begin[:, None] + np.arange(depth, depth + rounds)
            met = self.list_doc[places[places < end[:, None]]]
            met = np.unique(met[~self.met[met]])
            depth, rounds = depth + rounds, min(2 * rounds, MOST_ROUNDS)
            if len(met):
                self.met[met] = True
                touched.append(met)
                looked_up += len(met)
                scores = self.full_scores(met, per_term)
                hopeful = scores >= best[0][-1] if len(best[0]) == k else scores > 0
                both = [np.concatenate([a, b]) for a, b in zip(best, (scores[hopeful], self.no_id[met[hopeful]], self.ids[met[hopeful]]), strict=True)]
                order = np.lexsort((both[2], both[1], -both[0]))[:k]
                best = tuple(x[order] for x in both)
            # what a document in none of the places read could still have from each list
            left = begin + depth < end
            threshold = int((counts[left] * self.list_impact[begin[left] + depth - 1]).sum())
            if threshold == 0 or len(best[0]) == k and threshold < best[0][-1]:
                break
        for x in touched:
            self.met[x] = False
        return best, looked_up


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, length: int) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []

    def shard() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
        terms, tfs = column("terms"), column("tfs")
        lengths = np.diff(terms.offsets.to_numpy())
        return Shard(column("doc_id"), column("n").to_numpy(), lengths, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), weights, n_docs, length)

    postings = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
        if postings >= SHARD_POSTINGS:
            yield shard()
            held, postings = [], 0
    if held:
        yield shard()


def _search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    index = forward_index(docs, queries)
    weights, n_docs, length = term_weights(index, len(queries.vocabulary))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((queries.starts, queries.terms, queries.counts, weights))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, counts, weights = sent.value
        per_term = np.zeros(len(weights), np.int64)
        nothing = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best, looked_up = {}, 0
        for shard in _shards(batches, weights, n_docs, length):
            for q in range(len(starts) - 1):
                mine = slice(starts[q], starts[q + 1])
                per_term[terms[mine]] = counts[mine]
                best[q], n = shard.top(terms[mine], counts[mine], per_term, best.get(q, nothing), k)
                looked_up += n
                per_term[terms[mine]] = 0
        for q, (scores, no_id, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    found = index.mapInArrow(walk, "query int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query by ``score``, with their ``rank`` from 1; fewer where fewer have a score above 0."""
    pairs, spark = query_terms(queries), docs.sparkSession
    kind = queries.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    for (block,) in sorted(pairs.select("block").distinct().collect()):
        rows = pairs.where(F.col("block") == block).select("item_id", "term", "count").collect()  # about BLOCK_TERMS
        queries_ = Queries([tuple(r) for r in rows])
        names = spark.createDataFrame(list(enumerate(queries_.ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)]))
        ranked = land(_search_block(docs, queries_, k), "ranked")
        out = out.unionByName(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM doc WHERE len(w) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized
), item AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term
), posting AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM item) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total
), impact AS (
  SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS impact
  FROM posting p JOIN sized USING (r) JOIN weight w USING (term), total
), scored AS (
  SELECT item_id, r, CAST(sum(times * impact) AS BIGINT) AS score FROM item JOIN impact USING (term) GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
