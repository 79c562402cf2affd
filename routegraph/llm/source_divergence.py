"""Source divergence audit: how far the sources of a language differ in their words, and which words set a source apart.

Terms are counted per (lang, source) in every whole text. A language keeps the terms that at least three of its documents hold; a kept
term's share in a source is p = 1 + floor(10^9 * (count + 1) / (N + V)), and two shares differ by f(p, q) = floor((p - q)^2 / q).

Most terms of a language are rare, and their counts over its sources are one of few sparse vectors. ``count_vectors`` gathers each kept
term's vector, ``distinct_vectors`` keeps each vector once with the number of terms that have it, and ``pair_values`` evaluates every
pair of sources once for each distinct vector, times that number. Sources are dealt into blocks of about BLOCK; a vector visits the
tiles (block, block) in which it has a count, and the terms that a tile has not seen have the same two shares, which a formula adds. So
memory is bounded by tiles, and the rows by distinct vectors. ``term_values`` ranks the original terms.

All arithmetic is exact: shares by long division in 64 bits, sums in two halves and as decimals.

Defined results: a null text, lang or source counts as ''. Every (lang, source) that occurs has pair rows, even without terms; a language
with one source has none; without kept terms every value is 0. Repeated rows count as often as they occur. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, land

#: A term is a run of ASCII letters and characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 3
#: Counted terms that a task holds before it hands them on, about 150 bytes each.
HELD_TERMS = 1_000_000
#: Sources of a block on average at most, tiles that a task sums at a time (two matrices of 8 bytes a pair each), and pairs in one step.
BLOCK, HELD_TILES, STEP = 64, 200, 1_000_000
COUNTS = "lang string, source string, term string, count long, docs long"
PAIRS = "lang string, source string, item string, high long, low long, seen long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with its occurrences and the documents that hold it; summed in each task before the shuffle."""
    one_doc = 1 << 40  # occurrences below, documents above

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                n = np.fromiter(counts.values(), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), pa.array(counts.keys(), pa.string()), pa.array(n & (one_doc - 1)), pa.array(n >> 40)], ["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                counts = held.setdefault((lang.as_py(), source.as_py()), {})
                before = len(counts)
                known = counts.get
                for term, n in Counter(TERM.findall(ascii_lower(text.as_py()))).items():
                    counts[term] = known(term, 0) + n + one_doc
                size += len(counts) - before
                if size >= HELD_TERMS:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    # summed in Python already: dealt out at once, as another sum before the shuffle would find few equal keys
    dealt = docs.mapInArrow(count, COUNTS).repartition("lang", "source", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def count_vectors(docs: DataFrame) -> DataFrame:
    """Each kept term of a language with its sparse vector of counts, sorted by source."""
    vector = F.sort_array(F.collect_list(F.struct("source", "count")))
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector.alias("vector")).where(F.col("docs") >= LEAST_DOCS)
    return kept.select("lang", "term", "vector")


def distinct_vectors(terms: DataFrame) -> DataFrame:
    """Each vector of a language once, with the number of terms that have it."""
    return terms.groupBy("lang", "vector").agg(F.count("*").alias("terms"))


def group_totals(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs: ``n``, its occurrences of kept terms; ``v``, the kept terms of the language; ``n_lang``; the
    number of source ``blocks`` of the language, and the ``block`` of this source."""
    counts = vectors.select("lang", "terms", F.explode("vector").alias("_x")).groupBy("lang", F.col("_x.source").alias("source")).agg(F.sum(F.col("_x.count") * F.col("terms")).alias("n"))
    kept = vectors.groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = docs.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "v"])
    whole = W.partitionBy("lang")
    blocks = F.ceil(F.count("*").over(whole) / BLOCK).cast("int")
    return groups.withColumns({"n_lang": F.sum("n").over(whole), "blocks": blocks}).withColumn("block", _block("source", "blocks"))


def _block(source: Column | str, blocks: Column | str) -> Column:
    return F.pmod(F.xxhash64(source), F.col(blocks) if isinstance(blocks, str) else blocks).cast("int")


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / (n + v)) by long division, three digits at a time: exact up to n + v of 9 * 10^15."""
    by = np.maximum(n + v, 1)
    out, rest = np.divmod(counts + 1, by)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digits
    return out + 1


class Tile:
    """Two blocks of sources of one language, and the sums over the vectors met so far: f of every pair in two halves, and the terms."""

    def __init__(self, left: list[dict], right: list[dict], v: int):
        self.v, self.seen, self.sides = v, 0, []
        for side in (left, right):
            self.sides.append(({x["source"]: i for i, x in enumerate(side)}, np.array([x["n"] for x in side], np.int64)))
        shape = (len(left), len(right))
        self.high, self.low = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def add(self, row: np.ndarray, sources: list[str], code: np.ndarray, count: np.ndarray, times: np.ndarray) -> None:
        """Vectors as entries: the vector an entry belongs to, its source (a code into ``sources``) and count; ``times`` a vector."""
        p = []
        for place, n in self.sides:
            slot = np.array([place.get(s, -1) for s in sources], np.int64)[code]
            dense = np.zeros((len(times), len(n)), np.int64)
            dense[row[slot >= 0], slot[slot >= 0]] = count[slot >= 0]
            p.append(shares(dense, n, self.v))
        step = max(1, STEP // max(self.high.size, 1))
        for at in range(0, len(times), step):
            a, b, t = p[0][at : at + step, :, None], p[1][at : at + step, None, :], times[at : at + step, None, None]
            f = (a - b) ** 2 // b
            self.high += ((f >> 30) * t).sum(0)
            self.low += ((f & ((1 << 30) - 1)) * t).sum(0)
        self.seen += int(times.sum())

    def rows(self, lang: str) -> pa.RecordBatch:
        a, b = (list(place) for place, _ in self.sides)
        at = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] != b[j]]
        i, j = (np.array(x, np.int64) for x in (zip(*at, strict=True) if at else ([], [])))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array([a[x] for x in i], pa.string()), pa.array([b[x] for x in j], pa.string()), pa.array(self.high[i, j]), pa.array(self.low[i, j]), pa.array(np.full(len(at), self.seen, np.int64))],
            ["lang", "source", "item", "high", "low", "seen"],
        )


def _sum_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict[tuple, Tile] = {}
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "left", "right")), strict=True))
        rows_of: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            rows_of.setdefault(key, []).append(i)
        for key, mine in rows_of.items():
            if key not in tiles:
                if len(tiles) == HELD_TILES:
                    for (lang, *_), tile in tiles.items():
                        yield tile.rows(lang)
                    tiles = {}
                x = mine[0]
                tiles[key] = Tile(batch.column("left_sources")[x].as_py(), batch.column("right_sources")[x].as_py(), batch.column("v")[x].as_py())
            part = batch.take(pa.array(mine))
            vector = part.column("vector")
            entries = vector.flatten()
            coded = entries.field("source").dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), np.diff(vector.offsets.to_numpy()))
            tiles[key].add(row, coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), entries.field("count").to_numpy(), part.column("terms").to_numpy())
    for (lang, *_), tile in tiles.items():
        yield tile.rows(lang)


def pair_values(vectors: DataFrame, totals: DataFrame) -> DataFrame:
    """f of every ordered pair of sources of a language, over all its kept terms."""
    blocks = land(totals.groupBy("lang", "block", "v", "blocks").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")), "source-blocks")
    left = blocks.select("lang", "v", F.col("block").alias("left"), F.col("sources").alias("left_sources"))
    right = blocks.select("lang", F.col("block").alias("right"), F.col("sources").alias("right_sources"))
    touched = F.array_distinct(F.transform("vector", lambda x: _block(x["source"], "blocks")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.array_distinct(F.flatten(F.transform(every, lambda j: F.concat(F.transform("_touched", lambda i: F.struct(i.alias("left"), j.alias("right"))), F.transform("_touched", lambda i: F.struct(j.alias("left"), i.alias("right")))))))
    dealt = (
        vectors.join(totals.select("lang", "blocks").distinct(), "lang")
        .withColumn("_touched", touched)
        .select("lang", "vector", "terms", F.explode(tiles).alias("_tile"))
        .select("lang", "_tile.left", "_tile.right", "vector", "terms")
    )
    # every tile once without a vector, so that languages and blocks without kept terms have their rows too
    bare = left.select("lang", "left").join(right.select("lang", "right"), "lang").select("lang", "left", "right", F.array().cast(vectors.schema["vector"].dataType).alias("vector"), F.lit(0).cast("long").alias("terms"))
    met = dealt.unionByName(bare).join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "left", "right", "vector", "terms", "v", "left_sources", "right_sources")
    whole = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "seen")}
    sums = met.mapInArrow(_sum_tiles, PAIRS).groupBy("lang", "source", "item").agg(*whole.values())
    own = totals.select("lang", "source", "v", _share(F.lit(0), "n", "v").alias("p"))
    other = totals.select("lang", F.col("source").alias("item"), _share(F.lit(0), "n", "v").alias("q"))
    rest = (F.col("v").cast("decimal(38,0)") - F.col("seen")) * F.expr("((p - q) * (p - q)) div q")
    value = (F.col("high") * (1 << 30) + F.col("low") + rest).cast("long")
    return sums.join(own, ["lang", "source"]).join(other, ["lang", "item"]).select("lang", "source", "item", value.alias("value"))


def _share(count: Column, n: str, v: str) -> Column:
    """``shares`` as a column: three digits at a time, in 64 bits."""
    by, rest = F.greatest(F.col(n) + F.col(v), F.lit(1)), (count + 1).cast("long")
    out = F.call_function("div", rest, by)
    for _ in range(3):
        rest = (rest % by) * 1000
        out = out * 1000 + F.call_function("div", rest, by)
    return out + 1


def term_values(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """f of every kept term of a source that has a larger share there than in the language."""
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda n, x: n + x["count"])
    each = terms.select("lang", F.col("term").alias("item"), whole.alias("_all"), F.explode("vector").alias("_x")).select("lang", F.col("_x.source").alias("source"), "item", F.col("_x.count").alias("count"), "_all")
    known = each.join(totals.select("lang", "source", "n", "v", "n_lang"), ["lang", "source"])
    both = known.select("lang", "source", "item", _share(F.col("count"), "n", "v").alias("p"), _share(F.col("_all"), "n_lang", "v").alias("q"))
    return both.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, top_terms: int = 200) -> DataFrame:
    """Part ``pair``: every other source of the language, most different first; part ``term``: the terms that set a source apart."""
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = land(count_vectors(said), "count-vectors")
    vectors = land(distinct_vectors(terms), "distinct-vectors")
    totals = land(group_totals(said, vectors), "group-totals")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(vectors, totals).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    ranked = term_values(terms, totals).withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), occurrence AS (
  SELECT r, lang, source, unnest(w) AS term FROM doc
), kept AS (
  SELECT lang, term, count(*) AS lang_count FROM occurrence GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), size AS (
  SELECT lang, count(*) AS v, sum(lang_count) AS n_lang FROM kept GROUP BY lang
), counted AS (
  SELECT o.lang, o.source, o.term, count(*) AS c FROM occurrence o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term
), total AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source) s ON g.lang = s.lang AND g.source = s.source
), share AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // CAST(n + v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (lang_count + 1)) // CAST(n_lang + v AS HUGEINT) AS q
  FROM total t JOIN kept k ON t.lang = k.lang JOIN size z ON t.lang = z.lang LEFT JOIN counted d ON d.lang = t.lang AND d.source = t.source AND d.term = k.term
), pair AS (
  SELECT t.lang, t.source, u.source AS item, coalesce(value, 0) AS value
  FROM total t JOIN total u ON t.lang = u.lang AND t.source <> u.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
    ON s.lang = t.lang AND s.source = t.source AND s.item = u.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) FROM share WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
