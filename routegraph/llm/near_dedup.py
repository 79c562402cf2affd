"""MinHash near-deduplication: many universal hash minima, banding, verification, connected components.

1. ``sketch`` reads every whole text once: a key of its word sequence, the size of its shingle set,
   40 band values of 5 minima each, and one byte of each of the 200 minima.
2. Texts with the same word sequence form a class; only its smallest id goes on, so copies are never paired.
3. Classes that share a band value are candidates. They are compared with the most central document of
   their bucket, then, where that left them in different components, with a centre drawn by hash, and
   last, in bounded blocks, whatever two components still share a bucket. There, pairs are ruled out by what
   their sets can share at most, from profiles of bin counts. So no bucket is capped and none is
   expanded into all its pairs.
4. A candidate pair is a link only if its full shingle sets say so. Sets hold 64-bit values of shingles; two documents of
   a million shingles each have different shingles of one value with probability below 1e-7.
5. Large-star and small-star rounds give the components.

A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40 < 2e-7; the byte test of
step 3 asks for 124 equal bytes of 200, which such a pair misses with probability below 1e-9. A pair that shares several buckets is compared in the first of them.

Defined results: null, empty or blank texts have an empty set and are linked with nothing; texts
shorter than a shingle are one shingle of all their words; repeated rows of a document come back as
often as they went in (``without_near_duplicates`` keeps one of them); rows that share an id are judged each by its own text; a row
with a null id is kept and has a null component; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read. Similarities below 80 percent are refused, as the bands are made for that and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, land, numbered_copies, salted_join
from .components import connected_components

BANDS, ROWS = 40, 5
MIN_EQUAL_BYTES = 124
BLOCK, WIDE_BLOCK = 256, 4096
#: Ids of candidate documents are broadcast only up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> tuple[list[list[str]], list[np.ndarray]]:
    """Words of each text, and the sorted distinct 64-bit values of its shingles."""
    words = [WORD.findall(ascii_lower(x)) if x else [] for x in texts]
    ids: dict[str, int] = {}
    codes = [np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w)) for w in words]
    value = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in ids), np.uint64, len(ids))
    sets = []
    for c in codes:
        v = value[c]
        k = min(width, len(v))
        if not k:
            sets.append(np.zeros(0, np.uint64))
            continue
        n = len(v) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * ODD + v[i : i + n]
        sets.append(np.unique(_mix(h)))
    return words, sets


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, values: int = 1 << 14) -> np.ndarray:
    """Minima of each hash function over each set; about ``values`` values at a time stay in the processor's cache."""
    out = np.empty((len(a), len(sets)), np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    start = 0
    while start < len(sets):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + values, "right")))
        x = np.concatenate(sets[start:end])
        at = np.concatenate([[0], ends[start : end - 1] - (ends[start - 1] if start else 0)])
        h = np.empty_like(x)
        for j in range(len(a)):
            np.multiply(x, a[j], out=h)
            np.add(h, b[j], out=h)
            out[j, start:end] = np.minimum.reduceat(h, at)
        start = end
    return out


def _sketcher(width: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_family(BANDS * ROWS)
        power = ODD ** np.arange(ROWS, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                part = batch.slice(start, 400)
                words, sets = shingle_sets(part.column("text").to_pylist(), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                bands = np.zeros((len(sets), BANDS), np.int64)
                low = np.zeros((len(sets), BANDS * ROWS), np.uint8)
                if len(full):
                    minima = _minima([sets[i] for i in full], a, b)
                    grouped = _mix(minima.reshape(BANDS, ROWS, len(full)))
                    value = _mix((grouped * power[None, :, None]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * ODD)
                    bands[full] = value.T.astype(np.int64)
                    low[full] = (_mix(minima) & np.uint64(255)).astype(np.uint8).T
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(sizes),
                        pa.array([xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]), pa.int32()), pa.array(bands[full].ravel())),
                        pa.array([low[i].tobytes() for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "sequence", "bands", "bytes"],
                )

    return sketches


def sketch(docs: DataFrame, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_sketcher(width), "doc_id long, text_hash long, n_shingles long, sequence binary, bands array<long>, bytes binary")


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                part = batch.slice(start, 400)
                _, found = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return sets


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), a landed table, whose full shingle sets are similar enough. Texts are read again for
    the candidates alone, so the sets of the corpus are never stored. The centre of a large bucket is an end of many pairs, so
    both joins are salted."""
    wanted = land(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    sets = _chosen(docs, wanted).mapInArrow(_setter(width), "doc_id long, shingles array<long>")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = salted_join(salted_join(pairs, right, "b", "a"), left, "a", "b", counted=pairs)
    return joined.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 2 to 4 times as many bins, 4 bits a bin. The sum of the smaller
    counts of two profiles bounds what their sets share from above, and nearly meets it."""
    bins = 1 << max(5, (2 * len(shingles) - 1).bit_length())
    counts = np.minimum(np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 15).astype(np.uint8)
    return (counts[::2] | (counts[1::2] << 4)).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    half = np.frombuffer(packed, np.uint8)
    return np.stack([half & 15, half >> 4], 1).ravel()


def most_shared(profiles: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair (x[i], y[i]) of profiles, the most shingles that the two can share."""
    bins = np.array([2 * len(p) for p in profiles])
    out = np.zeros(len(x), np.int64)
    level = np.minimum(bins[x], bins[y])
    for m in np.unique(level):
        mine = np.flatnonzero(level == m)
        need, at = np.unique(np.concatenate([x[mine], y[mine]]), return_inverse=True)
        table = np.stack([_unpacked(profiles[d]).reshape(-1, m).sum(0, dtype=np.uint8) for d in need])
        one, other = at[: len(mine)], at[len(mine) :]
        step = max(1, (1 << 22) // int(m))
        for i in range(0, len(mine), step):
            out[mine[i : i + step]] = np.minimum(table[one[i : i + step]], table[other[i : i + step]]).sum(1, dtype=np.int64)
    return out


def _close(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], band: int) -> np.ndarray:
    """Of pairs given as their (bytes, bands): whether enough bytes are equal, and ``band`` is the first band of equal value, that is, the
    first bucket that both are in: a pair that shares several buckets is compared in one. Bytes alone could take a band for equal that is not."""
    return ((one[0] == other[0]).sum(1) >= MIN_EQUAL_BYTES) & ((one[1] == other[1]).argmax(1) == band)


def _compare(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Within one bounded block: pairs of different components that can still be links. With c the most that
    two sets can share, their similarity is c / (x + y - c) at most."""
    inner = block.column("inner").to_numpy()
    doc, comp, size = (block.column(k).to_numpy() for k in ("doc_id", "component", "n_shingles"))
    one, other = np.flatnonzero(inner), np.flatnonzero(~inner)
    a, b = size[one][:, None], size[other][None, :]
    x, y = np.nonzero((100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (comp[one][:, None] != comp[other][None, :]))
    x, y = one[x], other[y]
    if len(x):
        sig = np.frombuffer(b"".join(block.column("bytes").to_pylist()), np.uint8).reshape(block.num_rows, -1)
        bands = np.concatenate([c.flatten().to_numpy() for c in block.column("bands").chunks]).reshape(block.num_rows, BANDS)
        band = block.column("band_ix")[0].as_py()
        part = lambda rows, at: (sig[rows[at : at + 20_000]], bands[rows[at : at + 20_000]])
        close = np.concatenate([_close(part(x, at), part(y, at), band) for at in range(0, len(x), 20_000)])
        x, y = x[close], y[close]
    if len(x):
        most = most_shared(block.column("profile").to_pylist(), x, y)
        may = 100 * most >= percent * (size[x] + size[y] - most)
        x, y = x[may], y[may]
    return doc[x], doc[y]


def _block_comparer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block is held until the next begins."""
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            a, b = _compare(pa.Table.from_batches(held), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("band", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[start]) != key:
                    yield flush()
                    held = []
                key = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield flush()

    return run


def _profiler(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                part = batch.slice(start, 400)
                _, found = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([profile(x) for x in found], pa.binary())], ["doc_id", "profile"])

    return run


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents of ``ids`` (a landed table): by a broadcast of their ids up to BROADCAST_IDS of them."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return _judged(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    if percent < 80:
        raise ValueError("bands are made for similarities of 80 percent and more")
    sketches = land(sketch(docs, width), "sketches")
    classes = land(sketches.where("sequence is not null and doc_id is not null").groupBy("sequence").agg(F.min("doc_id").alias("class_id")), "classes")
    # one row for each class and id: the row of the class's smallest id
    first = sketches.join(classes, (sketches.sequence == classes.sequence) & (sketches.doc_id == classes.class_id), "left_semi")
    buckets = first.select("doc_id", F.posexplode("bands").alias("band_ix", "band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = land(buckets.join(shared, "band").select("band", "band_ix", "doc_id", "n"), "bucket-members")

    def linked(found: DataFrame, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        links = verified(land(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs"), docs, width, percent)
        links = land(links if earlier is None else links.unionByName(earlier), "verified")
        return links, land(connected_components(links, "a", "b"), "components")

    def placed(rows: DataFrame, column: str, comps: DataFrame, name: str) -> DataFrame:
        here = comps.select(F.col("node").alias(column), F.col("component").alias(name))
        return rows.join(here, column, "left").withColumn(name, F.coalesce(name, column))

    # with the most central document of each bucket: the one that shares the most places with others
    central = members.groupBy("doc_id").agg(F.sum("n").alias("central"))
    centres = members.join(central, "doc_id").groupBy("band").agg(F.max_by("doc_id", F.struct("central", -F.col("doc_id"))).alias("centre"))
    links, comps = linked(members.join(centres, "band").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")), None)

    # with a centre drawn by hash, where components still differ
    drawn = members.groupBy("band").agg(F.min_by("doc_id", F.xxhash64("band", "doc_id")).alias("drawn"))
    again = placed(placed(members.join(drawn, "band"), "doc_id", comps, "here"), "drawn", comps, "there").where("here <> there")
    links, comps = linked(again.select(F.col("drawn").alias("a"), F.col("doc_id").alias("b")), links)

    # whatever components still share a bucket, in blocks
    here = land(placed(members, "doc_id", comps, "component"), "placed")
    counts = here.groupBy("band", "component").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("band").agg(F.max_by("component", "k").alias("main"), F.sum("k").alias("n_all"), (F.sum("k") - F.max("k")).alias("n_inner")).where("n_inner > 0")
    mixed = mixed.withColumns({"inner_blocks": F.ceil(F.col("n_inner") / BLOCK).cast("int"), "all_blocks": F.ceil(F.col("n_all") / WIDE_BLOCK).cast("int")})
    open_ = land(here.select("band", "band_ix", "doc_id", "component").join(mixed, "band"), "open-buckets")
    ids = land(open_.select("doc_id").distinct(), "open-ids")
    profiles = _chosen(docs, ids).mapInArrow(_profiler(width), "doc_id long, profile binary")
    facts = land(first.select("doc_id", "bytes", "bands", "n_shingles").join(profiles, "doc_id").dropDuplicates(["doc_id"]), "open-facts")
    rows = open_.join(facts, "doc_id")
    pick = lambda inner, i, j: (F.col("band"), F.col("band_ix"), i.cast("int").alias("i"), j.cast("int").alias("j"), "doc_id", "component", "n_shingles", "bytes", "bands", "profile", F.lit(inner).alias("inner"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = rows.where("component <> main").withColumn("j", every("all_blocks")).select(*pick(True, F.pmod(F.hash("doc_id"), "inner_blocks"), F.col("j")))
    outer = rows.withColumn("i", every("inner_blocks")).select(*pick(False, F.col("i"), F.pmod(F.hash("doc_id", F.lit(1)), "all_blocks")))
    blocks = inner.unionByName(outer).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    links, comps = linked(blocks.mapInArrow(_block_comparer(percent), "a long, b long"), links)

    named = sketches.select("doc_id", "text_hash", "n_shingles", "sequence").join(classes, "sequence", "left")
    return named.join(comps, named.class_id == comps.node, "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "class_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, in all its columns, without the rows whose document is not the first of its group, and without the repeats of a row
    with the same id and text. Rows without an id stay."""
    judged = land(_judged(docs, width, percent), "near-duplicates")
    key = ["doc_id", "text_hash"]
    gone = land(judged.where("not kept").select(*key).distinct(), "gone")
    repeated = land(judged.where("kept and doc_id is not null").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = rows.join(few(gone), key, "left_anti")
    if repeated.isEmpty():
        return rows.select("row.*")
    again = rows.join(few(repeated), key, "left_semi").select("row", F.xxhash64(*key).alias("key"), F.spark_partition_id().alias("part"))
    once = numbered_copies(land(again, "repeats"), "key").where("copy = 0").select("row.*")
    return rows.join(few(repeated), key, "left_anti").select("row.*").unionByName(once)
