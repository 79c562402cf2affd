"""Token-id output as a content-addressed store.

``write_store`` encodes whole texts, appends the end id, cuts each id stream into chunks where a rolling
hash of the last ids says so, and writes

* ``chunks/``: every distinct chunk once: its SHA-256 address, number of ids and packed ids. Tasks write chunks where they
  make them; only addresses are shuffled, to choose the copy that stays;
* ``recipes/``: for each document, in ascending order of id, its number in that order, where it starts, its number of ids, the
  addresses of its chunks and the hash of their list;
* ``manifest/``: the nodes of a Merkle tree of FAN branches over the recipes in that order. A leaf covers all of its recipe
  (number, doc_id, start, n_tokens, hash), a node its children in order and what they hold; the last level is one root.

``read_store`` reads the files back, checks every chunk against its address, every recipe against its hash, that each
document starts where the one before ended, and the whole tree against the manifest, and joins chunk facts to documents. CRC-32
values of chunks combine to the CRC-32 of the document, so chunk payloads never move. ``read_ids`` gives the ids themselves.

Ids are packed as little-endian unsigned integers of the least width that holds the vocabulary (2 bytes here).

Defined results: a null or empty text is its end id alone; documents come by id, null ids first, then by address
list; repeated documents have recipes of their own and share chunks; an empty table gives an empty
store. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import land, remove, shared_folder

#: Chunks end where the rolling hash has MASK_BITS zero bits, after MIN ids at least and MAX at most.
ROLL, MASK_BITS, MIN_IDS, MAX_IDS = 16, 9, 128, 4096
#: Children of a node of the manifest.
FAN = 1024
#: Places of repeated chunks are broadcast only up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PLACES = 1_000_000
#: Pieces of text whose ids a process remembers: those met once, and those met again. When either are too many, they are
#: forgotten and learned anew, which changes no result. Longer pieces than LONGEST bytes are not remembered.
MET_ONCE, MET_AGAIN, LONGEST = 400_000, 700_000, 100
#: Bytes of text that are encoded at once, or one text if it is longer; a row counts as ROW_BYTES more.
AT_ONCE, ROW_BYTES = 4_000_000, 1000
#: Chunks that a task remembers to have sent.
SENT = 350_000
MULTIPLIER = 0x9E3779B97F4A7C15


def _cut_tables() -> tuple[np.ndarray, np.ndarray]:
    """What may follow a byte, and what a byte may follow, as bits: where a common bit stands in both, the byte-level pre-tokenizer
    always begins a piece. 1: white space after a letter, digit or mark; 2: a mark after a letter or digit; 4: a letter or digit after
    a mark, though not after an apostrophe, which may take it along; 8: either of the first two, if the character that ends here is a
    letter or digit beyond ASCII."""
    after, before = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for b in range(33, 127):
        alnum = chr(b).isalnum()
        after[b] = 1 | (2 if alnum else 0 if b == ord("'") else 4)
        before[b] = 4 if alnum else 2 | 8
    after[128:] = 8
    before[[ord(" "), ord("\n")]] = 1 | 8
    return after, before


AFTER, BEFORE = _cut_tables()


@cache
def _alnum() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


class _Known(dict):
    """Ids of pieces, learned as they are asked for. Most words of a large corpus are met once, so a piece stays only when it is met
    again before those met once have become too many."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn
        self.once: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.once.pop(word, None)
        if ids is not None:
            if len(self) > MET_AGAIN:
                self.clear()
            self[word] = ids
            return ids
        ids = self.learn(word)
        if len(word) > LONGEST:
            return ids
        if len(self.once) > MET_ONCE:
            self.once.clear()
        self.once[word] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level pre-tokenizer never joins a letter, digit or mark with the white space that follows it, nor letters and digits
    with marks (but for what follows an apostrophe), so a text is the concatenation of the encodings of the pieces between
    such places. Texts are cut there all at once, each different piece of them is looked up once, and pieces not met before are
    encoded by the library and remembered. Texts with the string of a special token, and all texts under another
    pre-tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.bytewise = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [array(self.code, [i]).tobytes() for i in range(size)]
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.newline = self._whole("\n")
        self.known = _Known(self._learn)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, piece: bytes) -> bytes:
        text = piece.decode()
        first = text[0]
        word = text[1:] if first == " " or first == "\n" else text
        if not (self.bytewise and (word.isalpha() or word.isdecimal())):
            return self._whole(text)
        if first == "\n":
            return self.newline + self._learn(piece[1:])
        # letters alone are one piece to the pre-tokenizer, which writes each of its bytes as a letter: to the library's model at once
        shown = piece.decode("latin-1").translate(self.letters) if not text.isascii() else "\u0120" + word if first == " " else word
        return b"".join([self.packed[t.id] for t in self.tokenize(shown)])

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte of UTF-8, whether a piece begins there for sure, whatever else stands around it."""
        cut = np.zeros(len(data) + 1, np.uint8)
        np.bitwise_and(AFTER[data[:-1]], BEFORE[data[1:]], out=cut[1:-1])
        at, alnum = np.flatnonzero(cut == 8), _alnum()
        last, b, c, d = (data[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3, 4))
        two, three = (b & 31) << 6 | last & 63, (c & 15) << 12 | (b & 63) << 6 | last & 63
        four = ((d & 7) << 18 | (c & 63) << 12 | (b & 63) << 6 | last & 63) % len(alnum)
        cut[at] = alnum[np.where(b >= 0xC0, two, np.where(c >= 0xE0, three, four))]
        return cut != 0

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and each with ``end`` after it, and where each of them ends."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or bounds[0] == bounds[-1]:
            return np.frombuffer(end * len(texts), self.dtype), np.arange(1, len(texts) + 1) * (len(end) // self.dtype.itemsize)
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = self._cuts(data) if self.bytewise else np.zeros(len(data) + 1, bool)
        cut[bounds] = False
        for special in map(str.encode, self.special):
            if special in data.tobytes():
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if special in data[a:b].tobytes():
                        cut[a:b] = False
        # an empty piece stands after each text
        full = bounds[1:] > bounds[:-1]
        at = np.sort(np.concatenate([np.flatnonzero(cut), bounds[:-1][full], bounds[1:], bounds[-1:]]), kind="stable").astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        _, edges, names = found.dictionary.buffers()
        edges, names = np.frombuffer(edges, np.int32)[: len(found.dictionary) + 1].tolist(), names.to_pybytes()
        known = [self.known[names[a:b]] if a < b else end for a, b in zip(edges[:-1], edges[1:], strict=True)]
        flat, length = np.frombuffer(b"".join(known), self.dtype), np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        which = found.indices.to_numpy()
        n = length[which]
        upto = np.cumsum(n)
        ids = np.repeat((np.cumsum(length) - length)[which] - (upto - n), n)
        ids += np.arange(len(ids))
        return flat[ids], upto[np.flatnonzero(at[1:] == at[:-1])]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, stops = self.encode_all(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, stops[:-1])] if texts else []


#: A worker process keeps its encoder, and the words it knows, for its next task.
_ENCODERS: dict[str, Encoder] = {}


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ROLL ids says that a chunk may end: the hash is a running sum of scrambled ids,
    less what has left the window, scrambled again. Equal stretches of ids are cut alike wherever they stand."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER)
    x ^= x >> np.uint64(29)
    total = np.cumsum(x, dtype=np.uint64)
    total[ROLL:] -= total[:-ROLL].copy()
    h = total * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1


def chunk_ends(n: int, may: list[int]) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids: at the places in ``may`` that leave chunks of MIN_IDS or more, and
    wherever a chunk would outgrow MAX_IDS."""
    ends, last = [], 0
    for e in [*may, n]:
        while e - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if e - last >= MIN_IDS:
            ends.append(e)
            last = e
    if last < n:
        ends.append(n)
    return ends


def list_hash(addresses: list[bytes]) -> str:
    """The hash of a document's chunk list; ``_list_hash`` is the same as a column."""
    return hashlib.sha256("".join(a.hex().upper() for a in addresses).encode()).hexdigest()


def _list_hash(addresses: str) -> Column:
    return F.sha2(F.array_join(F.transform(addresses, F.hex), ""), 256)


ENCODED = "doc_id long, n_tokens long, addresses array<binary>, root string, address binary, n_ids int, payload binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, in parts of AT_ONCE bytes about, and of one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        upto = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        last = 0
        for end in (np.flatnonzero(np.diff(upto // AT_ONCE, prepend=size // AT_ONCE)) + 1).tolist():
            yield pa.concat_batches([*held, batch.slice(last, end - last)])
            held, last = [], end
        if last < batch.num_rows:
            held.append(batch.slice(last))
            size = int(upto[-1])
        elif last:
            size = 0
    if held:
        yield pa.concat_batches(held)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Recipes (with a null address) and chunks (with one); a chunk that this task has just sent is not sent again."""
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        sent: set[bytes] = set()
        width = encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype).tobytes()
        for part in _parts(batches):
            rows: list[tuple] = []
            ids, ends = encoder.encode_all(part.column("text"), end)
            # all documents are hashed in one sweep: no chunk ends within MIN_IDS > ROLL ids of a document's start
            may = boundaries(ids)
            cuts, stops, packed = np.searchsorted(may, ends).tolist(), ends.tolist(), ids.tobytes()
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                start = stops[k - 1] if k else 0
                n = stops[k] - start
                stream = packed[start * width : stops[k] * width]
                addresses, last = [], 0
                for e in chunk_ends(n, (may[cuts[k - 1] if k else 0 : cuts[k]] - start).tolist()):
                    payload = stream[last * width : e * width]
                    address = hashlib.sha256(payload).digest()
                    addresses.append(address)
                    if address not in sent:
                        sent.add(address)
                        rows.append((None, None, None, None, address, e - last, payload))
                    last = e
                rows.append((doc_id, n, addresses, list_hash(addresses), None, None, None))
            if len(sent) > SENT:
                sent.clear()
            types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.string(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in ENCODED.split(", ")])

    return run


def _unique_chunks(made: DataFrame) -> DataFrame:
    """One of the chunks of each address: the one in the first place. A task has made each of its chunks about once, so no address
    has more rows than there are tasks."""
    places = made.where("address is not null").groupBy("address").agg(F.array_sort(F.collect_list("place")).alias("places"))
    gone = land(places.where(F.size("places") > 1).select(F.explode(F.slice("places", 2, F.size("places"))).alias("place")), "repeated-chunks")
    chunks = made.where("address is not null").select("address", "n_ids", "payload", "place")
    return chunks.join(F.broadcast(gone) if gone.count() <= BROADCAST_PLACES else gone, "place", "left_anti").drop("place")


def _packed(rows: DataFrame) -> DataFrameWriter:
    """A writer for ids and hashes: no value comes twice and little can be compressed, so neither dictionaries nor much effort pay."""
    return rows.write.option("compression", "snappy").option("parquet.enable.dictionary", "false")


CHUNKS = "address binary, n_ids int, payload binary"
RECIPES = "number long, doc_id long, start long, n_tokens long, addresses array<binary>, root string"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the store of ``docs`` under ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(tokenizer_path, end_id), ENCODED)
    # places are drawn once, when the table is written, and then are stored values
    _packed(encoded.withColumn("place", F.monotonically_increasing_id())).parquet(f"{path}/made")
    made = spark.read.schema(ENCODED + ", place long").parquet(f"{path}/made")
    _packed(_unique_chunks(made)).parquet(f"{path}/chunks")
    # ascending documents: range parts, with what comes before each part added
    order = (F.asc_nulls_first("doc_id"), "n_tokens", "root")
    parts = made.where("address is null").select("doc_id", "n_tokens", "addresses", "root").sort(*order).withColumn("part", F.spark_partition_id())
    ordered = land(parts, "ordered-recipes")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("tokens", "rows")])
    inside = W.partitionBy("part").orderBy(*order)
    recipes = ordered.withColumns({"upto": F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)), "nth": F.row_number().over(inside)}).join(offsets, "part")
    start = F.col("tokens_before") + F.col("upto") - F.col("n_tokens")
    recipes = recipes.select((F.col("rows_before") + F.col("nth") - 1).alias("number"), "doc_id", start.alias("start"), "n_tokens", "addresses", "root")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    tree(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    remove(spark, f"{path}/made")


NODES = "level int, node long, start long, tokens long, documents long, gapless boolean, hash string"


def tree(recipes: DataFrame) -> DataFrame:
    """All nodes of the Merkle tree over ``recipes``, level 1 to the root: a node holds FAN children at most, so no task sees
    more of a level than that at once. ``gapless`` says whether each child begins where the one before it ended."""
    leaf = F.sha2(F.concat_ws(",", "number", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", "root"), 256)
    level, k, every = recipes.select(F.col("number").alias("node"), "start", F.col("n_tokens").alias("tokens"), F.lit(1).cast("long").alias("documents"), F.lit(True).alias("gapless"), leaf.alias("hash")), 0, None
    while True:
        k += 1
        children = F.array_sort(F.collect_list(F.struct("node", "start", "tokens", "hash", "gapless")))
        up = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(children.alias("c"), F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        # each child begins where the sum of those before it says
        run = F.aggregate("c", F.struct(F.col("c")[0]["start"].alias("at"), F.lit(True).alias("ok")), lambda s, x: F.struct((s["at"] + x["tokens"]).alias("at"), (s["ok"] & x["gapless"] & (s["at"] == x["start"])).alias("ok")))
        hashed = F.sha2(F.concat_ws(",", F.col("node").cast("string"), F.col("tokens").cast("string"), F.col("documents").cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), ",")), 256)
        level = land(up.select("node", F.col("c")[0]["start"].alias("start"), "tokens", "documents", run["ok"].alias("gapless"), hashed.alias("hash")), "manifest")
        nodes = level.select(F.lit(k).alias("level"), "node", "start", "tokens", "documents", "gapless", "hash")
        every = nodes if every is None else every.unionByName(nodes)
        if level.count() <= 1:
            return every


CHECKED = "address binary, n int, crc long"


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        address, n, payload = (batch.column(c).to_pylist() for c in ("address", "n_ids", "payload"))
        crc = []
        for a, k, p in zip(address, n, payload, strict=True):
            if hashlib.sha256(p).digest() != a:
                raise ValueError("a chunk does not match its address")
            crc.append(zlib.crc32(np.frombuffer(p, f"<u{len(p) // k}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(address, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["address", "n", "crc"])


#: For 2 ** k zero bytes, k = 0, 1, ..: what they make of each byte of a CRC-32, as four tables of 256.
_ZEROS: list[np.ndarray] = []


def _zeros(k: int) -> np.ndarray:
    while len(_ZEROS) <= k:
        if _ZEROS:
            last = _ZEROS[-1]
            _ZEROS.append(np.stack([_over(last, row) for row in last]))
        else:
            step = np.array([zlib.crc32(b"\0", b) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0", 0))
            # one zero byte moves the upper bytes down and replaces the lowest by its table entry
            byte = np.arange(256, dtype=np.uint32)
            _ZEROS.append(np.stack([step, byte, byte << np.uint32(8), byte << np.uint32(16)]))
    return _ZEROS[k]


def _over(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def crc32_after(crc: np.ndarray, more: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values of texts followed by ``n_bytes`` bytes whose CRC-32 values are ``more``: ``crc`` advances over zero
    bytes, in powers of two, as the CRC is linear."""
    crc, n_bytes, k = np.asarray(crc, np.uint32).copy(), np.asarray(n_bytes, np.int64), 0
    while (n_bytes >> k).any():
        at = np.flatnonzero(n_bytes >> k & 1)
        crc[at] = _over(_zeros(k), crc[at])
        k += 1
    return crc ^ np.asarray(more, np.uint32)


@F.arrow_udf(T.LongType())
def _joined_crc(pieces: pa.Array) -> pa.Array:
    """CRC-32 of each document from those of its chunks (structs of seq, crc, n): the k-th chunks of all documents at a time."""
    n = np.asarray(pc.fill_null(pc.list_value_length(pieces), 0), np.int64)
    flat = pieces.flatten()
    doc = np.repeat(np.arange(len(n)), n)
    seq, crc, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("seq", "crc", "n"))
    order = np.lexsort((doc, seq))
    cuts = [0, *(np.flatnonzero(np.diff(seq[order])) + 1).tolist(), len(order)]
    out = np.zeros(len(n), np.uint32)
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = order[a:b]
        out[doc[at]] = crc32_after(out[doc[at]], crc[at].astype(np.uint32), 4 * size[at].astype(np.int64))
    return pa.array(out.astype(np.int64))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files, with all checks; a failed check fails the job."""
    facts = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(_check_chunks, CHECKED)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    found, manifest = land(tree(recipes), "manifest-read"), spark.read.schema(NODES).parquet(f"{path}/manifest")
    if not found.where("not gapless or (node = 0 and start <> 0)").isEmpty():
        raise ValueError("a document does not start where the one before it ends")
    if wrong := found.exceptAll(manifest).unionByName(manifest.exceptAll(found)).count():
        raise ValueError(f"{wrong} nodes do not match the manifest")
    checked = recipes.where(F.assert_true(_list_hash("addresses") == F.col("root"), "a recipe does not match its hash").isNull())
    pieces = checked.select("number", "start", "doc_id", "n_tokens", F.posexplode("addresses").alias("seq", "address"))
    joined = pieces.join(facts, "address", "left").groupBy("number", "start", "doc_id", "n_tokens").agg(F.collect_list(F.struct("seq", "crc", "n")).alias("pieces"))
    whole = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"]) == F.col("n_tokens")
    return joined.where(F.assert_true(whole, "a document lacks a chunk").isNull()).select("doc_id", "start", "n_tokens", _joined_crc("pieces").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, seq, address, payload) of the chosen documents: their packed ids, chunk by chunk."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("address", "payload")
    return recipes.select("doc_id", "start", F.posexplode("addresses").alias("seq", "address")).join(chunks, "address")


def stored(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write a store into the shared folder and give what ``read_store`` finds there."""
    path = f"{shared_folder(docs.sparkSession)}/store-{uuid.uuid4().hex[:12]}"
    write_store(docs, path, tokenizer_path, end_id)
    return read_store(docs.sparkSession, path)
