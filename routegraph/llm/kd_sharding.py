"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata
dimension until there are as many leaves as shards of the target bytes fit.

Rows of equal text are one group and have one place, so that no cut parts them, as long as the group has at most a sixteenth
of a shard's bytes and SLOT_ROWS rows. Larger groups would break the law, so their rows are placed one by one; a number
among equal rows tells even those apart. ``split_groups`` counts the groups that lie in more than one shard.

A place has 62 bits: 31 bits of where it lies along the node's dimension, then 31 bits of a hash, so that ties can be cut
anywhere. A weighted median is found for all nodes of a level at once by a few grouped histograms of 4096 bins, each inside
the bin that holds the median. The nodes are a small table, a row for each, that is joined; the driver sees counts only.
Spark expressions only.

The law is ``bytes``: leaves are near equal in bytes (each cut is within half a document, or half a group, of its median).

Defined results: a null text has size 1 and crc32 0; null metadata lies at 0; identical rows are a group like any
other; more shards than rows leave some shards empty; an empty table gives an empty result. Only doc_id, text,
lang and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import land, numbered_copies

HALF = 1 << 31
BITS, BIN_BITS = 62, 12
SLOT_ROWS = 50_000
#: A group stays together up to this part of a shard's bytes.
GROUP_SHARE = 16
#: Tables of at most this many small rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's group, a hash of the row, and the dimensions, all numeric."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), F.xxhash64("text").alias("text_hash"), "lang", "source")
    spread = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")).cast("double"), F.lit(0.0))
    return rows.select(
        "doc_id",
        (F.col("bytes") + 1).alias("size"),
        "text_crc32",
        F.xxhash64("text_hash", "text_crc32", "bytes").alias("text_group"),
        F.xxhash64("doc_id", "text_hash", "bytes", "source", "lang").alias("row_hash"),
        F.array(F.log2(F.col("bytes") + 1.0), spread("lang"), spread("source"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))).alias("dims"),
    )


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def placed_together(rows: DataFrame, most_bytes: float) -> DataFrame:
    """``rows`` with ``tie``, ``whole`` (whether the row's group stays together), and the dimensions of the group's least row where it does."""
    # a group of more than a sixteenth of a shard, or of more than SLOT_ROWS rows: there are few of either
    large = land(rows.groupBy("text_group").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where((F.col("w") > most_bytes) & (F.col("n") > 1) | (F.col("n") > SLOT_ROWS)).select("text_group"), "large-groups")
    n_large = large.count()
    least = F.min(F.struct("row_hash", "dims")).over(W.partitionBy("text_group"))["dims"]
    short = lambda *c: F.pmod(F.xxhash64(*c), F.lit(HALF))
    kept = rows.join(_small(large, n_large), "text_group", "left_anti").withColumns({"dims": least, "tie": short("text_group"), "whole": F.lit(True)}).drop("text_group", "row_hash", "part")
    if not n_large:
        return kept
    apart = numbered_copies(rows.join(_small(large, n_large), "text_group", "left_semi"), "row_hash")
    return kept.unionByName(apart.withColumns({"tie": short("row_hash", "copy"), "whole": F.lit(False)}).drop("text_group", "row_hash", "copy"))


def _cuts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cut): the place below which ``wanted`` of a node's bytes lie, as nearly as whole rows allow. ``rows`` has node,
    place and size, ``nodes`` has node and wanted."""
    state = nodes.select("node", "wanted", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"))
    bits = BITS
    while bits:
        bits = max(0, bits - BIN_BITS)
        width = 1 << bits
        open_ = state.where("cut is null")
        inside = rows.join(F.broadcast(open_), "node").where((F.col("place") >= F.col("at")) & (F.col("place") < F.col("at") + F.lit(width << BIN_BITS)))
        bins = inside.groupBy("node", F.floor((F.col("place") - F.col("at")) / F.lit(width)).alias("bin"), "wanted", "below").agg(F.sum("size").alias("w"), F.min("place").alias("first"), F.max("place").alias("last"))
        upto = bins.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")) + F.col("below"))
        crossing = upto.where("upto >= wanted").groupBy("node").agg(F.min_by(F.struct("bin", "w", "first", "last", "upto"), "bin").alias("x"))
        x = F.col("x")
        under = x["upto"] - x["w"]
        nearer = F.abs(x["upto"] - F.col("wanted")) < F.abs(under - F.col("wanted"))
        found = F.when(x["first"] == x["last"], F.when(nearer, x["first"] + 1).otherwise(x["first"]))
        state = state.join(crossing, "node", "left").select(
            "node", "wanted", F.coalesce(F.col("at") + x["bin"] * width, "at").alias("at"), F.coalesce(under, "below").cast("long").alias("below"),
            F.coalesce("cut", found, F.when(x.isNull(), F.lit(1 << BITS))).alias("cut"),
        )
        state = land(state, "kd-cuts")
        if state.where("cut is null").isEmpty():
            break
    return state.select("node", "cut")


def kd_leaves(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` (size, tie, dims) with the column ``shard`` in 0 .. leaves-1, a leaf of the tree."""
    n_dims = rows.select(F.max(F.size("dims"))).first()[0] or 0
    ends = [f(F.col("dims")[d]).alias(f"{k}{d}") for d in range(n_dims) for k, f in (("low", F.min), ("high", F.max))]
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    if not n_dims:
        return rows.withColumn("shard", F.lit(0)).drop("node")
    all_ = rows.agg(*ends).first()
    whole = [(all_[f"high{d}"] - all_[f"low{d}"]) or 1.0 for d in range(n_dims)]
    # leaves below a node: the first of them and their number
    nodes, most = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("k")), leaves
    while most > 1:
        facts = rows.groupBy("node").agg(F.sum("size").alias("total"), *ends)
        widths = F.array(*[(F.col(f"high{d}") - F.col(f"low{d}")) / F.lit(whole[d]) for d in range(n_dims)])
        lows, spans = F.array(*[F.col(f"low{d}") for d in range(n_dims)]), F.array(*[F.col(f"high{d}") - F.col(f"low{d}") for d in range(n_dims)])
        half = F.floor(F.col("k") / 2)
        level = nodes.join(facts, "node", "left").withColumn("dim", F.greatest(F.array_position(widths, F.array_max(widths)), F.lit(1)).cast("int"))
        level = level.select("node", "first", "k", half.alias("half"), "dim", F.element_at(lows, F.col("dim")).alias("low"), F.element_at(spans, F.col("dim")).alias("span"), (F.col("total") * half / F.col("k")).alias("wanted"), "total")
        level = land(level, "kd-nodes")
        along = F.when(F.col("span") > 0, (F.element_at("dims", F.col("dim")) - F.col("low")) / F.col("span")).otherwise(0.0)
        place = F.floor(along * (HALF - 1)).cast("long") * HALF + F.col("tie")
        columns = [c for c in rows.columns if c != "node"]
        placed = land(rows.join(F.broadcast(level.select("node", "dim", "low", "span")), "node").select("node", *columns, place.alias("place")), "kd-level")
        cuts = _cuts(placed, level.where("k > 1 and total is not null"))
        right = F.coalesce(F.col("place") >= F.col("cut"), F.lit(False)).cast("long")
        rows = placed.join(F.broadcast(cuts), "node", "left").select((2 * F.col("node") + right).alias("node"), *columns)
        child = lambda node, first, k: F.struct(node.alias("node"), first.alias("first"), k.alias("k"))
        node, first, k = F.col("node"), F.col("first"), F.col("k")
        two = F.array(child(2 * node, first, F.col("half")), child(2 * node + 1, first + F.col("half"), k - F.col("half")))
        nodes = level.select(F.explode(F.when(k > 1, two).otherwise(F.array(child(2 * node, first, k)))).alias("c")).select("c.*")
        most -= most // 2
    return rows.join(F.broadcast(nodes.select("node", F.col("first").cast("int").alias("shard"))), "node").drop("node")


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard: numbered within parts of about SLOT_ROWS rows,
    plus the rows of the parts before."""
    most = rows.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = rows.withColumn("slot_part", F.pmod("tie", F.lit(max(1, -(-most // SLOT_ROWS)))).cast("int"))
    counts = rows.groupBy("shard", "slot_part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("slot_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "slot_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("shard", "slot_part").orderBy("tie", "doc_id", "text_crc32", "size"))
    return rows.withColumn("inside", inside).join(offsets, ["shard", "slot_part"]).withColumn("slot", F.col("offset") + F.col("inside") - 1)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and whole_group of every row. Without ``shards`` there are as many as
    shards of ``target_bytes`` the corpus fills. ``whole_group``: the row's equals were kept together with it."""
    rows = land(metadata(docs).withColumn("part", F.spark_partition_id()), "kd-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    leaves = shards or max(1, -(-total // target_bytes))
    together = land(placed_together(rows, total / leaves / GROUP_SHARE), "kd-places")
    return with_slots(land(kd_leaves(together, leaves), "kd-leaves")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("whole").alias("whole_group")
    )


def split_groups(sharded: DataFrame) -> DataFrame:
    """(text_crc32, size, shards) of texts, told apart by crc and size, that lie in more than one shard."""
    return sharded.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("shards")).where("shards > 1")
