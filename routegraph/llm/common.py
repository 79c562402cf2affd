"""What the training-data operators share: words, held-out folds, and tables in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"

#: Lower-cases A-Z only, as the contracts ask; str.lower() would change other letters too.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def n_words(column: str) -> Column:
    """Number of words of a text column, 0 for null: each word and the space after it becomes one letter, which makes
    far less garbage than a list of words would."""
    return F.coalesce(F.length(F.regexp_replace(F.btrim(F.col(column), F.lit(SPACES)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def fold(key: str, folds: int) -> Column:
    """crc32 of a key's text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Documents are long: batches of Spark's default 10,000 rows would take tens of MB on both sides of each
    Python worker. A smaller setting of the session is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: Where tables go in local mode when spark.checkpoint.dir is unset, as in tests; a cluster must name a shared folder.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = LOCAL_FOLDER
    return f"{at.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps start from files that
    outlive executors, with no lineage, and prune the columns they need."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``position``, gapless from 0 in the given order: rows are numbered within range parts,
    plus the rows of the parts before, so no task sees them all."""
    parts = land(df.sort(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(offsets, "_part").withColumn("position", F.col("_before") + F.col("_inside") - 1).drop("_part", "_n", "_before", "_inside")


def numbered_copies(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``copy``, from 0 among rows of equal ``key``, and without ``part``. ``rows`` is a landed table whose column ``part``
    says in which task a row was written: rows are numbered within their part, plus the equal rows of the parts before, so a key that
    most rows share does not come to one task."""
    counts = rows.groupBy(key, "part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(key, "part").orderBy(F.lit(0)))
    numbered = rows.withColumn("_inside", inside).join(counts.withColumn("_before", before), [key, "part"])
    return numbered.withColumn("copy", F.col("_before") + F.col("_inside") - 1).drop("part", "_n", "_before", "_inside")


#: Rows of one key that a salted join leaves together, and keys that it broadcasts at most (16 bytes each).
SALTED_ROWS, BROADCAST_KEYS = 500, 1_000_000


def salted_join(rows: DataFrame, facts: DataFrame, key: str, spread: str, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``key``. A key with more than SALTED_ROWS rows in ``counted``, a landed
    table (``rows`` itself, or what it was made of), is dealt out by ``spread``, and its fact is repeated as often."""
    hot = land((rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / SALTED_ROWS).cast("int").alias("_salts")).where("_salts > 1"), "hot-keys")
    n = hot.count()
    if not n:
        return rows.join(facts, key)
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    held = facts.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return dealt.join(held, [key, "_salt"]).drop("_salt")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove every table that this application has landed; results that still read them must be written first."""
    remove(spark, shared_folder(spark))
