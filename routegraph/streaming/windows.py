"""Counts of a stream in tumbling or sliding windows, with late rows kept in a table of their own.

Spark's windowed aggregation drops rows behind the watermark. Here each batch writes three folders under its number: what it adds to each window, its
late rows, and the greatest time so far, from which the next batch takes the watermark. A batch that runs again after a failure writes the same folders again, so
nothing counts twice; a row is either counted or late, never lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.storagelevel import StorageLevel

MARK = "seen timestamp"


class WindowedCounts:
    """Counts and sums of ``value`` (if there is one) for each window and each value of ``keys``, kept under ``folder``, which all executors share.

    A row is late if its time ``ts`` lies more than ``late`` before the greatest time of all batches before its own; a row without a time is late too. Null keys are a
    group of their own. Names of the input's other columns do not matter: late rows are kept whole, as one struct."""

    def __init__(self, folder: str, window: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = (), ts: str = "ts", value: str | None = None) -> None:
        self.folder, self.window, self.slide, self.late, self.keys, self.ts, self.value = folder.rstrip("/"), window, slide, late, keys, ts, value

    def counted(self, rows: DataFrame) -> DataFrame:
        """(start, end, keys, n, total) of rows with a time."""
        total = F.sum(self.value).cast("double") if self.value else F.lit(None).cast("double")
        at = F.window(self.ts, self.window, self.slide) if self.slide else F.window(self.ts, self.window)
        groups = rows.where(F.col(self.ts).isNotNull()).groupBy(at.alias("window"), *self.keys).agg(F.count("*").alias("n"), total.alias("total"))
        return groups.select("window.start", "window.end", *self.keys, "n", "total")

    def _at(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def take(self, rows: DataFrame, batch: int) -> None:
        """One batch of the stream."""
        spark = rows.sparkSession
        before = spark.read.schema(MARK).parquet(self._at("marks", batch - 1)) if batch else spark.createDataFrame([(None,)], MARK)
        seen = before.first()["seen"]
        edge = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.late}")
        behind = F.col(self.ts).isNull() | F.coalesce(F.col(self.ts).cast("timestamp") < edge, F.lit(False))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.counted(rows.where(~behind)).write.mode("overwrite").parquet(self._at("counts", batch))
            rows.where(behind).select(F.struct("*").alias("row"), edge.alias("watermark")).write.mode("overwrite").parquet(self._at("late", batch))
            mark = rows.agg(F.greatest(F.max(F.col(self.ts).cast("timestamp")), F.lit(seen).cast("timestamp")).alias("seen"))
            mark.coalesce(1).write.mode("overwrite").parquet(self._at("marks", batch))
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The writer to start; its checkpoint and ``folder`` belong together."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.take)

    def counts(self, spark: SparkSession) -> DataFrame:
        """(start, end, keys, n, total) over all batches so far, without late rows."""
        return self._summed(spark.read.parquet(f"{self.folder}/counts").drop("batch"))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """(row, watermark, batch) of all late rows."""
        return spark.read.parquet(f"{self.folder}/late")

    def corrected(self, spark: SparkSession) -> DataFrame:
        """``counts`` with late rows added to their windows: what a batch job over all rows with a time would give."""
        late = self.late_rows(spark).select("row.*")
        return self._summed(spark.read.parquet(f"{self.folder}/counts").drop("batch").unionByName(self.counted(late)))

    def final(self, spark: SparkSession) -> DataFrame:
        """``counts`` of windows that end at or before the latest watermark, to which no further row can be added."""
        last = spark.read.schema(T.StructType([T.StructField("seen", T.TimestampType()), T.StructField("batch", T.LongType())])).parquet(f"{self.folder}/marks").agg(F.max_by("seen", "batch").alias("seen"))
        edge = last.select((F.col("seen") - F.expr(f"INTERVAL {self.late}")).alias("edge"))
        return self.counts(spark).join(F.broadcast(edge), F.col("end").cast("timestamp") <= F.col("edge")).drop("edge")

    def _summed(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("start", "end", *self.keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
