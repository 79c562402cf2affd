"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables go in local mode when spark.checkpoint.dir is unset, as in tests; a cluster must name a shared folder.
LOCAL_FOLDER = "/tmp/checkpoints"


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = LOCAL_FOLDER
    return f"{at.rstrip('/')}/graph-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; ``clean`` removes what is written there."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back: what follows starts from files that survive lost executors."""
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def clean(spark: SparkSession) -> None:
    """Remove every table that this application has landed; results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
