"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidefold-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidefold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with all rows of a key in one partition, sorted by key and order, for functions that stream over partitions.

    Dealt by a hash of the key, not the key: Spark leaves out a repartition by columns that a join below has dealt by, and
    adaptive execution may then broadcast that join and read its shuffle as it lies, with a key's rows in several partitions.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
