"""Tables that cut lineage between rounds, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one serves only a local master: executors elsewhere could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fogline-"))
    return spark.sparkContext.getCheckpointDir()


def many_tasks(spark: SparkSession) -> int:
    """Partitions for rows of few bytes that make many pairs; a repartition to a count is not coalesced by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed and checkpointed: a lost executor costs a re-read and no earlier round."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
