"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8-byte keys that may be broadcast; beyond it the same join is shuffled.
BROADCAST_KEYS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one serves only a local master: executors elsewhere could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fogline-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables of one operator call, under a folder of its own.

    A table is written once and read back, so a lost executor costs a re-read and never the work before it. Tables that
    no later step reads can be dropped early; the rest go when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def sized(self, table: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
        """A written table of a few narrow columns, marked for broadcast if it has no more than ``rows`` rows."""
        return F.broadcast(table) if table.count() <= rows else table

    def drop(self, *tables: str) -> None:
        """Delete the named tables, or all."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for path in [self.path(t) for t in tables] or [self.root]:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may have ended before the process
            pass
