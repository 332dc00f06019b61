"""Helpers shared by the training-data operators: table reading, the shared scratch folder, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_SCRATCH = "spark.codestrata.scratch"
WORD = r"[^\x20\x09-\x0D]+"


#: What a batch to Python holds at most where the session says nothing: a worker keeps several copies of a batch.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def small_batches(spark: SparkSession) -> None:
    for key, value in SMALL_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path, so any file system works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (as in tests) a temporary folder is made and kept for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_SCRATCH, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set(OWN_SCRATCH, root)
    return f"{root.rstrip('/')}/codestrata/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing that is still to run reads it."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle parallelism, which the cluster sizes to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def non_null_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
