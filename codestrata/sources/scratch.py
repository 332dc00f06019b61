"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "spark.codestrata.scratch"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: a short plan that outlives lost executors.

    Only where no folder is configured and all runs on one machine (as in tests) a temporary one is made.
    """
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set(OWN, root)
    return f"{root.rstrip('/')}/codestrata/{label}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file systems."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(data)
    out.close()
