"""The folder that the driver and all executors share, for tables that cut a plan's lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is local, as in tests, a folder on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_consentry_folder", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        got = spark._consentry_folder = f"file://{tempfile.mkdtemp(prefix='consentry-')}"
    return got.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written once, partitioned by the columns by, and read again. name: of the table, or a path made before."""
    spark, schema = df.sparkSession, df.schema
    to = name if "/" in name else path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(to)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(to)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)


def drop(spark: SparkSession, where: str) -> None:
    """Removes a table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
