"""Reading the input tables and finding the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="postmark-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder path, with its file system's scheme, below ``spark.checkpoint.dir``; only where all runs in one process (tests) may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/postmark-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def resolved(spark: SparkSession, folder: str) -> str:
    """A folder, made if need be, by the name that it has in the file system below views and mounts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.resolvePath(path).toString()


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: the lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a folder of ``store`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that have ended, instead of whenever the driver next collects garbage."""
    for _ in range(2):  # what the first round frees may hold the last reference to a shuffle
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
