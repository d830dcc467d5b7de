"""Folders for files that are written and read again within a job."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="quern-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (spark.checkpoint.dir), or under a temporary one where that is unset and all
    runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or _own(spark.sparkContext.applicationId)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def working_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df written to a new folder and read from there; the folder goes at the end."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
