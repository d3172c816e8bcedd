"""Tables between the steps of an operator: written once to the folder that a cluster's machines share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    folder = tempfile.TemporaryDirectory(prefix="pathloom-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def folder(spark: SparkSession) -> str:
    """Where tables are kept: spark.checkpoint.dir. Where that is unset, on one machine as in tests, a temporary folder; on a
    cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/pathloom-panels"
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f"{_own()}/pathloom-panels"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: its lineage ends here, and it outlives executors. It stays until clean() deletes it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what this application has kept: for when results that read it are written."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/*-{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or ():
        files.delete(found.getPath(), True)
