"""Tables between the steps of an operator, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_own_scopes = threading.local()


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    """Of this thread: two threads' tables don't meet."""
    if not hasattr(_own_scopes, "held"):
        _own_scopes.held = []
    return _own_scopes.held


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, on one machine as in tests, a temporary folder; on a cluster
    that is an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own()


@lru_cache(maxsize=1)
def _own() -> str:
    folder = tempfile.TemporaryDirectory(prefix="pathloom-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stashed within, but not kept, are deleted at the end: what is returned must not read them."""
    _scopes().append([])
    try:
        yield
    finally:
        for spark, path in _scopes().pop():
            delete(spark, path)


def stash(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """df, computed once and read again: its lineage ends here, and it outlives executors. keep: it outlives scratch() as
    well, since a result reads it; clean() deletes it."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/pathloom/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if _scopes() and not keep:
        _scopes()[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this application, those that results still read too: for when these are written."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(spark).rstrip('/')}/pathloom/*-{spark.sparkContext.applicationId}-*")
    for found in pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or ():
        delete(spark, found.getPath().toString())
