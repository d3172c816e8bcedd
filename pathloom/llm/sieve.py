"""Bit sieves: small tables of hashes that rule rows out before they are shuffled.

A sieve has a fixed number of bits whatever it's built from, so that it can be broadcast; one that is too full lets more
rows through, which costs time, but it never holds back a row whose hash is in it. A task sends the blocks that it has
marked, and Spark's aggregate of bitmaps merges them row by row, so memory doesn't follow the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: 2 MB, in blocks of 4 KB, which is the size of Spark's bitmaps.
BITS, BLOCKS = 1 << 24, 512


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return (h >> np.uint64(40)).astype(np.int64), (h & np.uint64(BITS - 1)).astype(np.int64)


def sieve(df: DataFrame, *columns: str):
    """A test for rows that may have the columns' values of a row of df: takes columns, gives a boolean column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            for x in _bits(b.column(0).to_numpy(zero_copy_only=False)):
                bits[x] = True
        parts = bits.reshape(BLOCKS, -1)
        some = np.flatnonzero(parts.any(1)).tolist()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())], names=["block", "bits"])
        del bits, parts
        release()

    marked = df.select(F.xxhash64(*columns).alias("h")).mapInArrow(mark, "block int, bits binary")
    marked = marked.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = np.zeros((BLOCKS, BITS // BLOCKS), bool)
    for block, x in marked.collect():
        bits[block] = np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool)
    packed = df.sparkSession.sparkContext.broadcast(np.packbits(bits.ravel(), bitorder="little"))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        ok = np.ones(len(h), bool)
        for x in _bits(h.to_numpy()):
            ok &= (packed.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(ok)

    def test(*cols: Column) -> Column:
        return may(F.xxhash64(*cols))

    return test
