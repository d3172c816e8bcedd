"""What the training-data operators share: table access, input shaping and Arrow helpers."""

from __future__ import annotations

import ctypes
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and Python, about: what a task holds of its input at once.
BATCH_BYTES = 4 << 20
#: White space between words; places of a word that have numbers of their own; bytes of text that are hashed at once.
SPACE, IS_SPACE = re.compile(rb"[ \t-\r]"), np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PLACED = 128
PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read by as many tasks as there are cores at least: one of fewer splits, such as a file of one row group, is
    dealt out by rows first. Large tables have more splits, and are read as they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return small_batches(df if df.rdd.getNumPartitions() >= cores else df.repartition(cores))


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends rows to Python in batches of BATCH_BYTES, unless it has a smaller size set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None)
    if not held or not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives memory that is free again back to the machine. A Python worker waits for further tasks, of other stages too,
    and would keep what it once needed."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """(doc_id long, text): every row of docs, null texts as empty ones. Other columns, whatever their names, are left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), (text.cast("binary") if as_bytes else text).alias("text")))


def text_key(text: Column) -> Column:
    """What tells texts apart: the first half of their SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def map_rows(df: DataFrame, of_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow by one function of a batch of so many rows at most; it may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, rows):
                if (out := of_batch(b.slice(k, rows))) is not None:
                    yield out
        release()

    return small_batches(df).mapInArrow(run, schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def new_salt() -> int:
    """A secret number for the hashes of one run: drawn by the driver, sent to the tasks with their code. Nobody can make
    words that collide without knowing it."""
    return secrets.randbits(128)


@lru_cache(maxsize=4)
def _places(salt: int) -> np.ndarray:
    """Random odd numbers for the places of a word, for each of the two halves of a name."""
    return np.random.default_rng(salt).integers(0, 1 << 63, (2, PLACED), np.uint64) << np.uint64(1) | np.uint64(1)


def word_hashes(text: bytes, salt: int) -> np.ndarray:
    """A salted 64-bit hash of each word: the first half of word_names()."""
    return np.concatenate([np.zeros(0, np.uint64), *(_word_names(p, salt, 1)[0] for p in _pieces(text))])


def word_names(text: bytes, salt: int) -> np.ndarray:
    """Salted 128-bit names of the words, as two rows of 64-bit halves: a word's bytes times random numbers, one for each
    place in a word, summed and mixed. The halves use independent numbers, so two given words share a name with a
    chance of 2 ** -112 at most. Words that are longer than there are numbers are hashed by keyed blake2b."""
    return np.concatenate([np.zeros((2, 0), np.uint64), *(_word_names(p, salt, 2) for p in _pieces(text))], 1)


def _word_names(text: bytes, salt: int, halves: int) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~IS_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros((halves, 0), np.uint64)
    first = np.cumsum(length) - length
    own = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    symbols = b[own + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)
    own = np.minimum(own, PLACED - 1)
    h = np.stack([np.add.reduceat(places[own] * symbols, first) for places in _places(salt)[:halves]])
    for k in np.flatnonzero(length > PLACED).tolist():
        word = hashlib.blake2b(text[start[k] : start[k] + length[k]], digest_size=16, key=salt.to_bytes(16, "little")).digest()
        h[:, k] = np.frombuffer(word, "<u8")[:halves]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
