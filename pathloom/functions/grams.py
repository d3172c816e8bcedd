"""Names of k-grams by doubling, and k-grams with what stands beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = (11, 23)


def _pair(a: Column, b: Column) -> Column:
    """A name of two names, as two independently salted hashes."""
    return F.struct(*(F.xxhash64(F.lit(s), a, b).alias(f"h{i}") for i, s in enumerate(SALTS)))


#: How many nodes behind a gram are told apart beside it.
AHEAD = 6


def node_code(node: Column, kind: str) -> Column:
    """A node as 64 bits: integers as they are, others by a hash. Null for null."""
    if kind in ("byte", "short", "integer", "long"):
        return node.cast("long")
    return F.when(node.isNotNull(), F.xxhash64(F.lit(SALTS[0] ^ SALTS[1]), node))


def gram_names(positions: DataFrame, length: int, key: str = "seq_id", ahead: bool = False) -> DataFrame:
    """positions (key, pos, node) with gram: the 128-bit name of the `length` nodes from pos on, and prev and next, the
    nodes before and after them (null at a path's ends). Positions with fewer nodes left are dropped.

    ahead: also a0 to a5, the codes (node_code) of the AHEAD nodes after them, f0 and f1, the name of the `length` + AHEAD nodes
    from pos on, and far, the code of the node after those; prev and next are codes, too. Null where the path ends before.

    Names double: one of 2n nodes is made of two of n, so `length` costs its logarithm in window functions, which all
    share one exchange and one sort by (key, pos)."""
    if length < 1:
        raise ValueError("a gram has 1 node at least")
    w = Window.partitionBy(key).orderBy("pos")
    named = positions.select(key, "pos", "node").withColumn("gram", F.struct(*(F.xxhash64(F.lit(s), "node").alias(f"h{i}") for i, s in enumerate(SALTS))))

    def longer(df: DataFrame, n: int, wanted: int) -> DataFrame:
        """Names of `wanted` nodes, at most 2n, from those of n."""
        return df.withColumn("ahead", F.lead("gram", wanted - n).over(w)).withColumn("gram", F.when(F.col("ahead").isNotNull(), _pair(F.col("gram"), F.col("ahead")))).drop("ahead")

    n = 1
    while n < length:
        named = longer(named, n, min(2 * n, length))
        n = min(2 * n, length)
    if not ahead:
        named = named.withColumn("prev", F.lag("node", 1).over(w)).withColumn("next", F.lead("node", length).over(w))
        return named.filter(F.col("gram").isNotNull()).select(key, "pos", F.col("gram.h0").alias("g0"), F.col("gram.h1").alias("g1"), "prev", "next")
    named = named.withColumns({"code": node_code(F.col("node"), positions.schema["node"].dataType.typeName()), "short": F.col("gram")})
    while n < length + AHEAD:
        named = longer(named, n, min(2 * n, length + AHEAD))
        n = min(2 * n, length + AHEAD)
    beside = {"prev": F.lag("code", 1), "next": F.lead("code", length), "far": F.lead("code", length + AHEAD)} | {f"a{k}": F.lead("code", length + k) for k in range(AHEAD)}
    named = named.withColumns({k: v.over(w) for k, v in beside.items()}).filter(F.col("short").isNotNull())
    return named.select(key, "pos", F.col("short.h0").alias("g0"), F.col("short.h1").alias("g1"), "prev", "next", *(f"a{k}" for k in range(AHEAD)), F.col("gram.h0").alias("f0"), F.col("gram.h1").alias("f1"), "far")


def doubled_names(positions: DataFrame, least: int, longest: int, key: str = "seq_id") -> DataFrame:
    """(key, min_length, g0, g1, prev): names of the grams of `least` nodes, twice as many and so on up to `longest`, with the
    code of the node before (null at a path's beginning). All from one exchange and sort."""
    w = Window.partitionBy(key).orderBy("pos")
    named = positions.select(key, "pos", node_code(F.col("node"), positions.schema["node"].dataType.typeName()).alias("code"), F.struct(*(F.xxhash64(F.lit(s), "node").alias(f"h{i}") for i, s in enumerate(SALTS))).alias("gram"))
    named = named.withColumn("prev", F.lag("code", 1).over(w))
    n, levels = 1, []
    while True:
        if n >= least:
            named = named.withColumn(f"n{n}", F.struct(F.lit(n).cast("long").alias("min_length"), "gram"))
            levels.append(f"n{n}")
        to = 2 * n if n >= least else min(2 * n, least)
        if to > max(longest, least):
            break
        named = named.withColumn("ahead", F.lead("gram", to - n).over(w)).withColumn("gram", F.when(F.col("ahead").isNotNull(), _pair(F.col("gram"), F.col("ahead")))).drop("ahead")
        n = to
    each = named.select(key, "prev", F.explode(F.array(*levels)).alias("x")).filter("x.gram IS NOT NULL")
    return each.select(key, "x.min_length", F.col("x.gram.h0").alias("g0"), F.col("x.gram.h1").alias("g1"), "prev")


def names_of_lengths(positions: DataFrame, lengths: list[int], key: str = "seq_id") -> DataFrame:
    """(key, pos, n, g0, g1): the name of the n nodes from pos on, for each n of lengths, as gram_names() gives it. All from one
    exchange and sort."""
    if min(lengths) < 1:
        raise ValueError("a gram has 1 node at least")
    w = Window.partitionBy(key).orderBy("pos")
    named = positions.select(key, "pos", F.struct(*(F.xxhash64(F.lit(s), "node").alias(f"h{i}") for i, s in enumerate(SALTS))).alias("gram"))
    n, levels = 1, []
    while True:
        for m in sorted(set(lengths)):
            if n <= m < 2 * n:
                ahead = F.lead("gram", m - n).over(w)
                named = named.withColumn(f"n{m}", F.col("gram") if m == n else F.when(ahead.isNotNull(), _pair(F.col("gram"), ahead)))
                levels.append(F.when(F.col(f"n{m}").isNotNull(), F.struct(F.lit(m).cast("long").alias("n"), F.col(f"n{m}").alias("gram"))))
        if 2 * n > max(lengths):
            break
        named = named.withColumn("ahead", F.lead("gram", n).over(w)).withColumn("gram", F.when(F.col("ahead").isNotNull(), _pair(F.col("gram"), F.col("ahead")))).drop("ahead")
        n *= 2
    each = named.select(key, "pos", F.explode(F.array(*levels)).alias("x")).filter("x IS NOT NULL")
    return each.select(key, "pos", "x.n", F.col("x.gram.h0").alias("g0"), F.col("x.gram.h1").alias("g1"))


#: Bits of the table that sharing() sends to all tasks: 2 MB, in blocks of 4 KB, the size of Spark's bitmaps.
BITS, BLOCKS = 1 << 24, 512


def _rolled(codes: np.ndarray, length: int) -> np.ndarray:
    """Three numbers below BITS for each gram of `length` codes, as rows; the same for equal grams."""
    n = len(codes) - length + 1
    if n < 1:
        return np.zeros((3, 0), np.int64)
    x, h = codes.astype(np.int64).view(np.uint64), np.zeros(n, np.uint64)
    for k in range(length):
        h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.stack([h >> np.uint64(40), h >> np.uint64(20), h]).astype(np.int64) & (BITS - 1)


def sharing(sequences: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """The sequences (seq_id, path array) that may have a gram of `length` nodes in common with queries (query_id, pos, node):
    all that do, and few others. The queries' grams are a table of bits of fixed size; sequences are looked up in it where
    they are read, so none is sent anywhere."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            for x in b.column(0):
                bits[_rolled(x.values.to_numpy(zero_copy_only=False), length)] = True
        parts = bits.reshape(BLOCKS, -1)
        some = np.flatnonzero(parts.any(1)).tolist()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())], names=["block", "bits"])

    own = queries.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.xxhash64("node").alias("code")))), lambda x: x["code"]).alias("codes"))
    marked = own.select("codes").mapInArrow(mark, "block int, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = np.zeros((BLOCKS, BITS // BLOCKS), bool)
    for block, x in marked.collect():  # of bounded number
        bits[block] = np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool)
    sent = sequences.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def may(codes: pd.Series) -> pd.Series:
        return pd.Series([x is not None and bool(sent.value[_rolled(np.asarray(x), length)].all(0).any()) for x in codes], dtype=bool)

    return sequences.filter(may(F.transform("path", lambda x: F.xxhash64(x))))


def pattern_name(nodes: list, kind: str) -> tuple[Column, Column]:
    """The name of one pattern, as gram_names() gives it."""
    level = [F.struct(*(F.xxhash64(F.lit(s), F.lit(x).cast(kind)).alias(f"h{i}") for i, s in enumerate(SALTS))) for x in nodes]
    n = 1
    while 2 * n <= len(nodes):
        level = [_pair(level[i], level[i + n]) for i in range(len(level) - n)]
        n *= 2
    name = _pair(level[0], level[len(nodes) - n]) if n < len(nodes) else level[0]
    return name["h0"], name["h1"]
