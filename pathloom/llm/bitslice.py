"""Exact top-k by inner product over a bit-sliced index.

Components become integers floor(scale * x). A block of vectors is kept as slices: for each dimension, the top bits of
its shifted integers, a bitmap of the block's rows for each bit. A query's score of all rows of a block is added up with
bitmap arithmetic alone: the slices of a dimension, flipped where the query's component is negative, are added by
carry-save adders at the places of the bits of the component's magnitude. The result is bit-sliced as well. The top rows
come from its most significant slice downward: while more rows than asked for have the bit, the rest drop out. Dropped
bits make the sum inexact by no more than a bound that the norms of query and remainder give (Cauchy-Schwarz), so rows
whose sum is within twice that bound of the last top row are resolved with the exact integers.

Vectors with components so large that a score might not fit 64 bits aren't sliced: their scores are sums of Python's
integers, and scores beyond 64 bits count as the largest or the smallest of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, KEPT_BITS = 256, 4
#: Rows of a block of vectors, at most and at least, and of a block of queries.
BLOCK, LEAST, QUERIES = 8192, 1024, 32_768
#: Queries whose sums are held at once, of a block of BLOCK rows.
AT_ONCE = 32
MOST = (1 << 63) - 1


def small(vectors: np.ndarray) -> np.ndarray:
    """Which vectors have components so small that no score with another such one reaches 2 ** 62."""
    limit = 1 << ((62 - max(1, vectors.shape[1]).bit_length()) // 2 - SCALE.bit_length())
    return (np.abs(vectors) < limit).all(1)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), for vectors that are small()."""
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def large_integers(vector: np.ndarray) -> list[int]:
    """The same for any finite components: from 2 ** 53 on they are integers themselves."""
    return [int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in vector.tolist()]


def score_of(a: list[int], b: list[int]) -> int:
    return max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(a, b, strict=True))))


def slowly(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """top() by Python's integers, for all pairs of a row and a query of which one isn't small."""
    fits, asked = small(rows), small(queries)
    each = [large_integers(x) for x in rows]
    for q, own, fit in zip(queries, query_ids.tolist(), asked, strict=True):
        whole, best = large_integers(q), {}
        for i in np.flatnonzero(ids != own) if not fit else np.flatnonzero((ids != own) & ~fits):
            best[int(ids[i])] = max(best.get(int(ids[i]), -MOST - 1), score_of(each[i], whole))
        yield from ((own, i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])


def bitmap(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans along the last axis as bitmaps of 64-bit words."""
    gap = -rows.shape[-1] % 64
    bits = np.packbits(np.pad(rows, [(0, 0)] * (rows.ndim - 1) + [(0, gap)]), axis=-1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little", count=n).astype(bool)


@dataclass
class Index:
    """slices[d][b]: the bitmap of the b-th lowest kept bit of dimension d; low: the least integer; drop: bits left out."""

    exact: np.ndarray
    slices: np.ndarray
    low: int
    drop: int
    rest: float  # the largest norm of what the dropped bits hold, about their middle

    @classmethod
    def of(cls, x: np.ndarray, kept: int = KEPT_BITS) -> Index:
        low = int(x.min())
        drop = max(0, int(x.max() - low).bit_length() - kept)
        u = (x - low) >> drop
        slices = np.stack([bitmap((u.T >> b & 1).astype(bool)) for b in range(max(1, int(u.max()).bit_length()))], 1)
        rest = (x - low) - (u << drop) - ((1 << drop) - 1) / 2
        return cls(x, slices, low, drop, float(np.sqrt((rest * rest).sum(1).max())))


def add_slices(index: Index, queries: np.ndarray) -> list[np.ndarray]:
    """For each query a bit-sliced sum over the rows: slices from the least significant, each queries x words."""
    d, bits, words = index.slices.shape
    magnitude, flip = np.abs(queries), np.where(queries < 0, ~np.uint64(0), np.uint64(0))
    columns: list[list[np.ndarray]] = []
    out: list[np.ndarray] = []

    def put(place: int, x: np.ndarray) -> None:
        """A carry-save adder takes three bitmaps of one place to one of it and one of the next."""
        while len(columns) <= place:
            columns.append([])
        columns[place].append(x)
        if len(columns[place]) == 3:
            a, b, c = columns[place]
            ab = a ^ b
            columns[place] = [ab ^ c]
            put(place + 1, (a & b) | (ab & c))

    for j in range(d):
        for k in range(int(magnitude[:, j].max()).bit_length()):
            taken = np.where(magnitude[:, j] >> k & 1, ~np.uint64(0), np.uint64(0))[:, None]
            for b in range(bits):
                put(b + k, (index.slices[j, b][None, :] ^ flip[:, j, None]) & taken)
    carry, place = None, 0
    while place < len(columns) or carry is not None:
        held = [*(columns[place] if place < len(columns) else []), *([carry] if carry is not None else [])]
        carry = None
        if len(held) == 3:
            a, b, c = held
            ab = a ^ b
            out.append(ab ^ c)
            carry = (a & b) | (ab & c)
        elif len(held) == 2:
            out.append(held[0] ^ held[1])
            carry = held[0] & held[1]
        else:
            out.append(held[0] if held else np.zeros((len(queries), words), np.uint64))
        place += 1
    return out


def highest(sums: list[np.ndarray], k: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each query, of the rows in its bitmap, the k-th highest sum, from the most significant slice downward."""
    left, wanted, least = rows.copy(), k.copy(), np.zeros(len(k), np.int64)
    for place in range(len(sums) - 1, -1, -1):
        have = left & sums[place]
        n = np.bitwise_count(have).sum(1).astype(np.int64)
        go = n >= wanted  # the k-th highest has this bit
        left = np.where(go[:, None], have, left & ~sums[place])
        least += np.where(go, 1 << place, 0)
        wanted = np.where(go, wanted, wanted - n)
    return least


def at_least(sums: list[np.ndarray], limit: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is at least the query's limit."""
    over, level = np.zeros_like(rows), rows.copy()
    limit = np.clip(limit, 0, None)
    for place in range(len(sums) - 1, -1, -1):
        bit = (limit >> place & 1).astype(bool)[:, None]
        over |= np.where(bit, np.uint64(0), level & sums[place])
        level &= np.where(bit, sums[place], ~sums[place])
    return over | level


def rows_of(ids: np.ndarray, k: int) -> int:
    """So many rows hold k distinct ids, whichever rows they are: one more than k - 1 ids have at most."""
    counts = np.unique(ids, return_counts=True)[1]
    return int(np.sort(counts)[::-1][: k - 1].sum()) + 1


def top(index: Index, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score): the k best ids of the block for each query, each by its best row, ties to the smaller id."""
    n, enough = len(ids), rows_of(ids, k)
    all_rows = bitmap(np.ones((1, n), bool))
    step = AT_ONCE * max(1, BLOCK // max(n, LEAST))
    for s in range(0, len(queries), step):
        q, own = queries[s : s + step], query_ids[s : s + step]
        rows = np.repeat(all_rows, len(q), 0) & ~bitmap(ids[None, :] == own[:, None])
        there = np.bitwise_count(rows).sum(1).astype(np.int64)
        sums = add_slices(index, q)
        wanted = np.minimum(enough, there)
        least = highest(sums, np.maximum(wanted, 1), rows)
        # a sum counts steps of 2 ** drop; a score differs from it by an offset of the query, and by no more than this:
        bound = np.sqrt((q.astype(float) ** 2).sum(1)) * index.rest / (1 << index.drop)
        near = unpack(at_least(sums, np.floor(least - 2 * bound - 1e-6 * np.abs(least) - 1).astype(np.int64), rows), n)
        for i in np.flatnonzero(there):
            found = np.flatnonzero(near[i])
            score = index.exact[found] @ q[i]
            best = np.lexsort((ids[found], -score))
            best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]
            yield from ((int(own[i]), int(ids[found[b]]), int(score[b])) for b in best)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows with the highest
    inner product of integers, ties to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
    another length than the query's aren't its candidates. Rows that share an id and a vector count once; of rows that
    share an id but no vector, each is a candidate, the best is kept, and as queries they compete for one list. Other
    columns don't matter. Blocks of rows meet blocks of queries in tasks of their own: what is shuffled is the rows times
    the number of query blocks and the queries times the number of row blocks, after one exchange in which repeated rows
    drop out; nothing is broadcast. A block returns its k best ids for a query, so other rows of one id take no places.
    Blocks have `block` rows; by default, as many as give each shuffle partition two, within LEAST and BLOCK. Scores beyond
    64 bits are the largest or the smallest of 64 bits, and tie."""
    v = F.col("v")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))
    own = own.filter(F.size("v") > 0).select("id", "v", F.size("v").alias("n"))
    rows, asked = own.count(), own.filter(F.col("id") % every == 0).count()
    block = block or min(BLOCK, max(LEAST, rows // (2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    blocks, query_blocks = max(1, -(-rows // block)), max(1, -(-asked // query_block))
    own = own.dropDuplicates(["id", "v"])
    number = lambda kind, n: F.pmod(F.xxhash64("id", F.lit(kind)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select(number("row", blocks).cast("int").alias("rb"), "n", "id", "v").withColumn("qb", each(query_blocks)).withColumn("asked", F.lit(False))
    right = own.filter(F.col("id") % every == 0).select(number("query", query_blocks).cast("int").alias("qb"), "n", "id", "v").withColumn("rb", each(blocks)).withColumn("asked", F.lit(True))

    def meet(table: pa.Table) -> pa.Table:
        ids, flag = np.asarray(table.column("id").combine_chunks()), table.column("asked").to_numpy()
        n = table.column("n")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, n).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, flag, x = ids[order], flag[order], x[order]
        q, c = np.flatnonzero(flag), np.flatnonzero(~flag)
        fits, found = small(x), []
        if len(q) and len(c):
            if not fits.all():
                found += slowly(x[c], ids[c], x[q], ids[q], k)
            q, c = q[fits[q]], c[fits[c]]
        if len(q) and len(c):
            found += top(Index.of(integers(x[c])), ids[c], integers(x[q]), ids[q], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(y, pa.int64()) for y in (zip(*found, strict=True) if found else ([], [], []))), strict=True)))

    met = left.unionByName(right).groupBy("rb", "qb", "n").applyInArrow(meet, "query_id long, vec_id long, score long")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
