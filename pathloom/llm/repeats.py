"""Windows that occur more than once: the part that the two substring operators share.

A window is `width` consecutive symbols of one text. Its anchor is the smallest hash among its `gram`-symbol grams, so
equal windows have equal anchors, and neighbouring windows mostly share theirs: a run is a stretch of windows with one
anchor, as long as the windows in it still overlap. This rules windows out, and deals the others to tasks:

1. Each distinct text is looked at once, with the number of rows that have it as its weight.
2. Runs are counted by anchor. An anchor of one run, of weight one, has no repeated window if the run holds it once.
3. Runs of one anchor that cover the same symbols are one class, which has the sum of their weights.
4. Each class is written out with the text that it covers, and the operator's own method compares the classes' windows,
   symbol by symbol. A class of weight two or more stands for so many windows at each of its places.

Symbols are bytes, or salted 128-bit names of words (common.word_names). That runs are of one class is told by 128 bits of
BLAKE2b of all symbols that they cover. Anchors come from 64-bit hashes, and names of grams double in length: a name of 2n
symbols is a mix of two names of n. These only deal windows to tasks, where those that collide are told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, release, text_key
from .sieve import sieve
from .storage import scratch, stash

U = np.uint64
#: Odd multipliers of the mixing steps.
M1, M2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: A hash of each byte.
BYTES = (np.arange(1, 257, dtype=U) * M1 ^ (np.arange(1, 257, dtype=U) * M2 >> U(31))) * M2
#: Symbols that are handled at once; longer texts are cut into overlapping parts.
PART = 1 << 17
#: Blocks of windows that a run is cut into where its anchor has too many.
BLOCKS = 16


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int

    @property
    def span(self) -> int:
        """Grams in a window, and windows in a run at most."""
        return self.width - self.gram + 1


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * M1
    x += b
    x ^= x >> U(29)
    x *= M2
    x ^= x >> U(32)
    return x


def names(symbols: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Names of all grams of these lengths; those that would begin too late for their length are missing."""
    found: dict[int, np.ndarray] = {}
    n, now = 1, symbols
    while True:
        for k in lengths:
            if n <= k < 2 * n:
                found[k] = now if k == n else mix(now[: max(0, len(now) - (k - n))], now[k - n :])
        if 2 * n > max(lengths):
            return [found[k] for k in lengths]
        now = mix(now[: max(0, len(now) - n)], now[n:])
        n *= 2


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of so many numbers from each first on, one after the other: which stretch, and the number."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of (np.minimum, np.maximum) of each n neighbours"""
    k = 1
    while 2 * k <= n:
        x = of(x[:-k], x[k:])
        k *= 2
    return of(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def runs(symbols: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in symbols (bounds: where they begin, and the end): for each run, its text's
    number, its first window's start, number of windows, the anchor, and whether it may hold the anchor more than once."""
    w = shape.width
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    ok = np.flatnonzero(sizes >= w)
    if not len(ok):
        return none, none, none, none.astype(U), none.astype(bool)
    (gram,) = names(symbols, shape.gram)
    least = slide(gram, shape.span, np.minimum)
    edge = np.zeros(shape.span - 1, U)
    some = np.flatnonzero(gram == slide(np.concatenate([edge, least, edge]), shape.span, np.maximum))  # grams that are anchors
    twice = np.concatenate([[0], np.cumsum(gram[some[1:]] == gram[some[:-1]]), [0]])  # between two places of a run's anchor lies no other
    _, starts = ranges(bounds[ok], sizes[ok] - w + 1)
    anchor = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(since % shape.span == 0)
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    text = np.searchsorted(bounds, at, "right") - 1
    low, high = np.searchsorted(some, at), np.searchsorted(some, at + count - 1 + shape.span) - 1
    return text, at - bounds[text], count, anchor[first], twice[high] > twice[low]


def hashed(x: np.ndarray) -> np.ndarray:
    """64 bits of each symbol: of a byte, or of a word's name (a row of two halves)."""
    return BYTES[x] if x.dtype == np.uint8 else x[:, 0]


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def parts(arrays: Iterator[np.ndarray], width: int) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray], np.ndarray, np.ndarray]]:
    """Symbols in parts of about PART: (number of the text, offset in it) of each piece, the pieces, the hashes of their
    symbols, bounds."""
    held: list[np.ndarray] = []
    ids: list[tuple[int, int]] = []
    size = 0

    def done():
        return ids, held, np.concatenate([hashed(x) for x in held]), np.cumsum([0, *map(len, held)])

    for i, x in enumerate(arrays):
        for s in range(0, max(1, len(x) - width + 1), PART):
            piece = x[s : s + PART + width - 1]
            if len(piece) < width:
                continue
            held.append(piece)
            ids.append((i, s))
            size += len(piece)
            if size >= PART:
                yield done()
                held, ids, size = [], [], 0
    if held:
        yield done()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: A text's symbols, as names of words or as bytes.
Symbols = Callable[[bytes], np.ndarray]
#: Gives stretches (starts, lengths) of a text's symbols as texts of their own.
Cut = Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
#: What compare functions return: stretches of repeated windows, from one symbol to another, counted from their run's start.
FOUND = "run long, s int, e int"


@dataclass(frozen=True)
class Found:
    """clean: (doc_id, text) of rows without a repeated window. Of the others, rows: (doc_id, key), and texts: (key, text,
    gone) of the distinct texts, where gone (null if none) is for covered(). may: whether a key is of these texts."""

    clean: DataFrame
    rows: DataFrame
    texts: DataFrame
    may: Callable[[Column], Column]


def find(docs: DataFrame, symbols: Symbols, cut: Cut, shape: Shape, compare: Callable[[DataFrame], DataFrame]) -> Found:
    """docs: (doc_id, text binary). compare: gets classes of runs as (run long, anchor long, weight long, windows int,
    region binary): a number, the anchor, how many runs they are, how many windows a run has, and the text of all that
    these cover. It returns FOUND for the windows that occur twice or more, in weight. Equal windows have equal anchors."""
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = lambda y: pa.array(y.astype(np.int32))
        for b in batches:
            keys, weights = b.column(0), b.column(2)
            for ids, pieces, x, bounds in parts((symbols(t.as_py()) for t in b.column(1)), shape.width):
                text, at, count, anchor, inner = runs(x, bounds, shape)
                if len(text):
                    which, offset = np.array(ids).T
                    row = pa.array(which[text])
                    whole = [digest(pieces[i][s : s + n]) for i, s, n in zip(text.tolist(), at.tolist(), (count + (shape.width - 1)).tolist(), strict=True)]
                    yield batch(key=keys.take(row), weight=weights.take(row), start=small(at + offset[text]), windows=small(count), anchor=signed(anchor), whole=pa.array(whole, pa.binary()), inner=pa.array(inner))
        release()

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, asked in zip(b.column(0), b.column(1), strict=True):
                start, windows, anchor, weight = (np.asarray(asked.values.field(k)) for k in (0, 1, 2, 4))
                whole = asked.values.field(3)
                for k in range(0, len(start), 2000):
                    some = slice(k, k + 2000)
                    region = cut(text.as_py(), start[some], windows[some] + (shape.width - 1))
                    yield batch(anchor=pa.array(anchor[some]), whole=whole.slice(k, 2000), weight=pa.array(weight[some]), windows=pa.array(windows[some]), region=pa.array(region, pa.binary()))
        release()

    with scratch():
        copied = stash(own.groupBy("key").agg(F.count("*").alias("weight")).filter("weight > 1"), "copied")
        has_copies = sieve(copied, "key")
        marked = own.withColumn("copied", has_copies(F.col("key")))
        several = marked.filter("copied").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("weight"))
        several = stash(several, "several", keep=True)  # copies are shuffled once, one of each map task at most
        distinct = marked.filter("NOT copied").select("key", "text", F.lit(1).cast("long").alias("weight")).unionByName(several)
        found = stash(distinct.select("key", "text", "weight").mapInArrow(anchors, "key binary, weight long, start int, windows int, anchor long, whole binary, inner boolean"), "runs")
        groups = stash(found.groupBy("anchor").agg(F.sum("weight").alias("n"), F.bool_or("inner").alias("inner")).filter("n > 1 OR inner").select("anchor"), "anchors")
        again = stash(found.filter(sieve(groups, "anchor")(F.col("anchor"))).join(groups, "anchor", "left_semi"), "again")
        classes = again.groupBy("anchor", "whole").agg(F.sum("weight").alias("weight"), F.min(F.struct("key", "start", "windows")).alias("run"))
        todo = classes.select("anchor", "whole", "weight", "run.*").groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor", "whole", "weight")).alias("runs"))
        todo = stash(todo, "classes")
        rows = distinct.filter(sieve(todo, "key")(F.col("key"))).select("key", "text").join(todo, "key").select("text", "runs")
        rows = rows.mapInArrow(regions, "anchor long, whole binary, weight long, windows int, region binary")
        listed = stash(rows.withColumn("run", F.monotonically_increasing_id()), "regions")  # numbers are fixed once written
        places = listed.select("run", "anchor", "whole").join(compare(listed.drop("whole")), "run").drop("run")
        gone = again.join(places, ["anchor", "whole"]).groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))).alias("gone"))
        gone = stash(gone, "gone", keep=True)
    may = sieve(gone, "key")
    marked = own.withColumn("hit", may(F.col("key")))
    once = marked.filter("hit").withColumn("copied", has_copies(F.col("key")))
    texts = once.filter("NOT copied").select("key", "text").unionByName(several.select("key", "text")).join(gone, "key", "left").select("key", "text", "gone")
    return Found(marked.filter("NOT hit").select("doc_id", "text"), marked.filter("hit").select("doc_id", "key"), texts, may)


def lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(s, e) of each row of an Arrow column of `gone`; None for null."""
    for x in column:
        yield None if x.values is None else (np.asarray(x.values.field(0)), np.asarray(x.values.field(1)))


def covered(n: int, gone: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which of a text's n symbols lie in a repeated window."""
    mask = np.zeros(n, bool)
    if gone is not None and len(gone[0]):
        order = np.argsort(gone[0], kind="stable")
        start, reach = gone[0][order], np.maximum.accumulate(gone[1][order])
        new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
        for a, b in zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist(), strict=True):
            mask[a:b] = True
    return mask


def stretches(place: np.ndarray, run: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FOUND (number of the run, s, e) for repeated windows, in order of run and place."""
    if not len(place):
        return run, place, place
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(run) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return run[first], place[first], place[last] + width


def spans(mask: np.ndarray) -> np.ndarray:
    """(starts, ends) of the maximal stretches of True, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).T


def deal(listed: DataFrame, symbols: Symbols, cut: Cut, shape: Shape, prefixes: tuple[int, ...], limit: int, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """FOUND of classes (see find) from work(), which gets the suffixes of a task as (anchor, run, place, weight, windows,
    region): place is that of the region's first window in its run.

    Classes are dealt to tasks by their anchor, many anchors to one task. An anchor of more than `limit` windows is split:
    its runs are cut into blocks of windows that have the anchor about as far from their start, and dealt by that and by
    what all windows of such a block share, which is nearly a whole window. The windows of blocks that still have too many
    are written out one by one, and dealt by a prefix of theirs; those whose prefix has too many, by the next longer one.
    Too many that are alike to the end aren't sorted, but counted."""
    width, step = shape.width, max(1, shape.span // BLOCKS)

    def worked(table: pa.Table) -> pa.Table:
        found = work(table)
        release()
        return found

    columns = ["anchor", "run", "place", "weight", "windows", "region"]
    own = listed.withColumn("place", F.lit(0)).select(*columns)
    sizes = own.groupBy("anchor").agg(F.sum("windows").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-4 * total // limit))
    task = lambda *by: F.pmod(F.xxhash64(*by), F.lit(tasks)).alias("task")
    heavy = stash(sizes.filter(F.col("n") > limit).select("anchor"), "heavy")
    if heavy.isEmpty():
        return own.select(task("anchor"), *columns).groupBy("task").applyInArrow(worked, FOUND)
    lengths = (*prefixes, width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                region, n, anchor = row.column(5)[0].as_py(), row.column(4)[0].as_py(), row.column(0).to_numpy().view(U)[0]
                x = hashed(symbols(region))
                gram, core = names(x, shape.gram, width - step + 1)
                at = np.flatnonzero(gram == anchor)
                first = at[np.searchsorted(at, np.arange(n))]  # where each window's anchor is first
                block = (first - np.arange(n)) // step
                new = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(first) != 0)))
                count = np.diff(np.append(new, n))
                one = pa.array(np.zeros(len(new), np.int64))
                shared = mix(core[first[new] - block[new] * step], block[new].astype(U))
                yield batch(anchor=row.column(0).take(one), run=row.column(1).take(one), place=pa.array(new.astype(np.int32)), weight=row.column(3).take(one), windows=pa.array(count.astype(np.int32)), region=pa.array(cut(region, new, count + (width - 1)), pa.binary()), shared=signed(shared))
        release()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                region, n, place = row.column(5)[0].as_py(), row.column(4)[0].as_py(), row.column(2)[0].as_py()
                found = names(hashed(symbols(region)), *lengths)
                for low in range(0, n, 500):
                    at = np.arange(low, min(n, low + 500))
                    one = pa.array(np.zeros(len(at), np.int64))
                    texts = cut(region, at, np.full(len(at), width))
                    yield batch(anchor=row.column(0).take(one), run=row.column(1).take(one), place=pa.array((place + at).astype(np.int32)), weight=row.column(3).take(one), windows=pa.array(np.ones(len(at), np.int32)), region=pa.array(texts, pa.binary()), **{f"p{i}": signed(f[at]) for i, f in enumerate(found)})
        release()

    kinds = "anchor long, run long, place int, weight long, windows int, region binary"
    own_blocks = stash(own.join(heavy, "anchor").select(*columns).mapInArrow(blocks, f"{kinds}, shared long"), "blocks")
    dealt = own.join(heavy, "anchor", "left_anti").select(task("anchor"), *columns)
    many = stash(own_blocks.groupBy("anchor", "shared").agg(F.sum("windows").alias("n")).filter(F.col("n") > limit).drop("n"), "many")
    dealt = dealt.unionByName(own_blocks.join(many, ["anchor", "shared"], "left_anti").select(task("anchor", "shared"), *columns))
    if many.isEmpty():
        return dealt.groupBy("task").applyInArrow(worked, FOUND)
    left = own_blocks.join(many, ["anchor", "shared"], "left_semi").select(*columns)
    left = stash(left.mapInArrow(windows, f"{kinds}, " + ", ".join(f"p{i} long" for i in range(len(lengths)))), "left")
    for i in range(len(lengths)):
        many = stash(left.groupBy("anchor", f"p{i}").count().filter(F.col("count") > limit).drop("count"), "many")
        dealt = dealt.unionByName(left.join(many, ["anchor", f"p{i}"], "left_anti").select(task("anchor", F.lit(i), f"p{i}"), *columns))
        left = stash(left.join(many, ["anchor", f"p{i}"], "left_semi"), "left")
    alike = left.groupBy("anchor", "region").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n")
    alike = left.join(alike, ["anchor", "region"], "left_semi").select("run", F.col("place").alias("s"), (F.col("place") + width).alias("e"))
    return dealt.groupBy("task").applyInArrow(worked, FOUND).unionByName(alike)
