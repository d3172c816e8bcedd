"""Exact substring dedup over words: suffix trees of parts of the corpus that variable-length prefixes cut out.

A suffix's prefix is its words up to the end of the anchor of its first window (repeats.py), so prefixes differ in length,
and suffixes that share a window share their prefix. Prefixes go to tasks by their anchors, as many as fit the memory of
a task, whole runs of neighbouring suffixes at once; the suffixes of an anchor that has too many are dealt by longer
prefixes (repeats.py), of 12 words, 24, and a window at last. A task builds the tree of its suffixes, to the depth of a window: the suffixes in order, the
longest common prefixes of neighbours, in words, and the inner nodes, which are the stretches of neighbours with a common
prefix. Inner nodes as deep as a window are the maximal repeats, and their leaves are the windows to remove.

Words are numbered in each task by themselves, not by hashes, so a tree is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import IS_SPACE, SPACE, map_rows, new_salt, texts, word_names
from .repeats import Shape, Symbols, covered, deal, find, lists, ranges, stretches

WIDTH, GRAM = 35, 12
#: Suffixes that a task may hold.
LIMIT = 200_000
WORD = re.compile(rb"[^ \t-\r]+")
CHUNK = 1 << 18


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text)


def some_words(text: bytes) -> Iterator[list[bytes]]:
    """words(text), in lists of what about CHUNK bytes hold."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + CHUNK)
        end = space.start() if space else len(text)
        yield WORD.findall(text, at, end)
        at = end


def cut(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Stretches of words, each word followed by one space but the last."""
    inside = np.concatenate([[False], ~IS_SPACE[np.frombuffer(text, np.uint8)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2][starts], edge[1::2][starts + lengths - 1]
    return [b" ".join(WORD.findall(text, a, b)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


@dataclass(frozen=True)
class Tree:
    """A suffix tree to some depth: leaves (places of suffixes in the symbols) in order, and how many symbols each has in
    common with the one before."""

    leaves: np.ndarray
    common: np.ndarray
    depth: int

    @classmethod
    def of(cls, numbers: np.ndarray, suffixes: np.ndarray, depth: int) -> Tree:
        """numbers: symbols as integers from 0 on; each suffix has `depth` of them at least."""
        rank, n = {1: numbers.astype(np.int64)}, 1
        while 2 * n <= depth:  # ranks of stretches of 2n symbols, from those of n
            rank[2 * n] = _rank(rank[n][:-n], rank[n][n:])
            n *= 2
        last = rank[n][suffixes] if n == depth else _rank(rank[n][suffixes], rank[n][suffixes + depth - n])
        order = np.argsort(last, kind="stable")
        leaves = suffixes[order]
        common = np.zeros(len(leaves), np.int64)
        a, b = leaves[:-1], leaves[1:]
        same = np.zeros(len(b), np.int64)
        full = last[order][1:] == last[order][:-1]
        for k in sorted(rank, reverse=True):
            at = np.minimum(same, depth - k)  # the last steps may look at symbols once more
            equal = rank[k][a + at] == rank[k][b + at]
            same = np.where(equal, np.maximum(same, at + k), same)
        common[1:] = np.where(full, depth, same)
        return cls(leaves, common, depth)

    def nodes(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Inner nodes by depth, from `least` on: (depth, first leaves, leaves after their last ones)."""
        for depth in range(least, self.depth + 1):
            inside = np.append(self.common >= depth, False)
            inside[0] = False
            edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
            first, last = edge[::2], edge[1::2] + 1  # common[k] is between leaves k - 1 and k
            if len(first):
                low = np.array([self.common[i + 1 : j].min() for i, j in zip(first, last, strict=True)]) if depth < self.depth else np.full(len(first), depth)
                yield depth, first[low == depth], last[low == depth]


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs, from 0 on in their order."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def grow(table: pa.Table, width: int) -> pa.Table:
    """FOUND (see repeats.py) from the tree of a task's suffixes."""
    run, place, weight, windows = (table.column(c).to_numpy() for c in ("run", "place", "weight", "windows"))
    numbers: dict[bytes, int] = {}
    each = [[numbers.setdefault(w, len(numbers)) for w in words(region.as_py())] for region in table.column("region")]
    base = np.cumsum([0, *map(len, each)])[:-1]
    x = np.fromiter((i for r in each for i in r), np.int64)
    del each
    which, at = ranges(base, windows)
    tree = Tree.of(x, at, width)
    hit = np.zeros(len(x), bool)
    for _, first, last in tree.nodes(width):
        hit[tree.leaves[ranges(first, last - first)[1]]] = True
    hit[at[weight[which] > 1]] = True  # a leaf that stands for several suffixes is a node by itself
    found = hit[at]
    k, s, e = stretches((at - base[which] + place[which])[found], which[found], width)
    return pa.table({"run": pa.array(run[k]), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))})


def trees(listed: DataFrame, symbols: Symbols, width: int, gram: int, limit: int = LIMIT) -> DataFrame:
    """FOUND of classes of runs (see repeats.find): which windows are leaves below an inner node as deep as they are wide."""
    lengths = tuple(range(gram, width, gram))
    return deal(listed, symbols, cut, Shape(width, gram), lengths, limit, lambda table: grow(table, width))


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: its words, joined by a space, without those that lie in a
    window of `width` words that also starts anywhere else, in the same text or another. All copies go, the first too.
    digest: kept_sha256 instead of kept.

    Null texts have no words; texts shorter than a window keep everything; rows that repeat remove one another, whatever
    their doc_id, which may be null. Other columns don't matter; an empty table gives no rows. A text that many rows have
    is examined once."""
    salt = new_salt()
    symbols = lambda text: np.ascontiguousarray(word_names(text, salt).T)
    found = find(texts(docs, id_col, text_col, as_bytes=True), symbols, cut, Shape(width, gram), lambda x: trees(x, symbols, width, gram, limit))
    name = "kept_sha256" if digest else "kept"

    def one(text: bytes, gone: tuple | None) -> tuple:
        mask = None if gone is None else covered(sum(map(len, some_words(text))), gone)
        n, parts, sha = 0, [], hashlib.sha256()
        for some in some_words(text):
            left = some if mask is None else list(compress(some, (~mask[n : n + len(some)]).tolist()))
            n += len(some)
            if left and digest:
                sha.update(b" " * bool(parts) + b" ".join(left))
                parts = [b""]
            elif left:
                parts.append(b" ".join(left))
        return n, 0 if mask is None else int(mask.sum()), sha.hexdigest() if digest else b" ".join(parts).decode(errors="replace")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        gone = lists(b.column(2)) if b.num_columns > 2 else [None] * b.num_rows
        n, removed, kept = zip(*(one(t.as_py(), g) for t, g in zip(b.column(1), gone, strict=True)), strict=True)
        long = pa.int64()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, long), pa.array(removed, long), pa.array(kept, pa.string())], names=[b.schema.names[0], "n_words", "n_removed", name])

    schema = f"n_words long, n_removed long, {name} string"
    clean = map_rows(found.clean, run, f"doc_id long, {schema}", 200)
    return clean.unionByName(found.rows.join(map_rows(found.texts, run, f"key binary, {schema}", 200), "key").drop("key"))
