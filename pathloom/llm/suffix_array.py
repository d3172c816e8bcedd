"""Exact substring dedup over bytes: suffixes sorted by digits, most significant first, and only as deep as a window.

Only the first WIDTH bytes of a suffix decide whether the window that it begins repeats, so suffixes are put in order
through that depth alone. They go to tasks by the anchor of their window (repeats.py), whole runs of neighbouring suffixes
at once, so a task's first buckets are its anchors. Each pass puts the suffixes of a bucket in order of their next digit of
DIGIT bytes and makes a bucket of each value; a bucket of one suffix is done. The buckets that are left after the last
pass are exactly the repeated windows. A digit's order is found by doubling: of 2n bytes, from the ranks of n.

The suffixes of an anchor that has too many for a task are dealt by what they share (repeats.py), and by their first digits
at last, one more at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_rows, small_batches, text_key, texts
from .repeats import Found, Shape, covered, deal, find, lists, ranges, spans, stretches

WIDTH, GRAM, DIGIT = 400, 64, 64
#: Suffixes that a task may hold.
LIMIT = 400_000


def symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def cut(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [text[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def digits(x: np.ndarray, size: int) -> np.ndarray:
    """The ranks of all stretches of `size` bytes, a power of two, among one another."""
    rank, n = x.astype(np.int64), 1
    while n < size:
        if 2 * n <= 4:  # still small enough as they are: numbers of two or four bytes
            rank = (rank[:-n] << 8 * n) | rank[n:]
        else:
            rank = rank if n > 4 else _rank(rank)
            rank = _rank(rank[:-n] * (int(rank.max(initial=0)) + 1) + rank[n:])
        n *= 2
    return rank


def msd_passes(x: np.ndarray, at: np.ndarray, bucket: np.ndarray, weight: np.ndarray, width: int, digit: int = DIGIT) -> np.ndarray:
    """Which of the suffixes that begin at `at` in the bytes x share their first `width` bytes with another suffix of their
    bucket, or stand for several suffixes themselves: numbers of suffixes, in the order of bucket and bytes."""
    while digit > width:
        digit //= 2
    rank = digits(x, digit)
    some, bucket = np.arange(len(at)), _rank(bucket)
    for offset in [*range(0, width - digit, digit), width - digit]:
        if not len(some):
            break
        own = rank[at[some] + offset]
        bucket = _rank(bucket * (int(own.max()) + 1) + own)
        left = np.bincount(bucket, weight[some])[bucket] > 1
        some, bucket = some[left], bucket[left]
    return some[np.argsort(bucket, kind="stable")]


def order(table: pa.Table, width: int, digit: int = DIGIT) -> pa.Table:
    """FOUND (see repeats.py) of a task's suffixes."""
    run, place, weight, windows = (table.column(c).to_numpy() for c in ("run", "place", "weight", "windows"))
    anchor = _rank(table.column("anchor").to_numpy())
    alone = (np.bincount(anchor)[anchor] == 1) & (weight > 1)  # of a bucket of one class, each suffix stands for several
    region = table.column("region").filter(pa.array(~alone)).to_pylist()
    x = np.frombuffer(b"".join(region), np.uint8)
    base = np.zeros(len(run), np.int64)
    base[~alone] = np.cumsum([0, *map(len, region)])[:-1]
    which, at = ranges(base, np.where(alone, 0, windows))
    found = np.sort(msd_passes(x, at, anchor[which], weight[which], width, digit))
    k, s, e = stretches((at - base[which] + place[which])[found], which[found], width)
    whole = np.flatnonzero(alone)
    k, s, e = np.append(k, whole), np.append(s, place[whole]), np.append(e, place[whole] + windows[whole] - 1 + width)
    return pa.table({"run": pa.array(run[k]), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))})


def sorted_suffixes(listed: DataFrame, width: int, gram: int, limit: int = LIMIT, digit: int = DIGIT) -> DataFrame:
    """FOUND of classes of runs (see repeats.find)."""
    return deal(listed, symbols, cut, Shape(width, gram), tuple(range(digit, width, digit)), limit, lambda table: order(table, width, digit))


def repeated_bytes(docs: DataFrame, width: int, gram: int, id_col: str, text_col: str, limit: int = LIMIT) -> Found:
    if gram > width:
        raise ValueError("windows are too narrow")
    return find(texts(docs, id_col, text_col, as_bytes=True), symbols, cut, Shape(width, gram), lambda x: sorted_suffixes(x, width, gram, limit))


def whole(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without bytes of characters that it has only in part."""
    part = (x & 0xC0) == 0x80  # not the first byte of a character
    out = np.zeros(len(x), bool)
    for a, b in spans(mask).T.tolist():
        while a < b and part[a]:
            a += 1
        while a < b < len(x) and part[b]:
            b -= 1
        out[a:b] = True
    return out


def _all_rows(found: Found, run: Callable[[bytes, tuple | None], tuple], schema: str, kinds: tuple[pa.DataType, ...]) -> DataFrame:
    """A row for each row of docs, from run(text, gone)."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        gone = lists(b.column(2)) if b.num_columns > 2 else [None] * b.num_rows
        out = zip(*(run(t.as_py(), g) for t, g in zip(b.column(1), gone, strict=True)), strict=True)
        names_ = [b.schema.names[0], *(x.split()[0] for x in schema.split(", "))]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names_)

    clean = map_rows(found.clean, of, f"doc_id long, {schema}", 200)
    return clean.unionByName(found.rows.join(map_rows(found.texts, of, f"key binary, {schema}", 200), "key").drop("key"))


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row: its text in UTF-8 without the bytes that lie in a
    window of `width` bytes that also starts anywhere else, in the same text or another. All copies go, the first too.
    whole_characters: characters are kept that only in part would be removed, so that kept is UTF-8.

    Null texts are empty; texts shorter than a window keep everything; rows that repeat remove one another, whatever
    their doc_id, which may be null. Other columns don't matter; an empty table gives no rows. A text that many rows have
    is examined once."""

    def run(text: bytes, gone: tuple | None) -> tuple:
        x = np.frombuffer(text, np.uint8)
        mask = covered(len(x), gone)
        mask = whole(x, mask) if whole_characters else mask
        return len(x), int(mask.sum()), spans(mask).shape[1], x[~mask].tobytes()

    long = pa.int64()
    return _all_rows(repeated_bytes(docs, width, gram, id_col, text_col, limit), run, "n_bytes long, n_removed long, n_spans long, kept binary", (long, long, long, pa.binary()))


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove(), with kept_sha256 for kept."""

    def run(text: bytes, gone: tuple | None) -> tuple:
        if gone is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        mask = covered(len(text), gone)
        removed = int(mask.sum())
        return len(text), removed, spans(mask).shape[1], hashlib.sha256(np.frombuffer(text, np.uint8)[~mask]).hexdigest()

    long = pa.int64()
    return _all_rows(repeated_bytes(docs, width, gram, id_col, text_col), run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", (long, long, long, pa.string()))


def strip(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all rows and columns, with repeated bytes taken out of their texts at whole characters; null texts stay null,
    and rows that repeat are stripped alike. length_col: gets the new length in characters, where a text has changed. An
    empty table stays empty; columns may have any names, `key`, `new` and `row` too, as long as no two are the same."""
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.coalesce(text, F.lit(""))).alias("key"))
    found = repeated_bytes(small_batches(docs).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), width, gram, "doc_id", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for t, gone in zip(b.column(1), lists(b.column(2)), strict=True):
            x = np.frombuffer(t.as_py(), np.uint8)
            new.append(x[~whole(x, covered(len(x), gone))].tobytes().decode())
        return batch(key=b.column(0), new=pa.array(new, pa.string()))

    cut_ = map_rows(found.texts, run, "key binary, new string", 200)
    hit = F.col("new").isNotNull() & F.col(f"row.`{text_col}`").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.when(hit, F.col("new")).otherwise(F.col(f"row.`{text_col}`"))}
    if length_col:
        columns[length_col] = F.when(hit, F.length("new")).otherwise(F.col(f"row.`{length_col}`")).cast(docs.schema[length_col].dataType)
    may = found.may(F.col("key"))
    marked = own.withColumn("hit", may)
    return marked.filter("NOT hit").select("row.*").unionByName(marked.filter("hit").join(cut_, "key", "left").select(*(v.alias(c) for c, v in columns.items())))
