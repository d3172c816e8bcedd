"""Phrases whose words stand together more often than chance has it: collocations, for each language.

Three passes over the texts, and none counts what can't be frequent:

1. Count-min sketches of words and pairs of words, of each task, are merged; a sketch never counts too few.
2. The same for three words and more, but only where the first sketch admits every pair in them: a phrase is no more frequent
   than its parts.
3. Phrases that both sketches admit are counted exactly, as strings, first in each task. So no frequent one is lost. A task
   sends its counts in ranges of phrases, a row for each, and a range's counts are added up as they come.

A sketch is cut into ranges of hashes. A task sends only the counters that it has touched, so what is shuffled follows the
text; each range is merged by itself, and of its counters one bit is left: whether it has reached the threshold. A phrase is
admitted if both of its counters have. The number of counters follows the text up to COUNTERS bits a row, which bounds what is
broadcast; beyond that more phrases are admitted, which costs time, but never a phrase.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, partitions, release, small_batches
from .storage import stash

U = np.uint64
#: What ends a piece, what parts words, the language of rows without one.
ENDS, GAPS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
WORDS, LEAST, TOP = 5, 100, 2000
#: Counters of a row of the sketch: one for so many bytes of text, and within these bounds.
BYTES, FEWEST, COUNTERS = 32, 1 << 20, 1 << 28
#: Hashes that a task holds before it sends them on, and what a range gets, about.
HELD = RANGE = 1 << 21
#: Phrases that a task counts before it sends them on.
PHRASES = 1 << 19
#: Bytes of a text that are taken apart at once, and words that are counted at once.
CHUNK, TOKENS = 1 << 20, 1 << 19
#: Counts of phrases.
COUNTED = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
TABLE = bytes(10 if c in ENDS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")
#: Odd multipliers of the mixing steps.
M1, M2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def tokens(text: bytes, longest: int = WORDS) -> Iterator[tuple[list[bytes], int]]:
    """A text's words and ends of pieces, in lists of what about CHUNK bytes hold, and how many of a list the one before
    had already: a list begins with the last words of it, so that phrases across them are seen, once."""
    text, at, held = text.translate(TABLE), 0, []
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = end if end >= 0 else len(text)
        found = held + TOKEN.findall(text, at, end)
        yield found, len(held)
        held, at = found[len(found) - min(len(found), longest - 1) :], end


class Numbered:
    """Words of some texts as numbers from 1 on; 0 ends a piece. old: places that were counted before."""

    def __init__(self, lists: Iterator[tuple[list[bytes], int]]) -> None:
        numbers: dict[bytes, int] = {b"\n": 0}
        ids, old = [], []
        for found, before in lists:
            ids.append(np.fromiter(chain((numbers.setdefault(w, len(numbers)) for w in found), (0,)), np.int64, len(found) + 1))
            old.append(np.arange(len(found) + 1) < before)
        self.words, self.ids, self.old = list(numbers), np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, bool), *old])
        ends = np.cumsum(np.append(0, self.ids == 0))
        self.whole = lambda k: ends[k:] == ends[: len(ends) - k]  # no end among the k places from each on

    def starts(self, k: int) -> np.ndarray:
        """Where phrases of k words begin."""
        if len(self.ids) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.whole(k) & ~self.old[k - 1 :])

    def hashes(self, seed: bytes) -> np.ndarray:
        """A hash of the word at each place."""
        own = b"".join(hashlib.blake2b(w, digest_size=8, key=seed).digest() for w in self.words)
        return np.frombuffer(own, "<u8")[self.ids]


def mixed(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words at these places."""
    x = np.full(len(at), k, U)
    for i in range(k):
        x = (x ^ h[at + i]) * M1
        x ^= x >> U(29)
    x *= M2
    return x ^ x >> U(32)


def places(h: np.ndarray, counters: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash's range, and where its counter is in each of the range's two rows; h has 32 bits below its range."""
    width = U(counters // ranges - 1)
    low = h & U(0xFFFFFFFF)
    second = low * M1
    return (h >> U(32)) % U(ranges), low & width, (second >> U(32)) & width


def admitted(bits: np.ndarray, h: np.ndarray, counters: int, ranges: int) -> np.ndarray:
    """bits: (row, counter) packed. Which hashes have reached the threshold in both rows."""
    r, *columns = places(h, counters, ranges)
    ok = np.ones(len(h), bool)
    for row, at in enumerate(columns):
        at = r * U(counters // ranges) + at
        ok &= (bits[row, (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def frequent_pairs(x: Numbered, h: np.ndarray, test) -> np.ndarray:
    """For each place, whether the pair of words from there on is one, and admitted."""
    ok = np.zeros(len(x.ids), bool)
    if len(x.ids) > 1:
        at = np.flatnonzero(x.whole(2))
        ok[at[test(mixed(h, at, 2))]] = True
    return ok


def inner(ok: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those places at which all pairs of a phrase of k words are admitted."""
    good = np.ones(len(at), bool)
    for i in range(k - 1):
        good &= ok[at + i]
    return at[good]


def by_lang(b: pa.RecordBatch, longest: int) -> Iterator[tuple[str, Numbered]]:
    """The texts of a batch (lang, text), language by language, some at once."""
    langs, texts = b.column(0).to_pylist(), b.column(1)
    for lang in dict.fromkeys(langs):
        held, size = [], 0
        for i in (i for i, own in enumerate(langs) if own == lang):
            for found in tokens(texts[i].as_py(), longest):
                held.append(found)
                size += len(found[0])
                if size >= TOKENS:
                    yield lang, Numbered(iter(held))
                    held, size = [], 0
        if held:
            yield lang, Numbered(iter(held))


def seeded(lang: str) -> bytes:
    return hashlib.blake2b(lang.encode(), digest_size=16).digest()


def sketched(docs: DataFrame, counters: int, ranges: int, least: int, phrases) -> np.ndarray:
    """Packed bits of the merged sketches: which counters have reached `least`. docs: (lang, text binary). phrases: gives
    the hashes of the phrases of one language's texts."""
    kind = np.uint8 if least <= 255 else np.uint32  # counts go up to the threshold and no further
    most = min(least, int(np.iinfo(kind).max))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            r = places(h, counters, ranges)[0]
            order = np.argsort(r, kind="stable")
            some, first = np.unique(r[order], return_index=True)
            cuts = [*zip(first, np.append(first[1:], len(order)), strict=True)]
            low, count = (h[order] & U(0xFFFFFFFF)).astype(np.uint32), np.minimum(n[order], most).astype(kind)
            return batch(rng=pa.array(some.astype(np.int32)), hashes=pa.array([low[i:j].tobytes() for i, j in cuts], pa.binary()), counts=pa.array([count[i:j].tobytes() for i, j in cuts], pa.binary()))

        for b in batches:
            for lang, x in by_lang(b, WORDS):
                found = phrases(lang, x)
                held += found
                size += sum(map(len, found))
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held.clear()
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = counters // ranges
        sums, rng = np.zeros((2, width), np.int64), None
        for b in batches:  # a range's rows are added up as they come
            rng = b.column("rng")[0].as_py() if b.num_rows else rng
            for hashes, counts in zip(b.column("hashes"), b.column("counts"), strict=True):
                h, n = np.frombuffer(hashes.as_py(), np.uint32).astype(U), np.frombuffer(counts.as_py(), kind)
                for row, at in enumerate(places(h, counters, ranges)[1:]):
                    sums[row] += np.bincount(at.astype(np.int64), n, width).astype(np.int64)
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums]
        release()
        yield batch(rng=pa.array([rng], pa.int32()), first=pa.array([bits[0]], pa.binary()), second=pa.array([bits[1]], pa.binary()))

    sent = docs.mapInArrow(send, "rng int, hashes binary, counts binary")
    out = np.zeros((2, ranges, counters // ranges // 8), np.uint8)
    for r, *rows in sent.groupBy("rng").applyInArrow(merge, "rng int, first binary, second binary").collect():  # of bounded size
        for row, x in enumerate(rows):
            out[row, r] = np.frombuffer(x, np.uint8)
    return out.reshape(2, -1)


def counted(docs: DataFrame, longest: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, n) for docs (lang, text binary): exact counts of the phrases of 1 to `longest` words that occur
    `least` times or more in their language, k words joined by a space; and, as k 0, each language's number of words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(COUNTERS, max(FEWEST, 1 << (size // BYTES).bit_length()))
    ranges = min(counters // 4096, 1 << max(partitions(spark), size // RANGE).bit_length())
    seeds: dict[str, bytes] = {}

    def start(lang: str, x: Numbered) -> np.ndarray:
        return x.hashes(seeds.setdefault(lang, seeded(lang)))

    def short(lang: str, x: Numbered) -> list[np.ndarray]:
        h = start(lang, x)
        return [mixed(h, x.starts(k), k) for k in (1, 2)]

    first = spark.sparkContext.broadcast(sketched(docs, counters, ranges, least, short))  # of bounded size
    pairs = lambda h: admitted(first.value, h, counters, ranges)

    def long(lang: str, x: Numbered) -> list[np.ndarray]:
        h = start(lang, x)
        ok = frequent_pairs(x, h, pairs)
        return [mixed(h, inner(ok, x.starts(k), k), k) for k in range(3, longest + 1)]

    second = spark.sparkContext.broadcast(sketched(docs, counters, ranges, least, long)) if longest > 2 else first
    more = lambda h: admitted(second.value, h, counters, ranges)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[bytes, int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, k, phrase.decode(errors="replace"), n) for (lang, k), found in held.items() for phrase, n in found.items()]
            rng = np.array([zlib.crc32(x[2].encode()) % ranges for x in rows], np.int32)
            order = np.argsort(rng, kind="stable")
            some, first = np.unique(rng[order], return_index=True)
            cuts, order = pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(order)
            columns = (pa.ListArray.from_arrays(cuts, pa.array(x, kind).take(order)) for x, kind in zip(zip(*rows, strict=True), COUNTED.types, strict=True))
            return batch(rng=pa.array(some), **dict(zip(COUNTED.names, columns, strict=True)))

        for b in batches:
            for lang, x in by_lang(b, longest):
                h = start(lang, x)
                ok = frequent_pairs(x, h, pairs)
                words = held.setdefault((lang, 0), {})
                words[b""] = words.get(b"", 0) + len(x.starts(1))
                name = x.ids  # exact numbers of the phrases from each place on, longer and longer
                for k in range(1, longest + 1):
                    if k > 1:
                        name = name[: len(x.ids) - k + 1] * (int(x.ids.max(initial=0)) + 1) + x.ids[k - 1 :] if len(x.ids) >= k else name[:0]
                        name = np.unique(name, return_inverse=True)[1]
                    at = inner(ok, x.starts(k), k)
                    at = at[(pairs if k < 3 else more)(mixed(h, at, k))]
                    _, one, n = np.unique(name[at], return_index=True, return_counts=True)
                    found = held.setdefault((lang, k), {})
                    before = len(found)
                    for row, times in zip(x.ids[at[one][:, None] + np.arange(k)].tolist(), n.tolist(), strict=True):
                        phrase = b" ".join([x.words[w] for w in row])
                        found[phrase] = found.get(phrase, 0) + times
                    size += len(found) - before
                if size >= PHRASES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()
        held.clear()
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = COUNTED.empty_table()
        for b in batches:  # a range's rows are added up as they come
            new = pa.table({c: pc.list_flatten(b.column(c)).cast(kind) for c, kind in zip(COUNTED.names, COUNTED.types, strict=True)})
            held = pa.concat_tables([held, new]).group_by(COUNTED.names[:3]).aggregate([("n", "sum")]).rename_columns(COUNTED.names)
        held = held.filter(pc.or_(pc.greater_equal(held["n"], least), pc.equal(held["k"], 0)))
        yield from held.cast(COUNTED).to_batches()
        del held
        release()

    sent = docs.mapInArrow(exact, "rng int, lang array<string>, k array<int>, phrase array<string>, n array<long>")
    return sent.groupBy("rng").applyInArrow(add, "lang string, k int, phrase string, n long")


def _part(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) for the phrases of two words and more of counted(): the cut with the least
    1000 * a * n / (l * r), rounded down. Products are decimals of 38 digits; quotients are of whole numbers."""
    total = found.filter("k = 0").select("lang", F.col("n").alias("total"))
    parts = found.filter("k > 0").select("lang", "phrase", "n")
    own = found.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    own = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    own = own.select("lang", "k", "phrase", "a", "cut", _part("w", F.lit(1), F.col("cut")).alias("left"), _part("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        own = own.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    own = own.join(stash(total, "languages", keep=True), "lang")  # a small file, which Spark broadcasts as long as it is one
    whole = "cast((1000 * cast(a as decimal(15,0))) * cast(total as decimal(17,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))"
    best = F.min(F.struct(F.expr(whole).cast("long").alias("score"), "cut", "l", "r")).alias("best")
    return own.groupBy("lang", "k", "phrase", "a", F.col("total").alias("n")).agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "n", "best.score")


def subsumed(rows: DataFrame) -> DataFrame:
    """(lang, phrase): phrases of rows (lang, k, phrase, a) whose words lie in a longer one that is as frequent."""
    longer = rows.filter("k > 2").select("lang", "k", "a", F.split("phrase", " ").alias("w"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = longer.groupBy("lang", _part("w", F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    return rows.join(inside, ["lang", "phrase"]).filter("100 * most >= 100 * a").select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = WORDS, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words that occur `least`
    times or more and lie in no longer such phrase that is as frequent, by score, then by a, both descending, then by
    phrase. a, l, r and n count the phrase, the two parts of its weakest cut, and all words of the language.

    Upper-case ASCII letters count as lower-case ones. Null texts are empty; rows without language are of language `und`;
    rows that repeat count each time; phrases never cross documents or punctuation. Other columns don't matter; an empty
    table gives no rows. The counts are kept in the shared folder, since the result reads them."""
    if not 2 <= longest <= WORDS or least < 1:
        raise ValueError("phrases have 2 to 5 words, and occur once at least")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG))
    own = small_batches(docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")))
    found = stash(counted(own, longest, least), "phrases", keep=True)
    rows = stash(scored(found), "scored", keep=True)
    left = rows.join(subsumed(rows), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # only each task's top rows are shuffled
    return left.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
