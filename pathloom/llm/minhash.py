"""Near-duplicates by b-bit MinHash.

A text's set of word n-grams has HASHES minima, each under its own permutation. Their bands of ROWS minima are buckets: two
sets of similarity s share one of BANDS buckets with a chance of 1 - (1 - s ** ROWS) ** BANDS; at 0.8, all but 5 of 10 ** 8
pairs. Of each minimum only BITS low bits are kept, packed to a signature. The bits of two signatures that differ, counted,
estimate the similarity: by chance alone one of 2 ** BITS minima agrees, which the estimate takes off. Pairs whose estimate
lies more than SIGMAS deviations below the threshold go. Of the others, bitmaps of the sets (jaccard.py) tell what can't be
shared, without error; what is left is counted on whole sets, so every link is exact.

Few pairs of a bucket are counted: nodes meet the heads of their buckets first, and what then is in one component needs
nothing more. Of buckets of several components the nodes get their signatures, which are compared within the bucket's task:
first each component's pairs with the highest estimates go on; at last every pair of different components whose estimate
admits it. A pair that shares several buckets is told in the first of them only, so a large group sends no pair twice. So the only links that may be missing are those whose sets share no bucket, or whose estimate errs so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, new_salt, partitions, release, text_key, texts
from .components import components
from .jaccard import bitmap, gram_set, heads, labelled, may_be_similar, split_buckets, verify
from .storage import scratch, stash

U = np.uint64
WORDS, PERCENT = 4, 80
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
SIGMAS = 5.5
#: N-grams that are hashed at once; texts that a task remembers, so as to sign copies once.
SOME, MEMO = 4096, 200_000
#: Rows of a bucket that meet others in one task, rows of a task, about, and pairs that a component gives at first.
BLOCK, TASK, FEW = 4096, 50_000, 4
#: The lowest bit of each group of BITS.
LOWEST = U(0x1111111111111111)


def permutations(salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands, a pair for each permutation."""
    x = np.random.default_rng(salt).integers(0, 1 << 63, (2, HASHES), np.uint64)
    return x[0] << U(1) | U(1), x[1]


def minima(grams: np.ndarray, salt: int) -> np.ndarray:
    """The least value of a set under each permutation."""
    factor, summand = permutations(salt)
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for k in range(0, len(grams), SOME):
        x = grams[None, k : k + SOME] * factor[:, None]
        x += summand[:, None]
        x ^= x >> U(32)  # low bits decide as well
        x *= U(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(1), out=least)
    return least ^ least >> U(29)


def signature(least: np.ndarray) -> bytes:
    """BITS low bits of each minimum, packed."""
    bits = (least[:, None] >> np.arange(BITS, dtype=U) & U(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket for each band: a hash of its number and minima."""
    rows = least.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = (h ^ rows[:, k]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
    return h


def unpacked(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), HASHES * BITS // 64)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity of each two sets with these signatures (unpacked), corrected for minima whose bits agree by chance."""
    differ = x ^ y
    any_bit = differ.copy()
    for k in range(1, BITS):
        any_bit |= differ >> U(k)
    agree = 1 - np.bitwise_count(any_bit & LOWEST).sum(1) / HASHES
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """What the estimate of a similar pair doesn't fall below: so many deviations under the threshold."""
    s, chance = percent / 100, 0.5**BITS
    p = s + (1 - s) * chance
    return s - SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes, signatures and bitmaps in nodes (key, n_shingles, bits, parts) may be those of similar
    sets."""
    floor = least_estimate(percent)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = estimates(unpacked(b.column(2).to_pylist()), unpacked(b.column(3).to_pylist())) >= floor
        for k in np.flatnonzero(ok).tolist():
            ok[k] = may_be_similar(*(b.column(c)[k].as_py() for c in (4, 5, 6, 7)), percent)
        return b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    first = nodes.select(F.col("key").alias("a"), F.col("bits").alias("x"), F.col("parts").alias("u"), F.col("n_shingles").alias("m"))
    second = nodes.select(F.col("key").alias("b"), F.col("bits").alias("y"), F.col("parts").alias("v"), F.col("n_shingles").alias("n"))
    met = pairs.join(first, "a").join(second, "b").filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    return map_rows(met.select("a", "b", "x", "y", "u", "v", "m", "n"), run, "a binary, b binary", 1000)


def signed(docs: DataFrame, n: int, salt: int) -> DataFrame:
    """(doc_id, key, n_shingles, bits, parts, buckets) for each row of docs (doc_id, key, text): signature, bitmap, and the
    buckets of its bands; of a text that its task has signed before, and of one without words, these are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            sizes, bits, maps, buckets = [], [], [], []
            for key, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                size = seen.get(key)
                grams = gram_set(text.as_py(), n, salt)[0] if size is None else ()
                fresh = size is None and len(grams) > 0
                least = minima(grams, salt) if fresh else None
                sizes.append(len(grams) if size is None else size)
                bits.append(signature(least) if fresh else None)
                maps.append(bitmap(grams) if fresh else None)
                buckets.append(bands(least).view(np.int64) if fresh else None)
                if len(seen) < MEMO:
                    seen[key] = sizes[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(maps, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "bits", "parts", "buckets"])
        seen.clear()
        release()

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, bits binary, parts binary, buckets array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, key, size, pos) of the buckets that two nodes (key, n_shingles, buckets) have at least."""
    rows = nodes.select(F.explode("buckets").alias("bucket"), "key", F.col("n_shingles").cast("int").alias("size"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return rows.join(several, "bucket", "left_semi").select("bucket", "key", "size", F.lit(0).alias("pos"))


def across(live: DataFrame, signs: DataFrame, percent: int, few: int | None) -> DataFrame:
    """(a, b), each once: in each bucket of live (bucket, key, size, pos, component), the pairs of nodes of different components
    that share no earlier bucket, and whose sizes, signatures and bitmaps in signs (key, bits, parts, buckets) may be those of
    similar sets; few: of each component's pairs in a task, so many with the highest estimates. A bucket of more than BLOCK rows is dealt into blocks, and each block meets each in a task."""
    floor = least_estimate(percent)
    sizes = live.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    total = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    own = live.join(sizes.select("bucket", "blocks"), "bucket").join(signs.select("key", "bits", "parts", "buckets"), "key")
    own = own.withColumn("k", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")})
    own = own.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(total // TASK + partitions(live.sparkSession))))

    def best(pairs: list[np.ndarray]) -> np.ndarray:
        """Rows a, b, part of a, part of b, and estimate in millionths, of each component's best."""
        rows = np.concatenate(pairs, 1)
        if few is None or not rows.shape[1]:
            return rows
        kept = np.zeros(rows.shape[1], bool)
        for part in rows[2:4]:
            order = np.lexsort((-rows[4], part))
            first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            kept[order[rank < few]] = True
        return rows[:, kept]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("bucket", "i", "j", "size", "key")])
        number = lambda c: np.unique(np.array(table.column(c).to_pylist(), object), return_inverse=True)
        (keys, node), (_, part) = number("key"), number("component")
        bucket, i_, j_, k, size = (table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j", "k", "size"))
        bits, maps = unpacked(table.column("bits").to_pylist()), table.column("parts").to_pylist()
        bands_ = pc.list_flatten(table.column("buckets")).to_numpy().reshape(-1, BANDS)

        new = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(i_) != 0) | (np.diff(j_) != 0)))
        held, count = [np.zeros((5, 0), np.int64)], 0
        for s, e in zip(new.tolist(), np.append(new[1:], len(bucket)).tolist(), strict=True):
            ends = s + np.searchsorted(size[s:e], size[s:e] * 100 // percent, "right")  # sizes are in order
            for x in range(s, e - 1):
                y = np.arange(x + 1, ends[x - s])
                y = y[(part[y] != part[x]) & ((k[y] != k[x]) | (i_[x] == j_[x]))]
                if not len(y):
                    continue
                found = estimates(bits[x][None], bits[y])
                ok = found >= floor
                both = bands_[y[ok]] == bands_[x]
                ok[ok] = both.argmax(1) == np.argmax(bands_[x] == bucket[x])  # the first bucket that they share is this one
                ok[ok] = [may_be_similar(maps[x], maps[o], int(size[x]), int(size[o]), percent) for o in y[ok].tolist()]
                y, found = y[ok], found[ok]
                held.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.full(len(y), part[x]), part[y], (1e6 * found).astype(np.int64)]))
                count += len(y)
                if few is not None and count > TASK:
                    held, count = [best(held)], 0
        a, b = np.unique(best(held)[:2], axis=1)
        return pa.table({"a": pa.array(keys[a].tolist(), pa.binary()), "b": pa.array(keys[b].tolist(), pa.binary())})

    return own.select("task", "bucket", "i", "j", "k", "key", "size", "component", "bits", "parts", "buckets").groupBy("task").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) for each row of docs: its text's key, the size of its set of n-grams of
    words, the smallest doc_id among the documents that links lead to, its own included, and whether that is its own. Two
    documents are linked if their sets' intersection is at least `percent` hundredths of their union.

    A text of fewer words than n has one n-gram, all its words; one without words, or null, has none, and no links. Rows of
    equal texts are in one component; rows that repeat their doc_id too are kept together. Rows without doc_id are compared
    too; a component of nothing else has a null component_id and is kept. Other columns don't matter; an empty table gives
    no rows. Names of n-grams, and so buckets, have a salt of the run."""
    salt = new_salt()
    own = texts(docs, id_col, text_col, as_bytes=True).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    scanned = stash(signed(own, n, salt), "signed", keep=True)
    rows = scanned.select("doc_id", "key", "n_shingles")
    with scratch():
        nodes = scanned.filter("bits IS NOT NULL").groupBy("key").agg(F.first(F.struct("n_shingles", "bits", "parts", "buckets")).alias("it")).select("key", "it.*")
        nodes = stash(nodes, "nodes")
        found = stash(shared_buckets(nodes), "buckets")
        signs, corpus = nodes.drop("buckets"), own.select("key", "text")
        rejected = parts = None

        def count(pairs: DataFrame) -> DataFrame:
            """(node, component) with the links among these pairs as well."""
            nonlocal rejected
            counted = verify(pairs if rejected is None else pairs.join(rejected, ["a", "b"], "left_anti"), signs, corpus, n, percent, salt, sift)
            no = counted.filter("NOT ok").select("a", "b")
            rejected = no if rejected is None else rejected.unionByName(no)
            links = counted.filter("ok").select("a", "b")
            if parts is not None:  # what is known is a link of each node to its component
                links = links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
            return stash(components(links), "parts", keep=True)

        parts = count(heads(found.withColumn("component", F.col("key")), percent))
        for few in (FEW, None):
            live = stash(split_buckets(labelled(found, parts)), "live")
            if live.isEmpty():
                break
            parts = count(across(live, nodes, percent, few))
    named = rows.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
