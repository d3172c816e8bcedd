"""Jaccard join of word n-gram sets, and its components.

Every set is ordered rarest n-gram first; two sets of the asked similarity then share one of their first few n-grams
(the prefix), so sets are only compared within the buckets of prefix n-grams. How rare an n-gram is, a sketch of a fixed
number of counters tells; any order is right as long as all sets use the same, so counts that are too high cost time
at most. Within a bucket, pairs must pass the length filter and the positional filter (what may still be shared after
this n-gram). The suffix filter then splits the range of hashes into a few parts for each n-gram of a set; a bit tells
whether a part has any, and parts that only one of two sets has bound what they may share. Only pairs that pass are given
whole sets, and counted. A pair that was counted and rejected is kept in mind, so that each pair is counted once.

Components need few of the pairs. First each node is only compared with two heads of its buckets; a bucket's head is its
first node in an order by hash, which is the same in all buckets, so that nodes of a group of near copies mostly meet the
same few heads. Buckets whose nodes are of one component need nothing more. Then a few pairs of each component with others
are compared, twice, as one link joins two. At last whatever pairs of a bucket still lie in different components are
counted, so that no link is lost.

All links are pairs within a component, so links() counts them there: every pair of a component's nodes is looked at once.

Texts that are equal are one node; a node is named by SHA-256 of its text. N-grams have salted names of 128 bits, by which
sets are compared; buckets, ranges and the sketch use the first half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_rows, new_salt, partitions, release, text_key, texts, word_names
from .components import components
from .sieve import sieve
from .storage import scratch, stash

WORDS, PERCENT = 5, 75
#: Counters of the sketch, in blocks, where a hash's counter is, and parts of a block that are added up by themselves; the
#: table of classes is 2 MB whatever the input is.
COUNTERS, BLOCKS, COUNTER, FAN = 1 << 21, 64, 43, 16
#: Prefix n-grams that a task holds before it sends them on.
HELD = 1_000_000
#: Prefix n-grams of a range of hashes, about, and rows of a bucket that meet others in one task.
RANGE, ROWS = 200_000, 4096
#: Parts of the range of hashes for each n-gram of a set, at least.
PARTS = 4
#: Pairs of a component that a task gives at first, and how many times.
FEW, ROUNDS = 1, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64
MEMO = 400_000
#: Nodes of a component that meet others in one task, and n-grams that are multiplied out at once.
MEMBERS, COLUMNS = 512, 4096


def all_grams(text: bytes, n: int, salt: int) -> np.ndarray:
    """Names (two rows of 64-bit halves) of the n-grams of lower-cased words; of fewer words, one of the whole sequence; of
    none, none."""
    x = word_names(text.translate(LOWER), salt)
    n = min(n, x.shape[1])
    if not n:
        return x
    h = np.full((2, x.shape[1] - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ x[:, k : k + h.shape[1]]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
    return h


def gram_set(text: bytes, n: int, salt: int) -> np.ndarray:
    """The different ones of all_grams(), in order of their first halves, then of the second."""
    h = all_grams(text, n, salt)
    h = h[:, np.argsort(h[0])]
    again = h[0, 1:] == h[0, :-1]
    if (h[1, 1:] != h[1, :-1])[again].any():  # equal first halves of different names
        h = h[:, np.lexsort((h[1], h[0]))]
    return h[:, np.append(True, (h[:, 1:] != h[:, :-1]).any(0))] if h.shape[1] else h


def prefix_size(size: int, percent: int) -> int:
    """How many of a set's first n-grams hold one that a set of the asked similarity shares."""
    return size - -(-percent * size // 100) + 1


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each part of the range of hashes, by their lower bits; the parts are a power of two, PARTS for an n-gram."""
    m = max(8, 1 << (PARTS * len(grams) - 1).bit_length()) if len(grams) else 8
    bits = np.zeros(m, bool)
    bits[(grams & U(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """The suffix filter: whether sets with these bitmaps and sizes may have the asked similarity. An n-gram whose part the
    other set lacks isn't shared; a longer bitmap is folded to the shorter one's length first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, m)), np.bitwise_or.reduce(y.reshape(-1, m))
    shared = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return 100 * shared >= percent * (n_a + n_b - shared)


def scan(docs: DataFrame, n: int, salt: int) -> DataFrame:
    """A row (key, doc_id, n_shingles, bits) for each row of docs, and a row (block, places, counts) for each block of the
    sketch that a task has touched, with the counters that it has touched there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(COUNTERS, np.uint32), ["doc_id", "key", "n_shingles", "bits", "block", "places", "counts"]
        kinds = pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
        for b in batches:
            sizes, bits, held = [], [], []
            for t in b.column(2):
                h = gram_set(t.as_py(), n, salt)[0]
                sizes.append(len(h))
                bits.append(bitmap(h))
                held.append((h >> U(COUNTER)).astype(np.int32))
            where, times = np.unique(np.concatenate(held), return_counts=True)
            counts[where] += times.astype(np.uint32)
            none = [pa.nulls(b.num_rows, k) for k in kinds[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, kinds[2]), pa.array(bits, kinds[3]), *none], names=names)
        there = [(k, at, x[at]) for k, x in enumerate(counts.reshape(BLOCKS, -1)) if len(at := np.flatnonzero(x))]
        if there:
            blocks, places, times = zip(*there, strict=True)
            packed = (pa.array([x.astype(kind).tobytes() for x in some], pa.binary()) for some, kind in ((places, np.uint16), (times, np.uint32)))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(there), k) for k in kinds[:4]), pa.array(blocks, kinds[4]), *packed], names=names)
        release()

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, bits binary, block int, places binary, counts binary")


def sketch(scanned: DataFrame) -> np.ndarray:
    """The class of each counter: 0 as long as chance may have filled it beyond the others, then one more for each doubling
    of what it has beyond the median. A block's rows are added up as they come, whatever the number of tasks that sent some;
    those of FAN of its parts first, so that no one adds up what all have sent."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, block = np.zeros(COUNTERS // BLOCKS, np.int64), None
        for b in batches:
            block = b.column("block")[0].as_py() if b.num_rows else block
            for places, x in zip(b.column("places"), b.column("counts"), strict=True):
                if places.is_valid:
                    sums[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(x.as_py(), np.uint32)
                else:
                    sums += np.frombuffer(x.as_py(), np.int64)
        yield batch(block=pa.array([block], pa.int32()), places=pa.nulls(1, pa.binary()), counts=pa.array([sums.tobytes()], pa.binary()))

    sent, schema = scanned.filter("block IS NOT NULL").select("block", "places", "counts"), "block int, places binary, counts binary"
    parts = sent.groupBy("block", F.pmod(F.xxhash64("places", "counts"), F.lit(FAN))).applyInArrow(add, schema)
    counts = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for block, x in parts.groupBy("block").applyInArrow(add, schema).select("block", "counts").collect():  # of fixed size
        counts[block] = np.frombuffer(x, np.int64)
    counts = counts.ravel()
    usual = np.median(counts)
    beyond = (counts - usual) / (4 + 4 * np.sqrt(usual))
    return np.where(beyond < 1, 0, 1 + np.floor(np.log2(np.maximum(1, beyond)))).astype(np.uint8)


def buckets(docs: DataFrame, rarity: np.ndarray, n: int, percent: int, ranges: int, salt: int) -> DataFrame:
    """(bucket, key, size, pos): prefix n-grams that at least two nodes have. docs: (key, text).

    A task sends its prefixes as packed arrays, one for each range of hashes, and a node once; a range is one group. A
    bucket is a range and 32 bits of a hash, so it may hold more than one n-gram, which costs time at most."""
    table = docs.sparkSession.sparkContext.broadcast(rarity)  # of fixed size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, bytes]] = []
        size, rare = 0, table.value

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            node = np.repeat(np.arange(len(held)), [len(x) for x, _ in held])
            pos = np.concatenate([np.arange(len(x)) for x, _ in held]).astype(np.uint32)
            keys = np.array([k for _, k in held], "V20")
            rng = ((h >> U(32)) * U(ranges)) >> U(32)
            order = np.argsort(rng, kind="stable")
            there, first = np.unique(rng[order], return_index=True)
            out = []
            for r, some in zip(there.tolist(), np.split(order, first[1:]), strict=True):
                used, local = np.unique(node[some], return_inverse=True)
                out.append((r, h[some].astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), pos[some].tobytes(), keys[used].tobytes()))
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["rng", "tokens", "nodes", "pos", "keys"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) < MEMO:
                    seen.add(key)
                h, second = gram_set(text, n, salt)
                if not len(h):
                    continue
                p = prefix_size(len(h), percent)
                order = np.lexsort((second, h, rare[(h >> U(COUNTER)).astype(np.int64)]))[:p]
                held.append((h[order], key + len(h).to_bytes(4, "little")))
                size += p
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        held.clear()
        seen.clear()
        release()

    def gather(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("tokens", "nodes", "pos", "keys")}
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in columns["tokens"]])
        pos = np.concatenate([np.frombuffer(x, np.uint32) for x in columns["pos"]])
        names = [np.frombuffer(x, "V20") for x in columns["keys"]]
        first = np.cumsum([0, *map(len, names)])
        node = np.concatenate([np.frombuffer(x, np.uint32) + f for x, f in zip(columns["nodes"], first, strict=False)])
        often = lambda t: np.unique(t, return_counts=True, return_inverse=True)
        _, at, count = often(token)
        some = count[at] > 1
        token, node, pos = token[some], node[some], pos[some]
        used, local = np.unique(node, return_inverse=True)
        keys = [x.tobytes() for x in np.concatenate(names)[used]]
        numbers: dict[bytes, int] = {}
        node = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)[local] if len(local) else local
        known = list(numbers)
        order = np.lexsort((node, token))  # a node that several tasks have sent is one
        token, node, pos = token[order], node[order], pos[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, pos = token[once], node[once], pos[once]
        _, at, count = often(token)
        some = np.flatnonzero(count[at] > 1)
        whole = [known[i] for i in node[some]]
        sizes = np.array([int.from_bytes(k[16:], "little") for k in known], np.int32)[node[some]] if len(some) else np.zeros(0, np.int32)
        return pa.table({"bucket": pa.array((key[0].as_py() << 32) + token[some].astype(np.int64)), "key": pa.array([k[:16] for k in whole], pa.binary()), "size": pa.array(sizes), "pos": pa.array(pos[some].astype(np.int32))})

    sent = docs.mapInArrow(send, "rng int, tokens binary, nodes binary, pos binary, keys binary")
    return sent.groupBy("rng").applyInArrow(gather, "bucket long, key binary, size int, pos int")


def passing(percent: int, x: str = "", y: str = "o_") -> Column:
    """Length and positional filter, for pairs of bucket rows with columns size and pos."""
    size, pos, other, at = (F.col(c).cast("long") for c in (f"{x}size", f"{x}pos", f"{y}size", f"{y}pos"))
    least = F.ceil(percent * (size + other) / (100 + percent))
    return (100 * F.least(size, other) >= percent * F.greatest(size, other)) & (F.least(size - pos, other - at) >= least)


def split_buckets(found: DataFrame) -> DataFrame:
    """Bucket rows, which have their node's component, of the buckets that have more than one component."""
    split = found.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
    return found.join(split, "bucket", "left_semi")


def labelled(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Bucket rows with the component of their node in parts (node, component); a node that isn't there is one by itself.
    Only rows of nodes that may be there are shuffled."""
    named = parts.select(F.col("node").alias("key"), "component")
    own = found.select("bucket", "key", "size", "pos", sieve(named, "key")(F.col("key")).alias("hit"))
    columns = ["bucket", "key", "size", "pos"]
    alone = own.filter("NOT hit").select(*columns, F.col("key").alias("component"))
    return alone.unionByName(own.filter("hit").join(named, "key", "left").select(*columns, F.coalesce("component", "key").alias("component")))


def heads(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with two of its buckets' heads at most, those in another component that pass the filters: the one
    that it shares most buckets with, and the first in an order by hash. A bucket's head is its first node in another one."""
    order = F.xxhash64("key")
    head = found.groupBy("bucket").agg(F.min_by(F.struct("key", "component", "size", "pos"), F.struct(order, "key")).alias("h"))
    head = head.select("bucket", *(F.col(f"h.{c}").alias(f"o_{c}") for c in ("key", "component", "size", "pos")))
    met = found.join(head, "bucket").filter((F.col("component") != F.col("o_component")) & passing(percent))
    shared = met.groupBy("key", "o_key").agg(F.count("*").alias("n"))
    ends = shared.groupBy("key").agg(F.max(F.struct("n", "o_key")).alias("most"), F.min(F.struct(F.xxhash64("key", "o_key").alias("n"), "o_key")).alias("first"))
    both = ends.select("key", F.col("most.o_key").alias("other")).unionByName(ends.select("key", F.col("first.o_key").alias("other")))
    return both.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def across(found: DataFrame, percent: int, rows: int = ROWS, few: int | None = None) -> DataFrame:
    """(a, b): in each bucket, the pairs of nodes of different components that pass the filters; few: of each component
    no more from a task, but those that another one needs. A bucket of more than `rows` is dealt into blocks by hash; each block meets each in a
    task of its own."""
    sizes = found.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / rows).cast("int"))
    own = found.join(sizes.select("bucket", "blocks"), "bucket").withColumn("k", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    large = own.filter("blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")})
    both = own.filter("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).unionByName(large.drop("o"))

    def fewer(pairs: np.ndarray) -> np.ndarray:
        """Each pair once, as it may share several buckets; if few, each component's first ones by hash."""
        pairs = pairs[:, np.unique(pairs[0], return_index=True)[1]]
        if few is None or not pairs.shape[1]:
            return pairs
        mixed, kept = pairs[0].astype(U) * U(0x9E3779B97F4A7C15), np.zeros(pairs.shape[1], bool)
        for part in pairs[1:]:
            order = np.lexsort((mixed ^ mixed >> U(29), part))
            first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            kept[order[rank < few]] = True
        return pairs[:, kept]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("size", "ascending"), ("key", "ascending")])
        number = lambda c: np.unique(np.array(table.column(c).to_pylist(), object), return_inverse=True)
        (keys, node), (_, part) = number("key"), number("component")
        bucket, i_, j_, k, size, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j", "k", "size", "pos"))
        new = np.ones(len(bucket), bool)
        new[1:] = (np.diff(bucket) != 0) | (np.diff(i_) != 0) | (np.diff(j_) != 0)
        task = np.cumsum(new)
        held, size_ = [np.zeros((3, 0), np.int64)], 0
        for gap in range(1, len(task)):  # rows so far apart, which are in order of size
            a = np.flatnonzero(task[gap:] == task[:-gap])
            a = a[100 * size[a] >= percent * size[a + gap]]
            if not len(a):
                break
            b = a + gap
            least = -(-percent * (size[a] + size[b]) // (100 + percent))
            ok = (part[a] != part[b]) & ((k[a] != k[b]) | (i_[a] == j_[a])) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= least)
            x, y = node[a[ok]], node[b[ok]]  # numbers in the order of keys
            held.append(np.stack([np.minimum(x, y) * len(keys) + np.maximum(x, y), part[a[ok]], part[b[ok]]]))
            size_ += len(x)
            if size_ > RANGE:
                held, size_ = [fewer(np.concatenate(held, 1))], 0
        seen = fewer(np.concatenate(held, 1))[0]
        return pa.table({"a": pa.array(keys[seen // len(keys)].tolist(), pa.binary()), "b": pa.array(keys[seen % len(keys)].tolist(), pa.binary())})

    tasks = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit((sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) * 4 // RANGE + partitions(found.sparkSession)))
    return both.withColumn("task", tasks).groupBy("task").applyInArrow(run, "a binary, b binary").distinct()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of names (gram_set, or of 64 bits) have the asked similarity."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    names = np.concatenate([a, b], 1)
    names = names[:, np.lexsort(names[::-1])]
    both = int((names[:, 1:] == names[:, :-1]).all(0).sum())
    return 100 * both >= percent * (a.shape[1] + b.shape[1] - both)


def sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter on the bitmaps of nodes (key, n_shingles, bits) doesn't rule out."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = [may_be_similar(*x, percent) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
        return b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    first = nodes.select(F.col("key").alias("a"), F.col("bits").alias("x"), F.col("n_shingles").alias("m"))
    second = nodes.select(F.col("key").alias("b"), F.col("bits").alias("y"), F.col("n_shingles").alias("n"))
    return map_rows(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y", "m", "n"), run, "a binary, b binary")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, salt: int, sift=sift) -> DataFrame:
    """(a, b, ok): of the pairs (a, b) that the suffix filter leaves, whether their texts in docs (key, text) have sets of
    the asked similarity. Sets are only made for the nodes of these pairs."""
    left = stash(sift(pairs, nodes, percent), "pairs")
    wanted = left.select(F.col("a").alias("key")).unionByName(left.select(F.col("b").alias("key"))).distinct()
    texts_ = docs.filter(sieve(wanted, "key")(F.col("key"))).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def grams(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(key=b.column(0), grams=pa.array([gram_set(t.as_py(), n, salt).tobytes() for t in b.column(1)], pa.binary()))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = [similar(np.frombuffer(x.as_py(), np.uint64).reshape(2, -1), np.frombuffer(y.as_py(), np.uint64).reshape(2, -1), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
        return batch(a=b.column(0), b=b.column(1), ok=pa.array(ok, pa.bool_()))

    sets = stash(map_rows(texts_.select("key", "text"), grams, "key binary, grams binary"), "sets")
    first, second = sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
    return stash(map_rows(left.join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "a binary, b binary, ok boolean"), "counted")


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, group, n_shingles, component_id) for each row of docs: its text's and its component's key, the size of
    its set of n-grams of words, and the smallest doc_id among the documents that links lead to, its own included. Two documents are linked if their sets'
    intersection is at least `percent` hundredths of their union.

    A text of fewer words than n has one n-gram, all its words; one without words, or null, has none, and no links. Rows
    of equal texts are in one component. Rows without doc_id are compared too; a component of nothing else has a null
    component_id. Other columns don't matter; an empty table gives no rows."""
    spark, salt = docs.sparkSession, new_salt()
    own = texts(docs, id_col, text_col, as_bytes=True).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    scanned = stash(scan(own, n, salt), "scan", keep=True)
    rows = scanned.filter("block IS NULL").select("doc_id", "key", "n_shingles")
    with scratch():
        total = rows.agg(F.sum("n_shingles")).first()[0] or 0
        ranges = max(16, partitions(spark), prefix_size(total, percent) // RANGE)
        found = stash(buckets(own.select("key", "text"), sketch(scanned), n, percent, ranges, salt), "buckets")
        nodes = scanned.filter("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
        nodes = stash(nodes.join(found.select("key").distinct(), "key", "left_semi"), "nodes")
        corpus = own.select("key", "text")
        rejected = parts = None

        def count(pairs: DataFrame) -> DataFrame:
            """(node, component) with the links among these pairs as well."""
            nonlocal rejected
            counted = verify(pairs if rejected is None else pairs.join(rejected, ["a", "b"], "left_anti"), nodes, corpus, n, percent, salt)
            no = counted.filter("NOT ok").select("a", "b")
            rejected = no if rejected is None else rejected.unionByName(no)
            links = counted.filter("ok").select("a", "b")
            if parts is not None:  # what is known is a link of each node to its component
                links = links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
            return stash(components(links), "parts", keep=True)

        parts = count(heads(found.withColumn("component", F.col("key")), percent))
        live = stash(split_buckets(labelled(found, parts)), "live")
        for _ in range(ROUNDS):
            parts = count(across(live, percent, few=FEW))
            live = stash(split_buckets(labelled(live, parts)), "live")
        parts = count(across(live, percent))
    named = rows.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", "key", F.col("component").alias("group"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of a shares with each of b: products of 0/1 matrices, some n-grams at a time."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        some = np.isin(grams, common)
        at = np.searchsorted(common, grams[some])
        order = np.argsort(at, kind="stable")
        return at[order], row[some][order]

    (x, x_row), (y, y_row) = places(a), places(b)
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(common), COLUMNS):
        parts = []
        for at, row, n in (x, x_row, len(a)), (y, y_row, len(b)):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)  # exact: sums are 4096 at most
            part[row[i:j], at[i:j] - low] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def numbered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of names as sorted sets of numbers: equal ones of equal names."""
    names = np.concatenate([np.zeros((2, 0), U), *sets], 1)
    order = np.lexsort((names[1], names[0]))
    new = np.append(False, (names[:, order[1:]] != names[:, order[:-1]]).any(0)) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return np.split(out, np.cumsum([x.shape[1] for x in sets])[:-1]) if sets else []


def count_links(members: DataFrame, n: int, percent: int, block: int, groups: int) -> DataFrame:
    """(key, links): the rows that a node is linked to, those of its own text aside. members: (key, group, members,
    copies, text), a component's nodes and how many these are. Nodes of a component are dealt into blocks, and each block
    meets each in a task of its own; components of one block share tasks."""
    blocks, salt = F.ceil(F.col("members") / block).cast("int"), new_salt()
    own = members.withColumn("blocks", blocks).withColumn("k", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")})
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(groups))).otherwise(F.xxhash64("group", "i", "j"))

    def run(table: pa.Table) -> pa.Table:
        where: dict[tuple, list[int]] = {}
        for at, name in enumerate(zip(*(table.column(c).to_pylist() for c in ("group", "i", "j")), strict=True)):
            where.setdefault(name, []).append(at)
        block_of, copies, texts_ = table.column("k").to_numpy(), table.column("copies").to_numpy(), table.column("text")
        links = np.zeros(table.num_rows, np.int64)
        for (_, i, j), rows in where.items():
            at = np.array(rows)
            sets = dict(zip(rows, numbered([gram_set(texts_[r].as_py(), n, salt) for r in rows]), strict=True))
            a, b = at[block_of[at] == i], at[block_of[at] == j]
            if not len(a) or not len(b):
                continue
            both = shared([sets[r] for r in a], [sets[r] for r in b])
            sizes = [np.array([len(sets[r]) for r in x]) for x in (a, b)]
            ok = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
            if i == j:
                np.fill_diagonal(ok, False)
            else:
                links[b] += ok.T @ copies[a]
            links[a] += ok @ copies[b]
        return pa.table({"key": table.column("key"), "links": pa.array(links)})

    met = own.select(task.alias("task"), "key", "group", "i", "j", "k", "copies", "text").groupBy("task").applyInArrow(run, "key binary, links long")
    return met.groupBy("key").agg(F.sum("links").alias("links"))


def links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs: as classes(), and the number of other rows that
    it is linked to, rows of the same text among them. A text without words has no links."""
    named = stash(classes(docs, n, percent, id_col, text_col), "named", keep=True)
    nodes = named.filter("n_shingles > 0").groupBy("key").agg(F.first("group").alias("group"), F.count("*").alias("copies"))
    with scratch():
        sizes = nodes.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
        wanted = stash(nodes.join(sizes, "group"), "members")
        own = texts(docs, id_col, text_col, as_bytes=True).select(text_key(F.col("text")).alias("key"), "text")
        members = own.filter(sieve(wanted, "key")(F.col("key"))).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
        found = stash(count_links(members, n, percent, block, max(partitions(docs.sparkSession), wanted.count() // block)), "counts", keep=True)
    counts = nodes.join(found, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return named.join(counts, "key", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, but of each component one document only: the one with the smallest id. Texts without
    words are in no component: each of them stays. Of rows that share the smallest id, the first by text and by all other
    columns stays; rows without id stay only if no row of their component has one, and then one of them. Columns of any
    names go along, as long as no two are the same; an empty table stays empty."""
    named = classes(docs, n, percent, id_col, text_col)
    # a component's document is told by its id and its text's key; choosing needs narrow rows only
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    counted = named.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    chosen = counted.filter("size > 0").groupBy("group").agg(F.min(F.struct(order.alias("o"), "n")).alias("it")).select("it.o.doc_id", "it.o.key", "it.n")
    empty = counted.filter("size = 0").select("doc_id", "key", F.lit(1).cast("long").alias("n"))
    wanted = stash(chosen.unionByName(empty).withColumnsRenamed({"doc_id": "id", "key": "k"}), "wanted")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("key"))
    meets = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))
    kept = own.join(wanted.filter("n = 1"), meets, "left_semi").select("row.*")
    several = wanted.filter("n > 1")
    if several.isEmpty():
        return kept
    # rows that share id and text: the first by all columns, which are compared as JSON, as any type has that
    many = own.filter(sieve(several, "id", "k")(F.col("doc_id"), F.col("key"))).join(several, meets).groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(many.select("row.*"))
