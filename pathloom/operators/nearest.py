"""Queries among a panel's places: the nearest places above and below, and the interval of places that share so many nodes.

Queries and panel are put in one order (order.py). Of all panel places, those next to a query's place share most with it; so
its longest match is told by two neighbours. All places that share `m` nodes with it are an interval around it, whose ends
are the first places on both sides that share less than m with the one before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from .order import CONTEXT, dealt, firsts, in_common, ordered, shared, with_common

LONG = "long"
#: Places of a bucket in searches, at least; how many buckets there are at most, whose minima are sent to all tasks.
BUCKET, BUCKETS = 1 << 17, 1 << 22
#: Places of a bucket when intervals are written out.
NARROW = 64


def together(queries: DataFrame, positions: DataFrame, back: bool = False) -> DataFrame:
    """(seq_id struct(asked, id), pos, node, at): the places of both. back: sequences are read backwards; `at` is the place
    in the sequence as it was."""
    side = lambda df, asked, key: df.select(F.struct(F.lit(asked).alias("asked"), F.col(key).cast(LONG).alias("id")).alias("seq_id"), F.col("pos").cast(LONG).alias("pos"), "node", F.col("pos").cast(LONG).alias("at"))
    rows = side(positions, False, "seq_id").unionByName(side(queries, True, "query_id"))
    return rows.withColumn("pos", F.max("pos").over(Window.partitionBy("seq_id")) - F.col("pos")) if back else rows


def neighbours(table: DataFrame, others: bool) -> DataFrame:
    """The asked rows of table (seq_id, pos, part, i, r, key, ...), an order of together(), with above and below: the nearest
    panel places, as (id, pos, r, key); null where there is none. others: of another sequence than the query's own id.

    The last panel place is carried on within ranges, and over ranges from a row for each. For others there is a second
    one: the last place before the sequence of the first began, which is of another sequence."""
    panel, asked = ~F.col("seq_id.asked"), F.col("seq_id.asked")
    table = dealt(table)
    own = table.withColumn("_x", F.when(panel, F.struct(F.col("seq_id.id").alias("id"), "pos", "r", "key")))
    place = F.when(panel, F.col("i"))
    ends = own.groupBy("part").agg(F.max_by("_x", place).alias("_last"), F.min_by("_x", place).alias("_first"))
    if others:
        seen = own.join(F.broadcast(ends), "part")  # a row for each range
        other = lambda c: F.when(panel & (F.col("seq_id.id") != F.col(f"{c}.id")), F.col("i"))
        ends = seen.groupBy("part").agg(F.max_by("_x", place).alias("_last"), F.min_by("_x", place).alias("_first"), F.max_by("_x", other("_last")).alias("_last2"), F.min_by("_x", other("_first")).alias("_first2"))
    w = Window.orderBy("part")  # over ranges, not rows
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns({"_a": F.last("_last", ignorenulls=True).over(before), "_b": F.first("_first", ignorenulls=True).over(after)})
    if others:
        turn = lambda near, second, end: F.coalesce(F.col(second), F.when(F.col(f"{near}.id") != F.col(f"{end}.id"), F.col(near)))
        ends = ends.withColumns({"_ta": turn("_a", "_last2", "_last"), "_tb": turn("_b", "_first2", "_first")})
        ends = ends.withColumns({"_a2": F.last("_ta", ignorenulls=True).over(before), "_b2": F.first("_tb", ignorenulls=True).over(after)})
    met = own.join(F.broadcast(ends.select("part", "_a", "_b", *(["_a2", "_b2"] if others else []))), "part")
    before, after = (Window.partitionBy("part").orderBy(i).rowsBetween(Window.unboundedPreceding, -1) for i in (F.asc("i"), F.desc("i")))  # both in linear time
    met = met.withColumn("above", F.coalesce(F.last("_x", ignorenulls=True).over(before), "_a")).withColumn("below", F.coalesce(F.last("_x", ignorenulls=True).over(after), "_b"))
    if others:
        turn = lambda near: F.when(panel & (F.col(f"{near}.id") != F.col("seq_id.id")), F.col(near))
        met = met.withColumns({"_ta": turn("above"), "_tb": turn("below")})
        met = met.withColumn("_b2", F.coalesce(F.last("_tb", ignorenulls=True).over(after), "_b2")).withColumn("_a2", F.coalesce(F.last("_ta", ignorenulls=True).over(before), "_a2"))
        mine = lambda near: F.coalesce(F.col(f"{near}.id") == F.col("seq_id.id"), F.lit(False))
        met = met.withColumns({"above": F.when(mine("above"), F.col("_a2")).otherwise(F.col("above")), "below": F.when(mine("below"), F.col("_b2")).otherwise(F.col("below"))})
    return met.filter(asked).select(*table.columns, "above", "below")


def longest(table: DataFrame, rows: DataFrame, others: bool = False, context: int = CONTEXT) -> DataFrame:
    """(query_id, at, pos, i, m) of the asked rows of table, the order of rows (together()): how many nodes the panel place
    that shares most with a query's place has in common with it. Contexts tell it up to their length, and ranks if the
    whole contexts are equal; only pairs that share all of a context and differ before are compared further."""
    near = neighbours(table, others)
    sides = F.explode(F.array(F.col("above"), F.col("below"))).alias("y")
    near = near.select("seq_id", "at", "pos", "i", "r", "key", sides).select("*", F.coalesce(shared(F.col("key"), F.col("y.key")), F.lit(0)).alias("near"))
    equal = F.coalesce(F.col("y.r") == F.col("r"), F.lit(False))
    near = near.select("*", equal.alias("equal")).withColumn("near", F.when(F.col("equal"), F.col("pos") + 1).otherwise(F.col("near")))
    near = keep(near.select("seq_id", "at", "pos", "i", "near", "equal", F.col("y.id").alias("y_id"), F.col("y.pos").alias("y_pos")), "nearest")
    asked = near.filter((F.col("near") >= context) & ~F.col("equal")).select("i", F.col("seq_id").alias("x"), (F.col("pos") - context).alias("x_at"), F.struct(F.lit(False).alias("asked"), F.col("y_id").alias("id")).alias("y"), (F.col("y_pos") - context).alias("y_at"))
    told = near.select("i", F.col("near").alias("m"))
    if not asked.isEmpty():
        told = told.unionByName(in_common(asked, rows, ["i"]).select("i", (F.col("common") + context).alias("m")))
    best = told.groupBy("i").agg(F.max("m").alias("m"))
    return near.groupBy("i", "seq_id", "at", "pos").agg(F.lit(1)).join(best, "i").select(F.col("seq_id.id").alias("query_id"), "at", "pos", "i", F.col("m").cast(LONG).alias("m"))


def _search(asked: DataFrame, table: DataFrame, bucket: int) -> DataFrame:
    """asked (i, left boolean, b, start, m) with found: the nearest place from start on, in this direction and in bucket b,
    whose `common` in table is less than m; null if there is none. By minima of 2 ** k neighbours."""

    def run(h: pa.Table, asked_: pa.Table) -> pa.Table:
        h = h.sort_by("i")
        low = np.asarray(h.column("i"))[0] if h.num_rows else 0
        levels = [np.asarray(h.column("common"))]
        while 2 << (len(levels) - 1) <= h.num_rows:
            x, n = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.minimum(x[:-n], x[n:]))
        left, m, p = np.asarray(asked_.column("left").to_numpy()), asked_.column("m").to_numpy(), asked_.column("start").to_numpy() - low
        for k in reversed(range(len(levels))):
            n, x = 1 << k, levels[k]
            at = np.where(left, p - n + 1, p)
            ok = (at >= 0) & (at + n <= h.num_rows)
            ok[ok] = x[at[ok]] >= m[ok]
            p = np.where(ok, np.where(left, p - n, p + n), p)
        there = (p >= 0) & (p < h.num_rows)
        return asked_.append_column("found", pa.array(p + low, pa.int64(), mask=~there))

    schema = "i long, left boolean, b long, start long, m long, found long"
    return table.select(F.floor(F.col("i") / bucket).alias("b"), "i", "common").groupBy("b").cogroup(asked.select("i", "left", "b", "start", "m").groupBy("b")).applyInArrow(run, schema)


def intervals(table: DataFrame, asked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(i, low, high) for asked (i, m): the places around i in table (i, common) that share m nodes with the place i, m at
    least 1, those from low to before high."""
    total = table.count()
    bucket = max(bucket, -(-total // BUCKETS))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("i").alias("start")), F.struct(F.lit(False).alias("left"), (F.col("i") + 1).alias("start")))).alias("s")
    first = asked.filter("m > 0").select("i", F.col("m").cast(LONG).alias("m"), sides).select("i", "s.left", F.floor(F.col("s.start") / bucket).alias("b"), "s.start", "m")
    first = keep(_search(first, table, bucket), "searched")
    minima = np.zeros(-(-total // bucket) + 1, np.int64)  # of bounded number; nothing is beyond the last
    for b, x in table.groupBy(F.floor(F.col("i") / bucket).alias("b")).agg(F.min("common").alias("x")).collect():
        minima[b] = x
    sent = table.sparkSession.sparkContext.broadcast(minima)

    def hop(batches):
        for x in batches:
            left, b, m = x.column("left").to_numpy(zero_copy_only=False), x.column("b").to_numpy(), x.column("m").to_numpy()
            to = np.array([_next(sent.value, int(k), bool(s), int(n)) for k, s, n in zip(b, left, m, strict=True)], np.int64)
            start = np.where(left, np.minimum((to + 1) * bucket, total) - 1, to * bucket)
            yield pa.RecordBatch.from_arrays([x.column("i"), x.column("left"), pa.array(to), pa.array(start), x.column("m")], names=["i", "left", "b", "start", "m"])

    rest = first.filter("found IS NULL").select("i", "left", "b", "start", "m").mapInArrow(hop, "i long, left boolean, b long, start long, m long")
    rest = keep(rest, "hopped")
    ended = rest.filter(F.col("start") >= total).select("i", "left", F.lit(total).cast(LONG).alias("found"))
    found = first.filter("found IS NOT NULL").select("i", "left", "found").unionByName(ended)
    later = rest.filter(F.col("start") < total)
    if not later.isEmpty():
        found = found.unionByName(_search(later, table, bucket).select("i", "left", "found"))
    return found.groupBy("i").agg(F.max(F.when(F.col("left"), F.col("found"))).alias("low"), F.max(F.when(~F.col("left"), F.col("found"))).alias("high"))


def _next(minima: np.ndarray, b: int, left: bool, m: int) -> int:
    """The nearest bucket on this side of b whose minimum is less than m; the first place of all shares nothing."""
    step, n = (-1, 1) if left else (1, 1)
    while True:  # stretches that double, then the first in the last one
        part = minima[max(0, b - n) : b][::-1] if left else minima[b + 1 : b + 1 + n]
        hit = np.flatnonzero(part < m)
        if len(hit):
            return b + step * (int(hit[0]) + 1)
        n *= 2


def members(table: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """found (low, high, ...), for each panel place of table in the interval, with columns of that place. What is joined is
    little more than what comes out: an interval is cut at every NARROW places."""
    b = lambda c: F.floor(c / NARROW)
    each = found.withColumn("_b", F.explode(F.sequence(b(F.col("low")), b(F.col("high") - 1))))
    places = table.filter(~F.col("seq_id.asked")).select(b(F.col("i")).alias("_b"), F.col("i").alias("_i"), *(F.col(c).alias(f"t_{c}") for c in columns))
    return each.join(places, "_b").filter((F.col("_i") >= F.col("low")) & (F.col("_i") < F.col("high"))).drop("_b", "_i")


def order_of(rows: DataFrame) -> DataFrame:
    """ordered() of rows with what neighbours share, kept."""
    return keep(with_common(ordered(rows, near=True), rows), "common")


def panel_before(table: DataFrame) -> DataFrame:
    """table (seq_id, i, r, first, part, ...) of an order of together(), with c, how many panel places lie before each row, and
    c_r and c_first, how many before the first of its context and of its node."""
    one = F.when(~F.col("seq_id.asked"), 1).otherwise(0)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = table.groupBy("part").agg(F.sum(one).alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_base"))
    own = dealt(table).join(F.broadcast(base), "part")  # a row for each range
    own = own.withColumn("c", (F.col("_base") + F.coalesce(F.sum(one).over(before(Window.partitionBy("part").orderBy("i"))), F.lit(0))).cast(LONG)).drop("_base")
    return firsts(own, {"c_r": F.col("i") == F.col("r"), "c_first": F.col("i") == F.col("first")}, "counts", {"c_r": F.col("c"), "c_first": F.col("c")})


def at_places(found: DataFrame, column: str, counted: DataFrame, name: str) -> DataFrame:
    """found with name: how many panel places of counted (panel_before) lie before the place in `column`."""
    total: Column = F.lit(counted.filter(~F.col("seq_id.asked")).count())
    met = found.join(counted.select(F.col("i").alias(column), F.col("c").alias(name)), column, "left")
    return met.withColumn(name, F.coalesce(F.col(name), total).cast(LONG))
