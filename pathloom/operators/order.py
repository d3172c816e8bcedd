"""Places of sequences in the order of what lies behind them, and what neighbours in that order have in common.

A place's context is its sequence read backwards from there; it ends at the sequence's beginning, which is smaller than any
node. Places are sorted by the last CONTEXT nodes of it and by sequence, by ranges that Spark samples, so no task holds a
frequent node, and none a frequent context. A place's number is its number in its range, and how many lie in earlier ranges:
sums over ranges, of which there are as many as shuffle partitions.

Places of the same whole context, as those of copies, are a group: a 128-bit name of the sequence up to there, salted anew
for each order, tells them. Only groups that still tie go on, a row for each: by the ranks of the groups CONTEXT nodes behind,
then twice as many. So rounds follow what different contexts have in common, not how long sequences or how many copies are.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import gram_names
from ..sources.kept import keep

LONG = "long"
CONTEXT = 16
SEPARATOR = "\u0000"
#: Rows of a range, about: what a task of a window over ranges holds.
RANGE = 1 << 15


def _ranges(rows: DataFrame) -> int:
    """How many ranges rows are put in: as many as shuffle partitions, more where these would hold more than RANGE rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))


def dealt(table: DataFrame) -> DataFrame:
    """table (part, ...) dealt to tasks by range, so that windows over ranges need no other exchange."""
    n = _ranges(table)
    return table if n == int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table.repartitionById(n, F.col("part"))  # hashes would deal several ranges to one task


def numbered(rows: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """rows, kept, with i: their numbers from 0 in the order of `by` (total), and part, the range of each. One exchange."""
    sorted_ = rows.repartitionByRange(_ranges(rows), *by).sortWithinPartitions(*by)
    held = keep(sorted_.withColumn("_m", F.monotonically_increasing_id()), name)  # numbers are fixed once written
    held = held.select(*rows.columns, F.shiftright("_m", 33).cast("int").alias("part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_k"))
    counts = held.groupBy("part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    base = counts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(F.broadcast(base), "part").select(*rows.columns, "part", (F.col("_base") + F.col("_k")).cast(LONG).alias("i"))  # a row for each range


def firsts(table: DataFrame, flags: dict[str, Column], group: str, values: dict[str, Column] | None = None) -> DataFrame:
    """table (i, part, ...) with, for each flag, the i (or the value, which must grow with i) of the last row up to here whose
    flag is set. Within ranges first; a range that begins without one takes it from those before."""
    up, values = Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0), values or {}
    own = keep(table.withColumns({k: F.max(F.when(v, values.get(k, F.col("i")))).over(up) for k, v in flags.items()}), group)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("part").agg(*(F.max(k).alias(k) for k in flags))
    ends = ends.select("part", *(F.max(k).over(before).alias(f"_{k}") for k in flags))
    joined = own.join(F.broadcast(ends), "part")  # a row for each range
    return joined.withColumns({k: F.coalesce(k, f"_{k}") for k in flags}).drop(*(f"_{k}" for k in flags))


def with_previous(table: DataFrame, columns: list[str]) -> DataFrame:
    """table (i, part, ...) with p_<column> of the row before in the order, over the borders of ranges too; null at first."""
    own = Window.partitionBy("part").orderBy("i")
    last = table.groupBy("part").agg(F.max_by(F.struct(*columns), "i").alias("_last"))
    before = last.select("part", F.last("_last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_last"))
    met = table.withColumn("_prev", F.lag(F.struct(*columns)).over(own)).join(F.broadcast(before), "part")  # a row for each range
    met = met.withColumn("_prev", F.coalesce("_prev", "_last"))
    return met.select(*table.columns, *(F.col(f"_prev.{c}").alias(f"p_{c}") for c in columns))


def shared(a: Column, b: Column) -> Column:
    """How many first nodes two contexts have in common."""
    same = F.zip_with(F.split(a, SEPARATOR), F.split(b, SEPARATOR), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast(LONG)


def coded(node: Column, kind: str) -> Column:
    """Nodes as text in the same order, without SEPARATOR, which is less than all characters: strings with it and the character
    after it escaped; integers by their number of digits and digits."""
    if kind == "string":
        return F.replace(F.replace(node, F.lit("\u0001"), F.lit("\u0001\u0002")), F.lit(SEPARATOR), F.lit("\u0001\u0001"))
    digits = F.hex(node.cast(LONG))
    return F.concat(F.when(node < 0, F.lit("!")).otherwise(F.substring(F.lit("ABCDEFGHIJKLMNOP"), F.length(digits), F.lit(1))), digits)


def contexts(rows: DataFrame, n: int = CONTEXT) -> DataFrame:
    """rows with key: the last n nodes up to each, backwards, as text in their order; and h0 and h1, which name all nodes up to
    there: hashes of nodes with their places, put together along the sequence."""
    kind = rows.schema["node"].dataType.typeName()
    salts = [secrets.randbits(63) for _ in range(2)]
    own = rows.withColumns({"_code": coded(F.col("node"), kind)} | {f"h{k}": F.xxhash64(F.lit(s), F.col("pos").cast(LONG), "node") for k, s in enumerate(salts)})
    w = Window.partitionBy("seq_id").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    names = {f"h{k}": F.bit_xor(f"h{k}").over(up) for k in range(len(salts))}
    return own.withColumns({"key": F.array_join(F.reverse(F.collect_list("_code").over(w.rowsBetween(1 - n, 0))), SEPARATOR)} | names).drop("_code")


def ordered(rows: DataFrame, context: int = CONTEXT, near: bool = False) -> DataFrame:
    """rows (seq_id, pos, node, ...), kept, in order: with i, the number of each; r, the i of the first row that has the same
    whole context; first, that of the first row of the same node; key, the last `context` nodes. near: also how many of
    these it shares with the row before. Rows of the same context are in order of seq_id."""
    held = numbered(keep(contexts(rows, context), "named"), ["key", "h0", "h1", "seq_id", "pos"], "contexts")
    own = with_previous(dealt(held), ["key", "node", "h0", "h1"])
    new = F.coalesce(F.col("key") != F.col("p_key"), F.lit(True))
    apart = new | (F.col("h0") != F.col("p_h0")) | (F.col("h1") != F.col("p_h1"))
    flags, values, columns = {"k": new, "r": apart, "first": F.coalesce(F.col("node") != F.col("p_node"), F.lit(True))}, {}, ["part", "i", "r", "first", "key"]
    if near:
        code = F.col("i") * (context + 1) + F.coalesce(shared(F.col("key"), F.col("p_key")), F.lit(0))
        flags["group"], values["group"], columns = new, code, [*columns, "near", "group"]
    now = firsts(own, flags, "ranks", values).withColumns({"near": F.lit(context)} if near else {}).select(*rows.columns, *columns, "k")
    tied = keep(now.filter((F.col("i") == F.col("r")) & (F.col("r") != F.col("k"))).select("k").distinct(), "tied")
    if not tied.isEmpty():
        now = keep(_moved(now, _refined(now, tied, context), context), "refined")
    if near:  # the first row of a context shares with the one before what the contexts do; others, all of a context
        most = F.least(F.lit(context), F.col("pos") + 1)
        is_first = F.col("i") == F.floor(F.col("group") / (context + 1))
        now = now.withColumn("near", F.when(is_first, F.col("group") % (context + 1)).otherwise(most).cast(LONG)).drop("group")
    return now.drop("k")


def _refined(now: DataFrame, tied: DataFrame, n: int) -> DataFrame:
    """(r, to) for the groups of now (k, r, ...) whose key has others, too, those of tied (k): where each begins in the order
    of whole contexts. A row for each group, with the group b that lies n places behind, its key's rank b_k, and t, its own
    rank by n nodes; n doubles. Groups that tie still have groups behind that tie, too."""
    among = now.select("seq_id", "pos", "i", "k", "r").join(tied, "k", "left_semi")
    heads = among.filter("i = r").select("r", "k", "seq_id", "pos").join(among.groupBy("r").agg(F.count("*").alias("size")), "r")
    behind = now.select("seq_id", (F.col("pos") + n).alias("pos"), F.col("r").alias("b"), F.col("k").alias("b_k"))
    state = heads.join(behind, ["seq_id", "pos"], "left").select("r", "k", "size", "pos", "b", F.coalesce("b_k", F.lit(-1)).alias("b_k"), F.lit(0).cast(LONG).alias("t"), F.lit(-1).cast(LONG).alias("b_t"))
    by = ["k", "t", "b_k", "b_t"]
    while True:
        own = numbered(keep(state, "ties"), [*by, "r"], "tie-order")
        own = with_previous(dealt(own), by)
        new = F.coalesce(F.col("k") != F.col("p_k"), F.lit(True))
        for c in by[1:]:
            new = new | (F.col(c) != F.col(f"p_{c}"))
        own = firsts(own, {"t": new}, "tie-ranks").select("part", "i", "r", "k", "size", "pos", "b", "b_k", "t")
        n *= 2
        if own.filter((F.col("t") != F.col("i")) & (F.col("pos") >= n - 1)).isEmpty():
            return _begins(own)
        hop = own.select(F.col("r").alias("b"), F.col("b").alias("c"), F.col("b_k").alias("c_k"))
        rank = own.select(F.col("r").alias("c"), F.col("t").alias("c_t"))
        met = own.join(hop, "b", "left").join(rank, "c", "left")
        state = met.select("r", "k", "size", "pos", F.col("c").alias("b"), F.coalesce("c_k", F.lit(-1)).alias("b_k"), "t", F.coalesce("c_t", F.lit(-1)).alias("b_t"))


def _begins(own: DataFrame) -> DataFrame:
    """(r, to) for groups (r, k, size, i, part) in order: the first place of a key, k, and the sizes of its groups before."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("part").agg(F.sum("size").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_base"))
    up = F.coalesce(F.sum("size").over(before(Window.partitionBy("part").orderBy("i"))), F.lit(0))
    sums = with_previous(dealt(own), ["k"]).withColumn("_up", up).join(F.broadcast(base), "part").withColumn("s", (F.col("_up") + F.col("_base")).cast(LONG))  # a row for each range
    met = firsts(sums.drop("_up", "_base"), {"s0": F.coalesce(F.col("k") != F.col("p_k"), F.lit(True))}, "tie-places", {"s0": F.col("s")})
    return met.select("r", (F.col("k") + F.col("s") - F.col("s0")).cast(LONG).alias("to"))


def _moved(now: DataFrame, begins: DataFrame, context: int) -> DataFrame:
    """now, with the groups of begins (r, to) moved there. Contexts shorter than `context` don't tie, so these rows meet nothing."""
    ranges, total = _ranges(now), now.count()
    own = now.withColumn("_r", F.when(F.col("pos") >= context - 1, F.col("r")).otherwise(-1 - F.col("i")))
    met = own.join(begins.withColumnRenamed("r", "_r"), "_r", "left").withColumn("_to", F.coalesce("to", "r"))
    met = met.withColumns({"i": F.col("i") - F.col("r") + F.col("_to"), "r": F.col("_to")})
    part = F.floor(F.col("i") * ranges / total).cast("int")  # ties may have lain in several ranges, and have moved
    return met.withColumn("part", part).select(*now.columns)


def in_common(pairs: DataFrame, rows: DataFrame, pairs_key: list[str]) -> DataFrame:
    """(*pairs_key, common): how many nodes two places (x, x_at) and (y, y_at) of rows (seq_id, pos, node) share, going
    backwards. Stretches of 2 ** k nodes that end at a place have names by doubling; pairs go back by the longest stretch
    of one name first, then by half of it: the binary digits of what they share. Names are made once, and only pairs that
    aren't told by contexts should be asked."""
    now = pairs.select(*pairs_key, "x", "x_at", "y", "y_at", F.lit(0).cast(LONG).alias("common"))
    longest = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    for k in reversed(range(longest.bit_length())):
        n = 1 << k
        named = gram_names(rows, n).select("seq_id", (F.col("pos") + n - 1).alias("at"), F.struct("g0", "g1").alias("name"))
        for s in ("x", "y"):
            now = now.join(named.select(F.col("seq_id").alias(s), F.col("at").alias(f"{s}_at"), F.col("name").alias(f"{s}_name")), [s, f"{s}_at"], "left")
        step = F.when(F.coalesce(F.col("x_name") == F.col("y_name"), F.lit(False)), F.lit(n)).otherwise(F.lit(0))
        now = now.withColumn("_step", step).withColumns({"common": F.col("common") + F.col("_step"), "x_at": F.col("x_at") - F.col("_step"), "y_at": F.col("y_at") - F.col("_step")}).drop("_step", "x_name", "y_name")
    return now.select(*pairs_key, "common")


def with_common(table: DataFrame, rows: DataFrame, context: int = CONTEXT) -> DataFrame:
    """table (seq_id, pos, i, part, near, ...) of ordered() with common: how many nodes a row's context shares with that of the
    row before; 0 at first.

    Contexts tell it up to their length. Of the others, a row follows another if the row before it does, too, and these two
    are neighbours: then it shares one node more. What isn't told so is the first of a run of places that go the same way;
    only these are compared by names. The rest is passed on along the sequences."""
    by_seq = Window.partitionBy("seq_id").orderBy("pos")
    own = table.withColumn("i_behind", F.lag("i").over(by_seq))
    own = keep(with_previous(dealt(own), ["seq_id", "pos", "i_behind"]), "neighbours")
    far = F.col("near") >= context
    open_ = own.filter(far & ~F.coalesce(F.col("i_behind") == F.col("p_i_behind") + 1, F.lit(False)))
    asked = open_.select("i", F.col("seq_id").alias("x"), (F.col("pos") - context).alias("x_at"), F.col("p_seq_id").alias("y"), (F.col("p_pos") - context).alias("y_at"))
    asked = keep(asked, "compared")
    own = own.select(*table.columns, far.alias("_far"))
    if asked.isEmpty():
        told = own.withColumn("_sample", F.when(~F.col("_far"), F.col("near")))
    else:
        found = in_common(asked, rows, ["i"]).select("i", (F.col("common") + context).alias("_common"))
        told = own.join(found, "i", "left").withColumn("_sample", F.when(~F.col("_far"), F.col("near")).otherwise(F.col("_common")))
    passed = F.last(F.col("_sample") - F.col("pos"), ignorenulls=True).over(by_seq.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("common", (passed + F.col("pos")).cast(LONG)).drop("_far", "_sample", "_common")
