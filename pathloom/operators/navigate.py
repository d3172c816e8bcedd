"""Tables for finding one's way in a panel: visits in co-lexicographic order, edges, runs, suffixes and text.

A visit is a place where a path meets a node. A node's visits are ordered by the path's prefix that ends there, read
backwards; at equal prefixes, by sequence (order.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from ..sources.panel import Panel
from . import nearest
from .asof import covering
from .order import in_common, ordered

LONG = "long"


def node_sizes(panel: Panel) -> DataFrame:
    return panel.positions.groupBy("node").agg(F.count("*").alias("visits"))


def contains(panel: Panel, node) -> DataFrame:
    """(found boolean): whether any path visits the node."""
    return panel.positions.agg(F.coalesce(F.bool_or(F.col("node") == node), F.lit(False)).alias("found"))


def in_range(panel: Panel, nodes: DataFrame, endmarker: int = 0) -> DataFrame:
    """(node, contained): whether each of nodes (node), which are integers, lies within the panel's least and greatest node,
    visited or not, or is the endmarker."""
    ends = panel.positions.agg(F.min("node").alias("low"), F.max("node").alias("high"))  # one row
    inside = (F.col("node") == endmarker) | F.coalesce(F.col("node").between(F.col("low"), F.col("high")), F.lit(False))
    return nodes.select("node").crossJoin(F.broadcast(ends)).select("node", inside.alias("contained"))


def header(panel: Panel) -> DataFrame:
    """One row: size (nodes, and an endmarker for each sequence), sequences, sigma (one more than the greatest node),
    effective (nodes of the range between, and the endmarker), bidirectional. For panels of integers."""
    ends = panel.positions.agg(F.min("node").alias("low"), F.max("node").alias("high"))
    both = panel.stats().crossJoin(ends)  # one row each
    return both.select("size", "sequences", (F.col("high") + 1).cast(LONG).alias("sigma"), (F.col("high") - F.col("low") + 2).cast(LONG).alias("effective"), F.lit(panel.bidirectional).alias("bidirectional"))


def successors(panel: Panel, end: Column) -> DataFrame:
    """(seq_id, pos, node, next_node): next_node is `end` after a path's last node."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    return panel.positions.withColumn("next_node", F.coalesce(F.lead("node").over(w), end))


def edges(panel: Panel, end: Column) -> DataFrame:
    """(node, next_node, visits, rank): successors of each node, ranked from 0."""
    counted = successors(panel, end).groupBy("node", "next_node").agg(F.count("*").alias("visits"))
    return counted.withColumn("rank", (F.dense_rank().over(Window.partitionBy("node").orderBy("next_node")) - 1).cast(LONG))


def outdegrees(panel: Panel, end: Column) -> DataFrame:
    return successors(panel, end).groupBy("node").agg(F.countDistinct("next_node").alias("outdegree"))


def outgoing(panel: Panel) -> DataFrame:
    """(node, next_node, visits, first): how many visits to next_node come from smaller nodes. Visits that begin a path
    come first, as from a node smaller than all (null here)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    counted = panel.positions.select(F.lag("node").over(w).alias("node"), F.col("node").alias("next_node")).groupBy("node", "next_node").agg(F.count("*").alias("visits"))
    before = Window.partitionBy("next_node").orderBy(F.asc_nulls_first("node")).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first", F.coalesce(F.sum("visits").over(before), F.lit(0)).cast(LONG))


def visits(panel: Panel, end: Column, prefix: bool = False) -> DataFrame:
    """(node, off, seq_id, pos, next_node, seq_offset), and prefix, which is read backwards from the visit; as it's as long
    as the path so far, only where it's asked for."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    rows = ordered(panel.positions.select("seq_id", "pos", "node")).select("seq_id", "pos", "node", (F.col("i") - F.col("first")).alias("off"))
    more = {"prefix": F.reverse(F.collect_list("node").over(w.rowsBetween(Window.unboundedPreceding, 0)))} if prefix else {}
    last = F.max("pos").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"next_node": F.coalesce(F.lead("node").over(w), end), "seq_offset": (last - F.col("pos")).cast(LONG)} | more)
    return rows.select("node", "off", "seq_id", "pos", "next_node", "seq_offset", *more)


def lf(table: DataFrame) -> DataFrame:
    """(node, off, next_node, next_off): from each visit to the next one on its path; no row at a path's end."""
    ahead = table.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("node").alias("to"), F.col("off").alias("next_off"))
    return table.join(ahead, ["seq_id", "pos"]).select("node", "off", F.col("to").alias("next_node"), "next_off")


def inverse_lf(table: DataFrame) -> DataFrame:
    """(node, off, prev_node, prev_off): to the visit before; null at a path's start."""
    behind = table.select("seq_id", (F.col("pos") + 1).alias("pos"), F.col("node").alias("prev_node"), F.col("off").alias("prev_off"))
    return table.join(behind, ["seq_id", "pos"], "left").select("node", "off", "prev_node", "prev_off")


def lf_to(table: DataFrame, node, off: int, to) -> DataFrame:
    """(to_off): where a visit at `off` of node would land if it went on to `to`: visits of `to` that come from smaller
    nodes, and those from this node's earlier visits. off may be the node's size; no row if no path goes that way."""
    asked = table.sparkSession.range(1).select(F.lit(node).alias("node"), F.lit(off).cast(LONG).alias("off"), F.lit(to).alias("to"))
    return lf_to_many(table, asked).select("to_off")


def lf_to_many(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, off, to, to_off): lf_to() for each row of asked (node, off, to); no row if no path goes that way."""
    counted = table.groupBy("node", F.col("next_node").alias("to")).agg(F.count("*").alias("n"))
    starts = table.filter("pos = 0").groupBy(F.col("node").alias("to")).agg(F.count("*").alias("starts"))
    below = Window.partitionBy("to").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("node", "to", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("first")).join(starts, "to", "left")
    steps = table.select("node", F.col("next_node").alias("to"), "off", F.lit(1).alias("own"))
    both = steps.unionByName(asked.select("node", "to", "off", F.lit(0).alias("own")))
    earlier = Window.partitionBy("node", "to").orderBy("off").rangeBetween(Window.unboundedPreceding, -1)
    done = both.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).filter("own = 0").drop("own")
    return done.join(first, ["node", "to"]).select("node", "off", "to", (F.col("first") + F.coalesce("starts", F.lit(0)) + F.col("before")).cast(LONG).alias("to_off"))


def runs(table: DataFrame, end: Column) -> DataFrame:
    """(node, concrete, logical): runs of equal successors in a node's order of visits; logically, each path's end is one."""
    return run_ids(table, end).groupBy("node").agg((F.max("run_id") + 1).alias("concrete"), (F.max("logical_id") + 1).alias("logical"))


def run_ids(table: DataFrame, end: Column, bucket: int = 65536) -> DataFrame:
    """(node, off, run_id, logical_id), both from 0. Sums run within buckets of a node's places, then over its buckets."""
    after = table.select("node", (F.col("off") + 1).alias("off"), F.col("next_node").alias("_before"), F.lit(True).alias("_there"))
    own = table.select("node", "off", "next_node", F.floor(F.col("off") / bucket).alias("b")).join(after, ["node", "off"], "left")
    new = F.when(F.col("_there").isNotNull() & F.col("_before").eqNullSafe(F.col("next_node")), 0).otherwise(1)
    flags = own.select("node", "off", "b", new.alias("n"), F.when(F.col("next_node") == end, 1).otherwise(new).alias("l"))
    before = Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = flags.groupBy("node", "b").agg(F.sum("n").alias("n0"), F.sum("l").alias("l0"))
    base = base.select("node", "b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "l0")))
    up = Window.partitionBy("node", "b").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    sums = flags.withColumns({"n": F.sum("n").over(up), "l": F.sum("l").over(up)}).join(base, ["node", "b"])
    return sums.select("node", "off", (F.col("n") + F.col("n0") - 1).cast(LONG).alias("run_id"), (F.col("l") + F.col("l0") - 1).cast(LONG).alias("logical_id"))


def run_table(table: DataFrame, end: Column) -> DataFrame:
    """(node, run, next_node, first, length, to_first): visits as runs of equal successors; to_first is where the first of
    them leads, and the others lead to the places after it; null at paths' ends. It has all that lf() has, in as many
    rows as there are runs: paths that go the same way, as copies do, share theirs."""
    steps = table.join(run_ids(table, end), ["node", "off"]).join(lf(table).select("node", "off", "next_off"), ["node", "off"], "left")
    rows = steps.groupBy("node", F.col("run_id").alias("run")).agg(F.first("next_node").alias("next_node"), F.min("off").alias("first"), F.count("*").alias("length"), F.min("next_off").alias("to_first"))
    return rows.select("node", "run", "next_node", "first", "length", "to_first")


def lf_by_runs(runs_: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, off, next_node, next_off) for asked (node, off): lf() from run_table() alone, by the run that begins last before
    a place. At a path's end next_off is null; beyond a node's visits next_node is, too."""
    met = covering(asked.select("node", "off"), "off", runs_, "first", "length", ["node"], ["next_node", "first", "to_first"])
    return met.select("node", "off", "next_node", (F.col("to_first") + F.col("off") - F.col("first")).alias("next_off"))


def lf_to_by_runs(runs_: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, off, to, to_off): lf_to_many() from run_table() alone: the first run that goes to `to` and ends after the place
    leads there, or else where the last one ends; no row if no path goes that way."""
    ways = runs_.filter("to_first IS NOT NULL").withColumn("to", F.col("next_node"))
    before = Window.partitionBy("node", "to").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ways = ways.withColumn("from", F.coalesce(F.max(F.col("first") + F.col("length")).over(before), F.lit(0)))  # over runs, not visits
    ways = ways.select("node", "to", "from", "first", (F.col("first") + F.col("length") - F.col("from")).alias("reach"), "to_first")
    last = ways.groupBy("node", "to").agg(F.max(F.col("to_first") + F.col("reach") - (F.col("first") - F.col("from"))).alias("beyond"))
    met = covering(asked.select("node", "to", "off"), "off", ways, "from", "reach", ["node", "to"], ["first", "to_first"]).join(last, ["node", "to"])
    inside = F.col("to_first") + F.greatest(F.col("off") - F.col("first"), F.lit(0))
    return met.select("node", "off", "to", F.coalesce(inside, F.col("beyond")).cast(LONG).alias("to_off"))


def run_samples(table: DataFrame, end: Column) -> DataFrame:
    """(node, run_id, head_seq, head_offset, tail_seq, tail_offset): the suffixes of a logical run's first and last visit."""
    at = F.struct("seq_id", "seq_offset")
    rows = table.join(run_ids(table, end), ["node", "off"]).groupBy("node", F.col("logical_id").alias("run_id"))
    both = rows.agg(F.min_by(at, "off").alias("h"), F.max_by(at, "off").alias("t"))
    return both.select("node", "run_id", F.col("h.seq_id").alias("head_seq"), F.col("h.seq_offset").alias("head_offset"), F.col("t.seq_id").alias("tail_seq"), F.col("t.seq_offset").alias("tail_offset"))


def head_lcp(table: DataFrame, end: Column) -> DataFrame:
    """(node, run_id, head_seq, head_offset, lcp): for each logical run, the suffix of its first visit and what that has in
    common with the visit before."""
    heads = run_ids(table, end).groupBy("node", F.col("logical_id").alias("run_id")).agg(F.min("off").alias("off"))
    at = table.select("node", "off", F.col("seq_id").alias("head_seq"), F.col("seq_offset").alias("head_offset"))
    return heads.join(at, ["node", "off"]).join(adjacent_lcp(table), ["node", "off"]).select("node", "run_id", "head_seq", "head_offset", "lcp")


def locate_ends(table: DataFrame) -> DataFrame:
    """(node, first_seq, first_offset, last_seq, last_offset): suffixes of the first and the last visit."""
    at = F.struct("seq_id", "seq_offset")
    both = table.groupBy("node").agg(F.min_by(at, "off").alias("f"), F.max_by(at, "off").alias("l"))
    return both.select("node", F.col("f.seq_id").alias("first_seq"), F.col("f.seq_offset").alias("first_offset"), F.col("l.seq_id").alias("last_seq"), F.col("l.seq_offset").alias("last_offset"))


def suffix_neighbours(table: DataFrame) -> DataFrame:
    """(node, off, seq_id, seq_offset, prev_seq, prev_offset, next_seq, next_offset): null beyond a node's ends. Joined by
    node and place, so a frequent node's visits are many tasks' work."""
    own = table.select("node", "off", "seq_id", "seq_offset")
    beside = lambda name, step: table.select("node", (F.col("off") + step).alias("off"), F.col("seq_id").alias(f"{name}_seq"), F.col("seq_offset").alias(f"{name}_offset"))
    return own.join(beside("prev", 1), ["node", "off"], "left").join(beside("next", -1), ["node", "off"], "left")


def adjacent_lcp(table: DataFrame) -> DataFrame:
    """(node, off, lcp): nodes that a visit's path shares, going backwards from the node itself, with the visit before.

    A visit whose path comes from the visit after that from which the path of the visit before comes shares one node more
    than these two. So only heads, whose paths come from elsewhere, are compared (order.in_common); the rest follows from
    the last head on the path and the distance from it. Visits are joined twice, to what lies before them on the path and
    in the node, and heads alone for each level of lengths."""
    by_seq = Window.partitionBy("seq_id").orderBy("pos")
    own = table.select("node", "off", "seq_id", "pos", F.lag(F.struct("node", "off")).over(by_seq).alias("came"))
    before = own.select("node", (F.col("off") + 1).alias("off"), F.col("seq_id").alias("y"), F.col("pos").alias("y_at"), F.col("came").alias("y_came"))
    met = own.join(before, ["node", "off"], "left")
    follows = F.coalesce((F.col("came.node") == F.col("y_came.node")) & (F.col("came.off") == F.col("y_came.off") + 1), F.lit(False))
    apart = ~F.coalesce(F.col("came.node") == F.col("y_came.node"), F.lit(False))
    told = F.when(F.col("y").isNull(), F.lit(0)).when(apart, F.lit(1))
    met = keep(met.select("node", "off", "seq_id", "pos", "y", "y_at", told.cast(LONG).alias("head"), follows.alias("follows")), "heads")
    asked = keep(met.filter("head IS NULL AND NOT follows").select("seq_id", "pos", F.col("seq_id").alias("x"), F.col("pos").alias("x_at"), "y", "y_at"), "compared")
    found = in_common(asked, table.select("seq_id", "pos", "node"), ["seq_id", "pos"])
    rows = met.join(found, ["seq_id", "pos"], "left").withColumn("head", F.coalesce("head", "common"))
    passed = F.last(F.col("head") - F.col("pos"), ignorenulls=True).over(by_seq.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("node", "off", (passed + F.col("pos")).cast(LONG).alias("lcp"))


def path_lengths(panel: Panel) -> DataFrame:
    return panel.positions.groupBy("seq_id").agg(F.count("*").alias("length"))


def path_starts(panel: Panel, bucket: int = 65536) -> DataFrame:
    """(seq_id, length, start): where each sequence begins in the text of all, each followed by an endmarker. Sums run
    within buckets of ids, then over the buckets, so no task holds all sequences."""
    lengths = path_lengths(panel).withColumn("b", F.floor(F.col("seq_id") / bucket))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lengths.groupBy("b").agg(F.sum(F.col("length") + 1).alias("n"))
    lead = total.select("b", F.coalesce(F.sum("n").over(before(Window.orderBy("b"))), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum(F.col("length") + 1).over(before(Window.partitionBy("b").orderBy("seq_id"))), F.lit(0))
    return lengths.withColumn("inner", inner).join(lead, "b").select("seq_id", "length", (F.col("base") + F.col("inner")).cast(LONG).alias("start"))


def text(panel: Panel, end: Column) -> DataFrame:
    """(i, node): each sequence backwards, then the endmarker, in order of sequences."""
    starts = path_starts(panel)
    nodes = panel.positions.join(starts, "seq_id").select((F.col("start") + F.col("length") - 1 - F.col("pos")).alias("i"), "node")
    return nodes.unionByName(starts.select((F.col("start") + F.col("length")).alias("i"), end.alias("node")))


def text_at(panel: Panel, places: DataFrame, end: Column) -> DataFrame:
    """(i, node) for the asked places (i); null outside of the text. A place's path is the one that begins last before it;
    then one join of these few places reads the nodes. The text itself isn't made."""
    starts = path_starts(panel).withColumn("n", F.col("length") + 1)
    asked = places.select(F.col("i").cast(LONG).alias("i"), F.lit(0).alias("text"))
    met = covering(asked, "i", starts.withColumn("text", F.lit(0)), "start", "n", ["text"], ["seq_id", "start", "length"])
    at = met.select("i", "seq_id", (F.col("start") + F.col("length") - 1 - F.col("i")).alias("pos"))
    return at.join(panel.positions, ["seq_id", "pos"], "left").select("i", F.when(F.col("pos") == -1, end).otherwise(F.col("node")).alias("node"))


def text_violations(panel: Panel, written: DataFrame, end: Column) -> DataFrame:
    """(i, node, found): places of the panel's text where another table of it (i, node) has something else, or nothing, or
    more than one row, and places that only that table has."""
    want = text(panel, end)
    got = written.groupBy("i").agg(F.count("*").alias("n"), F.min("node").alias("found"))
    both = want.join(got, "i", "full")
    return both.filter(~(F.col("node").eqNullSafe(F.col("found")) & (F.col("n") == 1))).select("i", "node", "found")


def suffix_violations(table: DataFrame) -> DataFrame:
    """Visits from which the next suffix's previous one isn't their own; none in a consistent table."""
    near = suffix_neighbours(table)
    back = near.select("node", F.col("seq_id").alias("next_seq"), F.col("seq_offset").alias("next_offset"), F.col("prev_seq").alias("x"), F.col("prev_offset").alias("y"))
    met = near.filter("next_seq IS NOT NULL").join(back, ["node", "next_seq", "next_offset"], "left")
    return met.filter(~(F.col("x").eqNullSafe(F.col("seq_id")) & F.col("y").eqNullSafe(F.col("seq_offset")))).select("node", "off", "seq_id", "seq_offset")


def violations(table: DataFrame) -> DataFrame:
    """Visits whose step forward and back again doesn't lead to themselves; none in a consistent table."""
    forth, back = lf(table), inverse_lf(table)
    met = forth.join(back.select(F.col("node").alias("next_node"), F.col("off").alias("next_off"), "prev_node", "prev_off"), ["next_node", "next_off"], "left")
    return met.filter(~(F.col("prev_node").eqNullSafe(F.col("node")) & F.col("prev_off").eqNullSafe(F.col("off"))))


def alphabet(panel: Panel) -> DataFrame:
    """(node, comp): nodes numbered from 1 in their order; 0 is left for the endmarker. Numbers run within groups of nodes
    that begin alike (in two characters, or in all but the last 16 bits), then over the groups."""
    kind = panel.positions.schema["node"].dataType.typeName()
    group = F.substring("node", 1, 2) if kind == "string" else F.floor(F.col("node") / 65536)
    nodes = panel.positions.select("node").distinct().withColumn("b", group)
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over groups, not nodes
    base = nodes.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return nodes.join(base, "b").select("node", (F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("node"))).cast(LONG).alias("comp"))


def to_node(panel: Panel, numbers: DataFrame) -> DataFrame:
    """(comp, node) for numbers (comp); null where no node has the number."""
    return numbers.select("comp").join(alphabet(panel), "comp", "left").select("comp", "node")


def offset_to(table: DataFrame) -> DataFrame:
    """(node, next_node, next_off, off): for each step that a path makes, where it came from."""
    return lf(table).select("node", "next_node", "next_off", "off")


def lf_with_runs(table: DataFrame, end: Column) -> DataFrame:
    """(node, off, next_node, next_off, run_first, run_last, logical_id): each step with the run that its visit is in."""
    ids = run_ids(table, end)
    ends = ids.groupBy("node", "run_id").agg(F.min("off").alias("run_first"), F.max("off").alias("run_last"))
    bounds = ids.join(ends, ["node", "run_id"]).select("node", "off", "run_first", "run_last", "logical_id")
    return lf(table).join(bounds, ["node", "off"]).select("node", "off", "next_node", "next_off", "run_first", "run_last", "logical_id")


def suffixes_of(table: DataFrame, node) -> DataFrame:
    """(off, seq_id, seq_offset): all suffixes of a node, which `off` puts in order."""
    return suffixes(table).filter(F.col("node") == node).drop("node")


def suffixes(table: DataFrame) -> DataFrame:
    """(node, off, seq_id, seq_offset): the suffixes of all nodes, which `off` puts in order."""
    return table.select("node", "off", "seq_id", "seq_offset")


def dump(panel: Panel, end: Column, n: int = 20) -> None:
    """Prints all that this module derives from a panel, n rows of each."""
    table = visits(panel, end)
    for name, df in {
        "paths": panel.paths(), "nodes": node_sizes(panel), "edges": edges(panel, end), "from smaller nodes": outgoing(panel), "visits, successors and suffixes": table, "steps": lf(table), "steps back": inverse_lf(table),
        "runs": runs(table, end), "samples of runs": run_samples(table, end), "shared with the visit before": adjacent_lcp(table), "text": text(panel, end), "starts of paths": path_starts(panel),
    }.items():
        print(name)
        df.orderBy(*df.columns[:2]).show(n, truncate=False)


def insertion_offsets(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, pos, off): before which visit of its node each query prefix would stand, in co-lexicographic order; at
    equal prefixes, before all. Only queries whose nodes all have visits should be asked."""
    return insertion_places(queries, table).select("query_id", "pos", "off")


def insertion_places(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, pos, node, off, after, new_off): as insertion_offsets(); after: at equal prefixes after all visits of the
    table; new_off: where the prefix stands once all queries are inserted, in this way and by their ids."""
    rows = nearest.together(queries, table.select("seq_id", "pos", "node"))
    asked = nearest.panel_before(ordered(rows)).filter("seq_id.asked")
    return asked.select(F.col("seq_id.id").alias("query_id"), "pos", "node", (F.col("c_r") - F.col("c_first")).alias("off"), (F.col("c") - F.col("c_first")).alias("after"), (F.col("i") - F.col("first")).alias("new_off"))
