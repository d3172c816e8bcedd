"""Matches of query sequences in a panel: long, set-maximal, matching statistics, occurrences of a pattern.

A long match is a pair of equal stretches that can be extended neither way. Four plans for it, which agree:

- events (the default): k-grams of the least length are joined, but only where a match begins, that is, where the symbols
  before differ. The occurrences of a gram fall into classes by the symbol before it, and a query's occurrence only meets
  the classes other than its own. So no pair within a match is ever made, and the cost follows the number of matches, not
  their lengths. An occurrence has the next few symbols with it, so most matches' ends are told within the join, and pairs
  aren't shuffled. Longer ones are found by grams longer by these symbols, where a match begins or ends: a beginning on a
  diagonal belongs to the next end.
- lists: the same for where most grams match: occurrences with the same symbols beside them are lists, one for each length that
  a short match may have, so that all pairs of two lists are matches, and nothing is compared for each of them (lists.py).
- grams: k-grams are joined, and neighbours on a diagonal are put together.
- islands: single symbols are joined. The plain definition; quadratic in how often a symbol occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import AHEAD, SALTS, doubled_names, gram_names, names_of_lengths, pattern_name, sharing
from ..sources.kept import keep
from ..sources.panel import Panel
from . import lists, nearest
from .navigate import lf_to_many
from .order import ordered

ROW = ["query_id", "q_start", "length", "seq_id", "t_start"]


def guard(queries: DataFrame, panel: Panel, on_unknown: str = "empty") -> DataFrame:
    """Queries (query_id, pos, node) as they are to be matched. on_unknown says what a node that the panel lacks does:
    'empty': its query matches nothing; 'drop': it's taken out and its neighbours close up; 'ignore': it stays."""
    if on_unknown == "ignore":
        return queries
    nodes = panel.positions if panel.sequences is None else panel.sequences.select(F.explode(F.array_distinct("path")).alias("node"))
    known = nodes.select("node").distinct()
    if on_unknown == "empty":
        return queries.join(queries.join(known, "node", "left_anti").select("query_id").distinct(), "query_id", "left_anti")
    if on_unknown == "drop":
        w = Window.partitionBy("query_id").orderBy("pos")
        kept = queries.join(known, "node", "left_semi")
        return kept.select("query_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "node")
    raise ValueError(f"on_unknown: {on_unknown}")


def reversed_with_end(queries: DataFrame, end: Column) -> DataFrame:
    """(query_id, pos, node): each query read backwards, followed by the endmarker."""
    last = queries.groupBy("query_id").agg((F.max("pos") + 1).alias("n"))
    back = queries.join(last, "query_id").select("query_id", (F.col("n") - 1 - F.col("pos")).alias("pos"), "node")
    return back.unionByName(last.select("query_id", F.col("n").alias("pos"), end.alias("node")))


def _islands(pairs: DataFrame, extra: int) -> DataFrame:
    d = F.col("t_pos") - F.col("q_pos")
    w = Window.partitionBy("query_id", "seq_id", "d").orderBy("q_pos")
    grouped = pairs.withColumn("d", d).withColumn("g", F.col("q_pos") - F.row_number().over(w)).groupBy("query_id", "seq_id", "d", "g")
    return grouped.agg(F.min("q_pos").alias("q_start"), (F.count("*") + extra).cast("long").alias("length"), F.min("t_pos").alias("t_start")).select(*ROW)


def _sided(named: DataFrame, side: str) -> DataFrame:
    """named (gram_names) with its columns but the gram's and the sequence's called side_<column>."""
    return named.withColumnsRenamed({c: f"{side}_{c}" for c in named.columns if c not in ("g0", "g1", "f0", "f1", "seq_id", "query_id")})


def named_panel(panel: Panel, length: int) -> DataFrame:
    """The panel's grams as long_matches() joins them; kept as a table, they serve many calls of the same length."""
    return _sided(gram_names(panel.positions, length, ahead=True), "t")


def _differ(side: str) -> Column:
    a, b = F.col(f"q_{side}"), F.col(f"t_{side}")
    return F.coalesce(a != b, F.lit(True))  # a path's end differs from everything


def _events(q: DataFrame, t: DataFrame, length: int, residual, short) -> DataFrame:
    """Long matches: those shorter than length + AHEAD by `short`, others by grams of that length."""
    far = lambda df, side: df.filter("f0 IS NOT NULL").select("query_id" if side == "q" else "seq_id", f"{side}_pos", F.col("f0").alias("g0"), F.col("f1").alias("g1"), f"{side}_prev", F.col(f"{side}_far").alias(f"{side}_next"))
    return short(q, t, length, residual).unionByName(_ends(far(q, "q"), far(t, "t"), length + AHEAD, residual))


def _short(q: DataFrame, t: DataFrame, length: int, residual) -> DataFrame:
    """Matches of `length` symbols at least and fewer than AHEAD more. Each is made where it is joined, and sent nowhere."""
    on = ["g0", "g1"]
    t = t.drop("t_next", "t_far", "f0", "f1")
    own = q.drop("q_next", "q_far", "f0", "f1").join(t.select(*on, F.col("t_prev").alias("other")).distinct(), on)
    own = own.filter(F.coalesce(F.col("q_prev") != F.col("other"), F.lit(True)))  # a path's end differs from everything
    own = own.withColumnsRenamed({"g0": "q_g0", "g1": "q_g1"})
    met = own.join(t, (F.col("q_g0") == F.col("g0")) & (F.col("q_g1") == F.col("g1")) & F.col("other").eqNullSafe(F.col("t_prev")))
    met = met if residual is None else met.filter(residual)
    more = F.lit(None).cast("int")
    for k in reversed(range(AHEAD)):
        more = F.when(F.col(f"q_a{k}") == F.col(f"t_a{k}"), more).otherwise(F.lit(k))
    met = met.filter(more.isNotNull())
    return met.select("query_id", F.col("q_pos").alias("q_start"), (more + length).cast("long").alias("length"), "seq_id", F.col("t_pos").alias("t_start"))


def _listed(q: DataFrame, t: DataFrame, length: int, residual) -> DataFrame:
    """What _short() gives, by lists: a match of length + k symbols is a pair of equal grams of so many with different symbols
    before and behind, so for each k, lists of occurrences by gram and symbols beside are joined."""

    def each(named: DataFrame, side: str, key: str) -> DataFrame:
        a = [F.col(f"{side}_a{k}") for k in range(AHEAD)]
        name = lambda k: [F.xxhash64(F.lit(s), "g0", "g1", *a[:k]) for s in SALTS]
        levels = [F.struct(F.lit(k).alias("k"), *(x.alias(f"h{i}") for i, x in enumerate(name(k))), a[k].alias("next")) for k in range(AHEAD)]
        levels = [levels[0], *(F.when(a[k - 1].isNotNull(), levels[k]) for k in range(1, AHEAD))]
        own = named.select(key, f"{side}_pos", f"{side}_prev", F.explode(F.array(*levels)).alias("x")).filter("x IS NOT NULL")
        return own.select("x.k", F.col("x.h0").alias("g0"), F.col("x.h1").alias("g1"), f"{side}_prev", F.col("x.next").alias(f"{side}_next"), key, f"{side}_pos")

    met = lists.met(each(q, "q", "query_id"), each(t, "t", "seq_id"), ["k", "g0", "g1"], ["query_id", "q_pos"], ["seq_id", "t_pos"], ("q_prev", "q_next"), ("t_prev", "t_next"), _differ("prev") & _differ("next"))
    met = met if residual is None else met.filter(residual)
    return met.select("query_id", F.col("q_pos").alias("q_start"), (F.col("k") + length).cast("long").alias("length"), "seq_id", F.col("t_pos").alias("t_start"))


def _ends(q: DataFrame, t: DataFrame, length: int, residual) -> DataFrame:
    """Long matches from pairs of gram occurrences with different symbols at a side."""
    on = ["g0", "g1"]
    t = t.withColumn("beside", F.xxhash64("t_prev", "t_next"))
    classes = t.groupBy(*on, "beside").agg(F.first("t_prev").alias("t_prev"), F.first("t_next").alias("t_next"))
    asked = q.join(classes, on).filter(_differ("prev") | _differ("next")).drop("t_prev", "t_next")
    met = asked.join(t, [*on, "beside"])
    met = met if residual is None else met.filter(residual)
    met = met.select("query_id", "seq_id", (F.col("t_pos") - F.col("q_pos")).alias("d"), F.col("q_pos").alias("q_start"), _differ("prev").alias("begins"), F.when(_differ("next"), F.col("q_pos")).alias("q_end"))
    on_from = Window.partitionBy("query_id", "seq_id", "d").orderBy("q_start").rowsBetween(0, Window.unboundedFollowing)
    rows = met.withColumn("q_end", F.min("q_end").over(on_from)).filter("begins")
    return rows.select("query_id", "q_start", (F.col("q_end") - F.col("q_start") + length).cast("long").alias("length"), "seq_id", (F.col("q_start") + F.col("d")).alias("t_start"))


def long_matches(queries: DataFrame, panel: Panel, length: int, strategy: str = "events", on_unknown: str = "empty", residual=None, named: DataFrame | None = None) -> DataFrame:
    """(query_id, q_start, length, seq_id, t_start): all maximal matches of at least `length` symbols. residual: a
    condition on query_id and seq_id that the join applies. named: named_panel() of this panel and length, if it's kept."""
    if length < 1:
        raise ValueError("length is 1 at least")
    q = guard(queries, panel, on_unknown)
    if panel.sequences is not None and named is None:
        panel = Panel.from_paths(sharing(panel.sequences, q, length), panel.bidirectional)
    if strategy == "islands":
        pairs = q.select("query_id", F.col("pos").alias("q_pos"), "node").join(panel.positions.select("seq_id", F.col("pos").alias("t_pos"), "node"), "node")
        pairs = pairs if residual is None else pairs.filter(residual)
        return _islands(pairs, 0).filter(F.col("length") >= length)
    if strategy == "grams":
        gt = _sided(gram_names(panel.positions, length), "t") if named is None else named
        pairs = _sided(gram_names(q, length, "query_id"), "q").join(gt, ["g0", "g1"])
        pairs = pairs if residual is None else pairs.filter(residual)
        return _islands(pairs, length - 1)
    if strategy not in ("events", "lists"):
        raise ValueError(f"strategy: {strategy}")
    if named is not None and "f0" not in named.columns:  # kept by an earlier version
        return _ends(_sided(gram_names(q, length, "query_id"), "q"), named, length, residual)
    return _events(_sided(gram_names(q, length, "query_id", ahead=True), "q"), named_panel(panel, length) if named is None else named, length, residual, _short if strategy == "events" else _listed)


def sweep(found: DataFrame, lengths: list[int]) -> DataFrame:
    """(min_length, query_id, q_start, length, seq_id, t_start): for each of the lengths, the matches of so many symbols at
    least. found: long_matches() of the smallest one, which has those of all others, so nothing is named or joined again.
    A length that is given twice counts once; one that no match reaches has no rows."""
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths are 1 at least, and there is one")
    asked = sorted(set(lengths))
    up_to = [F.array(*(F.lit(x).cast("long") for x in asked[: n + 1])) for n in range(len(asked))]
    reached = F.array().cast("array<long>")
    for least, x in zip(asked, up_to, strict=True):
        reached = F.when(F.col("length") >= least, x).otherwise(reached)
    return found.select(F.explode(reached).alias("min_length"), *ROW)


def sweep_counts(found: DataFrame, least: int) -> DataFrame:
    """(min_length, matches, symbols): for `least` and its doubles, up to the longest match, how many matches have so many
    symbols at least, and their symbols. found: long_matches() of `least`. Matches are counted by length first, so what is
    repeated for each double is a row for each length. Symbols are decimals of 38 digits."""
    if least < 1:
        raise ValueError("length is 1 at least")
    by_length = found.filter(F.col("length") >= least).groupBy("length").agg(F.count("*").alias("n"))
    doubles = F.expr(f"transform(sequence(0, 62), k -> {int(least)} * cast(shiftleft(1L, k) as decimal(19,0)))")
    each = by_length.withColumn("x", F.explode(F.filter(doubles, lambda x: x <= F.col("length"))))
    return each.groupBy(F.col("x").cast("long").alias("min_length")).agg(F.sum("n").alias("matches"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("length").cast("decimal(18,0)")).cast("decimal(38,0)").alias("symbols"))


def match_counts(queries: DataFrame, panel: Panel, least: int, on_unknown: str = "empty", others: bool = False) -> DataFrame:
    """What sweep_counts() gives for long_matches(), without a match being made: counts of grams alone are joined, so the work
    follows the tables and not the pairs. others: queries aren't matched with the sequence of their own id.

    Where a match of at least n symbols begins, two grams of n are equal and the symbols before them differ: pairs of equal
    grams, less those with the same symbol before. A match of l symbols has l - n + 1 pairs of equal grams, so the pairs
    and n - 1 for each match are the symbols."""
    if least < 1:
        raise ValueError("length is 1 at least")
    q = guard(queries, panel, on_unknown)
    longest = (q.agg(F.max("pos")).first()[0] or 0) + 1  # no match is longer than a query
    number = lambda c: F.col(c).cast("decimal(19,0)")
    product = (number("q") * number("t")).cast("decimal(38,0)")
    side = lambda df, key, q, t: doubled_names(df, least, longest, key).select(F.col(key).cast("long").alias("id"), "min_length", "g0", "g1", "prev", F.lit(q).alias("q"), F.lit(t).alias("t"))
    sums = lambda df, *keys: df.groupBy("min_length", *keys).agg(F.sum("q").alias("q"), F.sum("t").alias("t"))
    both = side(q, "query_id", 1, 0).unionByName(side(panel.positions, "seq_id", 0, 1))
    total = lambda df, sign, same: df.filter("q > 0 AND t > 0").groupBy("min_length").agg(F.sum(product).cast("decimal(38,0)").alias("n")).select("min_length", (F.col("n") * sign).alias("n"), F.lit(same).alias("same"))
    finest = sums(both, "g0", "g1", "prev", *(["id"] if others else []))
    classes = sums(finest, "g0", "g1", "prev") if others else finest
    parts = [total(sums(classes, "g0", "g1"), 1, False), total(classes.filter("prev IS NOT NULL"), -1, True)]
    if others:
        parts += [total(sums(finest, "g0", "g1", "id"), -1, False), total(finest.filter("prev IS NOT NULL"), 1, True)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    pairs, matched = F.sum(F.when(~F.col("same"), F.col("n"))).cast("decimal(38,0)"), F.sum("n").cast("decimal(19,0)")
    found = every.groupBy("min_length").agg(pairs.alias("pairs"), matched.alias("n")).filter("n > 0")
    return found.select("min_length", F.col("n").cast("long").alias("matches"), (F.col("pairs") + (F.col("min_length") - 1).cast("decimal(18,0)") * F.col("n")).cast("decimal(38,0)").alias("symbols"))


def verified(matches: DataFrame, queries: DataFrame, panel: Panel) -> DataFrame:
    """The matches whose stretches are equal symbol by symbol: all of them, unless two names of 128 bits collide. Only the
    symbols of the stretches are joined, one row for each."""
    each = matches.distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    each = each.withColumns({"q_pos": F.col("q_start") + F.col("k"), "t_pos": F.col("t_start") + F.col("k")})
    q = queries.select("query_id", F.col("pos").alias("q_pos"), F.col("node").alias("a"))
    t = panel.positions.select("seq_id", F.col("pos").alias("t_pos"), F.col("node").alias("b"))
    same = each.join(q, ["query_id", "q_pos"]).join(t, ["seq_id", "t_pos"]).filter("a = b")
    right = same.groupBy(*ROW).agg(F.count("*").alias("n")).filter("n = length").drop("n")
    return matches.join(right, ROW, "left_semi").select(*matches.columns)


OTHERS = "seq_id != query_id"  # text, as a column needs a session


def matching_statistics(queries: DataFrame, panel: Panel, on_unknown: str = "empty", others: bool = False) -> DataFrame:
    """(query_id, pos, m): the longest match that starts at each position: what its nearest neighbours in the order of all
    that follows have in common with it. others: queries aren't matched with the sequence of their own id."""
    rows = nearest.together(guard(queries, panel, on_unknown), panel.positions, back=True)
    return nearest.longest(ordered(rows), rows, others).select("query_id", F.col("at").alias("pos"), "m")


def matching_statistics_end(queries: DataFrame, panel: Panel, on_unknown: str = "empty", others: bool = False) -> DataFrame:
    """(query_id, pos, m): the longest match that ends with each position: the same in the order of what lies before."""
    rows = nearest.together(guard(queries, panel, on_unknown), panel.positions)
    return nearest.longest(ordered(rows), rows, others).select("query_id", F.col("at").alias("pos"), "m")


def set_maximal_matches(queries: DataFrame, panel: Panel, on_unknown: str = "empty", others: bool = False) -> DataFrame:
    """(query_id, q_start, length, seq_id, t_start): matches that lie in no longer match's part of the query: each
    position's longest ones, where they are no shorter than at the position before. All places of one are an interval of
    the order of what follows (nearest.intervals)."""
    rows = nearest.together(guard(queries, panel, on_unknown), panel.positions, back=True)
    table = nearest.order_of(rows)
    stats = nearest.longest(table, rows, others).withColumn("before", F.lag("m").over(Window.partitionBy("query_id").orderBy("at")))
    kept = keep(stats.filter((F.col("m") > 0) & (F.col("before").isNull() | (F.col("m") >= F.col("before")))).select("query_id", "at", "i", "m"), "maximal")
    found = kept.join(nearest.intervals(table, kept), "i")
    met = nearest.members(table, found, ["seq_id", "at"])
    met = met.select("query_id", F.col("at").alias("q_start"), F.col("m").alias("length"), F.col("t_seq_id.id").alias("seq_id"), F.col("t_at").alias("t_start"))
    return met.filter(OTHERS) if others else met


def without_places(matches: DataFrame) -> DataFrame:
    """Matches as (query_id, q_start, length, seq_id); a sequence that is met twice has two rows."""
    return matches.drop("t_start")


def locate(panel: Panel, pattern: list) -> DataFrame:
    """(seq_id, t_start): all occurrences of the pattern."""
    kind = panel.positions.schema["node"].dataType.simpleString()
    g0, g1 = pattern_name(pattern, kind)
    return gram_names(panel.positions, len(pattern)).filter((F.col("g0") == g0) & (F.col("g1") == g1)).select("seq_id", F.col("pos").alias("t_start"))


def _found(panel: Panel, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The order of panel and patterns, and (pattern_id, node, i, m, low, high): the interval of places where each ends."""
    rows = nearest.together(patterns.withColumnRenamed("pattern_id", "query_id"), panel.positions)
    table = nearest.order_of(rows)
    last = table.filter("seq_id.asked").groupBy("seq_id").agg(F.max(F.struct("pos", "i", "node")).alias("x"))
    asked = keep(last.select(F.col("seq_id.id").alias("pattern_id"), "x.node", "x.i", (F.col("x.pos") + 1).alias("m")), "patterns")
    return table, asked.join(nearest.intervals(table, asked), "i")


def find_many(panel: Panel, patterns: DataFrame) -> DataFrame:
    """(pattern_id, node, first, last) for patterns (pattern_id, pos, node) of any lengths: the visits, by their places in the
    order of node's visits, whose paths have the pattern up to there; no row for a pattern that occurs nowhere. All
    patterns are found at once, in one order of panel and patterns."""
    table, found = _found(panel, patterns)
    counted = keep(nearest.panel_before(table).select("seq_id", "i", "c", "c_first"), "states")
    found = found.join(counted.select("i", "c_first"), "i")
    for column, name in (("low", "first"), ("high", "last")):
        found = nearest.at_places(found, column, counted, name)
    return found.filter("last > first").select("pattern_id", "node", (F.col("first") - F.col("c_first")).alias("first"), (F.col("last") - F.col("c_first") - 1).alias("last"))


def extend_many(states: DataFrame, table: DataFrame, by: DataFrame) -> DataFrame:
    """(pattern_id, node, first, last): each state of find_many() after one more node, that of by (pattern_id, node); no row
    if nothing goes that way. table: visits, of which those from a state that go to the node are counted."""
    both = states.select("pattern_id", F.col("node").alias("from"), "first", "last").join(by.select("pattern_id", F.col("node").alias("to")), "pattern_id")
    asked = both.select("pattern_id", F.col("from").alias("node"), "to", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("off")), F.struct(F.lit(1).alias("end"), (F.col("last") + 1).alias("off")))).alias("x"))
    landed = lf_to_many(table, asked.select("node", "to", "x.off").distinct())
    met = asked.select("pattern_id", "node", "to", "x.end", "x.off").join(landed, ["node", "off", "to"])
    ends = met.groupBy("pattern_id", "to").agg(F.min("to_off").alias("first"), (F.max("to_off") - 1).alias("last"))
    return ends.filter("last >= first").select("pattern_id", F.col("to").alias("node"), "first", "last")


#: Lengths of patterns, at most, for which all places' grams are made.
LENGTHS = 8


def _by_lengths(panel: Panel, patterns: DataFrame) -> DataFrame | None:
    """What locate_many() gives, by grams of each length that a pattern has; None if there are more than LENGTHS of these.
    Patterns and places of one gram are lists."""
    own = patterns.groupBy("pattern_id").agg((F.max("pos") + 1).cast("long").alias("n"))
    lengths = [x.n for x in own.select("n").distinct().limit(LENGTHS + 1).collect()]
    if not 0 < len(lengths) <= LENGTHS or patterns.schema["node"].dataType != panel.positions.schema["node"].dataType:
        return None
    asked = names_of_lengths(patterns, lengths, "pattern_id").filter("pos = 0").join(own, ["pattern_id", "n"])
    places = names_of_lengths(panel.positions, lengths).withColumnRenamed("pos", "t_start")
    return lists.met(asked.drop("pos"), places, ["n", "g0", "g1"], ["pattern_id"], ["seq_id", "t_start"]).select("pattern_id", "seq_id", "t_start")


def locate_many(panel: Panel, patterns: DataFrame, length: int | None = None) -> DataFrame:
    """(pattern_id, seq_id, t_start) for patterns (pattern_id, pos, node) of any lengths: all places where one occurs. Few
    lengths are found by their grams, many in one order of panel and patterns. length: if all patterns have this length, its
    grams alone are joined."""
    if length is None:
        patterns = keep(patterns, "asked")
        found = _by_lengths(panel, patterns)
        if found is not None:
            return found
        table, found = _found(panel, patterns)
        met = nearest.members(table, found, ["seq_id", "pos"])
        return met.select("pattern_id", F.col("t_seq_id.id").alias("seq_id"), (F.col("t_pos") - F.col("m") + 1).alias("t_start"))
    asked = gram_names(patterns, length, "pattern_id").filter("pos = 0").select("pattern_id", "g0", "g1")
    return asked.join(gram_names(panel.positions, length).select("seq_id", F.col("pos").alias("t_start"), "g0", "g1"), ["g0", "g1"]).select("pattern_id", "seq_id", "t_start")


def agree(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are equal as bags, over the columns that both have."""
    columns = [c for c in a.columns if c in b.columns]
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
