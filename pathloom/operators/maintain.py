"""Panels with paths added, removed, held out, turned around or repeated; random walks for tests."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from ..sources.panel import Panel
from .asof import covering, running
from .navigate import alphabet, insertion_places


def bidirectional(panel: Panel) -> Panel:
    """Sequence 2h is path h with even nodes, 2h + 1 its reverse with odd ones."""
    w = Window.partitionBy("seq_id")
    forth = panel.positions.select((2 * F.col("seq_id")).alias("seq_id"), "pos", "node")
    back = panel.positions.select((2 * F.col("seq_id") + 1).alias("seq_id"), (F.max("pos").over(w) - F.col("pos")).alias("pos"), F.col("node").bitwiseXOR(F.lit(1).cast("long")).alias("node"))
    return Panel(forth.unionByName(back), True)


def insert(panel: Panel, added: Panel) -> Panel:
    return Panel(panel.positions.unionByName(added.positions), panel.bidirectional)


def insert_visits(table: DataFrame, added: Panel, end: Column) -> DataFrame:
    """The visits (navigate.visits) of a panel with paths added, from its visits: the new ones stand where insertion_places()
    has them, and the old ones move on by the new ones that stand before. Ids of new paths are greater than all old ones.

    Old visits keep their successors and suffixes; their places are shifted by sums over buckets of a node's places."""
    places = keep(insertion_places(added.as_queries(), table), "inserted")
    # a new visit stands before the old one of the same number
    new = places.select("node", (2 * F.col("after")).alias("at"), F.lit(1).alias("more"), F.lit(None).cast(table.select(F.struct("*")).schema[0].dataType).alias("row"))
    old = table.select("node", (2 * F.col("off") + 1).alias("at"), F.lit(0).alias("more"), F.struct(*table.columns).alias("row"))
    moved = running(new.unionByName(old), ["node"], "at", "more", "shift").filter("row IS NOT NULL")
    moved = moved.select("row.*", "shift").withColumn("off", F.col("off") + F.col("shift")).drop("shift")
    w = Window.partitionBy("seq_id").orderBy("pos")
    last = F.max("pos").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fresh = places.select("node", F.col("new_off").alias("off"), F.col("query_id").alias("seq_id"), "pos")
    fresh = fresh.withColumns({"next_node": F.coalesce(F.lead("node").over(w), end), "seq_offset": (last - F.col("pos")).cast("long")})
    return moved.unionByName(fresh.select(*table.columns))


def remove_visits(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The visits (navigate.visits) of a panel without the sequences in ids (seq_id), which keep their numbers: each place
    less the removed ones before it, by sums over buckets of a node's places."""
    gone = ids.select("seq_id").distinct().withColumn("gone", F.lit(1))
    marked = table.join(gone, "seq_id", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    left = running(marked, ["node"], "off", "gone", "before").filter("gone = 0")
    return left.withColumn("off", F.col("off") - F.col("before")).select(*table.columns)


def choose(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """(seq_id): n sequences by a hash of their ids, the same ones each time."""
    ids = panel.positions.select("seq_id").distinct()
    total = ids.count()
    if not 0 < n < total:
        raise ValueError(f"{n} of {total} sequences can't be held out")
    return ids.orderBy(F.xxhash64(F.lit(seed), "seq_id"), "seq_id").limit(n)


def renumber(panel: Panel) -> Panel:
    """The same sequences, with ids from 0 on in the order of the old ones. Counts run within buckets of ids first."""
    ids = panel.positions.select("seq_id").distinct().withColumn("b", F.floor(F.col("seq_id") / 65536))
    base = ids.groupBy("b").count().select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    new = ids.join(base, "b").select("seq_id", (F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("seq_id")) - 1).cast("long").alias("new_id"))
    return Panel(panel.positions.join(new, "seq_id").select(F.col("new_id").alias("seq_id"), "pos", "node"), panel.bidirectional)


def _whole_haplotypes(panel: Panel, ids: DataFrame) -> DataFrame:
    """(seq_id): in a bidirectional panel, both orientations of each haplotype that ids (seq_id) touch."""
    own = ids.select("seq_id")
    return own.unionByName(own.select(F.col("seq_id").bitwiseXOR(F.lit(1).cast("long")).alias("seq_id"))).distinct() if panel.bidirectional else own


def remove(panel: Panel, ids: DataFrame) -> Panel:
    """The panel without the sequences in ids (seq_id), renumbered. A bidirectional panel loses both orientations of a
    haplotype, so that even ids stay forward."""
    return renumber(Panel(panel.positions.join(_whole_haplotypes(panel, ids), "seq_id", "left_anti"), panel.bidirectional))


def hold_out(panel: Panel, ids: DataFrame) -> tuple[Panel, DataFrame]:
    """The panel without these sequences, and them as queries (query_id, pos, node); of a bidirectional panel, both
    orientations."""
    held = panel.positions.join(_whole_haplotypes(panel, ids), "seq_id", "left_semi")
    return remove(panel, ids), held.withColumnRenamed("seq_id", "query_id")


def choose_haplotypes(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """(seq_id): the forward sequences of n haplotypes, by a hash of their numbers. All but one can be held out at most."""
    own = Panel(panel.positions.filter("seq_id % 2 = 0")) if panel.bidirectional else panel
    return choose(own, n, seed)


def repeat(panel: Panel, times: int) -> Panel:
    """Each path `times` times, one after the other."""
    w = Window.partitionBy("seq_id")
    rows = panel.positions.withColumn("n", F.max("pos").over(w) + 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return Panel(rows.select("seq_id", (F.col("k") * F.col("n") + F.col("pos")).cast("long").alias("pos"), "node"), panel.bidirectional)


def draw(seed: int, what: str, *of: str) -> Column:
    """A number below 2 ** 32 for each row, from the columns `of`: the first digits of an MD5."""
    name = F.concat_ws(":", F.lit(seed), F.lit(what), *(F.col(c).cast("string") for c in of))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def random_walks(panel: Panel, walks: DataFrame, steps: int, seed: int, jump: int = 0) -> DataFrame:
    """(walk_id, pos, node): for each of walks (walk_id) a path along the panel's steps, each as likely as often it is taken;
    jump: of a thousand steps, how many go to any node instead, each as likely. A walk ends where the path ends whose step
    it takes, or after `steps` nodes. All walks go on together, step by step; each step is looked up in the steps of its
    node, which are intervals of their counts. Equal seeds give equal walks."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    rows = panel.positions.select("seq_id", F.lag("node").over(w).alias("a"), F.col("node").alias("b"), F.lead("node").over(w).alias("c"))
    pairs = rows.select(F.struct(F.col("a").alias("at")).alias("node"), F.col("b").alias("next")).unionByName(rows.filter("c IS NULL").select(F.struct(F.col("b").alias("at")).alias("node"), F.col("c").alias("next")))
    counted = pairs.groupBy("node", "next").agg(F.count("*").alias("n"))
    before = Window.partitionBy("node").orderBy(F.asc_nulls_first("next")).rowsBetween(Window.unboundedPreceding, -1)
    ways = keep(counted.withColumn("low", F.coalesce(F.sum("n").over(before), F.lit(0))), "ways")
    totals = keep(ways.groupBy("node").agg(F.sum("n").alias("total")), "totals")
    nodes = keep(alphabet(panel), "alphabet")
    sigma = max(1, nodes.count())
    now = walks.select("walk_id", F.lit(-1).cast("long").alias("pos"), F.struct(F.lit(None).cast(panel.positions.schema["node"].dataType).alias("at")).alias("node"))
    found = None
    for _ in range(steps):
        asked = now.withColumn("pos", F.col("pos") + 1).join(totals, "node")
        asked = asked.withColumns({"u": draw(seed, "step", "walk_id", "pos") % F.col("total"), "jumps": draw(seed, "jump", "walk_id", "pos") % 1000 < jump, "comp": 1 + draw(seed, "node", "walk_id", "pos") % sigma})
        near = covering(asked.filter("NOT jumps").select("walk_id", "pos", "node", "u"), "u", ways, "low", "n", ["node"], ["next"]).select("walk_id", "pos", "next")
        far = asked.filter("jumps").join(nodes.select("comp", F.col("node").alias("next")), "comp").select("walk_id", "pos", "next")
        now = keep(near.unionByName(far).filter("next IS NOT NULL"), "walk").select("walk_id", "pos", F.struct(F.col("next").alias("at")).alias("node"))
        found = now if found is None else found.unionByName(now)
        if now.isEmpty():
            break
    return found.select("walk_id", "pos", F.col("node.at").alias("node"))


def random_walk(paths: list[list[int]], mutation: float, new_node: float, seed: int) -> list[int]:
    """A walk along the paths' steps, each as likely as often it's taken; now and then to any node, or to a new one. It
    ends where a path ends."""
    r = random.Random(seed)
    steps: dict[int, list[int]] = {}
    for p in paths:
        for a, b in zip([0, *p], [*p, 0], strict=True):
            steps.setdefault(a, []).append(b)
    nodes, fresh = sorted({x for p in paths for x in p}), max((x for p in paths for x in p), default=0) + 1
    at, out = 0, []
    while True:
        kind = r.random() * (1 + mutation + new_node)
        if kind >= 1 + mutation:
            at, fresh = fresh, fresh + 1
        elif kind >= 1 and nodes:
            at = r.choice(nodes)
        else:
            at = r.choice(steps.get(at, [0]))
        if at == 0:
            return out
        out.append(at)
