"""Connected components of links, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stash

#: Links of a task, about.
TASK = 100_000


def _large(links: DataFrame) -> DataFrame:
    """Each node gives its larger neighbours to the least of its neighbours and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Each node gives its smaller neighbours and itself to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of links (a, b) reaches; only nodes with a link to another one.
    Null ends and links of a node to itself don't count; links may repeat. Each round shuffles the links four times,
    with partial sums for nodes that have many; none is collected anywhere. Rounds go on until nothing changes, about as
    many as the logarithm of the longest path."""
    now = stash(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "links")
    tasks = 1 + now.count() // TASK  # few links need few tasks, and few files between them
    last, mark = None, ()
    while mark != last:
        now = stash(_small(_large(now).coalesce(tasks)).distinct().coalesce(tasks), "links")
        last, mark = mark, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64(F.lit(1), "a", "b").cast("decimal(38,0)"))).first())
        if not mark[0]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
