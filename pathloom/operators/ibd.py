"""Shared segments of all pairs of haplotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import Panel
from .matches import long_matches


def forward(panel: Panel) -> Panel:
    """A bidirectional panel's forward sequences, by haplotype; another panel as it is."""
    if not panel.bidirectional:
        return panel
    p = panel.positions.filter("seq_id % 2 = 0")
    return Panel(p.select(F.expr("seq_id div 2").alias("seq_id"), "pos", "node"))


def segments(panel: Panel, length: int, max_haps: int | None = None, strategy: str = "events") -> DataFrame:
    """(hap1_id, hap2_id, hap1_start, hap2_start, length_nodes): maximal segments of at least `length` nodes that two
    haplotypes share, forward, hap1 < hap2. max_haps: only haplotypes with smaller ids are hap1. One self-join of all
    haplotypes by grams, in which the order of the pair is a residual condition; nothing loops over haplotypes. A segment is
    made once, so none is compared with others to drop duplicates."""
    if length < 1 or (max_haps is not None and max_haps < 0):
        raise ValueError("length is 1 at least, max_haps 0")
    own = forward(panel)
    queries = own.as_queries()
    queries = queries if max_haps is None else queries.filter(F.col("query_id") < max_haps)
    found = long_matches(queries, own, length, strategy, "ignore", F.col("seq_id") > F.col("query_id"))
    return found.select(F.col("query_id").alias("hap1_id"), F.col("seq_id").alias("hap2_id"), F.col("q_start").alias("hap1_start"), F.col("t_start").alias("hap2_start"), F.col("length").alias("length_nodes"))


def pairs(found: DataFrame) -> DataFrame:
    """(hap1_id, hap2_id, segments, nodes) of segments()."""
    return found.groupBy("hap1_id", "hap2_id").agg(F.count("*").alias("segments"), F.sum("length_nodes").alias("nodes"))


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("hap1_id", "hap2_id").alias("pairs"), F.count("*").alias("segments"))
