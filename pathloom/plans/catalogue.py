"""The queries over the provided tables, and SQL by other formulas to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared_segments
from ..operators import ibd, maintain, matches, navigate
from ..sources.kept import keep
from ..sources.panel import Panel

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
END = "$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel.from_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def orders(spark: SparkSession, sf_dir: str) -> Panel:
    """Priorities as numbers."""
    code = F.substring("o_orderpriority", 1, 1).cast("long")
    return Panel.from_rows(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], code)


def words(df: DataFrame, key: str) -> Panel:
    own = df.select(F.col(key).cast("long").alias("seq_id"), F.split("text", " ").alias("path"))
    return Panel(Panel.from_paths(own).positions, sequences=own)


def split(panel: Panel, every: int) -> tuple[DataFrame, Panel]:
    """Sequences whose id is divisible by `every` as queries, the others as the panel."""
    return panel.where(F.col("seq_id") % every == 0).as_queries(), panel.where(F.col("seq_id") % every != 0)


def query(name: str, oracle: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return add


EVENTS = "pos AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS node FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"
ORDERS = "pos AS (SELECT o_custkey AS seq_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(left(o_orderpriority, 1) AS BIGINT) AS node FROM orders WHERE o_custkey IS NOT NULL)"
WORDS = "{name} AS (SELECT {key} AS {as_}, unnest(range(len(w))) AS pos, unnest(w) AS node FROM (SELECT {key}, string_split(text, ' ') AS w FROM {table}))"
ISLANDS = """m AS (SELECT q.query_id, t.seq_id, q.pos AS qp, t.pos AS tp FROM q JOIN t ON q.node = t.node{on}),
g AS (SELECT *, qp - row_number() OVER (PARTITION BY query_id, seq_id, tp - qp ORDER BY qp) AS grp, tp - qp AS d FROM m),
isl AS (SELECT query_id, min(qp) AS q_start, count(*) AS length, seq_id, min(tp) AS t_start FROM g GROUP BY query_id, seq_id, d, grp)"""
LONGS = "CAST({0} AS BIGINT) AS {0}"


def longs(*names: str) -> str:
    return ", ".join(LONGS.format(n) for n in names)


def islands(every: int, source: str = EVENTS, on: str = "") -> str:
    return f"WITH {source}, q AS (SELECT seq_id AS query_id, pos, node FROM pos WHERE seq_id % {every} = 0), t AS (SELECT * FROM pos WHERE seq_id % {every} <> 0), " + ISLANDS.format(on=on)


MATCH = longs("query_id", "q_start", "length", "seq_id", "t_start")
BEST = """, best AS (SELECT query_id, q_start, max(q_start + length) AS q_end FROM isl GROUP BY query_id, q_start),
kept AS (SELECT * FROM (SELECT *, max(q_end) OVER (PARTITION BY query_id ORDER BY q_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) WHERE before IS NULL OR q_end > before),
found AS (SELECT isl.* FROM isl JOIN kept ON isl.query_id = kept.query_id AND isl.q_start = kept.q_start AND isl.q_start + isl.length = kept.q_end)"""


@query("long_matches_events", islands(10) + f" SELECT {MATCH} FROM isl WHERE length >= 6")
def long_matches_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(events(spark, sf_dir), 10)
    return matches.long_matches(q, t, 6)


@query("long_matches_grams", islands(10) + f" SELECT {MATCH} FROM isl WHERE length >= 7")
def long_matches_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(events(spark, sf_dir), 10)
    return matches.long_matches(q, t, 7, strategy="grams")


@query("long_matches_orders", islands(50, ORDERS) + f" SELECT {MATCH} FROM isl WHERE length >= 5")
def long_matches_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(orders(spark, sf_dir), 50)
    return matches.long_matches(q, t, 5)


@query(
    "long_matches_contamination",
    "WITH " + WORDS.format(name="p", key="item_id", as_="query_id", table="benchmark") + ", " + WORDS.format(name="d", key="doc_id", as_="seq_id", table="documents")
    + """, bad AS (SELECT DISTINCT query_id FROM p WHERE node NOT IN (SELECT node FROM d WHERE node IS NOT NULL)), pk AS (SELECT * FROM p WHERE query_id NOT IN (SELECT query_id FROM bad)),
g8 AS (SELECT query_id, pos, string_agg(node, ' ') OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM pk),
d8 AS (SELECT seq_id, pos, string_agg(node, ' ') OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM d),
m AS (SELECT query_id, seq_id, g8.pos AS qp, d8.pos AS tp FROM g8 JOIN d8 ON g8.g = d8.g WHERE g8.n = 8 AND d8.n = 8),
i AS (SELECT *, tp - qp AS dd, qp - row_number() OVER (PARTITION BY query_id, seq_id, tp - qp ORDER BY qp) AS grp FROM m),
isl AS (SELECT query_id, min(qp) AS q_start, count(*) + 7 AS length, seq_id, min(tp) AS t_start FROM i GROUP BY query_id, seq_id, dd, grp)"""
    + f" SELECT {MATCH} FROM isl",
)
def long_matches_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = words(table(spark, sf_dir, "benchmark"), "item_id").as_queries()
    return matches.long_matches(q, words(table(spark, sf_dir, "documents"), "doc_id"), 8)


#: All items: those with a word that no document has as well.
ALL_ITEMS = ORACLES["long_matches_contamination"].replace(" WHERE query_id NOT IN (SELECT query_id FROM bad)", "")


@query("long_matches_contamination_all", ALL_ITEMS)
def long_matches_contamination_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = words(table(spark, sf_dir, "benchmark"), "item_id").as_queries()
    return matches.long_matches(q, words(table(spark, sf_dir, "documents"), "doc_id"), 8, on_unknown="ignore")


@query("set_maximal_events", islands(10) + BEST + f" SELECT {MATCH} FROM found")
def set_maximal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(events(spark, sf_dir), 10)
    return matches.set_maximal_matches(q, t)


@query("set_maximal_ids_bag", islands(10) + BEST + f" SELECT {longs('query_id', 'q_start', 'length', 'seq_id')} FROM found")
def set_maximal_ids_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.without_places(set_maximal_events(spark, sf_dir))


@query("matching_stats_start", islands(10) + " SELECT CAST(q.query_id AS BIGINT) AS query_id, CAST(q.pos AS BIGINT) AS pos, CAST(coalesce(max(i.q_start + i.length - q.pos), 0) AS BIGINT) AS m FROM q LEFT JOIN isl i ON i.query_id = q.query_id AND q.pos >= i.q_start AND q.pos < i.q_start + i.length GROUP BY ALL")
def matching_stats_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(events(spark, sf_dir), 10)
    return matches.matching_statistics(q, t)


@query("matching_stats_end", islands(10) + " SELECT CAST(q.query_id AS BIGINT) AS query_id, CAST(q.pos AS BIGINT) AS pos, CAST(coalesce(max(q.pos - i.q_start + 1), 0) AS BIGINT) AS m FROM q LEFT JOIN isl i ON i.query_id = q.query_id AND q.pos >= i.q_start AND q.pos < i.q_start + i.length GROUP BY ALL")
def matching_stats_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = split(events(spark, sf_dir), 10)
    return matches.matching_statistics_end(q, t)


#: The same with each query against all sequences but its own.
def whole(panel: Panel, every: int = 20) -> tuple[DataFrame, Panel]:
    return panel.where(F.col("seq_id") % every == 0).as_queries(), panel


def islands_whole(source: str = EVENTS, every: int = 20) -> str:
    return f"WITH {source}, q AS (SELECT seq_id AS query_id, pos, node FROM pos WHERE seq_id % {every} = 0), t AS (SELECT * FROM pos), " + ISLANDS.format(on=" AND t.seq_id <> q.query_id")


@query("long_matches_events_whole", ORACLES["long_matches_events"].replace(islands(10), islands_whole()))
def long_matches_events_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*whole(events(spark, sf_dir)), 6, residual=matches.OTHERS)


@query("long_matches_grams_whole", ORACLES["long_matches_grams"].replace(islands(10), islands_whole()))
def long_matches_grams_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*whole(events(spark, sf_dir)), 7, strategy="grams", residual=matches.OTHERS)


@query("long_matches_orders_whole", ORACLES["long_matches_orders"].replace(islands(50, ORDERS), islands_whole(ORDERS)))
def long_matches_orders_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*whole(orders(spark, sf_dir)), 5, residual=matches.OTHERS)


#: Least lengths that are asked for at once.
LENGTHS = [4, 6, 9]


@query("long_matches_sweep", islands_whole() + f", v AS (SELECT CAST(unnest({LENGTHS}) AS BIGINT) AS min_length) SELECT min_length, {MATCH} FROM isl JOIN v ON length >= min_length")
def long_matches_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.sweep(matches.long_matches(*whole(events(spark, sf_dir)), min(LENGTHS), strategy="lists", residual=matches.OTHERS), LENGTHS)


@query("long_matches_sweep_counts", islands_whole() + ", v AS (SELECT CAST(3 * (1 << k) AS BIGINT) AS min_length FROM range(40) r(k)) SELECT min_length, CAST(count(*) AS BIGINT) AS matches, CAST(sum(length) AS DECIMAL(38,0)) AS symbols FROM isl JOIN v ON length >= min_length GROUP BY min_length")
def long_matches_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.match_counts(*whole(events(spark, sf_dir)), 3, others=True)


@query("set_maximal_events_whole", ORACLES["set_maximal_events"].replace(islands(10), islands_whole()))
def set_maximal_events_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.set_maximal_matches(*whole(events(spark, sf_dir)), others=True)


@query("set_maximal_ids_bag_whole", ORACLES["set_maximal_ids_bag"].replace(islands(10), islands_whole()))
def set_maximal_ids_bag_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.without_places(set_maximal_events_whole(spark, sf_dir))


@query("matching_stats_start_whole", ORACLES["matching_stats_start"].replace(islands(10), islands_whole()))
def matching_stats_start_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.matching_statistics(*whole(events(spark, sf_dir)), others=True)


@query("matching_stats_end_whole", ORACLES["matching_stats_end"].replace(islands(10), islands_whole()))
def matching_stats_end_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.matching_statistics_end(*whole(events(spark, sf_dir)), others=True)


def with_unknown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Panel]:
    """Queries of which every other one has a symbol that no path has, at its fifth place."""
    q, t = split(events(spark, sf_dir), 10)
    odd = (F.col("query_id") % 20 == 0) & (F.col("pos") == 4)
    return q.withColumn("node", F.when(odd, F.lit("?")).otherwise(F.col("node"))), t


UNKNOWN = f"WITH {EVENTS}, q0 AS (SELECT seq_id AS query_id, pos, CASE WHEN seq_id % 20 = 0 AND pos = 4 THEN '?' ELSE node END AS node FROM pos WHERE seq_id % 10 = 0), t AS (SELECT * FROM pos WHERE seq_id % 10 <> 0), "


@query("unknown_node_guard", UNKNOWN + "q AS (SELECT * FROM q0 WHERE NOT EXISTS (SELECT 1 FROM q0 x WHERE x.query_id = q0.query_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.node = x.node))), " + ISLANDS.format(on="") + f" SELECT {MATCH} FROM isl WHERE length >= 6")
def unknown_node_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown(spark, sf_dir), 6)


@query("drop_unknown", UNKNOWN + "q AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, node FROM q0 WHERE node IN (SELECT node FROM t)), " + ISLANDS.format(on="") + f" SELECT {MATCH} FROM isl WHERE length >= 6")
def drop_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown(spark, sf_dir), 6, on_unknown="drop")


@query("ignore_unknown", UNKNOWN + "q AS (SELECT * FROM q0), " + ISLANDS.format(on="") + f" SELECT {MATCH} FROM isl WHERE length >= 6")
def ignore_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown(spark, sf_dir), 6, on_unknown="ignore")


IBD = f"WITH {EVENTS}, q AS (SELECT seq_id AS query_id, pos, node FROM pos), t AS (SELECT * FROM pos), " + ISLANDS.format(on=" AND t.seq_id > q.query_id{more}")
SEGMENT = "CAST(query_id AS BIGINT) AS hap1_id, CAST(seq_id AS BIGINT) AS hap2_id, CAST(q_start AS BIGINT) AS hap1_start, CAST(t_start AS BIGINT) AS hap2_start, CAST(length AS BIGINT) AS length_nodes"


@query("ibd_segments", IBD.format(more="") + f" SELECT {SEGMENT} FROM isl WHERE length >= 8")
def ibd_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.segments(events(spark, sf_dir), 8)


@query("ibd_pairs", IBD.format(more="") + " SELECT CAST(query_id AS BIGINT) AS hap1_id, CAST(seq_id AS BIGINT) AS hap2_id, CAST(count(*) AS BIGINT) AS segments, CAST(sum(length) AS BIGINT) AS nodes FROM isl WHERE length >= 8 GROUP BY 1, 2")
def ibd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.pairs(ibd.segments(events(spark, sf_dir), 8))


@query("ibd_max_haps", IBD.format(more=" AND q.query_id < 20") + f" SELECT {SEGMENT} FROM isl WHERE length >= 7")
def ibd_max_haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.segments(events(spark, sf_dir), 7, max_haps=20)


@query("ibd_totals", IBD.format(more="") + " SELECT CAST(count(DISTINCT (query_id, seq_id)) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS segments FROM isl WHERE length >= 8")
def ibd_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.totals(ibd.segments(events(spark, sf_dir), 8))


FIND = f"WITH {EVENTS}, a AS (SELECT seq_id, list(node ORDER BY pos) AS p FROM pos GROUP BY seq_id), pat AS (SELECT list(node ORDER BY pos) AS w FROM pos WHERE seq_id = (SELECT min(seq_id) FROM pos) AND pos BETWEEN 2 AND 4), hit AS (SELECT seq_id, unnest(range(len(p) - 2)) AS t_start, p FROM a) "


def pattern(panel: Panel) -> DataFrame:
    """Three symbols of the first sequence, as a query."""
    first = panel.positions.agg(F.min("seq_id").alias("seq_id"))
    own = panel.positions.join(F.broadcast(first), "seq_id")  # one row
    return own.filter("pos BETWEEN 2 AND 4").select(F.lit(0).cast("long").alias("pattern_id"), (F.col("pos") - 2).alias("pos"), "node")


@query("locate_positions", FIND + "SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(t_start AS BIGINT) AS t_start FROM hit, pat WHERE p[t_start + 1:t_start + 3] = w")
def locate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    return matches.locate_many(panel, pattern(panel), 3).drop("pattern_id")


@query("locate_ids_bag", FIND + "SELECT CAST(seq_id AS BIGINT) AS seq_id FROM hit, pat WHERE p[t_start + 1:t_start + 3] = w")
def locate_ids_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_positions(spark, sf_dir).select("seq_id")


@query("find_count", FIND + "SELECT CAST(count(*) AS BIGINT) AS n FROM hit, pat WHERE p[t_start + 1:t_start + 3] = w")
def find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_positions(spark, sf_dir).agg(F.count("*").alias("n"))


#: Patterns of two to seven symbols: what follows every fifth place of every thirtieth sequence.
PATTERNS = f"WITH {EVENTS}, a AS (SELECT seq_id, list(node ORDER BY pos) AS p FROM pos GROUP BY seq_id), pat AS (SELECT x.seq_id * 1000 + x.pos AS pattern_id, a.p[x.pos + 1:x.pos + 2 + x.pos % 6] AS w FROM pos x JOIN a USING (seq_id) WHERE x.seq_id % 30 = 0 AND x.pos % 5 = 0)"


def patterns(panel: Panel) -> DataFrame:
    begun = panel.positions.filter("seq_id % 30 = 0 AND pos % 5 = 0").select("seq_id", F.col("pos").alias("start"))
    own = begun.select("*", F.explode(F.sequence(F.lit(0).cast("long"), 1 + F.col("start") % 6)).alias("k")).withColumn("pos", F.col("start") + F.col("k"))
    return own.join(panel.positions, ["seq_id", "pos"]).select((F.col("seq_id") * 1000 + F.col("start")).alias("pattern_id"), F.col("k").alias("pos"), "node")


@query("locate_mixed", PATTERNS + " SELECT CAST(pattern_id AS BIGINT) AS pattern_id, CAST(seq_id AS BIGINT) AS seq_id, CAST(t_start AS BIGINT) AS t_start FROM (SELECT seq_id, p, unnest(range(len(p))) AS t_start FROM a) h JOIN pat ON h.p[t_start + 1:t_start + len(pat.w)] = pat.w")
def locate_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of different lengths, all at once."""
    panel = events(spark, sf_dir)
    return matches.locate_many(panel, patterns(panel))


FOUND = PATTERNS + ", pre AS (SELECT pos.seq_id, pos.pos, pos.node, list_reverse(a.p[1:pos.pos + 1]) AS prefix FROM pos JOIN a USING (seq_id)), v AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY prefix, seq_id) - 1 AS off, prefix FROM pre)"


@query("find_mixed", FOUND + " SELECT CAST(pattern_id AS BIGINT) AS pattern_id, v.node, CAST(min(off) AS BIGINT) AS first, CAST(max(off) AS BIGINT) AS last FROM v JOIN pat ON v.node = pat.w[len(pat.w)] AND v.prefix[1:len(pat.w)] = list_reverse(pat.w) GROUP BY pattern_id, v.node")
def find_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that patterns of different lengths lead to: a node, and an interval of its visits."""
    panel = events(spark, sf_dir)
    return matches.find_many(panel, patterns(panel))


@query("extend_mixed", FOUND + ", more AS (SELECT pattern_id, list_append(w, (SELECT min(node) FROM pos)) AS w FROM pat) SELECT CAST(pattern_id AS BIGINT) AS pattern_id, v.node, CAST(min(off) AS BIGINT) AS first, CAST(max(off) AS BIGINT) AS last FROM v JOIN more ON v.node = more.w[len(more.w)] AND v.prefix[1:len(more.w)] = list_reverse(more.w) GROUP BY pattern_id, v.node")
def extend_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after one more symbol, the least of all."""
    panel = events(spark, sf_dir)
    asked = patterns(panel)
    least = panel.positions.agg(F.min("node").alias("node"))  # one row
    return matches.extend_many(matches.find_many(panel, asked), event_visits(spark, sf_dir), asked.select("pattern_id").distinct().crossJoin(F.broadcast(least)))


@query("extract_positions", f"WITH {EVENTS} SELECT {longs('seq_id', 'pos')}, node FROM pos")
def extract_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).positions


@query("extract_paths", f"WITH {EVENTS} SELECT CAST(seq_id AS BIGINT) AS seq_id, string_agg(node, '>' ORDER BY pos) AS path FROM pos GROUP BY seq_id")
def extract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).paths().select("seq_id", F.array_join("path", ">").alias("path"))


@query("node_sizes", "SELECT event_type AS node, CAST(count(*) AS BIGINT) AS visits FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.node_sizes(events(spark, sf_dir))


STEPS = f"WITH {EVENTS}, s AS (SELECT a.*, coalesce(b.node, '$') AS next_node FROM pos a LEFT JOIN pos b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1)"


@query("edges", STEPS + ", c AS (SELECT node, next_node, count(*) AS visits FROM s GROUP BY 1, 2) SELECT node, next_node, CAST(visits AS BIGINT) AS visits, CAST((SELECT count(*) FROM c y WHERE y.node = c.node AND y.next_node < c.next_node) AS BIGINT) AS rank FROM c")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.edges(events(spark, sf_dir), F.lit(END))


@query("outdegree", STEPS + " SELECT node, CAST(count(DISTINCT next_node) AS BIGINT) AS outdegree FROM s GROUP BY 1")
def outdegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.outdegrees(events(spark, sf_dir), F.lit(END))


@query("outgoing_rank", f"WITH {ORDERS}, s AS (SELECT b.node AS node, a.node AS next_node FROM pos a LEFT JOIN pos b ON a.seq_id = b.seq_id AND b.pos = a.pos - 1) SELECT CAST(node AS BIGINT) AS node, CAST(next_node AS BIGINT) AS next_node, CAST(count(*) AS BIGINT) AS visits, CAST((SELECT count(*) FROM s x WHERE x.next_node = s.next_node AND coalesce(x.node, -1) < coalesce(s.node, -1)) AS BIGINT) AS first FROM s GROUP BY 1, 2, s.node, s.next_node")
def outgoing_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.outgoing(orders(spark, sf_dir))


VISITS = STEPS + """, a AS (SELECT seq_id, list(node ORDER BY pos) AS p FROM pos GROUP BY seq_id),
v0 AS (SELECT s.seq_id, s.pos, s.node, s.next_node, len(p) - 1 - s.pos AS seq_offset, list_reverse(p[1:s.pos + 1]) AS prefix FROM s JOIN a USING (seq_id)),
v AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY prefix, seq_id) - 1 AS off, seq_id, pos, next_node, seq_offset, prefix FROM v0)"""


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.visits(events(spark, sf_dir), F.lit(END))


@query("visits", VISITS + f" SELECT node, {longs('off', 'seq_id', 'pos')}, next_node, {longs('seq_offset')} FROM v")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_visits(spark, sf_dir)


@query("lf_step", VISITS + " SELECT a.node, CAST(a.off AS BIGINT) AS off, b.node AS next_node, CAST(b.off AS BIGINT) AS next_off FROM v a JOIN v b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1")
def lf_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.lf(event_visits(spark, sf_dir))


@query("inverse_lf", VISITS + " SELECT a.node, CAST(a.off AS BIGINT) AS off, b.node AS prev_node, CAST(b.off AS BIGINT) AS prev_off FROM v a LEFT JOIN v b ON a.seq_id = b.seq_id AND b.pos = a.pos - 1")
def inverse_lf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.inverse_lf(event_visits(spark, sf_dir))


RUNS = VISITS + ", f AS (SELECT node, off, next_node, CASE WHEN lag(next_node) OVER (PARTITION BY node ORDER BY off) = next_node THEN 0 ELSE 1 END AS n FROM v)"


@query("runs", RUNS + " SELECT node, CAST(sum(n) AS BIGINT) AS concrete, CAST(sum(n) - sum(CASE WHEN next_node = '$' THEN n ELSE 0 END) + sum(CASE WHEN next_node = '$' THEN 1 ELSE 0 END) AS BIGINT) AS logical FROM f GROUP BY node")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.runs(event_visits(spark, sf_dir), F.lit(END))


@query("run_ids", RUNS + " SELECT node, CAST(off AS BIGINT) AS off, CAST(sum(n) OVER w - 1 AS BIGINT) AS run_id, CAST(sum(greatest(n, CASE WHEN next_node = '$' THEN 1 ELSE 0 END)) OVER w - 1 AS BIGINT) AS logical_id FROM f WINDOW w AS (PARTITION BY node ORDER BY off)")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.run_ids(event_visits(spark, sf_dir), F.lit(END))


@query("locate_ends", VISITS + " SELECT node, CAST(arg_min(seq_id, off) AS BIGINT) AS first_seq, CAST(arg_min(seq_offset, off) AS BIGINT) AS first_offset, CAST(arg_max(seq_id, off) AS BIGINT) AS last_seq, CAST(arg_max(seq_offset, off) AS BIGINT) AS last_offset FROM v GROUP BY node")
def locate_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.locate_ends(event_visits(spark, sf_dir))


@query("suffix_neighbours", VISITS + " SELECT a.node, CAST(a.off AS BIGINT) AS off, CAST(a.seq_id AS BIGINT) AS seq_id, CAST(a.seq_offset AS BIGINT) AS seq_offset, CAST(b.seq_id AS BIGINT) AS prev_seq, CAST(b.seq_offset AS BIGINT) AS prev_offset, CAST(c.seq_id AS BIGINT) AS next_seq, CAST(c.seq_offset AS BIGINT) AS next_offset FROM v a LEFT JOIN v b ON a.node = b.node AND b.off = a.off - 1 LEFT JOIN v c ON a.node = c.node AND c.off = a.off + 1")
def suffix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.suffix_neighbours(event_visits(spark, sf_dir))


@query("adjacent_lcp", VISITS + " SELECT a.node, CAST(a.off AS BIGINT) AS off, CAST(coalesce(len(list_filter(range(1, least(len(a.prefix), len(b.prefix)) + 1), lambda n: a.prefix[1:n] = b.prefix[1:n])), 0) AS BIGINT) AS lcp FROM v a LEFT JOIN v b ON a.node = b.node AND b.off = a.off - 1")
def adjacent_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.adjacent_lcp(event_visits(spark, sf_dir))


@query("path_lengths", f"WITH {ORDERS} SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(max(pos) + 1 AS BIGINT) AS length FROM pos GROUP BY 1")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.path_lengths(orders(spark, sf_dir))


STARTS = f"WITH {ORDERS}, l AS (SELECT seq_id, count(*) AS length FROM pos GROUP BY 1), st AS (SELECT seq_id, length, coalesce(sum(length + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"


@query("path_starts", STARTS + f" SELECT {longs('seq_id', 'length', 'start')} FROM st")
def path_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.path_starts(orders(spark, sf_dir), bucket=1024)


TEXT = STARTS + ", txt AS (SELECT start + length - 1 - pos AS i, node FROM pos JOIN st USING (seq_id) UNION ALL SELECT start + length, 0 FROM st)"


@query("text", TEXT + f" SELECT {longs('i', 'node')} FROM txt")
def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.text(orders(spark, sf_dir), F.lit(0).cast("long"))


@query("text_at", TEXT + " SELECT CAST(k.i AS BIGINT) AS i, CAST(node AS BIGINT) AS node FROM (SELECT unnest(range(0, 10000000, 997)) AS i) k LEFT JOIN txt ON txt.i = k.i")
def text_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.range(0, 10_000_000, 997).withColumnRenamed("id", "i")
    return navigate.text_at(orders(spark, sf_dir), places, F.lit(0).cast("long"))


@query("holdout_panel", f"WITH {EVENTS}, r AS (SELECT seq_id, dense_rank() OVER (ORDER BY seq_id) - 1 AS id FROM pos WHERE seq_id NOT IN (SELECT seq_id FROM pos WHERE seq_id % 7 = 0)) SELECT DISTINCT CAST(r.id AS BIGINT) AS seq_id, CAST(pos.pos AS BIGINT) AS pos, node FROM pos JOIN r USING (seq_id)")
def holdout_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    return maintain.hold_out(panel, panel.positions.select("seq_id").distinct().filter("seq_id % 7 = 0"))[0].positions


@query("holdout_queries", f"WITH {EVENTS} SELECT CAST(seq_id AS BIGINT) AS query_id, CAST(pos AS BIGINT) AS pos, node FROM pos WHERE seq_id % 7 = 0")
def holdout_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    return maintain.hold_out(panel, panel.positions.select("seq_id").distinct().filter("seq_id % 7 = 0"))[1]


@query("insert_paths", f"WITH {EVENTS} SELECT {longs('seq_id', 'pos')}, node FROM pos UNION ALL SELECT CAST(seq_id + 1000000 AS BIGINT), CAST(pos AS BIGINT), node FROM pos WHERE seq_id % 9 = 0")
def insert_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    added = panel.where("seq_id % 9 = 0")
    return maintain.insert(panel, Panel(added.positions.withColumn("seq_id", F.col("seq_id") + 1_000_000))).positions


@query("bidirectional_expand", f"WITH {ORDERS}, l AS (SELECT seq_id, count(*) AS n FROM pos GROUP BY 1) SELECT CAST(2 * seq_id AS BIGINT) AS seq_id, CAST(pos AS BIGINT) AS pos, CAST(2 * node AS BIGINT) AS node FROM pos UNION ALL SELECT CAST(2 * seq_id + 1 AS BIGINT), CAST(n - 1 - pos AS BIGINT), CAST(2 * node + 1 AS BIGINT) FROM pos JOIN l USING (seq_id)")
def bidirectional_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = orders(spark, sf_dir).positions.withColumn("node", 2 * F.col("node"))
    return maintain.bidirectional(Panel(even)).positions


@query("repeat_panel", f"WITH {ORDERS}, l AS (SELECT seq_id, max(pos) + 1 AS n FROM pos GROUP BY 1) SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(pos + k * n AS BIGINT) AS pos, CAST(node AS BIGINT) AS node FROM pos JOIN l USING (seq_id), range(3) r(k)")
def repeat_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.repeat(orders(spark, sf_dir), 3).positions


@query("panel_stats", f"WITH {EVENTS} SELECT CAST(count(*) + count(DISTINCT seq_id) AS BIGINT) AS size, CAST(count(DISTINCT seq_id) AS BIGINT) AS sequences, CAST(max(pos) + 1 AS BIGINT) AS longest, CAST(count(DISTINCT node) AS BIGINT) AS nodes FROM pos")
def panel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).stats()


@query("alphabet", "SELECT node, CAST(row_number() OVER (ORDER BY node) AS BIGINT) AS comp FROM (SELECT DISTINCT event_type AS node FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)")
def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.alphabet(events(spark, sf_dir))


@query("lf_with_runs", RUNS + ", r AS (SELECT node, off, sum(n) OVER w AS run_id, sum(greatest(n, CASE WHEN next_node = '$' THEN 1 ELSE 0 END)) OVER w - 1 AS logical_id FROM f WINDOW w AS (PARTITION BY node ORDER BY off)), e AS (SELECT node, run_id, min(off) AS lo, max(off) AS hi FROM r GROUP BY 1, 2) SELECT a.node, CAST(a.off AS BIGINT) AS off, b.node AS next_node, CAST(b.off AS BIGINT) AS next_off, CAST(e.lo AS BIGINT) AS run_first, CAST(e.hi AS BIGINT) AS run_last, CAST(r.logical_id AS BIGINT) AS logical_id FROM v a JOIN v b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1 JOIN r ON r.node = a.node AND r.off = a.off JOIN e ON e.node = r.node AND e.run_id = r.run_id")
def lf_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.lf_with_runs(event_visits(spark, sf_dir), F.lit(END))


@query("insertion_offsets", VISITS + ", q AS (SELECT pos.seq_id, pos.pos, pos.node, list_reverse(a.p[1:pos.pos + 1]) AS prefix FROM pos JOIN a ON a.seq_id = pos.seq_id WHERE pos.seq_id % 10 = 0) SELECT CAST(q.seq_id AS BIGINT) AS query_id, CAST(q.pos AS BIGINT) AS pos, CAST((SELECT count(*) FROM v WHERE v.node = q.node AND v.prefix < q.prefix) AS BIGINT) AS off FROM q")
def insertion_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.insertion_offsets(events(spark, sf_dir).where("seq_id % 10 = 0").as_queries(), event_visits(spark, sf_dir))


#: What one sequence, one place or one check gives.
@query("extract_one", f"WITH {EVENTS} SELECT {longs('seq_id', 'pos')}, node FROM pos WHERE seq_id = (SELECT max(seq_id) FROM pos)")
def extract_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    return panel.extract(panel.positions.agg(F.max("seq_id")).first()[0])


@query("nodes_in_range", f"WITH {ORDERS} SELECT CAST(k AS BIGINT) AS node, k = 0 OR k BETWEEN (SELECT min(node) FROM pos) AND (SELECT max(node) FROM pos) AS contained FROM range(-3, 12) r(k)")
def nodes_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.in_range(orders(spark, sf_dir), spark.range(-3, 12).withColumnRenamed("id", "node"))


@query("panel_header", f"WITH {ORDERS} SELECT CAST(count(*) + count(DISTINCT seq_id) AS BIGINT) AS size, CAST(count(DISTINCT seq_id) AS BIGINT) AS sequences, CAST(max(node) + 1 AS BIGINT) AS sigma, CAST(max(node) - min(node) + 2 AS BIGINT) AS effective, FALSE AS bidirectional FROM pos")
def panel_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.header(orders(spark, sf_dir))


@query("alphabet_inverse", "SELECT CAST(k AS BIGINT) AS comp, node FROM range(0, 9) r(k) LEFT JOIN (SELECT node, row_number() OVER (ORDER BY node) AS c FROM (SELECT DISTINCT event_type AS node FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)) ON c = k")
def alphabet_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.to_node(events(spark, sf_dir), spark.range(9).withColumnRenamed("id", "comp"))


@query("lf_to", VISITS + """, c AS (SELECT node, next_node, count(*) AS n FROM v GROUP BY 1, 2), e AS (SELECT DISTINCT node, next_node AS to_node FROM v WHERE next_node <> '$')
SELECT a.node, CAST(a.off AS BIGINT) AS off, e.to_node, CAST(coalesce((SELECT sum(n) FROM c WHERE c.next_node = e.to_node AND c.node < a.node), 0) + (SELECT count(*) FROM v x WHERE x.pos = 0 AND x.node = e.to_node)
+ coalesce(sum(CASE WHEN a.next_node = e.to_node THEN 1 ELSE 0 END) OVER (PARTITION BY a.node, e.to_node ORDER BY a.off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS to_off FROM v a JOIN e ON a.node = e.node""")  # fmt: skip
def lf_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each visit would land by each way out of its node."""
    table = event_visits(spark, sf_dir)
    ways = table.filter(F.col("next_node") != END).select("node", F.col("next_node").alias("to")).distinct()
    return navigate.lf_to_many(table, table.select("node", "off").join(ways, "node")).withColumnRenamed("to", "to_node")


@query("offset_to", VISITS + " SELECT a.node, b.node AS next_node, CAST(b.off AS BIGINT) AS next_off, CAST(a.off AS BIGINT) AS off FROM v a JOIN v b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1")
def offset_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.offset_to(event_visits(spark, sf_dir))


@query("node_suffixes", VISITS + f" SELECT node, {longs('off', 'seq_id', 'seq_offset')} FROM v")
def node_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.suffixes(event_visits(spark, sf_dir))


LOGICAL = RUNS + ", g AS (SELECT node, off, sum(greatest(n, CASE WHEN next_node = '$' THEN 1 ELSE 0 END)) OVER (PARTITION BY node ORDER BY off) - 1 AS run_id FROM f), u AS (SELECT g.node, g.run_id, g.off, v.seq_id, v.seq_offset FROM g JOIN v ON g.node = v.node AND g.off = v.off)"


@query("run_samples", LOGICAL + " SELECT node, CAST(run_id AS BIGINT) AS run_id, CAST(arg_min(seq_id, off) AS BIGINT) AS head_seq, CAST(arg_min(seq_offset, off) AS BIGINT) AS head_offset, CAST(arg_max(seq_id, off) AS BIGINT) AS tail_seq, CAST(arg_max(seq_offset, off) AS BIGINT) AS tail_offset FROM u GROUP BY node, run_id")
def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.run_samples(event_visits(spark, sf_dir), F.lit(END))


@query("head_lcp", LOGICAL + ", h AS (SELECT node, run_id, min(off) AS off FROM u GROUP BY node, run_id) SELECT h.node, CAST(h.run_id AS BIGINT) AS run_id, CAST(a.seq_id AS BIGINT) AS head_seq, CAST(a.seq_offset AS BIGINT) AS head_offset, CAST(coalesce(len(list_filter(range(1, least(len(a.prefix), len(b.prefix)) + 1), lambda n: a.prefix[1:n] = b.prefix[1:n])), 0) AS BIGINT) AS lcp FROM h JOIN v a ON a.node = h.node AND a.off = h.off LEFT JOIN v b ON b.node = h.node AND b.off = h.off - 1")
def head_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.head_lcp(event_visits(spark, sf_dir), F.lit(END))


@query("reverse_queries", f"WITH {EVENTS}, l AS (SELECT seq_id, max(pos) + 1 AS n FROM pos GROUP BY 1) SELECT CAST(seq_id AS BIGINT) AS query_id, CAST(n - 1 - pos AS BIGINT) AS pos, node FROM pos JOIN l USING (seq_id) UNION ALL SELECT CAST(seq_id AS BIGINT), CAST(n AS BIGINT), '$' FROM l")
def reverse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.reversed_with_end(events(spark, sf_dir).as_queries(), F.lit(END))


@query("text_check", TEXT + " SELECT CAST(i AS BIGINT) AS i, CAST(5 AS BIGINT) AS node, CAST(6 AS BIGINT) AS found FROM txt WHERE node = 5")
def text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a text in which one node was written as another."""
    panel, end = orders(spark, sf_dir), F.lit(0).cast("long")
    written = navigate.text(panel, end).withColumn("node", F.when(F.col("node") == 5, 6).otherwise(F.col("node")))
    return navigate.text_violations(panel, written, end)


@query("suffix_check", VISITS + f" SELECT node, {longs('off', 'seq_id', 'seq_offset')} FROM v WHERE off < 0")
def suffix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No visit's next suffix has another one before it."""
    return navigate.suffix_violations(event_visits(spark, sf_dir))


def both_ways(spark: SparkSession, sf_dir: str) -> Panel:
    return maintain.bidirectional(Panel(orders(spark, sf_dir).positions.withColumn("node", 2 * F.col("node"))))


@query("remove_haplotypes", f"WITH {ORDERS}, l AS (SELECT seq_id, count(*) AS n FROM pos GROUP BY 1), r AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS h, n FROM l WHERE seq_id % 7 <> 0) SELECT CAST(2 * h AS BIGINT) AS seq_id, CAST(pos AS BIGINT) AS pos, CAST(2 * node AS BIGINT) AS node FROM pos JOIN r USING (seq_id) UNION ALL SELECT CAST(2 * h + 1 AS BIGINT), CAST(n - 1 - pos AS BIGINT), CAST(2 * node + 1 AS BIGINT) FROM pos JOIN r USING (seq_id)")
def remove_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orientations go, though only the forward ones are named."""
    panel = both_ways(spark, sf_dir)
    return maintain.remove(panel, panel.positions.filter("seq_id % 14 = 0").select("seq_id").distinct()).positions


@query("ibd_both_ways", f"WITH {ORDERS}, q AS (SELECT seq_id AS query_id, pos, node FROM pos), t AS (SELECT * FROM pos), " + ISLANDS.format(on=" AND t.seq_id > q.query_id") + f" SELECT {SEGMENT} FROM isl WHERE length >= 6")
def ibd_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_segments.call(both_ways(spark, sf_dir), 6)


@query("run_table", RUNS + ", r AS (SELECT f.node, f.off, f.next_node, sum(n) OVER (PARTITION BY f.node ORDER BY f.off) - 1 AS run FROM f) SELECT r.node, CAST(r.run AS BIGINT) AS run, any_value(r.next_node) AS next_node, CAST(min(r.off) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS length, CAST(min(b.off) AS BIGINT) AS to_first FROM r JOIN v a ON a.node = r.node AND a.off = r.off LEFT JOIN v b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1 GROUP BY r.node, r.run")
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.run_table(event_visits(spark, sf_dir), F.lit(END))


@query("lf_by_runs", VISITS + " SELECT a.node, CAST(a.off AS BIGINT) AS off, a.next_node, CAST(b.off AS BIGINT) AS next_off FROM v a LEFT JOIN v b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1")
def lf_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visit's step, from the runs alone."""
    table = keep(event_visits(spark, sf_dir), "visits")
    return navigate.lf_by_runs(navigate.run_table(table, F.lit(END)), table)


@query("lf_to_by_runs", ORACLES["lf_to"])
def lf_to_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each visit would land by each way out of its node, from the runs alone."""
    table = keep(event_visits(spark, sf_dir), "visits")
    ways = table.filter(F.col("next_node") != END).select("node", F.col("next_node").alias("to")).distinct()
    return navigate.lf_to_by_runs(navigate.run_table(table, F.lit(END)), table.select("node", "off").join(ways, "node")).withColumnRenamed("to", "to_node")


COPIES = f"WITH {EVENTS}, one AS (SELECT * FROM pos), s AS (SELECT a.*, coalesce(b.node, '$') AS next_node FROM one a LEFT JOIN one b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1)" + VISITS[len(STEPS):] + ", f AS (SELECT node, off, next_node, CASE WHEN lag(next_node) OVER (PARTITION BY node ORDER BY off) = next_node THEN 0 ELSE 1 END AS n FROM v)"


@query("run_table_of_copies", COPIES + " SELECT node, CAST(sum(n) AS BIGINT) AS runs, CAST(3 * count(*) AS BIGINT) AS visits FROM f GROUP BY node")
def run_table_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a panel that has each path three times: as many runs as of one that has it once, three times the visits."""
    panel = events(spark, sf_dir)
    thrice = panel.positions.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select((3 * F.col("seq_id") + F.col("k")).alias("seq_id"), "pos", "node")
    found = navigate.run_table(navigate.visits(Panel(thrice), F.lit(END)), F.lit(END))
    return found.groupBy("node").agg(F.count("*").alias("runs"), F.sum("length").alias("visits"))


OF_PANEL = ", a AS (SELECT seq_id, list(node ORDER BY pos) AS p FROM pos GROUP BY seq_id)," + VISITS.split("GROUP BY seq_id),", 1)[1]
STEP = ", s AS (SELECT a.*, coalesce(b.node, '$') AS next_node FROM pos a LEFT JOIN pos b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1)"
ALL_VISITS = f" SELECT node, {longs('off', 'seq_id', 'pos')}, next_node, {longs('seq_offset')} FROM v"


@query("visits_inserted", "WITH " + EVENTS.replace("pos AS", "old AS", 1) + ", pos AS (SELECT * FROM old UNION ALL SELECT seq_id + 1 + (SELECT max(seq_id) FROM old), pos, node FROM old WHERE seq_id % 9 = 0)" + STEP + OF_PANEL + ALL_VISITS)
def visits_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are added to the visits that there are; the SQL builds them anew."""
    panel = events(spark, sf_dir)
    last = panel.positions.agg((F.max("seq_id") + 1).alias("shift"))  # one row
    added = panel.where("seq_id % 9 = 0").positions.crossJoin(F.broadcast(last)).select((F.col("seq_id") + F.col("shift")).alias("seq_id"), "pos", "node")
    return maintain.insert_visits(keep(event_visits(spark, sf_dir), "visits"), Panel(added), F.lit(END))


@query("visits_removed", "WITH " + EVENTS.replace("pos AS", "old AS", 1) + ", pos AS (SELECT * FROM old WHERE seq_id % 7 <> 0)" + STEP + OF_PANEL + ALL_VISITS)
def visits_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are removed from the visits that there are; the SQL builds them anew."""
    table = event_visits(spark, sf_dir)
    return maintain.remove_visits(table, table.select("seq_id").distinct().filter("seq_id % 7 = 0"))


@query("random_walks", f"""WITH RECURSIVE {EVENTS}, e AS (SELECT seq_id, pos, lag(node) OVER w AS a, node AS b, lead(node) OVER w AS c FROM pos WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
c AS (SELECT coalesce(a, '^') AS node, coalesce(b, '$') AS nxt, count(*) AS n FROM (SELECT a, b FROM e UNION ALL SELECT b, c FROM e WHERE c IS NULL) GROUP BY 1, 2),
k AS (SELECT node, nxt, n, sum(n) OVER (PARTITION BY node) AS total, sum(n) OVER (PARTITION BY node ORDER BY nxt <> '$', nxt) - n AS low FROM c),
al AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS comp, count(*) OVER () AS sigma FROM (SELECT DISTINCT node FROM pos)),
walk AS (SELECT seq_id AS walk_id, CAST(-1 AS BIGINT) AS pos, '^' AS node FROM pos WHERE seq_id % 10 = 0 GROUP BY seq_id UNION ALL
SELECT x.walk_id, x.pos, x.node FROM (SELECT w.walk_id, w.pos + 1 AS pos, CASE WHEN CAST('0x' || left(md5('5:jump:' || w.walk_id || ':' || (w.pos + 1)), 8) AS BIGINT) % 1000 < 50
THEN (SELECT min(al.node) FROM al WHERE al.comp = CAST('0x' || left(md5('5:node:' || w.walk_id || ':' || (w.pos + 1)), 8) AS BIGINT) % al.sigma) ELSE k.nxt END AS node
FROM walk w JOIN k ON k.node = w.node AND CAST('0x' || left(md5('5:step:' || w.walk_id || ':' || (w.pos + 1)), 8) AS BIGINT) % k.total >= k.low AND CAST('0x' || left(md5('5:step:' || w.walk_id || ':' || (w.pos + 1)), 8) AS BIGINT) % k.total < k.low + k.n) x WHERE x.node <> '$' AND x.pos < 8)
SELECT CAST(walk_id AS BIGINT) AS walk_id, CAST(pos AS BIGINT) AS pos, node FROM walk WHERE pos >= 0""")  # fmt: skip
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for every tenth sequence, all step by step together; one of twenty steps goes anywhere."""
    panel = events(spark, sf_dir)
    walks = panel.positions.filter("seq_id % 10 = 0").select(F.col("seq_id").alias("walk_id")).distinct()
    return maintain.random_walks(panel, walks, 8, 5, jump=50)


@query("suffix_check_damaged", VISITS + """, w AS (SELECT a.node, a.off, coalesce(b.seq_id, a.seq_id) AS seq_id, coalesce(b.seq_offset, a.seq_offset) AS seq_offset FROM v a LEFT JOIN v b ON a.off % 7 = 3 AND b.node = a.node AND b.off = a.off + 1),
n AS (SELECT *, lag(struct_pack(s := seq_id, o := seq_offset)) OVER (PARTITION BY node ORDER BY off) AS p, lead(struct_pack(s := seq_id, o := seq_offset)) OVER (PARTITION BY node ORDER BY off) AS x FROM w)
SELECT a.node, CAST(a.off AS BIGINT) AS off, CAST(a.seq_id AS BIGINT) AS seq_id, CAST(a.seq_offset AS BIGINT) AS seq_offset FROM n a JOIN n b ON b.node = a.node AND b.seq_id = a.x.s AND b.seq_offset = a.x.o WHERE b.p IS NULL OR b.p.s <> a.seq_id OR b.p.o <> a.seq_offset""")  # fmt: skip
def suffix_check_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of visits some of which were written with the suffix of the next one."""
    table = keep(event_visits(spark, sf_dir), "visits")
    after = table.select("node", (F.col("off") - 1).alias("off"), F.col("seq_id").alias("s"), F.col("seq_offset").alias("o")).filter("off % 7 = 3")
    damaged = table.join(after, ["node", "off"], "left").withColumns({"seq_id": F.coalesce("s", "seq_id"), "seq_offset": F.coalesce("o", "seq_offset")}).drop("s", "o")
    return navigate.suffix_violations(damaged)


#: The queries with unknown symbols, each against all sequences but its own.
def with_unknown_whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Panel]:
    q, t = whole(events(spark, sf_dir))
    odd = (F.col("query_id") % 40 == 0) & (F.col("pos") == 4)
    return q.withColumn("node", F.when(odd, F.lit("?")).otherwise(F.col("node"))), t


UNKNOWN_WHOLE = f"WITH {EVENTS}, q0 AS (SELECT seq_id AS query_id, pos, CASE WHEN seq_id % 40 = 0 AND pos = 4 THEN '?' ELSE node END AS node FROM pos WHERE seq_id % 20 = 0), t AS (SELECT * FROM pos), "
APART = ISLANDS.format(on=" AND t.seq_id <> q.query_id") + f" SELECT {MATCH} FROM isl WHERE length >= 6"


@query("unknown_node_guard_whole", UNKNOWN_WHOLE + "q AS (SELECT * FROM q0 WHERE NOT EXISTS (SELECT 1 FROM q0 x WHERE x.query_id = q0.query_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.node = x.node))), " + APART)
def unknown_node_guard_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown_whole(spark, sf_dir), 6, residual=matches.OTHERS)


@query("drop_unknown_whole", UNKNOWN_WHOLE + "q AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, node FROM q0 WHERE node IN (SELECT node FROM t)), " + APART)
def drop_unknown_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown_whole(spark, sf_dir), 6, on_unknown="drop", residual=matches.OTHERS)


@query("ignore_unknown_whole", UNKNOWN_WHOLE + "q AS (SELECT * FROM q0), " + APART)
def ignore_unknown_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.long_matches(*with_unknown_whole(spark, sf_dir), 6, on_unknown="ignore", residual=matches.OTHERS)


@query("text_at_ends", TEXT + ", k AS (SELECT start AS i FROM st UNION ALL SELECT start + length AS i FROM st UNION ALL SELECT max(start + length) + 1 AS i FROM st) SELECT CAST(k.i AS BIGINT) AS i, CAST(node AS BIGINT) AS node FROM k LEFT JOIN txt ON txt.i = k.i")
def text_at_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each path of the text begins and ends, and the place after the text."""
    panel = orders(spark, sf_dir)
    ends = navigate.path_starts(panel).select("start", (F.col("start") + F.col("length")).alias("stop"))
    places = ends.select(F.col("start").alias("i")).unionByName(ends.select(F.col("stop").alias("i"))).unionByName(ends.agg((F.max("stop") + 1).alias("i")))
    return navigate.text_at(panel, places, F.lit(0).cast("long"))


@query("insert_after", f"WITH {EVENTS} SELECT {longs('seq_id', 'pos')}, node FROM pos UNION ALL SELECT CAST(seq_id + 1 + (SELECT max(seq_id) FROM pos) AS BIGINT), CAST(pos AS BIGINT), node FROM pos WHERE seq_id % 9 = 0")
def insert_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are added get ids beyond all that there are."""
    panel = events(spark, sf_dir)
    last = panel.positions.agg((F.max("seq_id") + 1).alias("shift"))  # one row
    added = panel.where("seq_id % 9 = 0").positions.crossJoin(F.broadcast(last)).select((F.col("seq_id") + F.col("shift")).alias("seq_id"), "pos", "node")
    return maintain.insert(panel, Panel(added)).positions
