"""Orders, intervals and what is built on them, beside plain loops; contexts and buckets are tiny, so that every way is taken."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from pathloom.operators import asof, maintain, matches, navigate, nearest, order
from pathloom.sources.panel import Panel


def places(spark, seqs, kind="string"):
    rows = [(s, p, x) for s, path in enumerate(seqs) for p, x in enumerate(path)]
    return spark.createDataFrame(rows, f"seq_id long, pos long, node {kind}")


def repetitive(seed):
    r = random.Random(seed)
    base = [r.choice("ab") for _ in range(30)]
    seqs = [base[:] for _ in range(3)] + [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(3)] + [["a"] * 18, ["a"] * 18]
    seqs[1][r.randrange(30)] = "c"
    return seqs


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("context", [2, 5, 64])
def test_order_is_that_of_contexts(spark, context):
    seqs = repetitive(context)
    df = places(spark, seqs)
    found = {(r.seq_id, r.pos): r for r in order.with_common(order.ordered(df, context, near=True), df, context).collect()}
    back = {(s, p): path[p::-1] for s, path in enumerate(seqs) for p in range(len(path))}
    want = sorted(back, key=lambda k: (back[k], k))
    assert sorted(found, key=lambda k: found[k].i) == want
    for n, k in enumerate(want):
        assert found[k].r == next(i for i, o in enumerate(want) if back[o] == back[k])
        assert found[k].first == next(i for i, o in enumerate(want) if back[o][0] == back[k][0])
        assert found[k].common == (common(back[want[n - 1]], back[k]) if n else 0)


def test_codes_keep_the_order(spark):
    numbers = [-(2**63), -5, -1, 0, 1, 9, 10, 255, 256, 2**40, 2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", order.coded(F.col("x"), "long").alias("c")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.c.encode())] == numbers
    words = ["", "\0", "\0\0", "\0\1", "\1", "\1\0", "\1\1", "a", "a\0", "a\1", "ab", "é"]
    rows = spark.createDataFrame([(x,) for x in words], "x string").select("x", order.coded(F.col("x"), "string").alias("c")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.c.encode())] == sorted(words, key=str.encode)
    assert all("\0" not in r.c for r in rows)


def test_intervals_over_many_buckets(spark):
    r = random.Random(4)
    heights = [0] + [r.choice([0, 1, 1, 2, 3, 3, 5]) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(heights)), "i long, common long")
    asked = [(i, r.randint(1, 4)) for i in range(len(heights))]
    got = {x.i: (x.low, x.high) for x in nearest.intervals(table, spark.createDataFrame(asked, "i long, m long"), bucket=4).collect()}
    for i, m in asked:
        low = next(j for j in range(i, -1, -1) if heights[j] < m)
        assert got[i] == (low, next((j for j in range(i + 1, len(heights)) if heights[j] < m), len(heights)))


@pytest.mark.parametrize("others", [False, True])
def test_statistics_and_maximal_matches(spark, others):
    seqs = repetitive(9) + [list("abca")] * 2
    panel = Panel(places(spark, seqs))
    asked = panel.positions.filter("seq_id IN (0, 3, 6, 8)").withColumnRenamed("seq_id", "query_id")

    def longest(q, p):
        return max((common(seqs[q][p:], path[t:]) for s, path in enumerate(seqs) if not (others and s == q) for t in range(len(path))), default=0)

    m = {(q, p): longest(q, p) for q in (0, 3, 6, 8) for p in range(len(seqs[q]))}
    assert {(r.query_id, r.pos): r.m for r in matches.matching_statistics(asked, panel, others=others).collect()} == m
    want = sorted((q, p, n, s, t) for (q, p), n in m.items() if n and m.get((q, p - 1), 0) <= n for s, path in enumerate(seqs) if not (others and s == q) for t in range(len(path)) if path[t : t + n] == seqs[q][p : p + n])
    assert sorted(tuple(r) for r in matches.set_maximal_matches(asked, panel, others=others).collect()) == want


def test_patterns_of_any_length(spark):
    seqs = repetitive(5)
    panel = Panel(places(spark, seqs))
    patterns = [["a"], ["a", "a", "a"], seqs[0][3:25], ["c", "z"], ["a"] * 18, ["b", "a"]]
    asked = places(spark, patterns).withColumnRenamed("seq_id", "pattern_id")
    hits = sorted((k, s, t) for k, w in enumerate(patterns) for s, path in enumerate(seqs) for t in range(len(path)) if path[t : t + len(w)] == w)
    assert sorted(tuple(r) for r in matches.locate_many(panel, asked).collect()) == hits
    table = navigate.visits(panel, F.lit("$"))
    at = {(r.seq_id, r.pos): (r.node, r.off) for r in table.collect()}
    want = {}
    for k, s, t in hits:
        want.setdefault(k, []).append(at[s, t + len(patterns[k]) - 1])
    states = matches.find_many(panel, asked)
    assert {r.pattern_id: (r.node, r.first, r.last) for r in states.collect()} == {k: (v[0][0], min(v)[1], max(v)[1]) for k, v in want.items()}
    more = spark.createDataFrame([(k, "a") for k in range(len(patterns))], "pattern_id long, node string")
    longer = {}
    for k, s, t in hits:
        end = t + len(patterns[k])
        if end < len(seqs[s]) and seqs[s][end] == "a":
            longer.setdefault(k, []).append(at[s, end][1])
    assert {r.pattern_id: (r.first, r.last) for r in matches.extend_many(states, table, more).collect()} == {k: (min(v), max(v)) for k, v in longer.items()}


def test_runs_insertion_and_removal(spark):
    end = F.lit("$")
    seqs = repetitive(6)
    whole = Panel(places(spark, seqs))
    table = navigate.visits(whole, end)
    runs = navigate.run_table(table, end)
    asked = table.select("node", "off").unionByName(spark.createDataFrame([("a", 10**6)], "node string, off long"))
    got = {(r.node, r.off): (r.next_node, r.next_off) for r in navigate.lf_by_runs(runs, asked).collect()}
    steps = {(r.node, r.off): (r.next_node, r.next_off) for r in navigate.lf(table).collect()}
    assert got == {(r.node, r.off): steps.get((r.node, r.off), ("$", None)) for r in table.collect()} | {("a", 10**6): (None, None)}
    ways = table.select("node", "off").crossJoin(spark.createDataFrame([("a",), ("b",)], "to string"))
    assert matches.agree(navigate.lf_to_by_runs(runs, ways), navigate.lf_to_many(table, ways))
    old, new = whole.where("seq_id < 5"), whole.where("seq_id >= 5")
    assert matches.agree(maintain.insert_visits(navigate.visits(old, end), new, end), table)
    gone = whole.positions.select("seq_id").distinct().filter("seq_id IN (0, 4, 7)")
    left = maintain.remove_visits(table, gone)
    assert matches.agree(left, navigate.visits(whole.where("seq_id NOT IN (0, 4, 7)"), end))
    assert left.count() == sum(len(s) for k, s in enumerate(seqs) if k not in (0, 4, 7))


def test_walks_follow_steps(spark):
    panel = Panel(places(spark, list(brute.TOY.values()), "long"))
    walks = spark.createDataFrame([(k,) for k in range(40)], "walk_id long")
    found = maintain.random_walks(panel, walks, 30, 7)
    assert matches.agree(found, maintain.random_walks(panel, walks, 30, 7))
    paths = {}
    for r in found.orderBy("walk_id", "pos").collect():
        paths.setdefault(r.walk_id, []).append(r.node)
    steps = {(a, b) for p in brute.TOY.values() for a, b in zip([0, *p], [*p, 0], strict=True)}
    assert set(paths) == set(range(40))
    assert all((a, b) in steps for p in paths.values() for a, b in zip([0, *p], p, strict=False))
    assert all((p[-1], 0) in steps or len(p) == 30 for p in paths.values())
    nodes = {x for p in brute.TOY.values() for x in p}
    jumping = maintain.random_walks(panel, walks, 5, 7, jump=1000).collect()
    assert {r.node for r in jumping} <= nodes and len(jumping) == 200


def test_intervals_cover_what_is_asked(spark):
    rows = spark.createDataFrame([("k", 3, 5, "x"), ("k", 8, 100, "y"), ("l", 0, 1, "z")], "key string, first long, length long, name string")
    asked = spark.createDataFrame([("k", p) for p in (0, 3, 7, 8, 50, 107, 108, 108)] + [("l", 0), ("m", 4), ("k", None)], "key string, at long")
    got = sorted((r.key, -1 if r["at"] is None else r["at"], r.name or "") for r in asof.covering(asked, "at", rows, "first", "length", ["key"], ["name"], bucket=4).collect())
    assert got == sorted([("k", 0, ""), ("k", 3, "x"), ("k", 7, "x"), ("k", 8, "y"), ("k", 50, "y"), ("k", 107, "y"), ("k", 108, ""), ("k", 108, ""), ("l", 0, "z"), ("m", 4, ""), ("k", -1, "")])


def test_empty_panels(spark):
    none = places(spark, [["a"]]).limit(0)
    panel = Panel(none)
    assert navigate.visits(panel, F.lit("$")).count() == 0
    some = places(spark, [list("ab")]).withColumnRenamed("seq_id", "query_id")
    assert [r.m for r in matches.matching_statistics(some, panel, on_unknown="ignore").collect()] == [0, 0]
    assert matches.set_maximal_matches(some, panel, on_unknown="ignore").count() == 0
    assert matches.locate_many(panel, some.withColumnRenamed("query_id", "pattern_id")).count() == 0
