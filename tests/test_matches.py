import random

import brute
import pytest
from pyspark.sql import functions as F

from pathloom.operators import ibd, maintain, matches, navigate
from pathloom.sources.panel import Panel, queries_from_stream, queries_to_stream, write_segments


def panel(spark, paths):
    return Panel.from_paths(spark.createDataFrame([(s, p) for s, p in paths.items()], "seq_id long, path array<long>"))


def queries(spark, paths):
    return panel(spark, paths).as_queries()


def rows(df, query=None):
    return sorted((r.q_start, r.length, r.seq_id, r.t_start) for r in df.collect() if query is None or r.query_id == query)


@pytest.fixture(scope="module")
def toy(spark):
    own = panel(spark, brute.both_ways(brute.TOY))
    return Panel(own.positions.cache(), True)


def test_toy_counts_and_rows(spark, toy):
    q = queries(spark, {0: brute.QUERY})
    for least, n in ((1, 95), (4, 12)):
        found = rows(matches.long_matches(q, toy, least))
        assert len(found) == n
        assert found == brute.long_matches(brute.QUERY, brute.both_ways(brute.TOY), least)
    assert (7, 5, 8, 1) in rows(matches.long_matches(q, toy, 4))


def test_sweep(spark, toy):
    found = matches.long_matches(queries(spark, {0: brute.QUERY}), toy, 1).cache()
    swept = matches.sweep(found, [4, 2, 4, 100]).collect()
    for least in (2, 4, 100):
        own = sorted((r.q_start, r.length, r.seq_id, r.t_start) for r in swept if r.min_length == least)
        assert own == brute.long_matches(brute.QUERY, brute.both_ways(brute.TOY), least)
    counts = {r.min_length: (r.matches, int(r.symbols)) for r in matches.sweep_counts(found, 1).collect()}
    want = {k: brute.long_matches(brute.QUERY, brute.both_ways(brute.TOY), k) for k in (1, 2, 4, 8, 16)}
    assert counts == {k: (len(x), sum(n for _, n, _, _ in x)) for k, x in want.items() if x}
    assert not matches.sweep(found.limit(0), [1]).count() and not matches.sweep_counts(found.limit(0), 1).count()
    for wrong in ([], [0, 3]):
        with pytest.raises(ValueError):
            matches.sweep(found, wrong)
    found.unpersist()


def test_set_maximal_toy(spark, toy):
    found = matches.set_maximal_matches(queries(spark, {0: brute.QUERY}), toy)
    assert rows(found) == brute.set_maximal(brute.QUERY, brute.both_ways(brute.TOY))
    assert len(rows(found)) == 13
    assert matches.without_places(found).count() == 13


def random_paths(seed):
    r = random.Random(seed)
    size = r.choice([1, 2, 3, 6])
    path = lambda: [r.randrange(1, size + 1) for _ in range(r.randrange(1, 13))]
    return {s: path() for s in range(r.randrange(1, 6))}, {s: path() + [99] * (s == 2) for s in range(3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_agree_with_the_definition(spark, seed):
    paths, asked = random_paths(seed)
    p, q = panel(spark, paths), queries(spark, asked)
    for least, plan in ((1, "events"), (3, "events"), (2, "grams"), (1, "islands")):
        found = matches.long_matches(q, p, least, plan, "ignore").collect()
        for i, x in asked.items():
            assert sorted((r.q_start, r.length, r.seq_id, r.t_start) for r in found if r.query_id == i) == brute.long_matches(x, paths, least), (plan, least, i)
    stats = matches.matching_statistics(q, p, on_unknown="ignore").collect()
    ends = matches.matching_statistics_end(q, p, on_unknown="ignore").collect()
    maximal = matches.set_maximal_matches(q, p, on_unknown="ignore").collect()
    back = {s: x[::-1] for s, x in paths.items()}
    for i, x in asked.items():
        assert [r.m for r in sorted(stats, key=lambda r: r.pos) if r.query_id == i] == brute.statistics(x, paths)
        assert [r.m for r in sorted(ends, key=lambda r: -r.pos) if r.query_id == i] == brute.statistics(x[::-1], back)
        assert sorted((r.q_start, r.length, r.seq_id, r.t_start) for r in maximal if r.query_id == i) == brute.set_maximal(x, paths)


def test_unknown_nodes(spark, toy):
    q = queries(spark, {0: [2, 4, 77, 8, 10], 1: [2, 4, 8, 10]})
    assert {r.query_id for r in matches.long_matches(q, toy, 2).collect()} == {1}
    dropped = matches.long_matches(q, toy, 4, on_unknown="drop")
    assert rows(dropped, 0) == rows(dropped, 1) != []
    assert rows(matches.long_matches(q, toy, 2, on_unknown="ignore"), 0)
    with pytest.raises(ValueError):
        matches.long_matches(q, toy, 0)


def test_queries_within_the_panel(spark):
    """A sequence of the panel as a query meets all others, other queries too, but not itself."""
    r = random.Random(5)
    paths = {s: [r.choice([2, 4, 6]) for _ in range(14)] for s in range(5)}
    own, asked = panel(spark, paths), {s: paths[s] for s in (0, 2)}
    q = queries(spark, asked)
    found = matches.long_matches(q, own, 2, residual=matches.OTHERS).collect()
    stats = matches.matching_statistics(q, own, others=True).collect()
    maximal = matches.set_maximal_matches(q, own, others=True).collect()
    for i, x in asked.items():
        rest = {s: p for s, p in paths.items() if s != i}
        assert sorted((f.q_start, f.length, f.seq_id, f.t_start) for f in found if f.query_id == i) == brute.long_matches(x, rest, 2)
        assert [f.m for f in sorted(stats, key=lambda f: f.pos) if f.query_id == i] == brute.statistics(x, rest)
        assert sorted((f.q_start, f.length, f.seq_id, f.t_start) for f in maximal if f.query_id == i) == brute.set_maximal(x, rest)


def test_names_are_verified_and_empty_input(spark, toy):
    q = queries(spark, {0: brute.QUERY})
    found = matches.long_matches(q, toy, 4)
    assert matches.agree(found, matches.verified(found, q, toy))
    assert not matches.agree(found, found.limit(1))
    assert matches.long_matches(q.limit(0), toy, 2).count() == 0
    assert matches.long_matches(q, toy, 50).count() == 0
    assert sorted((r.seq_id, r.t_start) for r in matches.locate(toy, [8, 14]).collect()) == sorted((s, k) for s, p in brute.both_ways(brute.TOY).items() for k in range(len(p)) if p[k : k + 2] == [8, 14])


def test_shared_segments(spark, tmp_path):
    own = Panel(maintain.bidirectional(panel(spark, brute.TOY)).positions.cache(), True)
    for least, n, p in ((1, 116, 45), (4, 9, 8)):
        found = ibd.segments(own, least)
        t = ibd.totals(found).first()
        assert (t.segments, t.pairs) == (n, p)
    found = ibd.segments(own, 4)
    first = found.orderBy(*found.columns).collect()
    assert [tuple(r) for r in first[:3]] == [(0, 1, 2, 2, 4), (0, 3, 0, 0, 5), (0, 8, 0, 0, 6)]
    assert ibd.segments(own, 4, max_haps=1).count() == 3
    assert ibd.segments(own, 4, max_haps=0).count() == 0
    assert ibd.pairs(found).count() == 8
    write_segments(found, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "#hap1_id\thap2_id\thap1_start\thap2_start\tlength_nodes"
    assert "7\t9\t3\t2\t4" in lines


def test_navigation(spark, toy):
    end = F.lit(0).cast("long")
    table = navigate.visits(toy, end, prefix=True).cache()
    runs = navigate.runs(table, end).agg(F.sum("concrete").alias("c"), F.sum("logical").alias("l")).first()
    starts = spark.createDataFrame(sorted((s, p[0]) for s, p in brute.both_ways(brute.TOY).items()), "seq_id long, node long").orderBy("seq_id").collect()
    first = [r.node for r in starts]
    own = 1 + sum(a != b for a, b in zip(first, first[1:], strict=False))  # the endmarker's record: where paths begin
    assert (runs.c + own, runs.l + own) == (76, 92)
    record = [r.next_node for r in table.filter("node = 14").orderBy("off").collect()]
    assert record == [16] + [14] * 3 + [18] * 2 + [14] * 5 + [18, 12, 18]
    assert navigate.violations(table).count() == 0
    for r in navigate.lf(table).limit(5).collect():
        assert navigate.lf_to(table, r.node, r.off, r.next_node).first().to_off == r.next_off
    assert navigate.contains(toy, 14).first().found and not navigate.contains(toy, 99).first().found
    assert navigate.run_samples(table, end).count() == runs.l
    lcp = {(r.node, r.off): r.lcp for r in navigate.adjacent_lcp(table).collect()}
    prefixes = {(r.node, r.off): r.prefix for r in table.collect()}
    for (n, o), v in lcp.items():
        a, b = prefixes[n, o], prefixes.get((n, o - 1), [])
        assert v == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_maintenance(spark, tmp_path):
    own = panel(spark, brute.TOY)
    ids = maintain.choose(own, 2, seed=3)
    left, held = maintain.hold_out(own, ids)
    assert left.stats().first().sequences == 8 and held.select("query_id").distinct().count() == 2
    assert sorted(r.seq_id for r in left.positions.select("seq_id").distinct().collect()) == list(range(8))
    with pytest.raises(ValueError):
        maintain.choose(own, 10)
    twice = {r.seq_id: r.path for r in maintain.repeat(own, 2).paths().collect()}
    assert twice == {s: p * 2 for s, p in brute.TOY.items()}
    walk = maintain.random_walk(list(brute.TOY.values()), 0.05, 0.025, 1)
    assert walk == maintain.random_walk(list(brute.TOY.values()), 0.05, 0.025, 1)
    p = spark.createDataFrame([(0, [1, 2]), (1, [3])], "query_id long, path array<long>")
    stream = [(r.node) for r in queries_to_stream(p).orderBy("query_id", "i").collect()]
    assert stream == [1, 2, 0, 3, 0]
    again = queries_from_stream(spark.createDataFrame(list(enumerate(stream)), "i long, node long"))
    assert sorted(tuple(r) for r in again.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3)]
    (tmp_path / "raw").write_text(", 1,2 , 4\n3, 5\n")
    assert {r.seq_id: r.path for r in Panel.from_text(spark, str(tmp_path / "raw")).paths().collect()} == {0: [1, 2, 4], 1: [3, 5]}
    own.save(str(tmp_path / "p"))
    back = Panel.load(spark, str(tmp_path / "p"))
    assert matches.agree(back.positions, own.positions)
    build = lambda x: navigate.node_sizes(x)
    a = back.load_or_build("sizes", str(tmp_path / "kept"), build)
    assert matches.agree(a, back.load_or_build("sizes", str(tmp_path / "kept"), None))


def test_arrivals(spark, tmp_path):
    from pathloom.streaming.arrivals import match_arrivals

    own = panel(spark, brute.both_ways(brute.TOY))
    queries(spark, {0: brute.QUERY}).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("query_id long, pos long, node long").parquet(str(tmp_path / "in"))
    match_arrivals(arriving, own, 4, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
