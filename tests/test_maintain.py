"""The command line, panels that grow and shrink, and raw text."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from pathloom import shared_segments
from pathloom.operators import maintain, matches, navigate
from pathloom.sources.panel import Panel, queries_from_stream


def panel(spark, paths):
    return Panel.from_paths(spark.createDataFrame([(s, p) for s, p in paths.items()], "seq_id long, path array<long>"))


@pytest.fixture(scope="module")
def toy(spark):
    return Panel(maintain.bidirectional(panel(spark, brute.TOY)).positions.cache(), True)


def test_command_line(spark, toy, tmp_path, capsys):
    toy.save(str(tmp_path / "p"))
    place, out = str(tmp_path / "p"), str(tmp_path / "out")
    assert shared_segments.main([place, "4", "--bidirectional", "--verbose"], spark) == 0
    printed = capsys.readouterr()
    lines = printed.out.splitlines()
    assert lines[0] == "#hap1_id\thap2_id\thap1_start\thap2_start\tlength_nodes" and len(lines) == 10 and lines[1] == "0\t1\t2\t2\t4"
    assert "8 pairs, 9 segments" in printed.err
    assert shared_segments.main([place, "4", "--bidirectional", "--version", "2", "--max-haps", "1", "--output", out], spark) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(out).count() == 3
    for wrong in ([place], [place, "x"], [place, "0"], [place, "4", "--max-haps"], [place, "4", "--max-haps", "-1"], [place, "4", "--version", "7"], [place, "4", "--output"], [place, "4", "--what"]):
        with pytest.raises(SystemExit) as e:
            shared_segments.main(wrong, spark)
        assert e.value.code == 1
    assert shared_segments.main([place, "4"], spark) == 1  # the default version needs both orientations
    assert shared_segments.main([str(tmp_path / "none"), "4", "--version", "2"], spark) == 1
    with pytest.raises(ValueError, match="no haplotypes"):
        shared_segments.call(Panel(toy.positions.limit(0), True), 4)
    (tmp_path / "file").write_text("")
    assert shared_segments.main([place, "4", "--bidirectional", "--output", str(tmp_path / "file" / "x")], spark) == 1


def test_growing_panel(spark):
    """Random walks are inserted in both orientations; after each, matches are those of the definition."""
    r, paths = random.Random(8), dict(list(brute.TOY.items())[:3])
    own = maintain.bidirectional(panel(spark, paths))
    for step in range(2):
        walk = [2 * x for x in maintain.random_walk([[y // 2 for y in p] for p in paths.values()], 0.05, 0.025, step)]
        new = len(paths)
        paths[new] = walk
        own = maintain.insert(own, maintain.bidirectional(panel(spark, {new: walk})))
        asked = [r.choice(sorted({x for p in brute.both_ways(paths).values() for x in p})) for _ in range(3)] + walk[:6]
        q = panel(spark, {0: asked}).as_queries()
        rows = lambda df: sorted((x.q_start, x.length, x.seq_id, x.t_start) for x in df.collect())
        assert rows(matches.long_matches(q, own, 2)) == brute.long_matches(asked, brute.both_ways(paths), 2)
        assert rows(matches.set_maximal_matches(q, own)) == brute.set_maximal(asked, brute.both_ways(paths))


def test_removed_haplotypes(toy):
    ids = maintain.choose_haplotypes(toy, 2, seed=1)
    left, held = maintain.hold_out(toy, ids)
    gone = {r.seq_id // 2 for r in ids.collect()}
    rest = {k: p for k, p in enumerate(p for h, p in brute.TOY.items() if h not in gone)}
    assert {r.seq_id: r.path for r in left.paths().collect()} == brute.both_ways(rest)
    assert {r.query_id // 2 for r in held.collect()} == gone and held.select("query_id").distinct().count() == 4
    with pytest.raises(ValueError):
        maintain.choose_haplotypes(toy, 10)


def test_raw_text_of_several_files(spark, tmp_path):
    (tmp_path / "a").write_text("1,2\n\n 3\n")
    (tmp_path / "b").write_text("4, 5\n6\n")
    assert {r.seq_id: r.path for r in Panel.from_text(spark, str(tmp_path / "[ab]")).paths().collect()} == {0: [1, 2], 2: [3], 3: [4, 5], 4: [6]}


def test_streams_and_ranks_in_small_buckets(spark, toy):
    stream = [1, 2, 0, 0, 3, 4, 5, 0, 6]
    found = queries_from_stream(spark.createDataFrame(list(enumerate(stream)), "i long, node long"), bucket=2)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 1), (0, 1, 2), (2, 0, 3), (2, 1, 4), (2, 2, 5), (3, 0, 6)]
    end = F.lit(0).cast("long")
    table = navigate.visits(toy, end).cache()
    assert matches.agree(navigate.run_ids(table, end, bucket=3), navigate.run_ids(table, end))
    assert navigate.suffix_violations(table).isEmpty()
    assert [r.found for r in navigate.text_violations(toy, navigate.text(toy, end).filter("i != 3"), end).collect()] == [None]
    header = navigate.header(toy).first()
    assert (header.sequences, header.sigma, header.effective, header.bidirectional) == (20, 20, 19, True)


def test_dump(toy, capsys):
    navigate.dump(toy, F.lit(0).cast("long"), 1)
    toy.describe(1)
    printed = capsys.readouterr().out
    assert all(x in printed for x in ("paths", "visits, successors and suffixes", "samples of runs", "starts of paths", "longest"))
