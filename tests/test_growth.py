"""What is shuffled grows with the tables, not with the pairs that come out."""

import random

from pyspark.sql import functions as F

from pathloom.operators import ibd, lists, matches, order
from pathloom.plans import catalogue
from pathloom.sources.panel import Panel


def shuffled(spark, make):
    """Rows that come out of make(), and rows that its run writes to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    listed = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    before = {listed().apply(i).stageId() for i in range(listed().size())}
    rows = make().count()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = listed()
    return rows, sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() not in before)


def panel(spark, copies, n=24, length=30):
    r = random.Random(3)
    paths = [[r.randrange(3) for _ in range(length)] for _ in range(n)]
    return Panel.from_paths(spark.createDataFrame([(k * n + i, p) for k in range(copies) for i, p in enumerate(paths)], "seq_id long, path array<long>"))


def split(own):
    return own.where("seq_id % 6 = 0").as_queries(), own.where("seq_id % 6 != 0")


def test_pairs_are_not_shuffled(spark):
    for make in (lambda p: matches.long_matches(*split(p), 3), lambda p: ibd.segments(p, 3)):
        (few, sent), (many, more) = (shuffled(spark, lambda: make(panel(spark, k))) for k in (2, 8))  # noqa: B023
        assert many > 12 * few and more < 6 * sent + 1000


def test_short_and_long_matches(spark):
    """Lengths below, at and beyond what a gram has beside it; ends of paths; sequences that are equal."""
    r = random.Random(5)
    base = [r.randrange(9) for _ in range(40)]
    paths = {0: base, 1: base[:], 2: base[3:9] + [77], 3: [5, 5] + base[4:14], 4: base[4:15] + [6], 5: base[20:] + base[:20], 6: [1] * 12, 7: [1] * 9}
    own = Panel.from_paths(spark.createDataFrame(list(paths.items()), "seq_id long, path array<long>"))
    as_text = Panel(own.positions.withColumn("node", F.concat(F.lit("n"), "node")))
    for length in (1, 2, 4, 5, 10, 11, 20):
        want = sorted((q, s, n, t, u) for q, a in paths.items() for t, b in paths.items() for s, n, u in brute_matches(a, b) if n >= length)
        for p in (own, as_text):
            assert sorted(tuple(x) for x in matches.long_matches(p.as_queries(), p, length).select(*matches.ROW).collect()) == want


def brute_matches(a, b):
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                yield i, n, j


def test_counts_without_matches(spark):
    def counted(p, others):
        q = p.where("seq_id % 6 = 0").as_queries()
        return matches.match_counts(q, p if others else p.where("seq_id % 6 != 0"), 3, others=others)

    small = panel(spark, 2)
    for others in (True, False):
        q = small.where("seq_id % 6 = 0").as_queries()
        found = matches.long_matches(q, small if others else small.where("seq_id % 6 != 0"), 3, residual=F.col("seq_id") != F.col("query_id"))
        want = sorted(map(tuple, matches.sweep_counts(found, 3).collect()))
        assert len(want) > 1 and sorted(map(tuple, counted(small, others).collect())) == want
    (_, sent), (_, more) = (shuffled(spark, lambda: counted(panel(spark, k), True)) for k in (2, 8))  # noqa: B023
    assert more < 5 * sent


def test_documents_that_share_nothing_are_not_shuffled(spark):
    """Found among many: a passage at a document's beginning, middle or end, twice in one, none shorter than asked."""
    r = random.Random(7)
    passage = "one two three four five six seven eight nine".split()
    texts = {k: [f"w{r.randrange(10**6)}" for _ in range(200)] for k in range(300)}
    texts[3][:0], texts[5][9:9], texts[7][200:], texts[9][9:9], texts[11][50:50] = passage, passage[:8], passage, passage + ["x"] + passage, passage[:7]
    texts |= {900: [], 901: passage[2:]}
    docs = catalogue.words(spark.createDataFrame([(k, " ".join(x)) for k, x in texts.items()] + [(999, None)], "doc_id long, text string"), "doc_id")
    asked = catalogue.words(spark.createDataFrame([(1, " ".join(["unheard", *passage])), (2, " ".join(passage)), (3, ""), (4, None)], "item_id long, text string"), "item_id").as_queries()
    want = {3: [(0, 9, 0)], 5: [(0, 8, 9)], 7: [(0, 9, 200)], 9: [(0, 9, 9), (0, 9, 19)]}
    rows, sent = shuffled(spark, lambda: matches.long_matches(asked, docs, 8, on_unknown="ignore"))
    assert rows == 2 * sum(map(len, want.values())) and sent < 10000
    for strategy in ("events", "grams"):
        found = matches.long_matches(asked, docs, 8, strategy, on_unknown="ignore").select(*matches.ROW).collect()
        assert sorted(map(tuple, found)) == sorted((q, a + (q == 1), n, t, b) for q in (1, 2) for t, x in want.items() for a, n, b in x)
    found = matches.long_matches(asked, docs, 8)
    assert {x.query_id for x in found.collect()} == {2}


def test_order_of_copies_is_one_sort(spark):
    """Places that tie only with their copies take no rounds: as many rows are shuffled as of sequences that don't tie."""
    r = random.Random(11)
    apart = [[r.randrange(10**6) for _ in range(40)] for _ in range(64)]
    of = lambda paths: Panel.from_paths(spark.createDataFrame(list(enumerate(paths)), "seq_id long, path array<long>")).positions
    (rows, sent), (same, more) = (shuffled(spark, lambda: order.ordered(of(p), 4, near=True)) for p in (apart, apart[:8] * 8))  # noqa: B023
    assert same == rows and more < 1.2 * sent


def test_ranges_follow_the_rows(spark, monkeypatch):
    """More rows make more ranges, not larger ones; what comes out is the same."""
    r = random.Random(13)
    paths = [[r.randrange(2) for _ in range(20)] for _ in range(8)] * 3
    rows = Panel.from_paths(spark.createDataFrame(list(enumerate(paths)), "seq_id long, path array<long>")).positions
    monkeypatch.setattr(order, "RANGE", 40)
    found = order.ordered(rows, 4).collect()
    back = lambda x: (paths[x.seq_id][x.pos :: -1], x.seq_id)
    assert [(x.seq_id, x.pos) for x in sorted(found, key=lambda x: x.i)] == [(x.seq_id, x.pos) for x in sorted(found, key=back)]
    assert len({x.part for x in found}) > 6


def test_matches_by_lists(spark, monkeypatch):
    """Lists of all lengths, cut and dealt to several tasks; ends of paths; a query that isn't matched with itself."""
    r = random.Random(17)
    paths = {k: [r.randrange(2) for _ in range(r.randrange(1, 30))] for k in range(9)} | {20: [1] * 12, 21: [0] * 9, 22: [0, 1] * 10}
    paths |= {40 + k: x[:] for k, x in paths.items()}
    own = Panel.from_paths(spark.createDataFrame(list(paths.items()), "seq_id long, path array<long>"))
    few = {k: x for k, x in paths.items() if k % 4 == 0}
    want = {n: sorted((q, s, m, t, u) for q, a in few.items() for t, b in paths.items() if q != t for s, m, u in brute_matches(a, b) if m >= n) for n in (1, 3, 9)}
    for most in ((1 << 16, 64, 128, 8), (5, 2, 3, 1)):
        for name, value in zip(("BLOCK", "LONGEST", "ASKED", "FEW"), most, strict=True):
            monkeypatch.setattr(lists, name, value)
        for length in want:
            found = matches.long_matches(own.where("seq_id % 4 = 0").as_queries(), own, length, "lists", residual=matches.OTHERS)
            assert sorted(tuple(x) for x in found.select(*matches.ROW).collect()) == want[length]
    swept = matches.sweep(found, [9, 10, 12, 9]).collect()
    assert sorted(map(tuple, swept)) == sorted((n, *x) for x in want[9] for n in (9, 10, 12) if x[2] >= n)


def test_a_pair_of_lists_is_small(spark):
    """However many places one gram has, no list is longer than what a task may hold the pairs of."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("g0"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("x"), F.col("id").alias("a"), (-F.col("id")).alias("b"))
    made = lists.gathered(rows, ["g0", "x"], ["a", "b"], lists.LONGEST).collect()
    assert max(x["_n"] for x in made) == lists.LONGEST and len(made) < 2 * 40_000 / lists.LONGEST
    assert sorted((a, b, x["x"]) for x in made for a, b in zip(x["_l_a"], x["_l_b"], strict=True)) == [(k, -k, k % 3 or None) for k in range(40_000)]


def test_patterns_by_lengths(spark, monkeypatch):
    """Few lengths take no order of all places; both ways find the same. What is shuffled doesn't follow what is found."""

    def asked(copies):
        p = panel(spark, copies)
        paths = p.paths().filter("seq_id % 4 = 0").select((F.col("seq_id") * 10).alias("id"), "path")
        cut = paths.select("id", "path", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select((F.col("id") + F.col("k")).alias("id"), F.slice("path", F.col("k") * 2, F.col("k")).alias("w"))
        return p, cut.select(F.col("id").alias("pattern_id"), F.posexplode("w").alias("pos", "node")).withColumn("pos", F.col("pos").cast("long"))

    (few, sent), (many, more) = (shuffled(spark, lambda: matches.locate_many(*asked(k))) for k in (2, 8))  # noqa: B023
    assert many > 12 * few and more < 6 * sent + 1000 and sent < 20 * 2 * 24 * 30
    p, patterns = asked(2)
    patterns = patterns.unionByName(spark.createDataFrame([(7, k, 5) for k in range(3)], patterns.schema))  # is nowhere
    found = sorted(map(tuple, matches.locate_many(p, patterns).collect()))
    words = {x[0]: x[1] for x in Panel(patterns.withColumnRenamed("pattern_id", "seq_id")).paths().collect()}
    paths = {x[0]: x[1] for x in p.paths().collect()}
    assert found == sorted((k, s, i) for k, w in words.items() for s, x in paths.items() for i in range(len(x)) if x[i : i + len(w)] == w)
    monkeypatch.setattr(lists, "BLOCK", 50)
    monkeypatch.setattr(lists, "FEW", 1)
    assert sorted(map(tuple, matches.locate_many(p, patterns).collect())) == found
    monkeypatch.setattr(matches, "LENGTHS", 2)
    assert sorted(map(tuple, matches.locate_many(p, patterns).collect())) == found
    assert matches.locate_many(p, patterns.filter("pattern_id < 0")).isEmpty()
