"""Operators that compare documents with each other, the classifier, and the pipeline, with plain loops beside them."""

import hashlib
import importlib.util
import random
from collections import Counter

import numpy as np
import pytest
from brute_llm import WORD, components, repeated

from pathloom.llm import jaccard, quality, suffix_array, suffix_tree
from pathloom.llm import components as cc


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8))) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, repetition, ties, odd and empty texts."""
    r = random.Random(11)
    passage, base = prose(r, 60), prose(r, 120)
    rows = [(i, prose(r, r.randrange(1, 80))) for i in range(12)]
    rows += [(20 + i, f"{prose(r, r.randrange(0, 9))} {passage} {prose(r, r.randrange(0, 9))}") for i in range(6)]
    rows += [(30 + i, base) for i in range(3)]
    for i in range(8):
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        w[r.randrange(len(w))] = "Changed" * (1 + i % 2)
        rows.append((40 + i, " ".join(w)))
    rows += [(50, "x " * 400), (51, "a" * 900), (52, "a" * 450), (53, None), (54, ""), (55, " \t\n"), (56, "one two"), (57, "ONE two"), (58, "é" * 300)]
    rows += [(60, prose(random.Random(1), 50)), (60, prose(random.Random(2), 50)), (61, base), (61, base), (None, base), (None, prose(r, 40)), (62, passage[:-1] + "\x0b" + passage)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "c") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, anchor int, component string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("width,gram", [(400, 64), (40, 8)])
def test_repeated_bytes(docs, none, width, gram):
    data = [(t or "").encode() for _, t in ROWS]
    want = Counter()
    for (i, _), x, m in zip(ROWS, data, repeated(data, width), strict=True):
        kept = np.frombuffer(x, np.uint8)[~m].tobytes()
        want[i, len(x), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_array.digests(docs, width, gram).collect()) == want
    if width == 400:
        assert suffix_array.digests(none).count() == 0


def test_strip_keeps_rows_and_columns(docs):
    new = suffix_array.strip(docs, 40, 8, length_col="anchor")
    assert new.columns == docs.columns and new.count() == len(ROWS)
    found = {r.doc_id: r for r in new.collect()}
    assert found[53].text is None and found[54].text == "" and found[58].text == "" and found[58].anchor == 0
    assert found[57].text == "ONE two"


@pytest.mark.parametrize("limit", [200_000, 20])
def test_repeated_words(docs, none, limit):
    own = [WORD.findall(t or "") for _, t in ROWS]
    want = Counter()
    for (i, _), x, m in zip(ROWS, own, repeated(own, 35), strict=True):
        want[i, len(x), int(m.sum()), hashlib.sha256(" ".join(w for w, gone in zip(x, m, strict=True) if not gone).encode()).hexdigest()] += 1
    # a small limit makes prefixes as long as a window
    assert Counter(tuple(r) for r in suffix_tree.remove(docs, limit=limit, digest=True).collect()) == want
    if limit > 20:
        assert suffix_tree.remove(none).count() == 0


def test_similar_documents(docs, none):
    sets, group = components(ROWS)
    least = {}
    for (i, _), g in zip(ROWS, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(ROWS, sets, group, strict=True))
    found = jaccard.classes(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == want
    assert jaccard.classes(none).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    empty = sum(not s for s in sets)
    assert len(left) == len({g for s, g in zip(sets, group, strict=True) if s}) + empty
    assert {30, 53, 54, 55, 56} <= set(left) and not {31, 32, 57, 61} & set(left)


@pytest.mark.parametrize("block", [512, 3])
def test_all_links(docs, none, block):
    """Every link counts, those within a group of near copies too, and equal texts by their number."""
    sets, _ = components(ROWS)
    alike = lambda s, t: s and t and 100 * len(s & t) >= 75 * len(s | t)
    want = Counter((i, len(s), sum(bool(alike(s, t)) for m, t in enumerate(sets) if m != k)) for k, ((i, _), s) in enumerate(zip(ROWS, sets, strict=True)))
    found = jaccard.links(docs, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in found) == want
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((r.doc_id, r.component_id) for r in jaccard.classes(docs).collect())
    assert max(r.n_links for r in found) > 10
    assert jaccard.links(none).count() == 0


def test_rare_heavy_links(spark):
    """A chain, a star and a ring have the components that they should."""
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 201 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 7), (300, 301)]
    found = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 200 for i in range(200, 251)} | {i: 300 for i in range(300, 303)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_never_lose_a_pair():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64)
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 60, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert jaccard.similar(a, b, 75) == (100 * both >= 75 * (len(a) + len(b) - both))
        if jaccard.similar(a, b, 75):
            p, q = a[: jaccard.prefix_size(len(a), 75)], b[: jaccard.prefix_size(len(b), 75)]
            assert len(np.intersect1d(p, q))


DATA = "/root/testdata/sf0.01"


def test_classifier_learns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.learn(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.93
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert 0.7 < model.prior < 0.99


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (None, 1, "x"), (4, None, "x"), (1, 0, "x")], "doc_id long, quality int, text string")
    model = quality.learn(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(ROWS) and len({r.score for r in found if r.doc_id in (53, 54)}) == 1
    assert quality.score(none, quality.learn(none, labels)).count() == 0
    # the prior of a known mixture
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(1.5, 1, (1500, 4)), r.normal(1.5, 1, (1800, 4)), r.normal(-1.5, 1, (1200, 4))]).astype(np.float32)
    assert abs(quality.estimate_prior(np.hstack([x, np.ones((4500, 1), np.float32)]), np.arange(4500) < 1500) - 0.6) < 0.08


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline(spark):
    """run() is its stages by plain loops: classifier by its own scores, the rest by definition."""
    import corpus_pipeline
    import public_tokenizers
    from brute_llm import secrets
    from tokenizers import Tokenizer

    from pathloom.llm import secrets as scan

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "packing"]
    model = quality.learn(docs, spark.read.parquet(f"{where}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    sets, group = components(rows)
    rows = [x for k, x in enumerate(rows) if group[k] == k or not sets[k]]
    data = [t.encode() for _, t in rows]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for (i, _), x, m in zip(rows, data, repeated(data, 400), strict=True):
        y = np.frombuffer(x, np.uint8)
        text = y[~suffix_array.whole(y, m)].tobytes().decode()
        at, out = 0, ""
        extra = [(m.start(), 3, m.end()) for k in scan.ADDED for m in __import__("re").finditer(k.pattern, text) if len(m[0]) >= k.least]
        for s, _, e in sorted(secrets(text) + extra):
            if s < at:
                at = max(at, e)
                continue
            out, at = out + text[at:s] + scan.MASK, e
        want[i] = [*t.encode(out + text[at:], add_special_tokens=False).ids, 2]
    found = {}
    for r in corpus_pipeline.run(spark, where).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [y for _, x in sorted(p) for y in x] for i, p in found.items()} == want
