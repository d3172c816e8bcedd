"""Odd rows, long texts, and results beside plain loops and other libraries."""

import cmath
import hashlib
import importlib.util
import math
import random
import zlib

import numpy as np
import pytest
from brute_llm import WORD, repeated
from pyspark.sql import functions as F

from pathloom.llm import bitslice, bpe, jaccard, media, packing, quality, repeats, secrets, storage, suffix_array, suffix_tree, trigrams
from pathloom.llm.sieve import sieve

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_bpe_columns(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = read(spark, "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = own.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def plain_fingerprint(samples):
    """Peaks and pairs from the definition of the transform, one frame, band and pair at a time."""
    x = [(v - 128) / 128 for v in samples]
    n = 1 + max(0, math.ceil((len(x) - 512) / 256))
    x += [0.0] * ((n - 1) * 256 + 512 - len(x))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / 511) for k in range(512)]
    turn = [cmath.exp(-2j * math.pi * k / 512) for k in range(512)]
    size = [[abs(sum(x[256 * f + k] * window[k] * turn[b * k % 512] for k in range(512))) for b in range(257)] for f in range(n)]
    bands = [(1, 11), (11, 21), (21, 41), (41, 81), (81, 161), (161, 257)]
    best = [[max(range(a, b), key=lambda k: size[f][k]) for a, b in bands] for f in range(n)]
    mean = [sum(size[f][best[f][j]] for f in range(n)) / n for j in range(6)]
    peaks = [(f, best[f][j]) for f in range(n) for j in range(6) if size[f][best[f][j]] >= mean[j]]
    return [(f, b, c, g - f) for i, (f, b) in enumerate(peaks) for g, c in peaks[i + 1 : i + 4] if g - f <= 63]


def test_fingerprint_is_its_definition():
    r = random.Random(2)
    for n in (1100, 1700):
        samples = [min(255, max(0, int(128 + 60 * math.sin(k * k / 4000) + r.gauss(0, 20)))) for k in range(n)]
        frames, codes = media.fingerprint(np.array(samples, np.uint8))
        assert [(f, c >> 15, c >> 6 & 511, c & 63) for f, c in zip(frames.tolist(), codes.tolist(), strict=True)] == plain_fingerprint(samples)


def plain_features(text):
    """What a text's features are, counted one by one."""
    out = [0.0] * (quality.TRIGRAMS + quality.RATIOS)
    if not text:
        return out
    for k in range(len(text) - 2):
        out[((text[k] << 16 | text[k + 1] << 8 | text[k + 2]) * 2654435761 % 2**32) >> 22] += 1 / (len(text) - 2)
    out = [math.sqrt(v) for v in out]
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    symbols = [c for c in text if 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()"]
    out[quality.TRIGRAMS :] = [sum(65 <= c <= 90 for c in text) / len(text), len(symbols) / len(text), sum(c in b"\t\n\r " for c in text) / len(text), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n / (1 + 0.1 * math.log1p(n)), len(set(lines)) / len(lines), min(1.0, len(text) / n / 20)]
    return out


def test_scores_from_weights(spark):
    docs = read(spark, "documents")
    model = quality.learn(docs, read(spark, "labels"))
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.limit(40).collect():
        x = plain_features((r.text or "").encode())
        z = model.weights[-1] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False))
        assert abs(found[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-4
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_packed_ids_and_padding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [(10**6, "ab<|endoftext|>cd<|startoftext|> x"), (10**6 + 1, "<|endoftext|> hi"), (10**6 + 2, "<|ENDOFTEXT|>"), (10**6 + 3, None)]
    docs = read(spark, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    text, pieces, sequences = {r.doc_id: r.text or "" for r in docs.collect()}, {}, {}
    for r in packing.sequences(docs, P.path("word_bpe_49k.json"), with_ids=True).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in pieces.items()} == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in text.items()}
    assert [x for _, p in pieces[10**6 + 1] for x in p][:1] == [49407]
    waste = sum(4096 - n for n in sequences.values() if n & (n - 1))
    assert waste < 0.01 * sum(sequences.values())


ODD = [(1, None, 1, "a"), (1, "", 2, "b"), (None, "token = abcdef123 ü", 3, None), (2, "token = abcdef123 ü", 3, "c"), (2, "token = abcdef123 ü", 3, "c"), (3, "x" * 900, None, "d"), (4, "ü" * 500, 5, "e"), (None, None, None, None), (5, "plain words", 6, "f")]
NAMES = "doc_id long, text string, key int, row string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, NAMES)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("hit", "new", "rules", "spans", "trigram", "component", "weight", "n_chars")))).cache()


def test_redact(odd):
    new = secrets.redact(odd, length_col="n_chars")
    assert new.columns == odd.columns and new.count() == len(ODD)
    rows = [r for r in new.collect() if r.key == 3]
    assert [r.text for r in rows] == ["[SECRET] ü"] * 3 and [r.n_chars for r in rows] == [10] * 3
    assert sum(r.text is None for r in new.collect()) == 2 and secrets.redact(odd.limit(0)).count() == 0


def test_strip_odd(odd):
    new = suffix_array.strip(odd, length_col="n_chars")
    assert new.columns == odd.columns and new.count() == len(ODD)
    by = {(r.doc_id, r.key): r for r in new.collect()}
    assert by[3, None].text == "" and by[4, 5].text == "" and by[5, 6].text == "plain words" and by[1, 1].text is None and by[1, 2].text == ""
    assert suffix_array.strip(odd.limit(0)).count() == 0


def test_keep_odd(spark, odd):
    labels = read(spark, "labels")
    model = quality.learn(read(spark, "documents"), labels)
    kept = quality.keep(odd, model)
    scores = {r.doc_id: r.predicted for r in quality.score(odd, model).collect()}
    assert kept.columns == odd.columns and sum(r.doc_id == 2 for r in kept.collect()) == 2 * scores[2]
    assert quality.keep(odd.limit(0), model).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_odd(spark, odd, tmp_path):
    """Each stage takes odd rows and none at all; all but the last return the columns of its documents."""
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        where = str(tmp_path / name)
        docs.coalesce(1).write.parquet(f"{where}/documents.parquet")
        read(spark, "labels").write.parquet(f"{where}/labels.parquet")
        now = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = storage.stash(stage(spark, now, where))
            assert now.columns == docs.columns
        assert corpus_pipeline.run(spark, where).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


@pytest.mark.parametrize("text,n", [("a" * 3_000_000, 3_000_000), ("\n".join(["ab cd"] * 300_000), 1_799_999)])
def test_long_repetitive_texts(spark, text, n):
    docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_array.digests(docs).collect()}
    assert (found[1].n_bytes, found[1].n_removed, found[1].n_spans, found[2].n_removed) == (n, n, 1, 0)
    found = {r.doc_id: r for r in suffix_tree.remove(docs).collect()}
    words = text.count(" ") + text.count("\n") + 1
    assert (found[1].n_words, found[1].n_removed, found[2].kept) == (words, words if words > 35 else 0, "other")


def test_long_texts_elsewhere(spark):
    r = random.Random(4)
    text = " ".join(str(r.randrange(10**5)) for _ in range(250_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    assert {x.component_id for x in jaccard.classes(docs).collect()} == {1}
    assert [x.n_assign for x in secrets.scan(docs.withColumn("text", F.concat("text", F.lit(" token=abcdefgh")))).collect()] == [1, 1]
    for x in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert x.decoded_sha256 == hashlib.sha256((text + " end" * (x.doc_id == 2)).encode()).hexdigest()
    assert {x.n_bytes for x in media.digests(docs).collect()} == {len(text), len(text) + 4}


def test_trees(spark):
    """Inner nodes by depth are the repeats of so many symbols; windows are told from them, with odd white space too."""
    r = random.Random(6)
    for width in (3, 5, 8):
        x = np.array([r.randrange(3) for _ in range(60)])
        tree = suffix_tree.Tree.of(x, np.arange(60 - width + 1), width)
        assert [x[i : i + width].tolist() for i in tree.leaves] == sorted(x[i : i + width].tolist() for i in range(60 - width + 1))
        for depth, first, last in tree.nodes(1):
            for a, b in zip(first, last, strict=True):
                stems = {tuple(x[i : i + depth]) for i in tree.leaves[a:b]}
                longer = {tuple(x[i : i + depth + 1]) for i in tree.leaves[a:b]}
                assert len(stems) == 1 and b - a > 1 and (depth == width or len(longer) > 1)
        deep = {tuple(x[tree.leaves[a] : tree.leaves[a] + width]) for d, first, last in tree.nodes(width) for a in first}
        seen = [tuple(x[i : i + width]) for i in range(60 - width + 1)]
        assert deep == {s for s in seen if seen.count(s) > 1}
    text = " \t".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text.replace(" \t", "\n")), (3, text + " w0")]
    for limit in (200_000, 2):
        found = suffix_tree.remove(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
        assert {(x.doc_id, x.n_words, x.n_removed, x.kept) for x in found} == {(1, 40, 40, ""), (2, 40, 40, ""), (3, 41, 40, "w0")}


def test_radix_passes():
    r = random.Random(7)
    for width, digit in ((5, 4), (16, 8), (40, 16), (100, 64)):
        x = np.array([r.randrange(2) for _ in range(700)], np.uint8)
        at = np.arange(len(x) - width + 1)
        found = suffix_array.msd_passes(x, at, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), width, digit)
        seen = [x[i : i + width].tobytes() for i in at]
        assert found.tolist() == sorted((i for i in at if seen.count(seen[i]) > 1), key=lambda i: (seen[i], i))


@pytest.mark.parametrize("limit", [400_000, 30])
def test_many_suffixes_of_an_anchor(spark, limit):
    """A small limit splits anchors by longer and longer prefixes."""
    r = random.Random(3)
    base = "".join(r.choice("ab") for _ in range(300))
    texts = [base[r.randrange(40) :] + "".join(r.choice("abc") for _ in range(40)) for _ in range(12)] + ["ab" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: int(m.sum()) for i, m in enumerate(repeated([t.encode() for t in texts], 80))}
    assert {x.doc_id: x.n_removed for x in suffix_array.remove(docs, 80, 8, limit=limit).collect()} == want


def test_runs_tell_where_an_anchor_is_twice():
    r = np.random.default_rng(0)
    shape = repeats.Shape(12, 4)
    for _ in range(60):
        x = repeats.hashed(r.integers(0, 2, 80).astype(np.uint8))
        gram = repeats.names(x, 4, 8)[0]
        _, at, count, anchor, twice = repeats.runs(x, np.array([0, 80]), shape)
        assert at.tolist() == np.cumsum([0, *count[:-1]]).tolist() and count.sum() == 69
        for a, n, v, t in zip(at, count, anchor, twice, strict=True):
            region = gram[a : a + n - 1 + shape.span]
            assert v == region.min() and (t or (region == v).sum() == 1)


def prose(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_pairs_that_only_the_last_phase_finds(spark):
    """across() gives every pair of a bucket that passes the filters, in blocks too; heads() two at most for a node."""
    rows = [(7, bytes([k]) * 16, bytes([k]) * 16, 10 + k % 3, k % 2) for k in range(40)] + [(8, bytes([k]) * 16, bytes([9]) * 16, 10, 0) for k in range(5)]
    found = spark.createDataFrame(rows, "bucket long, key binary, component binary, size int, pos int")
    want = set()
    for i, (b, x, p, m, u) in enumerate(rows):
        for c, y, q, n, v in rows[i + 1 :]:
            least = math.ceil(75 * (m + n) / 175)
            if b == c and p != q and 100 * min(m, n) >= 75 * max(m, n) and min(m - u, n - v) >= least:
                want.add((min(x, y), max(x, y)))
    for block in (4096, 6):
        assert {(bytes(r.a), bytes(r.b)) for r in jaccard.across(found, 75, block).collect()} == want
    some = [(bytes(r.a), bytes(r.b)) for r in jaccard.heads(found, 75).collect()]
    assert set(some) <= want and len(some) == len(set(some)) > 0
    assert jaccard.across(found.limit(0), 75).count() == 0


def test_links_through_a_chain(spark):
    """Each text is like the next one only, so that heads miss some."""
    r = random.Random(9)
    words, texts = prose(r, 90), []
    for _ in range(12):
        texts.append(" ".join(words))
        words = words[9:] + prose(r, 9)
    found = jaccard.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(86)} for w in (WORD.findall(t) for t in texts)]
    want = [sum(100 * len(a & b) >= 75 * len(a | b) for b in sets) - 1 for a in sets]
    assert [x.n_links for x in sorted(found, key=lambda x: x.doc_id)] == want and {x.component_id for x in found} == {0} and min(want) == 1


def test_suffix_filter_never_loses_a_pair():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 90)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, r.integers(0, 9)).astype(np.uint64)]))
        if len(b) and jaccard.similar(a, b, 75):
            assert jaccard.may_be_similar(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b), 75)


def test_full_sieve(spark):
    """A sieve holds back nothing that is in it, and little else while it isn't full."""
    inside, outside = spark.range(20_000), spark.range(10**6, 10**6 + 20_000)
    may = sieve(inside, "id")
    assert inside.filter(may(F.col("id"))).count() == 20_000 and outside.filter(may(F.col("id"))).count() < 20
    assert outside.filter(sieve(inside.limit(0), "id")(F.col("id"))).count() == 0


def test_tables_between_steps(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "pathloom")
    there = lambda: {p.name for p in folder.glob("mine-*")}
    with storage.scratch():
        storage.stash(spark.range(3), "mine")
        kept = storage.stash(spark.range(3), "mine", keep=True)
        with storage.scratch():
            storage.stash(spark.range(3), "mine")
            assert len(there()) == 3
        assert len(there()) == 2
    assert len(there()) == 1 and kept.count() == 3


def test_trigrams_in_one_pass(spark):
    wanted = sorted({t for rule in secrets.RULES for c in rule.query for t in c})
    r = random.Random(1)
    texts = ["".join(r.choice("paswordtken_iy-x b") for _ in range(300)) for _ in range(30)] + ["", "-----begin private key-----"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = {(x.key, x.trigram) for x in secrets.postings(df, wanted).collect()}
    assert found == {(k, t) for k, text in enumerate(texts) for t in wanted if t in text}
    assert trigrams.finder(["abc"]).count("abc") <= 1


def test_scores_of_any_size(spark):
    rows = [(0, [1e200, -3.0]), (1, [1e200, 1.0]), (2, [-1e200, 1.0]), (3, [2.0**40, 2.0**40]), (4, [0.5, 0.25]), (50, [2.0**30, 1.0])]
    found = {(x.query_id, x.vec_id): (x.rank, x.score) for x in bitslice.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    value = {i: [int(x) * 256 if abs(x) > 2**53 else math.floor(x * 256) for x in v] for i, v in rows}
    for q in (0, 50):
        score = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(value[q], v, strict=True)))) for i, v in value.items() if i != q}
        order = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert {i: found[q, i] for i in order} == {i: (k + 1, score[i]) for k, i in enumerate(order)}
