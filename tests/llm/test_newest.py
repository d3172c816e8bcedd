"""MinHash, fill-in-the-middle, collocations, and what hashes must not decide: beside plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute_llm import LOWER, WORD, secrets as plain_secrets
from pyspark.sql import functions as F

from pathloom.llm import fim, jaccard, minhash, packing, phrases, quality, secrets, suffix_array, suffix_tree, warc

#: Two words of one sum under the fixed numbers that word hashes once used.
ALIKE = "dddddddddddddddddddd", "gaaebacfadfeecccccce"
SCHEMA = "doc_id long, text string, lang string, key string, component_id long, n long"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "k", -1, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def plain_components(texts, n=4, percent=80):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return {i: (len(s), group[i]) for i, s in enumerate(sets)}


def near(base, changes, seed):
    r, w = random.Random(seed), base[:]
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_minhash_beside_all_pairs(spark):
    base = words(120, 1)
    chain = [" ".join(base[k : k + 100]) for k in range(0, 20, 4)]  # neighbours are near, ends aren't
    texts = [None, "", " \t ", "a", "A", "a b c", "a b c d", "A  b\tC d", *chain, *(near(base, k % 5, k) for k in range(30)), *(" ".join(words(60, k)) for k in range(100, 110)), "é ü ß ø å", " ".join(base).upper()]
    want = plain_components(texts)
    found = minhash.near_duplicates(docs(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == {i: (n, g, g == i) for i, (n, g) in want.items()}
    assert minhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_minhash_of_many_blocks(spark, monkeypatch):
    """Large buckets in blocks, tasks that drop all but the best pairs, and components that heads don't join."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TASK", 10)
    monkeypatch.setattr(minhash, "heads", lambda found, percent: jaccard.heads(found, percent).filter("substring(hex(a), 1, 1) < '4'"))
    base = words(100, 5)
    texts = [near(base, k % 7, k) for k in range(50)]
    want = plain_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts)).collect()} == want


@pytest.mark.parametrize("few", [None, 2])
def test_minhash_sends_no_pair_twice(spark, monkeypatch, few):
    """Near copies share many buckets, but a pair is told in one of them, and all pairs are, if few is None."""
    texts = [near(words(100, 5), k % 3, k) for k in range(1, 40)]
    own = docs(spark, texts).select("doc_id", F.encode("key", "utf-8").alias("x"), F.unhex(F.sha2("text", 256)).alias("key"), F.encode("text", "utf-8").alias("text"))
    nodes = minhash.signed(own.select("doc_id", "key", "text"), 4, 1).filter("bits IS NOT NULL").drop("doc_id").distinct()
    live = minhash.shared_buckets(nodes).withColumn("component", F.col("key"))
    rows = nodes.collect()

    def may(a, b):
        close = minhash.estimates(minhash.unpacked([a.bits]), minhash.unpacked([b.bits]))[0] >= minhash.least_estimate(80)
        return close and set(a.buckets) & set(b.buckets) and jaccard.may_be_similar(a.parts, b.parts, a.n_shingles, b.n_shingles, 80)

    want = {(bytes(a.key), bytes(b.key)) for a in rows for b in rows if a.key < b.key and may(a, b)}
    monkeypatch.setattr(type(live), "distinct", lambda self: self)
    got = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in minhash.across(live, nodes, 80, few).collect()]
    assert len(got) == len(set(got)) > 0 and set(got) <= want
    assert few or len(got) == len(want)


def test_minhash_rows_without_id_and_rows_that_repeat(spark):
    rows = spark.createDataFrame([(None, "one two three four five"), (4, "one two three four five"), (4, "one two three four five"), (None, "none like it at all"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == Counter({(None, 2, 4, False): 1, (4, 2, 4, True): 2, (None, 2, None, True): 1, (None, 0, None, True): 1})


def test_estimates_are_of_the_similarity():
    r = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 0.95):
        own, rest = r.integers(0, 1 << 63, int(2000 * share), np.uint64), r.integers(0, 1 << 63, (2, 2000 - int(2000 * share)), np.uint64)
        a, b = np.append(own, rest[0]), np.append(own, rest[1])
        s = len(own) / (len(own) + 2 * rest.shape[1])
        x, y = ([minhash.signature(minhash.minima(v, k)) for k in range(30)] for v in (a, b))
        assert len(x[0]) == minhash.HASHES * minhash.BITS // 8
        found = minhash.estimates(minhash.unpacked(x), minhash.unpacked(y))
        assert abs(found.mean() - s) < 0.03 and (s < 0.8 or found.min() > minhash.least_estimate(80))


def plain_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_fim_beside_loops(spark):
    r = random.Random(2)
    odd = [None, "", "a", "é", "<P>", "x <S> y", "<M", "<", "<<S", "P>", "\n\r\t", "👩‍👩‍👧 zoë", "word " * 30_000, "<" * 200 + "S>" * 100]
    texts = odd + ["".join(r.choice("ab <>PSM\n.é🙂") for _ in range(r.randint(1, 60))) for _ in range(300)]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "no id", "en", "k", 1, 1)], SCHEMA))
    made = fim.arrange(df)
    for row, back in zip(made.collect(), fim.restore(made).collect(), strict=True):
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plain_fim(row.doc_id, text)
        assert back.text == text
    assert fim.arrange(df.limit(0)).count() == 0
    assert "Python" not in made._jdf.queryExecution().toString()


def plain_phrases(rows, longest, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    kept = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    for (lang, p), a in kept.items():
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in kept.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("tokens", [1 << 19, 40])
def test_phrases_beside_loops(spark, monkeypatch, tokens):
    monkeypatch.setattr(phrases, "TOKENS", tokens)
    monkeypatch.setattr(phrases, "CHUNK", 1 << 20 if tokens > 100 else 37)
    monkeypatch.setattr(phrases, "PHRASES", 1 << 19 if tokens > 100 else 5)
    monkeypatch.setattr(phrases, "HELD", 1 << 21 if tokens > 100 else 50)
    r = random.Random(3)
    rows = [(" ".join(r.choice(["New", "york", "the", "a", "b", "é", "c.", ",", "d\n", "e\t f"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for _ in range(80)]
    rows += [("new york city hall, new york city hall", "en")] * 6 + [(None, "en"), ("", None), ("x", "fr"), ("the " * 300, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    for longest, least, top in ((5, 4, 2000), (2, 3, 7), (3, 300, 5)):
        got = {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.collocations(df, longest, least, top).collect()}
        assert got == plain_phrases(rows, longest, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrases_are_sent_by_range(spark, monkeypatch):
    """What tasks send has a row for each range at most, however many phrases there are."""
    df = spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(600)).encode())] * 4, "lang string, text binary").repartition(2)
    frames, of = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: frames.append(of(self, *a, **k)) or frames[-1])
    got = {(r.k, r.phrase): r.n for r in phrases.counted(df, 2, 4).collect()}
    assert got == {(0, ""): 2400} | {(1, f"w{i}"): 4 for i in range(600)} | {(2, f"w{i} w{i + 1}"): 4 for i in range(599)}
    assert frames[-1].count() <= 2 * 256


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """Counters that many phrases share admit too many, never too few."""
    monkeypatch.setattr(phrases, "FEWEST", 1 << 13)
    monkeypatch.setattr(phrases, "COUNTERS", 1 << 13)
    rows = [(" ".join(words(300, k)) + " to be or not to be" * 3, "en") for k in range(20)]
    got = {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 5, 20, 50).collect()}
    assert got == plain_phrases(rows, 5, 20, 50)


def test_words_of_one_sum_are_told_apart(spark):
    rest = [f"w{k}" for k in range(34)]
    texts = [" ".join([w, *rest]) for w in ALIKE]
    assert {r.n_removed for r in suffix_tree.remove(docs(spark, texts)).collect()} == {0}
    short = docs(spark, [" ".join([w, "b", "c", "d", "e"]) for w in ALIKE])
    assert {r.component_id for r in jaccard.classes(short).collect()} == {0, 1}
    assert {r.component_id for r in minhash.near_duplicates(short).collect()} == {0, 1}
    assert {r.n_removed for r in suffix_tree.remove(docs(spark, [texts[0], texts[0]])).collect()} == {35}


def test_classes_are_told_by_their_bytes(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=500))
    other = text[:250] + "~" + text[251:]
    assert {r.n_removed for r in suffix_array.digests(docs(spark, [text, other])).collect()} == {0}
    assert {r.n_removed for r in suffix_array.digests(docs(spark, [text, text])).collect()} == {500}


def test_a_text_of_very_many_secrets(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(30_000)) + " token = abcdef0123456789abcdef0123456789"
    df = docs(spark, [text, "x"])
    row = secrets.scan(df).filter("doc_id = 0").first()
    assert [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",")] == [(a, b) for a, _, b in plain_secrets(text)]
    assert secrets.redact(df).filter("doc_id = 0").first().text == "[SECRET] " * 30_000 + "[SECRET]"


def test_long_texts_of_the_other_operators(spark):
    text = " ".join(words(150_000, 8))
    df = docs(spark, [text, "short one", None])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.score(df, quality.learn(df, labels)).collect()} == {0, 1, 2}
    P = pytest.importorskip("public_tokenizers")
    pieces = packing.sequences(df.filter("doc_id > 0 OR length(text) > 0"), P.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r.all for r in pieces) and len(pieces) == 3
    pages = spark.createDataFrame([(1, "u", text), (2, "v", text), (3, "w", None)], "page_id long, url string, html string")
    back = {r.page_id: r for r in warc.read(warc.archives(pages)).collect()}
    assert back[2].refers_to == 1 and back[1].payload_bytes == len(text) and back[3].payload_bytes == 0
