"""Secret scans with a trigram inverted index, by DataFrame functions alone.

Each rule's regular expression gives a Boolean trigram query (trigrams.py). The index lists, for each trigram that a
query needs, the texts that hold it, lower-cased; intersecting lists, by counting a text's trigrams of a conjunction,
gives each rule's candidates. Only candidates are searched with the rule's expression; rules without mandatory trigrams
search every text.

Spark has no function for the places of all matches, but split() gives the texts between them and regexp_extract_all()
the matches; running sums of their lengths are the places, in code points. Sums run within chunks of matches, from what
all earlier chunks add up to, so that no growing array is copied for each match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import ALL, Query, finder, trigram_query


@dataclass(frozen=True)
class Rule:
    """group: whose length must be `least` at least; 0 is the whole match. Both Python and Java read the pattern alike."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


#: The rules that every scan has, in the order of their kinds; then those that this method adds.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
RULES = BASE + ADDED
MASK = "[SECRET]"
#: Matches of a text that are added up one by one.
CHUNK = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the index of texts (key, text) by these trigrams of their lower-cased forms, a row for each
    trigram that a text holds. One pass over a text finds all of them."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(finder(trigrams)), F.lit(1)))
    return texts.select("key", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules long): for each text that some rule's query admits, a bit for each such rule. Rules without mandatory
    trigrams aren't looked up, and have no bit."""
    parts = [(r, sorted(c)) for r, rule in enumerate(rules) if rule.query != ALL for c in sorted(rule.query, key=sorted)]
    trigrams = sorted({t for _, c in parts for t in c})
    uses = {t: [n for n, (_, c) in enumerate(parts) if t in c] for t in trigrams}
    if not trigrams:
        return texts.select("key", F.lit(0).cast("long").alias("rules")).limit(0)
    where = F.create_map(*(x for t in trigrams for x in (F.lit(t), F.array(*map(F.lit, uses[t])))))
    need = F.array(*(F.lit(len(c)) for _, c in parts))
    bit = F.array(*(F.lit(1 << r).cast("long") for r, _ in parts))
    listed = postings(texts, trigrams).select("key", "trigram", F.explode(where[F.col("trigram")]).alias("part"))
    full = listed.distinct().groupBy("key", "part").count().filter(F.col("count") == need[F.col("part")])
    return full.groupBy("key").agg(F.bit_or(bit[F.col("part")]).alias("rules"))


def places(text: Column, kind: int, rule: Rule) -> Column:
    """The spans (start, kind, end) of the rule's matches, those that are too short left out."""
    pattern = F.lit(rule.pattern)
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), part.alias("p")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["w"]).alias("w"), F.length(x["p"]).alias("p")))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["b"], acc["at"] + x["b"] + x["w"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["p"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def of(chunks: Column, totals: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), lambda a, x: a + x)
        start = lambda k: F.struct(before(k).alias("at"), F.array().cast(SPANS).alias("spans"))
        return F.flatten(F.transform(chunks, lambda x, k: F.aggregate(x, start(k), step)["spans"]))

    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["b"] + y["w"])
    return once(in_chunks(lengths), lambda c: once(F.transform(c, total), lambda t: of(c, t)))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it's used."""
    return F.transform(F.array(value), use)[0]


def in_chunks(items: Column) -> Column:
    """An array in arrays of CHUNK items: what grows item by item is copied within one only."""
    return once(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice(x, k + 1, F.lit(CHUNK))))


def located(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row struct of all columns of docs, text, spans): for each row its text, null as empty, and the spans of all
    rules' matches, by start, then in the order of the rules. A text is looked up by a hash; texts that share one are
    candidates together, and each is searched itself. Texts are shuffled once; one that many rows have may be split."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of(f"`{text_col}`").alias("text"))
    own = own.withColumn("key", F.xxhash64("text"))
    asked = candidates(own.select("key", "text"), rules)
    none = F.array().cast(SPANS)
    found = []
    for k, rule in enumerate(rules):
        on = F.lit(True) if rule.query == ALL else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
        found.append(F.when(on & F.col("text").rlike(rule.pattern), places(F.col("text"), k, rule)).otherwise(none))
    return own.join(asked, "key", "left").select("row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans string) for each row: how many spans of the base rules its
    text has, SHA-256 of these as kind:start:end, and the spans of all rules, in code points, end exclusive.

    Null and empty texts have no spans; rows that repeat have each their own row; rows without doc_id are scanned as
    well. Other columns don't matter; an empty table gives no rows."""
    found = located(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *(count(k).alias(f"n_{r.name}") for k, r in enumerate(BASE)), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch that spans cover replaced by the mask; spans are in order of their start."""
    def of(chunk: Column, low: Column, part: Column) -> Column:
        """What the chunk's spans make of part, the text from `low` on."""

        def step(acc: Column, s: Column) -> Column:
            fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(part, acc["at"] - low + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
            more = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            return F.when((s["start"] < acc["at"]) & (acc["at"] > 0), more).otherwise(fresh)

        return F.aggregate(chunk, F.struct(low.alias("at"), F.lit("").alias("out")), step)["out"]

    def chunk_of(x: Column, low: Column) -> Column:
        high = F.greatest(F.array_max(F.transform(x, lambda s: s["start"])), low)
        return once(F.substring(text, low + 1, high - low), lambda part: of(x, low, part))

    def whole(chunks: Column, ends: Column) -> Column:
        low = lambda k: F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0))
        out = F.transform(chunks, lambda x, k: once(low(k), lambda at: chunk_of(x, at)))
        return F.concat(F.array_join(out, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return once(in_chunks(spans), lambda c: once(F.transform(c, lambda x: F.array_max(F.transform(x, lambda s: s["end"]))), lambda e: whole(c, e)))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mask: str = MASK) -> DataFrame:
    """docs, all rows and columns, with secrets in texts masked. length_col: gets the new length.

    Null texts stay null, and empty ones empty; rows that repeat are masked alike, and all stay. Columns of any names are
    kept as they are, as long as no two are the same; an empty table gives no rows. Spans are masked in
    chunks, each of which reads the text from its beginning: 5 MB of nothing but secrets takes about 20 s."""
    found = located(docs, text_col)
    new = F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"), mask)).otherwise(F.col(f"row.`{text_col}`"))
    found = found.select("row", (F.size("spans") > 0).alias("hit"), new.alias("new"))  # made once, for the text and its length
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.col("new")}
    if length_col:
        columns[length_col] = F.when(F.col("hit"), F.length("new")).otherwise(F.col(f"row.`{length_col}`")).cast(docs.schema[length_col].dataType)
    return found.select(*(v.alias(c) for c, v in columns.items()))
