"""Fill-in-the-middle arrangements of texts, by DataFrame functions alone.

A text is cut into units, runs of letters or single other characters; two cuts make a prefix, a middle and a suffix, which
sentinels put in another order, so that a model learns to write a middle between two sides. Cuts and forms come from a hash
of the document's id, so a run can be repeated, on any number of machines, and each row is work by itself: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The unit, and the sentinels of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many are arranged, and how many of these have the suffix first.
ARRANGED, SUFFIX_FIRST = 90, 20
LONG = "long"


def draws(seed: int, doc_id: Column, n: int = 4) -> list[Column]:
    """The first n groups of eight digits of the hex SHA-256 of `seed:doc_id`, as numbers; a null id is an empty string."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast(LONG) for k in range(n)]


def _join(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start + 1, length), "")


def arrange(docs: DataFrame, seed: int = 1, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs: how many units its text has, the form
    (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle), how many code points prefix and middle have (null if
    plain), and the text in that form.

    Null texts are empty ones. Empty texts, and those that hold a sentinel, stay plain. Rows that repeat have equal
    results; rows without id share the draws of an empty id. Other columns don't matter; an empty table gives no rows. A
    text is never cut short; a task holds one text's units at a time."""
    own = docs.select(F.col(f"`{id_col}`").cast(LONG).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), F.array(*draws(seed, F.col("doc_id"))).alias("h"))
    own = own.select("*", F.size("units").alias("n"))
    cuts = [(F.col("h")[k] % (F.col("n") + 1)).cast("int") for k in (0, 1)]
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(F.col("text"), F.lit(sentinel))
    form = F.when((F.col("n") == 0) | held | (F.col("h")[2] % 100 >= arranged), "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    own = own.select("doc_id", "text", "units", "n", F.least(*cuts).alias("x"), F.greatest(*cuts).alias("y"), form.alias("form"))
    moved, units = F.col("form") != "plain", F.col("units")
    parts = {"prefix": _join(units, F.lit(0), F.col("x")), "middle": _join(units, F.col("x"), F.col("y") - F.col("x")), "suffix": _join(units, F.col("y"), F.col("n") - F.col("y"))}
    own = own.select("doc_id", "text", "n", "form", *(F.when(moved, v).alias(k) for k, v in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return own.select("doc_id", F.col("n").cast(LONG).alias("n"), "form", *(F.length(k).cast(LONG).alias(f"{k}_chars") for k in ("prefix", "middle")), output.alias("output"))


def _between(output: Column, first: str, second: str) -> list[Column]:
    """What follows the sentinel `first`, with which output begins, up to `second`; then up to MIDDLE; then the rest."""
    second_at = F.locate(second, output)
    middle_at = F.locate(MIDDLE, output)
    a, b, c = (F.lit(len(s) + 1) for s in (first, second, MIDDLE))
    return [F.substring(output, a, second_at - a), F.substring(output, second_at + b - 1, middle_at - second_at - b + 1), F.substring(output, middle_at + c - 1, F.length(output))]


def restore(arranged: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """arranged, with its columns and text: the document that an output of this form was made of, told by where the
    sentinels are. A null output or form gives a null text."""
    output, form = F.col(f"`{output_col}`"), F.col(f"`{form_col}`")
    prefix, suffix, middle = _between(output, PREFIX, SUFFIX)
    text = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "plain", output)
    suffix, prefix, middle = _between(output, SUFFIX, PREFIX)
    return arranged.withColumn("text", text.otherwise(F.when(form == "spm", F.concat(prefix, middle, suffix))))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): arrange() and restore(), in digests."""
    both = restore(arrange(docs, **options))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))
