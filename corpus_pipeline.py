"""From raw documents to packed training sequences: five stages, each by one of the operators of pathloom.llm.

A stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns
of documents. Each is written as Parquet and read again before the next begins.

Every stage takes null and empty texts, rows that repeat, rows without doc_id, no rows at all, and columns of any names
beside those of documents, as long as no two are the same; what becomes of each is said below. Very long texts are never
cut: what a task holds is bounded by its longest text, with a small factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import jaccard, packing, quality, secrets, suffix_array
from pathloom.llm.common import table
from pathloom.llm.queries import tokenizer
from pathloom.llm.storage import stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these and the table of labels, scores at 0.5 or more. Null and empty texts
    are scored alike, and rows that repeat stay or go together."""
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest doc_id. Rows that share that
    doc_id and its text are one document; rows without doc_id stay only if no other of their component has one, once.
    Texts without words, null ones too, are in no component, and all stay."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that are repeated in these documents, at whole characters; none is dropped, even
    if nothing is left of its text. Null texts stay null."""
    return suffix_array.strip(docs, length_col="n_chars")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; none is dropped. Null texts stay null."""
    return secrets.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece, with its ids. Null and empty texts are the end id alone;
    each row is a document of its own; no documents make no pieces."""
    return packing.sequences(docs, tokenizer("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secret_scan),
    ("packing", packed),
]

#: A fitted model, connected components and a tokenizer aren't SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents of sf_dir. Odd rows are treated as each stage says; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}")
    return docs
