"""The queries of the training-data operators: thin calls that derive the asked digests from what an operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, bpe, fim, jaccard, media, minhash, packing, phrases, quality, secrets, suffix_array, suffix_tree, warc
from .common import table
from .oracles import ORACLES
from .storage import stash

__all__ = ["ORACLES", "QUERIES", "tokenizer"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.remove(table(spark, sf_dir, "documents"), digest=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("key", "group")


def op7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.digests(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_bytes", found["n_bytes"] - found["n_removed"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(stash(warc.archives(table(spark, sf_dir, "pages")), "archives", keep=True)).drop("payload")


def op10_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.nearest(table(spark, sf_dir, "embeddings"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_secrets": op6_secrets,
    "op7_jaccard": op7_jaccard,
    "op7_links": op7_links,
    "op8_suffix_array": op8_suffix_array,
    "op9_warc": op9_warc,
    "op10_bit_sliced": op10_bit_sliced,
    "op11_minhash": op11_minhash,
    "op12_fim": op12_fim,
    "op13_phrases": op13_phrases,
}
