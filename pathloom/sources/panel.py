"""Panels: ordered sequences of symbols, from tables, rows, text or Parquet, and the sinks for results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The columns of shared segments, in order.
SEGMENT_COLUMNS = ("hap1_id", "hap2_id", "hap1_start", "hap2_start", "length_nodes")


@dataclass(frozen=True)
class Panel:
    """positions (seq_id long, pos long from 0, node of any comparable type). bidirectional: sequence 2h is haplotype h
    and 2h + 1 its reverse, every node with its lowest bit flipped. sequences: the same as (seq_id, path array), a row for
    each sequence, where they are read so; then those that can match nothing are left out before positions are shuffled."""

    positions: DataFrame
    bidirectional: bool = False
    sequences: DataFrame | None = None

    @staticmethod
    def from_rows(df: DataFrame, key: str | Column, order: list[str | Column], symbol: str | Column) -> Panel:
        """A path for each key: its symbols in the given order, which should be total. Null symbols are left out."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        own = df.select(col(key).cast("long").alias("seq_id"), col(symbol).alias("node"), *(col(c).alias(f"o{i}") for i, c in enumerate(order))).filter("seq_id IS NOT NULL AND node IS NOT NULL")
        w = Window.partitionBy("seq_id").orderBy(*(f"o{i}" for i in range(len(order))))
        return Panel(own.select("seq_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "node"))

    @staticmethod
    def from_paths(paths: DataFrame, bidirectional: bool = False) -> Panel:
        """From (seq_id, path array). A sequence without nodes, null or empty, has no positions, and so isn't counted."""
        rows = paths.select(F.col("seq_id").cast("long").alias("seq_id"), F.posexplode("path").alias("pos", "node"))
        return Panel(rows.select("seq_id", F.col("pos").cast("long").alias("pos"), "node"), bidirectional)

    @staticmethod
    def from_text(spark: SparkSession, path: str) -> Panel:
        """A line for each path: comma-separated integers, however padded. Lines are numbered in the order of files and of
        lines in them; a line without integers has a number and no path. Files may be split among tasks."""
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # over parts of files, not lines
        base = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("low")).select("f", "b", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        number = (F.col("base") + F.col("i") - F.col("low")).cast("long")  # a part's lines are numbered without gaps
        nodes = F.transform(F.regexp_extract_all("value", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
        paths = lines.join(base, ["f", "b"]).select(number.alias("seq_id"), nodes.alias("path"))
        return Panel.from_paths(paths.filter(F.size("path") > 0))

    @staticmethod
    def load(spark: SparkSession, path: str, bidirectional: bool = False) -> Panel:
        return Panel(spark.read.parquet(path), bidirectional)

    def save(self, path: str) -> None:
        self.positions.write.mode("overwrite").parquet(path)

    def load_or_build(self, name: str, path: str, build) -> DataFrame:
        """A derived table, read from path/name if it's there, else built from this panel and kept there."""
        spark = self.positions.sparkSession
        place = f"{path.rstrip('/')}/{name}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            build(self).write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)

    def paths(self) -> DataFrame:
        """(seq_id, path array)"""
        pairs = F.array_sort(F.collect_list(F.struct("pos", "node")))
        return self.positions.groupBy("seq_id").agg(F.transform(pairs, lambda x: x["node"]).alias("path"))

    def extract(self, seq_id: int) -> DataFrame:
        return self.positions.filter(F.col("seq_id") == seq_id)

    def where(self, condition: Column | str) -> Panel:
        """The panel of the sequences for which the condition holds."""
        return Panel(self.positions.filter(condition), self.bidirectional)

    def as_queries(self) -> DataFrame:
        """(query_id, pos, node)"""
        return self.positions.withColumnRenamed("seq_id", "query_id")

    def stats(self) -> DataFrame:
        """size (nodes and an endmarker for each sequence), sequences, distinct nodes, longest sequence"""
        per = self.positions.groupBy("seq_id").agg(F.count("*").alias("n"))
        nodes = self.positions.agg(F.countDistinct("node").alias("nodes"))
        return per.agg((F.sum("n") + F.count("*")).alias("size"), F.count("*").alias("sequences"), F.max("n").alias("longest")).crossJoin(nodes)  # one row each

    def describe(self, n: int = 20) -> None:
        self.stats().show()
        self.paths().orderBy("seq_id").show(n, truncate=False)


def queries_from_stream(symbols: DataFrame, endmarker=0, bucket: int = 65536) -> DataFrame:
    """(query_id, pos, node) from (i, node): paths one after the other, each ended by the endmarker. Endmarkers are counted
    within buckets of i, then over the buckets, so no task holds the whole stream."""
    own = symbols.select("i", "node", F.floor(F.col("i") / bucket).alias("b"), F.when(F.col("node") == endmarker, 1).otherwise(0).alias("e"))
    earlier = lambda w: F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = own.groupBy("b").agg(F.sum("e").alias("e")).select("b", earlier(Window.orderBy("b")).alias("base"))
    split = own.withColumn("within", earlier(Window.partitionBy("b").orderBy("i"))).join(base, "b").filter("e = 0")
    split = split.select((F.col("base") + F.col("within")).cast("long").alias("query_id"), "i", "node")
    order = Window.partitionBy("query_id").orderBy("i")
    return split.select("query_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "node")


def queries_to_stream(paths: DataFrame, endmarker: int = 0) -> DataFrame:
    """(query_id, i, node): each path of (query_id, path) followed by the endmarker; a file in this order is a stream."""
    return paths.select("query_id", F.posexplode(F.concat("path", F.array(F.lit(endmarker).cast("long")))).alias("i", "node"))


def write_segments(segments: DataFrame, path: str) -> None:
    """Tab-separated values in order of all columns, the names led by '#' in the first line of each file."""
    named = segments.orderBy(*SEGMENT_COLUMNS).select(F.col("hap1_id").alias("#hap1_id"), *SEGMENT_COLUMNS[1:])
    named.write.mode("overwrite").option("sep", "\t").option("header", True).option("comment", "\u0001").csv(path)  # else the name that begins with # is quoted
