"""Intervals and the places that are asked for in them: joins by the last one before, without a task that holds a whole key.

Intervals of one key don't overlap. They are cut at the borders of buckets of places, so that whatever covers a place begins
in the place's own bucket: one exchange by key and bucket, one sort, and the last interval seen is the answer. A bucket holds
`bucket` intervals at most, and what is asked in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = "long"
BUCKET = 4096


def cut(intervals: DataFrame, first: str, length: str, bucket: int = BUCKET) -> DataFrame:
    """Intervals with _b, their bucket, and _from: where they begin in it; one for each bucket that an interval touches."""
    low, last = F.col(first), F.col(first) + F.col(length) - 1
    b = lambda c: F.floor(c / bucket)
    each = intervals.filter(F.col(length) > 0).withColumn("_b", F.explode(F.sequence(b(low), b(last))))
    return each.withColumn("_from", F.greatest(low, F.col("_b") * bucket).cast(LONG))


def covering(asked: DataFrame, at: str, intervals: DataFrame, first: str, length: str, keys: list[str], payload: list[str], bucket: int = BUCKET) -> DataFrame:
    """asked, with the payload of the interval [first, first + length) of the same keys that its place `at` lies in; null
    where none does. Rows of asked may repeat; a null place lies in none. Names of asked and payload don't clash."""
    own = cut(intervals, first, length, bucket)
    held = F.struct(F.lit(True).alias("there"), (F.col(first) + F.col(length)).alias("end"), *(F.col(c) for c in payload))
    there = own.select(*keys, "_b", F.col("_from").alias("_at"), held.alias("_held"), F.lit(None).cast(asked.select(F.struct(*asked.columns)).schema[0].dataType).alias("_row"))
    rows = asked.select(*keys, F.floor(F.col(at) / bucket).alias("_b"), F.col(at).cast(LONG).alias("_at"), F.lit(None).cast(there.schema["_held"].dataType).alias("_held"), F.struct(*asked.columns).alias("_row"))
    order = Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = there.unionByName(rows).withColumn("_held", F.last("_held", ignorenulls=True).over(order)).filter("_row IS NOT NULL")
    inside = F.coalesce(F.col("_at") < F.col("_held.end"), F.lit(False))
    return met.select("_row.*", *(F.when(inside, F.col(f"_held.{c}")).alias(c) for c in payload))


def running(rows: DataFrame, keys: list[str], at: str, amount: str | Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """rows, with name: the sum of amount over rows of the same keys at smaller places. Sums run within buckets of places,
    then over the buckets."""
    own = rows.withColumns({"_b": F.floor(F.col(at) / bucket), "_n": F.coalesce(amount if isinstance(amount, Column) else F.col(amount), F.lit(0)).cast(LONG)})
    up = Window.partitionBy(*keys, "_b").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = own.withColumn("_up", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    return within.join(base, [*keys, "_b"]).select(*rows.columns, (F.col("_up") + F.col("_base")).cast(LONG).alias(name))
