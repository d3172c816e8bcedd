"""Sieves: whatever is in them passes, from any number of tasks, and most else doesn't."""

from pyspark.sql import functions as F

from pathloom.llm.sieve import sieve


def test_sieve(spark):
    rows = spark.range(0, 4000, 1, 37).select("id", (F.col("id") % 7).cast("string").alias("s"))
    some = rows.filter("id % 3 = 0").unionByName(rows.filter("id % 6 = 0"))
    hit = rows.select("id", sieve(some, "id", "s")("id", "s").alias("hit")).collect()
    assert all(r.hit for r in hit if r.id % 3 == 0)
    assert sum(r.hit for r in hit if r.id % 3) < 20
    nulls = spark.createDataFrame([(None,), (b"a",), (b"",)], "k binary")
    assert [r.hit for r in nulls.select(sieve(nulls, "k")("k").alias("hit")).collect()] == [True] * 3
    assert not rows.filter(sieve(rows.limit(0), "id")("id")).count()
