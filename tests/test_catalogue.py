"""Every query with SQL, at the smallest size, beside DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_items_with_unknown_words(spark, tmp_path):
    """A passage is found though its item has a word that no document has."""
    text = "one two three four five six seven eight nine"
    spark.createDataFrame([(1, text + " unheard")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "so " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["long_matches_contamination_all"](spark, str(tmp_path))
    assert [tuple(r) for r in found.select("query_id", "q_start", "length", "seq_id", "t_start").collect()] == [(1, 0, 9, 7, 1)]
