"""Pairs of equal keys where far more come out than go in: what has one key is gathered in lists, and only lists are joined.

A pair is made where two lists meet, and sent nowhere. Lists are of bounded length, and made where rows are, before these are
sent. A key of more places than BLOCK is dealt to several tasks, and what is asked of it is sent to each: so what is
shuffled follows the tables, and the pairs divided by BLOCK. Pairs come out place by place, with what is asked in the same
order each time, so files of them are small: a column of runs, and one of repeats within reach of a compressor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep

#: Places of a key that go to one task, about; places of a list, and what is asked in one, at most. All pairs of two lists
#: are held by a task at once.
BLOCK, LONGEST, ASKED = 1 << 16, 1 << 6, 1 << 7
#: Shorter lists don't count when it is told which keys have many places.
FEW = 8


def gathered(rows: DataFrame, key: list[str], columns: list[str], most: int) -> DataFrame:
    """(*key, _n, _l_<column>...): the rows of one key and partition as lists of `most` at most, and their number. Keys are
    integers, or null."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), "_n int", *(f"_l_{c} array<{kinds[c]}>" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            new[::most] = True
            for c in key:
                x = b.column(c)
                for y in (x.is_null(), x.fill_null(0)):
                    y = y.to_numpy(zero_copy_only=False)
                    new[1:] |= y[1:] != y[:-1]
            ends = np.append(np.flatnonzero(new), b.num_rows).astype(np.int32)
            own = [b.column(c).take(pa.array(ends[:-1])) for c in key]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends)), *(pa.ListArray.from_arrays(pa.array(ends), b.column(c)) for c in columns)], names=[*key, "_n", *(f"_l_{c}" for c in columns)])

    return rows.select(*key, *columns).sortWithinPartitions(F.xxhash64(*key)).mapInArrow(run, schema)


def met(asked: DataFrame, places: DataFrame, on: list[str], own: list[str], there: list[str], own_beside: tuple[str, ...] = (), there_beside: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """(*on, *own, *there): each row of asked (*on, *own_beside, *own) with each of places (*on, *there_beside, *there) that has the
    same `on`, and for which the condition on the columns beside holds. None of own, there and on is null."""
    t = keep(gathered(places, [*on, *there_beside], there, LONGEST), "lists")
    many = t.filter(F.col("_n") >= FEW).groupBy(*on).agg(F.sum("_n").alias("_all")).filter(F.col("_all") > BLOCK).select(*on, F.ceil(F.col("_all") / BLOCK).cast("int").alias("_parts"))
    many = F.broadcast(many)  # no more rows than places / BLOCK
    dealt = F.pmod(F.xxhash64(*(F.get(f"_l_{c}", F.lit(0)) for c in there)), F.col("_parts")).cast("int")
    t = t.join(many, on, "left").withColumn("_part", F.coalesce(dealt, F.lit(0))).drop("_parts", "_n")
    q = gathered(asked, [*on, *own_beside], own, ASKED).join(many, on, "left")
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "_n")
    both = t.join(q, [*on, "_part"])
    both = both if condition is None else both.filter(condition)
    for side in (there, own):  # the last one runs through its list for each of the other
        first, *rest = side
        lists = [c for c in both.columns if c.startswith("_l_") and c[3:] not in side]
        kept = [c for c in both.columns if not c.startswith("_")]
        both = both.select(*kept, *lists, *(f"_l_{c}" for c in rest), F.posexplode(f"_l_{first}").alias("_k", first))
        both = both.select(*kept, *lists, first, *(F.get(f"_l_{c}", F.col("_k")).alias(c) for c in rest))
    return both.select(*on, *own, *there)
