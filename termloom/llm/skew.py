"""Joins of a large table with one row for each key, where one key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of the rows are broadcast: by their definition there are at most 1 / SHARE of them.
SHARE = 1 / 2000


def join_hot(rows: DataFrame, named: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with named, which has one row for each key and in ``count`` how many of the ``total`` rows have it (kept out of the result).

    Hot keys are broadcast and the rest is shuffled, so no task gets more of one key than SHARE of all
    rows. how: inner, or left for all rows.
    """
    hot = F.broadcast(named.where(F.col(count) > SHARE * total).drop(count))
    cold = named.where(F.col(count) <= SHARE * total).drop(count)
    others = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(cold, key, how))
