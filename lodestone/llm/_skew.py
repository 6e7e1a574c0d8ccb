"""Joins of many rows with few per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a 1 / SHARE of all rows is hot; there are fewer than SHARE of them.
SHARE = 1000
#: Keys of no more rows are never hot.
ROWS = 1024


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join that is shuffled whatever its size.

    A table that grows with the input would else be sent through the driver as long as its files are small: 10 MB of them hold
    millions of rows, which take hundreds of MB there.
    """
    return df.hint("merge")


def _least(groups: DataFrame) -> tuple[int, bool]:
    """Above how many rows a key is hot, and whether any is."""
    total, most = groups.agg(F.sum("n"), F.max("n")).first()
    least = max(ROWS, (total or 0) // SHARE)
    return least, (most or 0) > least


def met(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row a key with the number ``n`` of rows that hold it.

    Hot keys, fewer than ``SHARE``, are broadcast and their rows stay where they are; the other rows are shuffled. Adaptive
    execution doesn't split such a join, since an aggregate stands between it and the shuffle. ``groups`` is read three
    times and ``rows`` twice: both should be written tables or cheap. Keys may not be null; empty tables give no rows.
    """
    least, some = _least(groups)
    if not some:
        return rows.join(apart(groups), on)
    hot, cold = F.broadcast(groups.where(F.col("n") > least)), groups.where(F.col("n") <= least)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(apart(cold), on))


def salted(rows: DataFrame, counted: DataFrame, values: DataFrame, key: str, other: str) -> DataFrame:
    """Inner join of ``rows`` (key, other, ...) with ``values``, one or few rows a key.

    A hot key's rows are dealt by ``other`` and its values repeated for each part, at most 2 * ``SHARE`` times over all keys.
    ``counted``, a written table, has the keys of ``rows``, each as often. Empty tables give no rows.
    """
    groups = counted.groupBy(key).agg(F.count("*").alias("n"))
    least, some = _least(groups)
    if not some:
        return rows.join(apart(values), key)
    ways = F.broadcast(groups.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("ways")))
    count = F.coalesce("ways", F.lit(1))
    left = rows.join(ways, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), count).cast("int")).drop("ways")
    right = values.join(ways, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("ways")
    return left.join(apart(right), [key, "salt"]).drop("salt")
