"""A trigram index for substring search: (gram, id) in ranges of grams, and the named rows in ranges of their ids.

A search intersects the ids of a pattern's grams, of which it reads only those grams' row groups, fetches the rows of these
ids, and keeps those that match the pattern itself, so that the result is the scan's. Patterns whose literal parts are all
shorter than three letters have no gram and take the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_like

#: Ids that are sent to the scan of the rows as constants, so that row groups are skipped; more meet the rows in a join.
NAMED_IDS = 2000


def _grams(c: Column) -> Column:
    low = ascii_lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def pattern_grams(pattern: str) -> list[str]:
    """The grams that every row which contains the pattern has; ``%`` and ``_`` stand for any text and any letter."""
    low = pattern.translate({i: i + 32 for i in range(65, 91)})
    parts = low.replace("_", "%").split("%")
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


class TrigramIndex:
    """Rows with an ``id`` under ``path`` and the grams of some of their columns."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...]):
        self.spark, self.path, self.columns = spark, path, columns

    @classmethod
    def write(cls, rows: DataFrame, path: str, columns: tuple[str, ...] = ("name", "full_symbol")) -> TrigramIndex:
        """Rows with unique ids; the grams of each column are kept apart, as a match lies in one of them."""
        each = None
        for k, c in enumerate(columns):
            part = rows.where(F.char_length(c) >= 3).select(F.explode(_grams(F.col(c))).alias("gram"), F.lit(k).alias("of"), "id")
            each = part if each is None else each.unionByName(part)
        each.repartitionByRange("gram", "of", "id").sortWithinPartitions("gram", "of", "id").write.parquet(f"{path}/grams")
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/rows")
        return cls(rows.sparkSession, path, columns)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(id) of the rows of which one column has all the pattern's grams; None without grams."""
        grams = pattern_grams(pattern)
        if not grams:
            return None
        posts = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(grams))
        return posts.groupBy("of", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id").distinct()

    def containing(self, pattern: str, where: Column | None = None) -> DataFrame:
        """The rows of which a column contains the pattern, as ``contains_like`` has it."""
        match = F.lit(False)
        for c in self.columns:
            match |= F.coalesce(contains_like(F.col(c), pattern), F.lit(False))
        rows = self.rows() if where is None else self.rows().where(where)
        found = self.candidates(pattern)
        if found is None:
            return rows.where(match)
        few = [r["id"] for r in found.limit(NAMED_IDS + 1).collect()]
        if len(few) <= NAMED_IDS:
            return rows.where(F.col("id").isin(few) if few else F.lit(False)).where(match)
        return rows.join(found, "id", "left_semi").where(match)

    def find(self, pattern: str, repo: str | None = None, limit: int = 20) -> DataFrame:
        """``filters.find_symbol`` for a part of a name, through the index."""
        from .filters import limited, metadata

        return limited(self.containing(pattern, metadata(repo=repo)).orderBy("repo", "filepath", "start_line"), limit)
