"""Input tables of the queries, reduced to the columns in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def buckets_of(df: DataFrame, parts: int, each: int = 16 << 20) -> int:
    """How many buckets to deal ``df`` into, so that one holds at most about ``each`` bytes of it: by the size that the plan states.

    At least ``parts``; a size that the plan does not know counts as small.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts, min(size // each, 1 << 20) if size < 1 << 60 else 0)


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, balance: bool = True) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` labelled rows of each class outside the held-out fold.

    Rows are taken in the order of a hash of the id, so the sample is the same at every partitioning. It has a bound,
    so it may be broadcast and its numbers collected. Repeated rows of labels or documents count once.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("doc_id"))
    if balance:
        parts = [known.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
        known = parts[0].unionByName(parts[1])
    else:
        known = known.orderBy(order, "doc_id").limit(2 * per_class)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # an id that many rows share counts once; its rows combine before the shuffle
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
