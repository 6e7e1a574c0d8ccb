"""The size of the batches in which rows go to Python, and the tasks that they go from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to 1000 rows and 8 MB, where they are at Spark's defaults.

    Texts are long rows: at the defaults a batch is tens of MB, in the JVM, on the wire and in the worker at once.
    """
    for name, default, low in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(64 << 20), str(8 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) in (default, f"{default}b", "64MB"):
            spark.conf.set(key, low)


def spread(rows: DataFrame, *by: str, most: int = 25_000) -> DataFrame:
    """``rows`` dealt by ``by`` over tasks of about ``most`` rows, of which there are no fewer than cores.

    Small rows lie in one or two splits, however many they are and whatever work each of them makes. The number is given, since
    adaptive execution would merge the tasks again by the rows' few bytes. It takes a count of ``rows`` beforehand.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)), *by)
