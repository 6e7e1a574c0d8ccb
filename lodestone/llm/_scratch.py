"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.folders import new_path, remove, shared_dir

__all__ = ["new_path", "remove", "shared_dir", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read again: later jobs survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
