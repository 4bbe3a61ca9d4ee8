"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``; columns are pruned by what the query selects."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
