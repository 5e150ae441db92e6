"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table; columns and filters reach the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
