"""Scans of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables; columns are pruned and filters pushed down by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
