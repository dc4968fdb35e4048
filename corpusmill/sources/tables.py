"""Scans of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; columns and filters are pruned into the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
