"""Readers of the parquet tables; one directory or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored. Only the columns a query names are read (parquet column pruning)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
