"""The organized layout: one folder per category and subcategory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLACE = ("category", "subcategory")


def write_layout(files: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """``REBALANCE`` brings the rows of a folder together without tiny files and splits a
    folder that is too large for one task."""
    files.hint("rebalance", *PLACE).write.mode(mode).partitionBy(*PLACE).parquet(folder)


def read_layout(spark: SparkSession, folder: str, columns_ddl: str) -> DataFrame:
    """The declared schema keeps folder names such as ``2024`` strings."""
    return spark.read.schema(f"{columns_ddl}, category string, subcategory string").parquet(folder)
