"""Inventory tables: what a run starts from when nothing is scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INVENTORY_DDL = (
    "path string, size_bytes bigint, hash string, modified_time timestamp, is_symlink boolean"
)


def read_inventory(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(INVENTORY_DDL).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(folder)
