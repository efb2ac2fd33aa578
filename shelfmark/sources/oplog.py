"""The operation log: what a run moved, so that it can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_LOG_DDL = (
    "version string, timestamp string, root_dir string, "
    "operations array<struct<timestamp:string, source:string, destination:string>>"
)
LOG_DDL = (
    "run_id string, kind string, phase int, source string, destination string, status string, "
    "ts timestamp"
)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """A log document as rows ``root_dir, op_pos, timestamp, source, destination``.

    Malformed JSON raises; a document without operations gives one row with null ``op_pos``.
    """
    documents = spark.read.schema(JSON_LOG_DDL).json(path, multiLine=True, mode="FAILFAST")
    return documents.select("root_dir", F.posexplode_outer("operations").alias("op_pos", "op")).select(
        "root_dir", "op_pos", "op.timestamp", "op.source", "op.destination"
    )


def log_rows(results: DataFrame, run_id: str) -> DataFrame:
    """Log rows of all operations that changed the inventory, also those that failed a later
    integrity check."""
    return results.where(F.col("status").isin("ok", "mismatch")).select(
        F.lit(run_id).alias("run_id"), "kind", "phase", "source",
        F.col("final_destination").alias("destination"), "status",
        F.current_timestamp().alias("ts"),
    )


def write_log(rows: DataFrame, folder: str) -> None:
    """One append per run, as JSON lines."""
    rows.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG_DDL).json(folder)
