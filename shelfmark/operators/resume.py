"""Progress of interrupted runs.

Schema of a progress table: ``run_id, root, hash, phase, status, ts``; rows are only appended.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS_DDL = (
    "run_id string, root string, hash string, phase string, status string, ts timestamp"
)
# The phases of a run.
PHASES = ("analysis", "planning", "execution", "cleanup")
DONE, FAILED, CLEARED = "done", "failed", "cleared"


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The progress table; empty where nothing was saved yet."""
    try:
        return spark.read.schema(PROGRESS_DDL).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROGRESS_DDL)


def save_progress(rows: DataFrame, folder: str, run_id: str, root: str, phase: str, status: str = DONE) -> None:
    """Appends one progress row per row of ``rows`` (hash): its content is ``status`` in ``phase`` of this run.

    Rows are only ever appended, so that a run that is cut off loses none that were saved. A file without a hash, which
    was never read, gets a row that `remaining` does not match: it is looked at again.
    """
    if phase not in PHASES:
        raise ValueError(f"unknown phase: {phase}")
    rows.select(
        F.lit(run_id).alias("run_id"), F.lit(root).alias("root"), "hash", F.lit(phase).alias("phase"),
        F.lit(status).alias("status"), F.current_timestamp().alias("ts"),
    ).write.mode("append").parquet(folder)


def clear_progress(spark: SparkSession, folder: str, run_id: str, root: str) -> None:
    """From now on ``root`` has no progress: one more row says so, and `current` starts behind it."""
    none = spark.range(1).select(F.lit(None).cast("string").alias("hash"))
    save_progress(none, folder, run_id, root, PHASES[-1], CLEARED)


def current(progress: DataFrame) -> DataFrame:
    """The rows of every root after it was last cleared."""
    cleared = progress.where(F.col("status") == CLEARED).groupBy("root").agg(F.max("ts").alias("_cleared"))
    return progress.join(cleared, "root", "left").where(
        (F.col("status") != CLEARED) & (F.col("_cleared").isNull() | (F.col("ts") > F.col("_cleared")))
    ).select(*progress.columns)


def remaining(files: DataFrame, progress: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files whose content is not done yet; give ``["path", "hash"]`` to tell copies apart."""
    keys = keys or ["hash"]
    done = progress.where(F.col("status") == DONE).select(*keys).distinct()
    return files.join(done, keys, "left_anti")


def progress_summary(progress: DataFrame, total: Column) -> DataFrame:
    """One row per root; ``total`` is the number of files to process."""
    counts = progress.groupBy("root").agg(
        F.count_if(F.col("status") == DONE).alias("completed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.max_by("phase", "ts").alias("phase"),
    )
    counts = counts.withColumn("total", total)
    return counts.withColumn(
        "percent",
        F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("completed") / F.col("total") * 100),
    )


def latest_runs(progress: DataFrame) -> DataFrame:
    """The last run of every root that was not cleared afterwards."""
    last = progress.groupBy("root").agg(
        F.max(F.struct("ts", "run_id", "phase", "status")).alias("_last")
    )
    return last.where(F.col("_last.status") != CLEARED).select(
        "root", "_last.run_id", "_last.phase", "_last.ts"
    )
