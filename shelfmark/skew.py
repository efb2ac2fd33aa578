"""Ordered running sums that hold no large key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import staged

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; at most rows/hot_rows of them can exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    hot_rows: int = HOT_ROWS,
    may_be_hot: bool = True,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key, in ``order`` (unique within a key).

    Ordinary keys go through one window. A hot key is cut by a range partitioning on
    (key, order) into chunks; each chunk is summed on its own and then shifted by the totals of
    the chunks before it. A key has at most one chunk per partition, so the second window only
    sees a few rows per key. ``may_be_hot=False`` is for callers that have measured the keys.
    """
    def window(*by: str) -> Window:
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )

    df = df.withColumn("_v", value)
    hot = hot_keys(df, keys, hot_rows) if may_be_hot else None
    if hot is None or hot.isEmpty():
        return df.withColumn(out, F.sum("_v").over(window(*keys))).drop("_v")

    hot = staged(hot, "hot-keys")
    cold = df.join(hot, keys, "left_anti").withColumn(out, F.sum("_v").over(window(*keys)))
    chunks = staged(
        df.join(hot, keys, "left_semi")
        .repartitionByRange(*keys, *order)
        .withColumn("_chunk", F.spark_partition_id()),
        "chunks",
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        chunks.groupBy(*keys, "_chunk")
        .agg(F.sum("_v").alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    )
    spread = (
        chunks.withColumn("_local", F.sum("_v").over(window(*keys, "_chunk")))
        .join(shifts, [*keys, "_chunk"])
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_local", "_shift", "_chunk")
    )
    return cold.unionByName(spread).drop("_v")


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str,
    hot_rows: int = HOT_ROWS,
    may_be_hot: bool = True,
) -> DataFrame:
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, hot_rows, may_be_hot)
