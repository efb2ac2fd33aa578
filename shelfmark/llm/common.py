"""What the operators share: the shared folder, staged tables, order positions, connected components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Functions of ``module`` travel to the workers with their code, wherever the package lies."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)

SLICE = 256  # rows that a worker works on at once


def worker_store() -> dict:
    """What a worker keeps from one task to the next: functions sent by value have new globals in every task."""
    return sys.modules.setdefault("_shelfmark_worker", types.ModuleType("_shelfmark_worker")).__dict__


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: no lineage, no recomputation."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only what is worked on, so that other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)


def values(column: pa.ChunkedArray | pa.Array) -> Iterator:
    """The values of an Arrow column, one at a time (null: None)."""
    for scalar in column:
        yield scalar.as_py()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ``rows`` at once, without copying them.

    What a worker makes of a slice, and what goes back to the JVM in one buffer, is as small as that; of an Arrow batch of
    ten thousand texts it is tens of MB on both sides, which the allocators keep.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def unused_name(df: DataFrame, wish: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def running(df: DataFrame, keys: list[str], order: list[Column], value: str, label: str) -> DataFrame:
    """Adds ``_before`` and ``_upto``: the sum of ``value`` over earlier rows of the same ``keys``, and with the row.

    Rows are range-sorted by keys and order (ties at random, so that equal rows spread too), so that a hot key lies in as many partitions as it needs; each
    partition sums its own rows, and the sums of earlier partitions (one row per key and partition) are added.
    The sorted rows are staged: the positions of rows that tie in every order column never change afterwards.
    """
    keyed = [F.col(k).asc_nulls_last() for k in keys]
    parts = staged(
        df.withColumn("_tie", F.rand(1)).repartitionByRange(*keyed, *order, "_tie")
        .withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keyed, *order, "_tie").drop("_tie").withColumn("_place", F.monotonically_increasing_id()), label)
    own = Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    shifts = sums.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        parts.withColumn("_own", F.sum(value).over(own)).join(shifts, same)
        .withColumn("_upto", F.col("_own") + F.col("_shift")).withColumn("_before", F.col("_upto") - F.col(value))
        .drop("_own", "_shift", "_p", "_part", *[f"_k{i}" for i in range(len(keys))])
    )


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), the root being the component's smallest node.

    Large-star and small-star steps alternate; each is an aggregate and a join on the node, so that no task
    gathers a node's neighbours. Rounds grow with the logarithm of the largest component.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), label)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())

    seen = mark(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), label)
        now = mark(edges)
        if now == seen:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        seen = now
