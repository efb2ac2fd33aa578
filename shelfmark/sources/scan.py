"""Scanning a directory tree on the executors."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import by_value, literal_table, new_folder
from shelfmark.sources.files import DIRECTORY, ERROR, FILE, PENDING, children, failure, is_remote, local

by_value(__name__)

ENTRY_DDL = (
    "path string, kind string, size_bytes bigint, modified_time timestamp, is_symlink boolean, target string, error string"
)
BUDGET = 20_000  # entries after which a task leaves the directories it has not opened yet to the next round
ROWS = 5_000


def _walker(budget: int):
    schema = pa.schema([
        ("path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()),
        ("modified_time", pa.timestamp("us", "UTC")), ("is_symlink", pa.bool_()), ("target", pa.string()),
        ("error", pa.string()),
    ])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        listed = 0
        for batch in batches:
            queue = deque(batch["path"].to_pylist())
            while queue:
                folder = queue.popleft()
                if listed >= budget:
                    rows.append((folder, PENDING, None, None, None, None, None))
                else:
                    listed += 1
                    try:
                        for entry in children(folder):
                            rows.append(entry)
                            listed += 1
                            if entry[1] == DIRECTORY and not entry[4]:
                                queue.append(entry[0])
                            if len(rows) >= ROWS:
                                yield packed(rows)
                                rows = []
                    except Exception as error:  # whatever a store may raise: one directory, one error
                        rows.append((folder, ERROR, None, None, None, None, failure(error)))
                if len(rows) >= ROWS:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return walk


def scan_tree(spark: SparkSession, root: str, budget: int = BUDGET) -> DataFrame:
    """One row per entry below ``root`` (ENTRY_DDL): files, directories, others, and errors.

    The frontier of directories that nobody has opened is a table. Every round deals it to the tasks; each goes down
    from its directories until it has seen ``budget`` entries and leaves what is left for the next round, so a small
    tree takes one or two rounds and a large one spreads at once. No name is left out, whatever it starts with. Links
    are not followed: a link to a directory is an entry, what is behind it is not.
    """
    root = (root if is_remote(root) else local(root)).rstrip("/") or "/"
    folder = new_folder(spark, "scan")
    frontier = literal_table(spark, [{"path": root}], "path string")
    tasks = 4 * spark.sparkContext.defaultParallelism
    level = 0
    while True:
        frontier.mapInArrow(_walker(budget), ENTRY_DDL).write.parquet(f"{folder}/round={level}")
        seen = spark.read.schema(ENTRY_DDL).parquet(f"{folder}/round={level}")
        if level == 0:
            refused = seen.where((F.col("path") == root) & (F.col("kind") == ERROR)).first()
            if refused:
                raise ValueError(f"no such directory: {root} ({refused['error']})")
        pending = seen.where(F.col("kind") == PENDING).select("path")
        left = pending.count()
        if not left:
            break
        frontier = pending.repartition(min(left, tasks))
        level += 1
    entries = spark.read.schema(f"{ENTRY_DDL}, round int").parquet(folder)
    return entries.where(F.col("kind") != PENDING).drop("round")


def files_of(entries: DataFrame) -> DataFrame:
    """The files of a scan, and what could not be looked at as rows with an ``error``."""
    return entries.where(F.col("kind").isin(FILE, ERROR)).select(
        "path", "size_bytes", "modified_time", F.coalesce("is_symlink", F.lit(False)).alias("is_symlink"), "error"
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes, modified_time, is_symlink, error`` of everything below ``root``; no content is read."""
    return files_of(scan_tree(spark, root))
