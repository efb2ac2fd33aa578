"""Watching for new files with Structured Streaming.

Events: ``event_id, path, event_type (created/modified), ts TIMESTAMP, size_bytes`` and any further columns; the id
tells events of one time apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.config import JobConfig
from shelfmark.functions import paths
from shelfmark.functions.globs import matches_any
from shelfmark.operators.classify import Classifier, classify
from shelfmark.operators.classify import destination as destination_of
from shelfmark.session import new_folder
from shelfmark.sources.layout import write_layout
from shelfmark.sources.oplog import LOG_DDL
from shelfmark.streaming import arrivals

EVENT_DDL = "event_id bigint, path string, event_type string, ts timestamp, size_bytes bigint"
SENTINEL = "/inbox/_end"
# What a started query takes along: state on local disks instead of executor memory, bursts merged before the shuffle.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """The settings a stream starts with; afterwards the session has its own again."""
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_events(
    spark: SparkSession, folder: str, ddl: str = EVENT_DDL, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def watch_landing_directory(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Every new object of a landing directory once, as a created event.

    ``ts`` is when the object was seen, which never runs backwards, so none is ever too late for a watermark, however
    old its own ``modified_time`` is.
    """
    objects = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    return objects.select(
        F.xxhash64("path", "modificationTime", "length").alias("event_id"),
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit("created").alias("event_type"),
        F.current_timestamp().alias("ts"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_time"),
    )


def in_managed_directory(path: Column, prefix: str) -> Column:
    """Any directory above the file, at any depth, is a managed one."""
    folders = F.split(paths.parent(path), "/")
    return F.exists(folders, lambda s: s.startswith(prefix))


def relevant(events: DataFrame, cfg: JobConfig) -> DataFrame:
    """Events a run acts on: not in a managed directory, hidden or ignored. Stateless."""
    path = F.col("path")
    keep = ~in_managed_directory(path, cfg.directory_prefix) & ~matches_any(
        path, cfg.ignore_patterns, cfg.recursive_globs
    )
    if cfg.ignore_hidden:
        keep = keep & ~paths.is_hidden(path)
    return events.where(keep)


def stable_sessions(events: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Bursts of events per path that were followed by a quiet ``gap``: the file is complete.

    Works on streams (a burst comes out once the watermark has passed it) and on tables. A stream loses events that
    come more than ``delay`` after a later one. Started within `stream_settings`, events of one path are merged to
    bursts before the shuffle, so a busy path does not fill one task.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("path", F.session_window("ts", gap).alias("burst"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min(F.struct("ts", "event_id", "size_bytes")).alias("_first"),
            F.max(F.struct("ts", "event_id", "size_bytes")).alias("_last"),
        )
        .select(
            "path", F.col("_first.ts").alias("first_ts"), F.col("_last.ts").alias("last_ts"), "n_events",
            F.col("_first.size_bytes").alias("first_size"), F.col("_last.size_bytes").alias("last_size"),
        )
    )


def first_seen(events: DataFrame, expiry: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Events that lead to work: every created event, and a modified one when its path was not seen before.

    State holds a path's last time and nothing else of its events, in one row per bucket of paths. With ``expiry`` (in event time, like ``30 days``) a
    path that had no event for so long counts as new, and its state goes once the watermark has passed; without it the
    state grows with the paths. Events that come more than ``delay`` after a later one are lost.
    """
    return arrivals.first_seen(events, expiry, delay)


def settled_files(events: DataFrame, gap: str, expiry: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Files that are complete and lead to work: `stable_sessions` and `first_seen` as one stateful step.

    One row per burst that was followed by a quiet ``gap``, if it has a created event or its path had no earlier burst
    (within ``expiry``). Events of a path are merged to bursts before the shuffle.
    """
    return arrivals.settled_files(events, gap, expiry, delay)


def classified(
    events: DataFrame, root: str, rules: DataFrame, cfg: JobConfig, custom: Classifier | None = None
) -> DataFrame:
    """Destination of every event's file; stateless, the rules are the static side of the join.

    No duplicates are looked for here.
    """
    files = relevant(events, cfg)
    if "modified_time" not in files.columns:
        files = files.withColumn("modified_time", F.col("ts"))
    return (
        classify(files, rules, cfg, custom)
        .withColumn("destination", destination_of(root, cfg))
        .where(F.col("path") != F.col("destination"))
    )


def run_to_end(
    stream: DataFrame, label: str, mode: str = "append", before_write: Callable | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Processes what is there, stops and returns the output as a table; ``progress`` gets a row per batch."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, label), new_folder(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        if before_write:
            before_write(batch, batch_id)
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with stream_settings(spark):
        query = (
            stream.writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    if progress is not None:
        progress += [
            {"batch": p["batchId"], "rows": p["numInputRows"], "state_rows": sum(o["numRowsTotal"] for o in p["stateOperators"]),
             "late": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])}
            for p in query.recentProgress
        ]
    return spark.read.schema(stream.schema).parquet(out)


class Watcher:
    """A running job that organizes files as they arrive.

    Only files count that lie outside managed directories and are not hidden or ignored; of these a file is organized
    when no event came for ``watch_settle`` seconds, and again after a new created event. Events that come more than
    ``watch_delay`` seconds after a later one are lost; those of a landing directory never do. Every batch writes the layout and the log under its own batch number and overwrites both on a
    replay, so a restart repeats nothing. ``on_batch(rows, batch_id)`` is called after each batch.
    """

    def __init__(
        self,
        root: str,
        rules: DataFrame,
        cfg: JobConfig | None = None,
        custom: Classifier | None = None,
        on_batch: Callable[[DataFrame, int], None] | None = None,
    ) -> None:
        self.root = root
        self.rules = rules
        self.cfg = cfg or JobConfig()
        self.custom = custom
        self.on_batch = on_batch
        self.query: StreamingQuery | None = None

    def start(self, events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        if self.is_running:
            raise RuntimeError("already running")
        cfg = self.cfg
        files = settled_files(
            relevant(events, cfg), f"{cfg.watch_settle} seconds",
            f"{cfg.watch_memory_days} days" if cfg.watch_memory_days else None, f"{cfg.watch_delay} seconds",
        )
        placed = classified(files, self.root, self.rules, cfg, self.custom)
        if not cfg.watch_auto_organize:
            placed = placed.where(F.lit(False))
        trigger = {"availableNow": True} if once else {"processingTime": f"{cfg.watch_interval} seconds"}
        with stream_settings(events.sparkSession):
            self.query = (
                placed.writeStream.foreachBatch(lambda batch, n: self._write(batch, n, out))
                .outputMode("append")
                .option("checkpointLocation", checkpoint)
                .trigger(**trigger)
                .start()
            )
        return self.query

    def _write(self, batch: DataFrame, batch_id: int, out: str) -> None:
        batch = batch.persist()
        log = batch.select(
            F.lit("file").alias("kind"), F.lit(2).alias("phase"), F.col("path").alias("source"), "destination",
            F.lit("ok").alias("status"), F.current_timestamp().alias("ts"),
        )
        log.write.mode("overwrite").json(f"{out}/log/run_id={batch_id}")
        write_layout(batch, f"{out}/files/batch={batch_id}", mode="overwrite")
        if self.on_batch:
            self.on_batch(batch, batch_id)
        batch.unpersist()

    def read_log(self, spark: SparkSession, out: str) -> DataFrame:
        return spark.read.schema(LOG_DDL).json(f"{out}/log")

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    @property
    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive
