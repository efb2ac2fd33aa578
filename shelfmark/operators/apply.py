"""Applying and undoing operations on inventory snapshots.

Nothing is moved in place: a new inventory is derived, and all names of the old one count as
taken for the whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths


MOVED = ("ok", "mismatch", "overwritten")


def winners(resolved: DataFrame, inventory: DataFrame, how: str) -> DataFrame:
    """Who gets the destinations that several operations want, now that some sources may be gone: ``final_destination,
    winner, occupied``.

    The first (``skip``) or last (``overwrite``) operation whose source is there; none where all are gone. One
    aggregate, over the contested destinations only.
    """
    contested = resolved.where(F.col("status").isin("overwritten", "skipped")).select("final_destination").distinct()
    present = inventory.select(F.col("path").alias("source"), F.lit(True).alias("_present"))
    rivals = resolved.join(contested, "final_destination", "left_semi").join(present, "source", "left")
    place = F.when(F.col("_present"), F.struct("phase", "source"))
    first_or_last = F.max(place) if how == "overwrite" else F.min(place)
    return rivals.groupBy("final_destination").agg(
        first_or_last["source"].alias("winner"), F.max(F.col("status") == "failed").alias("occupied")
    )


def matched(resolved: DataFrame, inventory: DataFrame, how: str = "rename") -> DataFrame:
    """Every row of the inventory with the operation on it: ``row`` and ``op`` (structs, one may be null), and how the
    operation ended: ``status, error``.

    One join gives the results as well as the new inventory; both are projections of it.
    """
    rows = inventory.select(F.struct(*inventory.columns).alias("row"))
    ops = resolved.select(F.struct(*resolved.columns).alias("op"))
    both = rows.join(ops, F.col("row.path") == F.col("op.source"), "full")
    gone = F.col("row").isNull()
    missing = F.concat(F.lit("Source file does not exist: "), F.col("op.source"))
    planned = F.col("op.status")
    if how not in ("skip", "overwrite"):
        failed = gone & (planned != "skipped")
        return both.select(
            "row", "op", F.when(failed, "failed").when(planned == "planned", "ok").otherwise(planned).alias("status"),
            F.when(failed, missing).otherwise(F.col("op.error")).alias("error"),
        )
    place = winners(resolved, inventory, how).withColumnRenamed("final_destination", "_place")
    both = both.join(place, F.col("op.final_destination") == F.col("_place"), "left")
    contested, won = F.col("_place").isNotNull(), F.col("winner") == F.col("op.source")
    blocked = contested & won & F.coalesce("occupied", F.lit(False)) if how == "skip" else F.lit(False)
    exists = F.concat(F.lit("Destination exists and strategy is SKIP: "), F.col("op.final_destination"))
    status = (
        F.when(F.col("op").isNull(), F.lit(None).cast("string")).when(gone | blocked, "failed")
        .when(contested & won, "ok").when(contested, "skipped" if how == "skip" else "overwritten")
        .when(planned == "planned", "ok").otherwise(planned)
    )
    error = (
        F.when(F.col("op").isNull(), F.lit(None).cast("string")).when(gone, missing).when(blocked, exists)
        .when(~contested, F.col("op.error"))
    )
    return both.select("row", "op", status.alias("status"), error.alias("error"))


def results_of(pairs: DataFrame) -> DataFrame:
    """The operations of `matched` with their outcome."""
    names = [f.name for f in pairs.schema["op"].dataType.fields if f.name not in ("status", "error")]
    return pairs.where(F.col("op").isNotNull()).select(*[F.col(f"op.{n}").alias(n) for n in names], "status", "error")


def inventory_of(pairs: DataFrame, replaces: bool = True) -> DataFrame:
    """The inventory after the operations of `matched`.

    ``replaces=False`` promises that no operation overwrites anything and saves a join. A row that an operation replaced
    disappears: it was moved and then overwritten, or it lay at the destination and did not move itself.
    """
    names = [f.name for f in pairs.schema["row"].dataType.fields]
    moved = F.coalesce(F.col("status").isin(*MOVED), F.lit(False))
    now = F.when(moved, F.col("op.final_destination")).otherwise(F.col("row.path"))
    kept = pairs.where(F.col("row").isNotNull() & ~F.coalesce(F.col("status") == "overwritten", F.lit(False)))
    columns = [now.alias("path") if n == "path" else F.col(f"row.{n}").alias(n) for n in names]
    if not replaces:
        return kept.select(columns)
    targets = pairs.where(F.col("status").isin("ok", "mismatch")).select(
        F.col("op.final_destination").alias("_target"), F.lit(True).alias("_hit"))
    return kept.withColumn("_stays", F.when(~moved, F.col("row.path"))).join(
        targets, F.col("_stays") == F.col("_target"), "left_anti").select(columns)


def operation_results(resolved: DataFrame, inventory: DataFrame, how: str = "rename") -> DataFrame:
    """Resolved operations with ``status`` ok/failed/skipped/overwritten and ``error``."""
    return results_of(matched(resolved, inventory, how))


def directories_created(results: DataFrame) -> DataFrame:
    """Folders of all operations whose source was there, new or not."""
    tried = results.where(
        (F.col("status") != "skipped")
        & ~F.coalesce(F.startswith(F.col("error"), F.lit("Source file")), F.lit(False))
    )
    return tried.select(paths.parent(F.col("final_destination")).alias("path")).distinct()


def known_directories(inventory: DataFrame, root: str) -> DataFrame:
    """Every directory between root and a file, each once."""
    direct = inventory.where(paths.under(F.col("path"), root)).select(
        paths.parent(F.col("path")).alias("dir")
    ).distinct()
    leaf = F.concat(F.col("dir"), F.lit("/_"))
    return direct.select(F.explode(paths.ancestors(leaf, root)).alias("path")).distinct()


def child_directories(inventory: DataFrame, folder: str) -> DataFrame:
    """The directories directly below ``folder`` that hold a file at any depth."""
    rest = paths.relative(F.col("path"), folder)
    return (
        inventory.where(paths.under(F.col("path"), folder) & F.contains(rest, F.lit("/")))
        .select(paths.joined(folder, F.substring_index(rest, "/", 1)).alias("path"))
        .distinct()
    )


def _head(path: Column, root: str, segments: int) -> Column:
    """Root and the first segments below it, when there is something below those."""
    rest = F.split(paths.relative(path, root), "/")
    return F.when(
        F.size(rest) > segments, F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(rest, 1, segments), "/"))
    )


def _move_prefix(inventory: DataFrame, moves: DataFrame, root: str, segments: int) -> DataFrame:
    """Rewrites the prefix ``old`` of all paths below it to ``new``; ``old`` has the given
    number of segments below root."""
    rest = F.substr(F.col("path"), F.length("old") + 1)
    return (
        inventory.withColumn("_head", _head(F.col("path"), root, segments))
        .join(moves, F.col("_head") == F.col("old"), "left")
        .withColumn("path", F.when(F.col("new").isNotNull(), F.concat(F.col("new"), rest)).otherwise(F.col("path")))
        .select(*inventory.columns)
    )


def apply_directories(inventory: DataFrame, dir_results: DataFrame, root: str) -> DataFrame:
    moves = dir_results.where(F.col("status") == "ok").select(
        F.col("source").alias("old"), F.col("final_destination").alias("new")
    )
    return _move_prefix(inventory, moves, root, 1)


def empty_directories(
    before: DataFrame, after: DataFrame, root: str, prefix: str, directories: DataFrame | None = None
) -> DataFrame:
    """Managed directories that hold nothing any more.

    A directory goes when no remaining file and no directory that must stay lies below it, which
    is one anti join instead of a walk from the leaves up. ``directories`` adds paths a file
    listing cannot know.
    """
    known = known_directories(before, root)
    if directories is not None:
        known = known.union(directories.select("path")).distinct()
    known = known.where(paths.under(F.col("path"), root))
    rest = F.split(paths.relative(F.col("path"), root), "/")
    managed = F.when(F.size(rest) == 1, F.startswith(rest[0], F.lit(prefix))).otherwise(
        F.exists(F.slice(rest, F.lit(1), F.size(rest) - 1), lambda s: F.startswith(s, F.lit(prefix)))
    )
    removable = managed & ~paths.is_hidden(F.col("path"))
    staying = known.where(~removable).select(F.explode(paths.ancestors(F.col("path"), root)).alias("path"))
    full = known_directories(after, root).union(staying).distinct()
    return known.where(removable).join(full, "path", "left_anti").select("path")


def undo(inventory: DataFrame, log: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Reverts one run: (inventory, log rows with ``undo_status`` ok/failed).

    Directories moved last, so they go back first. All rows of a run restore independently, which
    makes the reverse order of the log a matter of these two steps.
    """
    file_log = log.where(F.col("kind") == "file")
    dir_log = log.where(F.col("kind") == "directory")
    back = dir_log.select(F.col("destination").alias("old"), F.col("source").alias("new"))
    folders = known_directories(inventory, root).select(F.col("path").alias("destination"))
    dir_status = dir_log.join(folders.withColumn("_found", F.lit(True)), "destination", "left")
    inventory = _move_prefix(inventory, back, root, 2)

    moves = file_log.select(F.col("destination").alias("path"), F.col("source").alias("_back"))
    files = inventory.select(F.col("path").alias("destination"), F.lit(True).alias("_found"))
    file_status = file_log.join(files, "destination", "left")
    restored = (
        inventory.join(moves, "path", "left")
        .withColumn("path", F.coalesce("_back", "path"))
        .select(*inventory.columns)
    )
    status = F.when(F.col("_found").isNotNull(), "ok").otherwise("failed")
    outcome = dir_status.unionByName(file_status).withColumn("undo_status", status).drop("_found")
    return restored, outcome


def undo_counts(outcome: DataFrame) -> DataFrame:
    return outcome.agg(
        F.count_if(F.col("undo_status") == "ok").alias("successful"),
        F.count_if(F.col("undo_status") == "failed").alias("failed"),
    )


def result_metrics(results: DataFrame) -> DataFrame:
    """One row about the file operations; directory failures do not count."""
    files = results.where(F.col("kind") == "file")
    counts = files.agg(
        F.count_if(F.col("status").isin("ok", "overwritten")).alias("files_moved"),
        F.count_if(F.col("status").isin("failed", "mismatch")).alias("files_failed"),
    )
    total = F.col("files_moved") + F.col("files_failed")
    return counts.withColumn(
        "success_rate",
        F.when(total == 0, F.lit(100.0)).otherwise(F.col("files_moved") / total * 100),
    ).withColumn("complete_success", F.col("files_failed") == 0)
