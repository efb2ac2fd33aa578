"""Operations of a run and the resolution of destination conflicts.

Schema of operations: ``kind, phase, source, destination, reason, conflict_resolution,
size_bytes, hash, is_symlink, category, subcategory``. Their order is (phase, source).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import REASON_CLASSIFY, REASON_DUPLICATE, REASON_FOLDER, JobConfig
from shelfmark.functions import paths
from shelfmark.operators import dedup, scope, similarity
from shelfmark.operators.classify import Classifier, classify, destination, duplicate_destination
from shelfmark.session import staged
from shelfmark.skew import HOT_ROWS, row_numbers, running_total

ORDER = ["phase", "source"]
PHASE_EXTRA, PHASE_UNIQUE, PHASE_PRIMARY, PHASE_DIRECTORY = 1, 2, 3, 4
OP_COLUMNS = (
    "kind", "phase", "source", "destination", "reason", "conflict_resolution",
    "size_bytes", "hash", "is_symlink", "category", "subcategory",
)


@dataclass(frozen=True)
class Plan:
    """Lazy tables of one run."""

    root: str
    cfg: JobConfig
    inventory: DataFrame
    files: DataFrame
    sets: DataFrame | None
    ops: DataFrame
    dir_ops: DataFrame
    errors: DataFrame
    similar: DataFrame | None = None
    resolved: DataFrame | None = None
    skipped: DataFrame | None = None

    def with_(self, **changes) -> Plan:
        return replace(self, **changes)


def _ops(
    rows: DataFrame, phase: int | Column, target: Column, reason: str, cfg: JobConfig
) -> DataFrame:
    """Rows as operations; a row that is already in its place gives none."""
    phase = F.lit(phase) if isinstance(phase, int) else phase
    return (
        rows.select(
            F.lit("file").alias("kind"), phase.cast("int").alias("phase"), F.col("path").alias("source"),
            target.alias("destination"), F.lit(reason).alias("reason"),
            F.lit(cfg.conflict_resolution).alias("conflict_resolution"), "size_bytes", "hash", "is_symlink",
            *[F.lit(None).cast("string").alias(c) if reason == REASON_DUPLICATE else F.col(c)
              for c in ("category", "subcategory")],
        ).where(F.col("source") != F.col("destination"))
    )


def duplicate_ops(extras: DataFrame, root: str, cfg: JobConfig) -> DataFrame:
    ops = _ops(extras, PHASE_EXTRA, duplicate_destination(root, cfg), REASON_DUPLICATE, cfg)
    return ops if cfg.isolate_duplicates else ops.where(F.lit(False))


def classify_ops(rows: DataFrame, phase: int | Column, root: str, cfg: JobConfig) -> DataFrame:
    return _ops(rows, phase, destination(root, cfg), REASON_CLASSIFY, cfg)


def directory_ops(directories: DataFrame, root: str, cfg: JobConfig) -> DataFrame:
    """Every unmanaged root directory moves into the folders directory."""
    name = paths.base_name(F.col("path"))
    home = root.rstrip("/") + "/" + cfg.managed_name(cfg.folders_folder)
    return directories.where(
        ~name.startswith(cfg.directory_prefix)
        & (name != cfg.log_directory)
        & (paths.parent(F.col("path")) != home)
    ).select(
        F.lit("directory").alias("kind"), F.lit(PHASE_DIRECTORY).alias("phase"), F.col("path").alias("source"),
        paths.joined(home, name).alias("destination"), F.lit(REASON_FOLDER).alias("reason"),
        F.lit(cfg.conflict_resolution).alias("conflict_resolution"),
        F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("hash"),
        F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("subcategory"),
    )


def build_plan(
    inventory: DataFrame,
    root: str,
    cfg: JobConfig,
    rules: DataFrame,
    custom: Classifier | None = None,
) -> Plan:
    """Scope, classification, duplicates and operations of an inventory.

    Files are classified before they are grouped by content: classification is narrow, and
    afterwards neither contents nor tags travel through a shuffle.
    """
    scoped = scope.with_scope(inventory, root, cfg)
    inside = scope.files_in_scope(scoped)
    columns = ["path", "size_bytes", "hash", "modified_time", "is_symlink"]
    if cfg.perceptual_dedup:
        columns.append("sketch")
    if "content_key" in inventory.columns:
        columns.append("content_key")
    readable = dedup.content_key(inventory).isNotNull()
    failed = (F.col("scope") == scope.FILE) & ~readable
    message = F.lit("unreadable")
    if "error" in inventory.columns:
        readable &= F.col("error").isNull()
        failed = F.col("error").isNotNull() | failed
        message = F.coalesce("error", message)
    errors = scoped.where(failed).select("path", message.alias("message"))
    files = inside.where(readable).select(*columns)
    placed = classify(inside.where(readable), rules, cfg, custom).select(*columns, "category", "subcategory")

    sets = similar = None
    if cfg.detect_duplicates:
        contents = dedup.by_content(placed, ("size_bytes", "is_symlink", "category", "subcategory"))
        sets = dedup.duplicate_sets(contents)
        extra_ops = duplicate_ops(dedup.extras(files, sets), root, cfg)
        if cfg.perceptual_dedup:
            similar = similarity.similar_members(
                files.where(paths.extension(F.col("path")).isin(*similarity.SKETCH_EXTENSIONS)),
                cfg.perceptual_threshold,
            )
            more = similar.where(~F.col("is_primary"))
            # An exact copy keeps its exact set; a similar extra is not classified as well.
            contents = contents.join(more.select("path"), "path", "left_anti")
            more_ops = duplicate_ops(more, root, cfg).join(
                extra_ops.select("source"), "source", "left_anti"
            )
            extra_ops = extra_ops.unionByName(more_ops)
        phase = F.when(F.col("cnt") == 1, F.lit(PHASE_UNIQUE)).otherwise(F.lit(PHASE_PRIMARY))
        ops = extra_ops.unionByName(classify_ops(contents, phase, root, cfg))
    elif cfg.compat_skip_copies:
        contents = dedup.by_content(placed, ("size_bytes", "is_symlink", "category", "subcategory"))
        ops = classify_ops(dedup.unique_files(contents), PHASE_UNIQUE, root, cfg)
    else:
        ops = classify_ops(placed, PHASE_UNIQUE, root, cfg)

    dir_ops = directory_ops(scope.directories_in_scope(scoped, root), root, cfg)
    return Plan(root, cfg, inventory, files, sets, ops, dir_ops, errors, similar)


# --- conflicts --------------------------------------------------------------------------------


def destination_conflicts(ops: DataFrame, existing: DataFrame) -> DataFrame:
    """Destinations wanted by several operations or already in the inventory, with the first
    and the last operation on each. One aggregate and one join, no window."""
    order = F.struct("phase", "source")
    wanted = ops.groupBy("destination").agg(
        F.count(F.lit(1)).alias("n_ops"),
        F.min(order)["source"].alias("first_source"),
        F.max(order)["source"].alias("last_source"),
    )
    return _crowded(wanted, existing)


def _crowded(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    taken = existing.select(F.col("path").alias("destination"), F.lit(True).alias("occupied"))
    return (
        wanted.join(taken, "destination", "left")
        .withColumn("occupied", F.coalesce("occupied", F.lit(False)))
        .where((F.col("n_ops") > 1) | F.col("occupied"))
    )


def resolve(ops: DataFrame, existing: DataFrame, how: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``final_destination, status, error``.

    ``status`` is ``planned``, ``skipped`` (a later operation on one destination), ``failed``
    (destination exists) or ``overwritten`` (moved, then replaced by a later operation).
    """
    if how == "skip":
        return resolve_skip(ops, existing)
    if how == "overwrite":
        return resolve_overwrite(ops, existing)
    return resolve_rename(ops, existing, hot_rows)


def _outcome(ops: DataFrame, final: Column, status: Column, error: Column | None = None) -> DataFrame:
    error = F.lit(None).cast("string") if error is None else error
    return ops.select(
        *OP_COLUMNS, final.alias("final_destination"), status.alias("status"), error.alias("error")
    )


def resolve_skip(ops: DataFrame, existing: DataFrame) -> DataFrame:
    tagged = ops.join(destination_conflicts(ops, existing), "destination", "left")
    later = F.col("n_ops").isNotNull() & (F.col("source") != F.col("first_source"))
    blocked = F.coalesce("occupied", F.lit(False))
    status = F.when(later, "skipped").when(blocked, "failed").otherwise("planned")
    message = F.concat(F.lit("Destination exists and strategy is SKIP: "), F.col("destination"))
    return _outcome(tagged, F.col("destination"), status, F.when(~later & blocked, message))


def resolve_overwrite(ops: DataFrame, existing: DataFrame) -> DataFrame:
    tagged = ops.join(destination_conflicts(ops, existing), "destination", "left")
    replaced = F.col("n_ops").isNotNull() & (F.col("source") != F.col("last_source"))
    return _outcome(tagged, F.col("destination"), F.when(replaced, "overwritten").otherwise("planned"))


def resolve_rename(ops: DataFrame, existing: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first operation on a free name keeps it; the others get ``stem_N.suffix`` with the
    smallest numbers that neither the inventory nor the plan uses, in operation order.

    The crowded destinations are written once: their number and the size of the largest decide
    how the rest of the plan looks.
    """
    wanted = ops.groupBy("destination").agg(F.count(F.lit(1)).alias("n_ops"))
    crowded = staged(_crowded(wanted, existing).select("destination", "n_ops", "occupied"), "crowded")
    dotted = F.col("destination").endswith(".")
    facts = crowded.agg(
        F.max("n_ops").alias("largest"), F.count_if(dotted).alias("dotted")
    ).first()
    if facts["largest"] is None:
        return _outcome(ops, F.col("destination"), F.lit("planned"))

    alone = _outcome(ops.join(crowded, "destination", "left_anti"), F.col("destination"), F.lit("planned"))
    contested = row_numbers(
        ops.join(crowded, "destination"), ["destination"], ORDER, "_k", hot_rows, facts["largest"] > hot_rows
    ).withColumn("_r", F.col("_k") - F.when(F.col("occupied"), F.lit(0)).otherwise(F.lit(1)))

    names = existing.select("path").union(ops.select("destination"))
    # A name may be a numbered form of two others only when one of these ends in a dot, so those
    # are numbered last, with all other results taken.
    if not facts["dotted"]:
        return alone.unionByName(_numbered(contested, crowded, names, hot_rows))
    plain = staged(
        _numbered(contested.where(~dotted), crowded.where(~dotted), names, hot_rows), "numbered"
    )
    names = names.union(plain.select("final_destination"))
    odd = _numbered(contested.where(dotted), crowded.where(dotted), names, hot_rows, with_dotted=True)
    return alone.unionByName(plain).unionByName(odd)


def _numbered(
    contested: DataFrame, crowded: DataFrame, names: DataFrame, hot_rows: int, with_dotted: bool = False
) -> DataFrame:
    """Turns the rank ``_r`` among the operations that need a number into the number itself.

    With the taken numbers t_1 < t_2 < …, the r-th free number is r plus the count of those i
    with t_i - i < r: a running count over operations and taken numbers together.
    """
    taken = staged(
        _numbers_in_use(names, with_dotted)
        .join(crowded.select("destination"), "destination", "left_semi")
        .distinct(),
        "taken",
    )
    dest = F.col("destination")

    def outcome(rows: DataFrame, number: Column) -> DataFrame:
        renamed = F.concat(paths.without_suffix(dest), F.lit("_"), number.cast("string"), paths.suffix(dest))
        return _outcome(rows, F.when(F.col("_r") == 0, dest).otherwise(renamed), F.lit("planned"))

    if taken.isEmpty():
        return outcome(contested, F.col("_r"))
    marks = row_numbers(taken, ["destination"], ["number"], "_i", hot_rows).select(
        "destination", (F.col("number") - F.col("_i")).alias("_pos"), F.lit(1).alias("_mark"),
        F.col("number").cast("string").alias("_tie"),
    )
    points = contested.select(
        "*", F.col("_r").alias("_pos"), F.lit(0).alias("_mark"), F.col("source").alias("_tie")
    ).unionByName(marks, allowMissingColumns=True)
    counted = running_total(
        points, ["destination"], ["_pos", "_mark", "_tie"], F.col("_mark").cast("bigint"), "_before", hot_rows
    ).where("_mark = 0")
    return outcome(counted, F.col("_r") + F.col("_before"))


def _numbers_in_use(names: DataFrame, with_dotted: bool) -> DataFrame:
    """All (destination, number) whose numbered form is one of the names."""
    p = F.col("path")

    def forms(destination: Column, number: str) -> DataFrame:
        return names.where(p.rlike(number)).select(
            destination.alias("destination"), F.regexp_extract(p, number, 1).cast("bigint").alias("number")
        )

    usual = forms(
        F.regexp_replace(p, r"(?<=[^/])_[1-9][0-9]{0,17}((?<=[^/])\.[^./]+)?$", "$1"),
        r"[^/]_([1-9][0-9]{0,17})(?:\.[^./]+)?$",
    )
    if not with_dotted:
        return usual
    return usual.union(
        forms(F.regexp_replace(p, r"_[1-9][0-9]{0,17}$", ""), r"[^/]\._([1-9][0-9]{0,17})$")
    )


# --- figures ----------------------------------------------------------------------------------


def categories_used(ops: DataFrame, root: str) -> DataFrame:
    """Names of the destination folders that do not lie at the root itself."""
    folder = paths.parent(F.col("destination"))
    return (
        ops.where(folder != root.rstrip("/")).select(paths.base_name(folder).alias("category")).distinct()
    )


def plan_metrics(ops: DataFrame, sets: DataFrame, root: str) -> DataFrame:
    """One row: operations, extra copies, recoverable bytes, folders used."""
    used = categories_used(ops, root).agg(F.count(F.lit(1)))
    return (
        ops.agg(F.count(F.lit(1)).alias("total_files"))
        .withColumn("copies", dedup.waste_struct(sets))
        .select(
            "total_files", F.col("copies.sets").alias("duplicate_sets"), "copies.total_duplicates",
            "copies.space_recoverable", used.scalar().alias("categories_used"),
        )
    )


def preview(ops: DataFrame, root: str, limit: int = 50) -> DataFrame:
    """The first operations in order, and how many there are in all."""
    total = ops.agg(F.count(F.lit(1))).scalar()
    return (
        ops.orderBy(*ORDER)
        .limit(limit)
        .select(
            "phase", "reason", "source", paths.relative(F.col("destination"), root).alias("target"),
            (total - F.lit(limit)).alias("more"),
        )
        .withColumn("more", F.greatest("more", F.lit(0)))
    )
