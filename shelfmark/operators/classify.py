"""Category and destination of every file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import JobConfig
from shelfmark.functions import paths
from shelfmark.functions.formats import size_mb
from shelfmark.functions.metadata import tag_date
from shelfmark.sources.mime import sniffed_mime, with_mime_category
from shelfmark.sources.rules import FALLBACK, extension_lookup

# A user's own classifier: takes files, returns them with ``category`` and ``subcategory``.
Classifier = Callable[[DataFrame], DataFrame]

# Size classes in ascending order; the last one has no upper bound.
SIZE_CLASSES = (
    ("Small", "Under1MB"),
    ("Small", "1-10MB"),
    ("Medium", "10-100MB"),
    ("Medium", "100MB-1GB"),
    ("Large", "Over1GB"),
)


def by_extension(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule lookup on the extension. One lookup row per extension; Catalyst sees its size and
    broadcasts it while it is small."""
    lookup = extension_lookup(rules)
    return (
        files.withColumn("_ext", paths.extension(F.col("path")))
        .join(lookup, F.col("_ext") == F.col("rule_ext"), "left")
        .withColumn("category", F.coalesce("category", F.lit(FALLBACK[0])))
        .withColumn("subcategory", F.coalesce("subcategory", F.lit(FALLBACK[1])))
        .drop("_ext", "rule_ext")
    )


def by_content(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Detected MIME type first, the extension where nothing is detected.

    The type is the ``mime`` that a scan found in the head of each file, or is told from ``content``.
    """
    found = F.col("mime") if "mime" in files.columns else sniffed_mime(F.col("content"))
    detected = with_mime_category(files.withColumn("_mime", found), "_mime")
    detected = detected.withColumnsRenamed({"category": "_cat", "subcategory": "_sub"})
    return (
        by_extension(detected, rules)
        .withColumn("category", F.coalesce("_cat", "category"))
        .withColumn("subcategory", F.coalesce("_sub", "subcategory"))
        .drop("_cat", "_sub", "_mime")
    )


def by_date(files: DataFrame, use_metadata: bool = False) -> DataFrame:
    """Year and month-day of the tag date of an image if wanted, else of the modification time."""
    date = F.col("modified_time")
    if use_metadata:
        date = F.coalesce(tag_date(F.col("metadata"), paths.extension(F.col("path"))), date)
    return files.withColumn("category", F.date_format(date, "yyyy")).withColumn(
        "subcategory", F.date_format(date, "MM-dd")
    )


def by_size(files: DataFrame, bounds_mb: tuple[float, ...] = (1, 10, 100, 1000)) -> DataFrame:
    mb = size_mb(F.col("size_bytes"))

    def pick(part: int) -> Column:
        chosen = F.when(mb < bounds_mb[0], F.lit(SIZE_CLASSES[0][part]))
        for bound, names in zip(bounds_mb[1:], SIZE_CLASSES[1:], strict=False):
            chosen = chosen.when(mb < bound, F.lit(names[part]))
        return chosen.otherwise(F.lit(SIZE_CLASSES[-1][part]))

    return files.withColumn("category", pick(0)).withColumn("subcategory", pick(1))


def hybrid(files: DataFrame, rules: DataFrame, use_magic: bool = False) -> DataFrame:
    placed = by_content(files, rules) if use_magic else by_extension(files, rules)
    year = F.date_format("modified_time", "yyyy")
    return placed.withColumn("category", F.concat_ws("-", "category", year))


def classify(
    files: DataFrame, rules: DataFrame, cfg: JobConfig, custom: Classifier | None = None
) -> DataFrame:
    """The strategy is chosen on the driver, so the plan holds one branch only."""
    if custom is not None:
        return custom(files)
    if cfg.strategy == "by-date":
        return by_date(files, cfg.use_metadata)
    if cfg.strategy == "by-size":
        return by_size(files, cfg.size_bounds_mb)
    if cfg.strategy == "hybrid":
        return hybrid(files, rules, cfg.use_magic)
    return by_content(files, rules) if cfg.use_magic else by_extension(files, rules)


def destination(root: str, cfg: JobConfig) -> Column:
    """Where a classified file belongs."""
    folder = F.concat(F.lit(cfg.directory_prefix), F.col("category"))
    return paths.joined(root, folder, F.col("subcategory"), paths.base_name(F.col("path")))


def duplicate_destination(root: str, cfg: JobConfig) -> Column:
    """Where an extra copy belongs: its old relative path below the duplicates folder.

    A copy that is already below that folder stays where it is, unless ``compat_nested``.
    """
    folder = cfg.managed_name(cfg.duplicates_folder)
    rel = paths.relative(F.col("path"), root)
    if not cfg.compat_nested:
        inside = rel.startswith(folder + "/")
        rel = F.when(inside, F.substr(rel, F.lit(len(folder) + 2))).otherwise(rel)
    return paths.joined(root, F.lit(folder), rel)
