"""Which files of an inventory a run looks at."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import JobConfig
from shelfmark.functions import paths
from shelfmark.functions.globs import matches_any

FILE = "file"
IGNORED = ("hidden", "pattern", "symlink")


def with_scope(inventory: DataFrame, root: str, cfg: JobConfig) -> DataFrame:
    """Adds ``top`` (first directory below root, or null) and ``scope``.

    ``scope`` is ``file`` (to be organized), ``hidden``/``pattern``/``symlink`` (ignored file),
    ``directory`` (below a root directory that moves as a whole), ``ignored_directory`` (below a
    root directory that is left alone) or ``outside``. One pass, no shuffle.
    """
    path = F.col("path")
    base = "^" + re.sub(r"([^\w/])", r"\\\1", root.rstrip("/")) + "/"
    prefix = re.sub(r"([^\w/])", r"\\\1", cfg.directory_prefix)
    top = F.regexp_extract(path, f"{base}([^/]+)/", 1)
    top_path = F.regexp_extract(path, f"({base}[^/]+)/", 1)

    def ignored(p: Column) -> Column:
        return matches_any(p, cfg.ignore_patterns, cfg.recursive_globs)

    scope = F.when(~paths.under(path, root), F.lit("outside"))
    if cfg.ignore_hidden:
        scope = scope.when(path.rlike(base + r"\.[^/]*/"), F.lit("ignored_directory"))
    scope = scope.when(ignored(top_path), F.lit("ignored_directory")).when(
        path.rlike(f"{base}(?!{prefix})[^/]+/"), F.lit("directory")
    )
    if cfg.ignore_hidden:
        scope = scope.when(path.rlike(r"/\.[^/]*$"), F.lit("hidden"))
    scope = scope.when(ignored(path), F.lit("pattern"))
    if not cfg.follow_symlinks:
        scope = scope.when(F.col("is_symlink"), F.lit("symlink"))
    return inventory.withColumn("top", F.nullif(top, F.lit(""))).withColumn("scope", scope.otherwise(F.lit(FILE)))


def files_in_scope(scoped: DataFrame) -> DataFrame:
    return scoped.where(F.col("scope") == FILE).drop("scope", "top")


def ignored_files(scoped: DataFrame) -> DataFrame:
    return scoped.where(F.col("scope").isin(*IGNORED)).withColumnRenamed("scope", "skip_reason").drop("top")


def directories_in_scope(scoped: DataFrame, root: str) -> DataFrame:
    return (
        scoped.where(F.col("scope") == "directory")
        .select(paths.joined(root, F.col("top")).alias("path"))
        .distinct()
    )
