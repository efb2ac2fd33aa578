"""Exact duplicates by content hash.

All steps work on one row per hash that is built with partial aggregation; members of a set are
only ever reached by a join, so one hash may own any share of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.totals import exact_sum


def preferred(*more: str) -> Column:
    """Aggregate: the preferred file as a struct with the columns ``path, modified_time`` and
    ``more``: the shortest path, then the oldest file, then path order."""
    rest = [F.col(c) for c in more]
    return F.min(
        F.struct(F.length("path").alias("_len"), F.col("modified_time"), F.col("path"), *rest)
    )


def content_key(files: DataFrame) -> Column:
    """What tells contents apart: the ``content_key`` of a scan, which files that were never read have too, or the hash."""
    return F.coalesce("content_key", "hash") if "content_key" in files.columns else F.col("hash")


def by_content(files: DataFrame, carry: tuple[str, ...] = ("size_bytes", "is_symlink")) -> DataFrame:
    """One row per content: ``hash, cnt`` and the preferred file with its ``carry`` columns.

    The hash is null for a file of unique size that a scan did not read.
    """
    kept = ("path", "modified_time", *carry)
    return (
        files.groupBy(content_key(files).alias("_key"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("hash").alias("hash"), preferred(*carry).alias("_first"))
        .select("hash", "cnt", *[f"_first.{c}" for c in kept])
    )


def unique_files(contents: DataFrame) -> DataFrame:
    return contents.where("cnt = 1").drop("cnt")


def duplicate_sets(contents: DataFrame) -> DataFrame:
    return contents.where("cnt > 1").select(
        "hash", "cnt", "size_bytes", F.col("path").alias("primary"),
        (F.col("size_bytes") * (F.col("cnt") - 1)).alias("space_wasted"),
    )


def set_members(files: DataFrame, sets: DataFrame) -> DataFrame:
    """All files of duplicate sets with the primary of their set. The large side is split by
    the adaptive skew join when one hash dominates."""
    return files.join(sets.select("hash", "primary"), "hash").withColumn(
        "is_primary", F.col("path") == F.col("primary")
    )


def extras(files: DataFrame, sets: DataFrame) -> DataFrame:
    return set_members(files, sets).where(~F.col("is_primary")).drop("is_primary")


def waste(sets: DataFrame) -> DataFrame:
    """Sets, extra copies and the bytes these take; the bytes are a decimal, which no number of files overflows."""
    return sets.agg(
        F.count(F.lit(1)).alias("sets"),
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("total_duplicates"),
        F.coalesce(exact_sum("space_wasted"), F.lit(0)).alias("space_recoverable"),
    )


def waste_struct(sets: DataFrame) -> Column:
    """The figures of `waste` as one scalar struct, computed once."""
    return waste(sets).select(F.struct("sets", "total_duplicates", "space_recoverable")).scalar()


def totals(files: DataFrame) -> DataFrame:
    """Files and their bytes, these as a decimal."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(exact_sum("size_bytes"), F.lit(0)).alias("total_size"),
    )


def _status(planned: Column, actual: Column) -> Column:
    return (
        F.when(actual.isNull(), F.lit("missing"))
        .when(planned == actual, F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def verify_planned(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Every planned ``path, hash`` against a fresh reading: ok, mismatch or missing."""
    found = actual.select("path", F.col("hash").alias("actual_hash"))
    return planned.select("path", F.col("hash").alias("planned_hash")).join(found, "path", "left").select(
        "path", "planned_hash", "actual_hash", _status(F.col("planned_hash"), F.col("actual_hash")).alias("status"))


def verify_integrity(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """As `verify_planned`, and what was read but not planned as unplanned."""
    more = actual.join(planned.select("path"), "path", "left_anti").select(
        "path", F.lit(None).cast("string").alias("planned_hash"), F.col("hash").alias("actual_hash"),
        F.lit("unplanned").alias("status"))
    return verify_planned(planned, actual).unionByName(more)
