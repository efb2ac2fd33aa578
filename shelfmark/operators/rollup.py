"""Directory totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.totals import exact_sum


def directory_sizes(files: DataFrame, root: str) -> DataFrame:
    """Bytes and files below every directory.

    Files are first summed per direct parent, so only one row per directory is expanded to its
    ancestors; the upper levels combine on the map side. ``total_bytes`` is a decimal: the bytes of all files
    can be more than a bigint holds.
    """
    direct = files.groupBy(paths.parent(F.col("path")).alias("_dir")).agg(
        exact_sum("size_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_files")
    )
    leaf = F.concat(F.col("_dir"), F.lit("/_"))
    return (
        direct.where(paths.under(leaf, root))
        .select(F.explode(paths.ancestors(leaf, root)).alias("directory"), "_bytes", "_files")
        .groupBy("directory")
        .agg(exact_sum("_bytes").alias("total_bytes"), F.sum("_files").alias("total_files"))
    )
