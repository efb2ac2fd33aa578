"""Sums that do not overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import staged

EXACT = "decimal(28,0)"  # a bigint has 19 digits, and a sum may have 10 more


def exact_sum(column: str) -> Column:
    """Aggregate: the sum of a bigint column, or of such sums, as a decimal; null over no rows."""
    return F.sum(F.col(column).cast(EXACT))


def as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these decimals as bigint if all of their values are in its range, else as they are.

    ``df`` is computed once and written; only its size, not that of what it sums, matters.
    """
    kept = staged(df, "totals")
    fits = kept.agg(*[
        F.bool_and(F.col(c).between(F.lit(-(2**63)), F.lit(2**63 - 1))).alias(c) for c in columns
    ]).first().asDict()
    narrow = all(fits[c] is not False for c in columns)
    return kept.withColumns({c: F.col(c).cast("bigint") for c in columns}) if narrow else kept
