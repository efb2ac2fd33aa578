"""Column functions that format numbers for people; one decimal, ties to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def size_mb(size: Column) -> Column:
    return size / F.lit(1024.0**2)


def size_gb(size: Column) -> Column:
    return size / F.lit(1024.0**3)


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def format_size(size: Column) -> Column:
    """1024-step units from B to PB."""
    text = None
    for power, unit in enumerate(UNITS):
        shown = F.concat(one_decimal(size / F.lit(float(1024**power))), F.lit(" " + unit))
        below = size < F.lit(float(1024 ** (power + 1)))
        if unit == UNITS[-1]:
            return text.otherwise(shown)
        text = F.when(below, shown) if text is None else text.when(below, shown)


def format_duration(seconds: Column) -> Column:
    def whole(value: Column) -> Column:
        return F.floor(value).cast("string")

    return (
        F.when(seconds < 60, F.concat(one_decimal(seconds), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(whole(seconds / 60), F.lit("m "), whole(seconds % 60), F.lit("s")),
        )
        .otherwise(
            F.concat(whole(seconds / 3600), F.lit("h "), whole(seconds % 3600 / 60), F.lit("m"))
        )
    )
