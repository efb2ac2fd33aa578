"""64-bit sketches of small grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_sketch(grid: Column) -> Column:
    """Bit i is set when cell i is above the mean of the 64 cells; null for any other size."""
    cells = F.transform(grid, lambda v: v.cast("double"))
    mean = F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v) / F.lit(64.0)
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def folded(m: Column) -> Column:
        bits = F.transform(
            cells, lambda v, i: F.when(v > m, F.call_function("shiftleft", one, i)).otherwise(none)
        )
        return F.aggregate(bits, none, lambda acc, b: acc.bitwiseOR(b))

    # The mean is bound to a variable, otherwise it would be taken again for every cell.
    return F.when(F.size(grid) == 64, F.transform(F.array(mean), folded)[0])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sketch_hex(sketch: Column) -> Column:
    return F.lpad(F.lower(F.hex(sketch)), 16, "0")
