"""Totals that are longer than a bigint."""

from shelfmark.functions.totals import as_bigint
from shelfmark.operators import dedup
from shelfmark.operators.rollup import directory_sizes

LARGE = 2**62


def large_files(inventory):
    return inventory(*[(f"/r/{'ab'[n % 2]}/f{n}", f"h{n % 2}", LARGE) for n in range(4)], ("/r/a/small", "s", 5))


def test_inventory_totals(spark, inventory):
    assert tuple(dedup.totals(large_files(inventory)).first()) == (5, 4 * LARGE + 5)


def test_duplicate_waste(spark, inventory):
    wasted = dedup.waste(dedup.duplicate_sets(dedup.by_content(large_files(inventory))))
    assert tuple(wasted.first()) == (2, 2, 2 * LARGE)


def test_directory_sizes(spark, inventory):
    got = {r.directory: (r.total_bytes, r.total_files) for r in directory_sizes(large_files(inventory), "/r").collect()}
    assert got == {"/r": (4 * LARGE + 5, 5), "/r/a": (2 * LARGE + 5, 3), "/r/b": (2 * LARGE, 2)}


def test_bigint_where_all_totals_fit(spark, inventory):
    small = as_bigint(dedup.totals(inventory(("/r/a", "x", 7), ("/r/b", "y", LARGE))), "total_size")
    assert dict(small.dtypes)["total_size"] == "bigint" and small.first().total_size == LARGE + 7
    large = as_bigint(dedup.totals(large_files(inventory)), "total_size")
    assert dict(large.dtypes)["total_size"].startswith("decimal") and large.first().total_size == 4 * LARGE + 5
    edge = as_bigint(dedup.totals(inventory(("/r/a", "x", LARGE), ("/r/b", "y", LARGE - 1))), "total_size")
    assert edge.dtypes[1] == ("total_size", "bigint") and edge.first().total_size == 2**63 - 1
