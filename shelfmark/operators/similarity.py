"""Similarity sets of 64-bit sketches within a Hamming threshold.

Semantics: in the order of their first file, every sketch that is not yet taken becomes a leader
and takes all later free sketches within the threshold.

Equal sketches are grouped first. Distinct sketches meet in buckets (equal bits in one of several
bands, by the pigeonhole principle at least one bucket for every pair within the threshold). A
crowded bucket is split by bands of the bits it has not used yet. No bucket ever lists its pairs:
each round compares its members with at most ``CAP`` of its earliest candidates, so a bucket may
hold any share of the data.
"""

from __future__ import annotations

from itertools import combinations, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.metadata import SKETCH_EXTENSIONS
from shelfmark.functions.sketch import hamming, sketch_hex
from shelfmark.operators.dedup import preferred
from shelfmark.session import literal_table, staged

__all__ = ["SKETCH_EXTENSIONS", "leaders_of", "similar_members", "similar_sets"]

BITS = 64
CAP = 64
MAX_SPLITS = 3
SCATTER = 37


def _signed(value: int) -> int:
    """The 64-bit pattern as a signed number."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _mask(positions: list[int]) -> int:
    return _signed(sum(1 << p for p in positions))


def _bands(positions: list[int], number: int) -> list[list[int]]:
    """``positions`` dealt out to ``number`` bands in a scattered order, so that every band gets
    its share of the bits that differ when whole regions of the sketches are equal."""
    scattered = sorted(positions, key=lambda p: p * SCATTER % BITS)
    return [scattered[i::number] for i in range(number)]


def _first_level(threshold: int) -> tuple[list[list[int]], int]:
    """Bands of the whole sketch and how many bits of a band may differ."""
    number = threshold + 1 if threshold <= 5 else max(4, threshold // 3 + 1)
    bands = _bands(list(range(BITS)), min(number, BITS))
    return bands, threshold // len(bands)


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _bucket_rows(nodes: DataFrame, threshold: int) -> DataFrame:
    """``bucket, used, home, sketch, rank``: a sketch is at home in the bucket of its own bits
    and visits those of nearby bits; it is compared with the members at home."""
    bands, radius = _first_level(threshold)
    entries = []
    for number, positions in enumerate(bands):
        part = F.col("sketch").bitwiseAND(F.lit(_mask(positions)))
        flips = [m for size in range(radius + 1) for m in combinations(positions, size)]
        entries += [
            F.struct(
                _bucket(F.lit(number), part.bitwiseXOR(F.lit(_mask(list(flip))))).alias("bucket"),
                F.lit(_mask(positions)).alias("used"),
                F.lit(not flip).alias("home"),
            )
            for flip in flips
        ]
    return nodes.select(F.explode(F.array(*entries)).alias("e"), "sketch", "rank").select(
        "e.bucket", "e.used", "e.home", "sketch", "rank"
    )


def _pieces(masks: list[int], parts: int) -> dict[int, list[int]]:
    """For every set of used bits: masks of ``parts`` bands over the remaining bits."""
    pieces = {}
    for used in masks:
        rest = [p for p in range(BITS) if not used >> p & 1]
        if len(rest) >= parts:
            pieces[used] = [_mask(band) for band in _bands(rest, parts)]
    return pieces


def _split(rows: DataFrame, pieces: dict[int, list[int]]) -> DataFrame:
    """Each row of a crowded bucket goes to threshold + 1 smaller ones: two sketches of the
    bucket that are within the threshold agree in at least one band of the remaining bits."""
    table = literal_table(
        rows.sparkSession,
        [dict(used=used, i=i, m=m) for used, ms in pieces.items() for i, m in enumerate(ms)],
        "used bigint, i int, m bigint",
    )
    return rows.join(table, "used").select(
        _bucket(F.col("bucket"), F.col("i"), F.col("sketch").bitwiseAND(F.col("m"))).alias("bucket"),
        F.col("used").bitwiseOR(F.col("m")).alias("used"), "home", "sketch", "rank",
    )


def _buckets(nodes: DataFrame, threshold: int, splits: int) -> DataFrame:
    """Rows of all buckets in which somebody can meet somebody else, after at most ``splits``
    divisions of the crowded ones."""
    rows = staged(_bucket_rows(nodes, threshold), "buckets")
    masks = [_mask(band) for band in _first_level(threshold)[0]]
    done = None
    for level in range(splits + 1):
        pieces = _pieces(masks, threshold + 1) if level < splits else {}
        sizes = (
            rows.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home")).alias("n_home"))
            .where("n > 1 and n_home > 0")
        )
        tagged = rows.join(sizes, "bucket")
        splittable = (F.col("n_home") > CAP) & F.col("used").isin(*pieces) if pieces else F.lit(False)
        calm = tagged.where(~splittable).select("bucket", "home", "sketch", "rank")
        done = calm if done is None else done.unionByName(calm)
        crowded = tagged.where(splittable).select(*rows.columns)
        if not pieces or crowded.isEmpty():
            break
        rows = staged(_split(crowded, pieces), "buckets")
        masks = sorted({_signed(used | m) for used, ms in pieces.items() for m in ms})
    return done


def leaders_of(nodes: DataFrame, threshold: int) -> DataFrame:
    """``sketch, rank`` (unique) -> ``sketch, leader_sketch, leader_rank, distance`` for the
    sketches that were taken by a leader; all others are leaders themselves.

    States of a sketch in the rounds: free (``best`` is null), dominated (a leader is within the
    threshold but an earlier free sketch might still become one) and settled. In every round a
    free sketch without an earlier free neighbour becomes a leader, so the earliest one always
    does and the loop ends.
    """
    # Two rounds in undivided buckets find the leaders of dense clusters and settle their members;
    # only the rest is worth dividing.
    buckets = staged(_buckets(nodes, threshold, 0), "meetings")
    sizes = buckets.where("home").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    divide_after = None if sizes.where(F.col("n") > CAP).isEmpty() else 2
    near = F.struct("rank", "sketch")
    live = buckets.withColumn("best", F.lit(None).cast(buckets.select(near.alias("s")).schema["s"].dataType))
    taken = None
    for round_no in count(1):
        free = F.col("best").isNull()
        in_order = Window.partitionBy("bucket").orderBy("rank")
        lists = (
            live.where(free & F.col("home"))
            .withColumn("_i", F.row_number().over(in_order))
            .where(F.col("_i") <= CAP)
            .groupBy("bucket")
            .agg(F.sort_array(F.collect_list(near)).alias("first"))
        )
        limit = F.coalesce("best.rank", "rank")
        earlier = F.exists(
            "first",
            lambda c: (c["rank"] < limit)
            & (hamming(c["sketch"], F.col("sketch")) <= threshold),
        )
        beyond = (F.size("first") == CAP) & (F.element_at("first", -1)["rank"] < limit)
        state = (
            live.join(lists, "bucket", "left")
            .withColumn("_open", F.coalesce(earlier | beyond, F.lit(False)))
            .groupBy("sketch", "rank", "best")
            .agg(F.max("_open").alias("open"))
        )
        state = staged(state, "round")
        settled = state.where(~F.col("open") & ~free).select("sketch", "best")
        taken = settled if taken is None else taken.unionByName(settled)
        open_ = state.where("open")
        if open_.isEmpty():
            break
        chosen = state.where(~F.col("open") & free).select("sketch")
        leader_lists = (
            buckets.where("home")
            .join(chosen, "sketch", "left_semi")
            .groupBy("bucket")
            .agg(F.sort_array(F.collect_list(near)).alias("won"))
        )
        found = F.array_min(
            F.filter(
                "won",
                lambda c: (c["rank"] < F.col("rank"))
                & (hamming(c["sketch"], F.col("sketch")) <= threshold),
            )
        )
        still = buckets.join(open_.select("sketch", "best"), "sketch")
        found_best = (
            still.join(leader_lists, "bucket", "left")
            .groupBy("sketch")
            .agg(F.min(F.least(F.col("best"), found)).alias("best"))
        )
        if round_no == divide_after:
            found_best = staged(found_best, "best")
            buckets = staged(
                _buckets(nodes.join(found_best.select("sketch"), "sketch"), threshold, MAX_SPLITS), "meetings"
            )
            # Whoever meets nobody any more keeps the leader found so far.
            apart = found_best.where("best is not null").join(buckets.select("sketch"), "sketch", "left_anti")
            taken = taken.unionByName(apart)
        live = staged(buckets.join(found_best, "sketch"), "live")
    return taken.select(
        "sketch", F.col("best.sketch").alias("leader_sketch"), F.col("best.rank").alias("leader_rank"),
        hamming(F.col("sketch"), F.col("best.sketch")).alias("distance"),
    )


def sketch_nodes(files: DataFrame) -> DataFrame:
    """One row per distinct sketch: file count, first path and the preferred file."""
    return files.where(F.col("sketch").isNotNull()).groupBy("sketch").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("path").alias("rank"),
        F.min(F.struct("path", "size_bytes")).alias("_first"),
        preferred("size_bytes").alias("_best"),
    )


def _assigned(files: DataFrame, threshold: int) -> DataFrame:
    nodes = staged(sketch_nodes(files), "sketches")
    taken = leaders_of(nodes.select("sketch", "rank"), threshold)
    return nodes.join(taken, "sketch", "left").withColumn(
        "leader_sketch", F.coalesce("leader_sketch", "sketch")
    )


def _sets(assigned: DataFrame) -> DataFrame:
    return (
        assigned.groupBy("leader_sketch")
        .agg(
            F.sum("cnt").alias("cnt"),
            F.min("_best").alias("_best"),
            F.max(F.when(F.col("leader_rank").isNull(), F.col("_first"))).alias("_leader"),
        )
        .where("cnt > 1")
        .select(
            "leader_sketch",
            F.concat(F.lit("perceptual_"), sketch_hex(F.col("leader_sketch"))).alias("hash"),
            "cnt",
            F.col("_leader.size_bytes").alias("size_bytes"),
            F.col("_best.path").alias("primary"),
            (F.col("_leader.size_bytes") * (F.col("cnt") - 1)).alias("space_wasted"),
            F.col("_leader.path").alias("first_path"),
        )
    )


def similar_sets(files: DataFrame, threshold: int) -> DataFrame:
    """One row per set of more than one file: ``hash, cnt, size_bytes, primary, space_wasted,
    first_path``."""
    return _sets(_assigned(files, threshold)).drop("leader_sketch")


def similar_members(files: DataFrame, threshold: int) -> DataFrame:
    """Every file of a similarity set with the ``set_hash`` and ``primary`` of its set."""
    assigned = staged(_assigned(files, threshold), "assigned")
    sets = _sets(assigned).select("leader_sketch", F.col("hash").alias("set_hash"), "primary")
    home = assigned.select("sketch", "leader_sketch").join(sets, "leader_sketch").drop("leader_sketch")
    return files.join(home, "sketch").withColumn("is_primary", F.col("path") == F.col("primary"))


def similar_matches(files: DataFrame, threshold: int) -> DataFrame:
    """The comparisons that count: every taken sketch with its leader, by first path."""
    nodes = staged(sketch_nodes(files), "sketches")
    taken = leaders_of(nodes.select("sketch", "rank"), threshold)
    return taken.join(nodes.select("sketch", F.col("rank").alias("path")), "sketch").select(
        F.col("leader_rank").alias("leader_path"), "path", "distance"
    )
