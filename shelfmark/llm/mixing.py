"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import running, staged

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
PASSES = 2  # a source is taken at most so many times
SEED = 7


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT,
            passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Weights go round the sources in code-point order, null last. A target stops at ``passes`` times its source's
    size; what is over is shared again by weight among the rest until none is above. All sources get the one
    water level that is left, so a round is one aggregate; rounds are those in which some source fills up.
    """
    ranked = running(sizes.withColumn("_one", F.lit(1)), [], [F.col("source").asc_nulls_last()], "_one", "sources")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = staged(ranked.select(
        "source", "source_size",
        F.element_at(weight, (F.col("_before") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * passes).cast("double").alias("most")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = total * percent / 100, 0.0, -1
    while True:
        filled = F.col("most") <= F.col("weight") * level
        taken, rest, now = ranked.agg(
            F.sum(F.when(filled, F.col("most"))), F.sum(F.when(~filled, F.col("weight"))),
            F.count_if(filled)).first()
        if now == full or not rest:
            break
        level, full = (budget - (taken or 0.0)) / rest, now
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def queue(sized: DataFrame, shared: DataFrame, percent: int = SHARE_PERCENT, passes: int = PASSES,
          seed: int = SEED) -> DataFrame:
    """The rows of ``sized`` (row, source, size) with how often each is taken.

    The documents of a source are shuffled by a hash. Each offer of a document, up to ``passes`` of them one round
    of the source after another, finishes at virtual time (words of its source so far) / target; offers are
    range-sorted by it over all sources, and those are taken whose words, summed up to them, stay within the budget.
    """
    placed = running(sized, ["source"], [F.xxhash64(F.lit(seed), "row"), F.col("row").asc()], "size", "shuffled")
    joined = placed.join(shared.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    offers = joined.where("size > 0").select(
        "row", "size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"),
        "source_size", "target", "_upto"
    ).select("row", "size", "pass",
             ((F.col("pass") * F.col("source_size") + F.col("_upto")) / F.col("target")).alias("finish"))
    # The budget ends at virtual time 1; what finishes a whole round later can't come before it.
    queued = running(offers, [], [F.col("finish").asc(), F.col("row").asc(), F.col("pass").asc()], "size", "offers")
    budget = (shared.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    return queued.where(F.col("_upto") <= budget).groupBy("row").agg(F.count(F.lit(1)).alias("times"))


def measured(docs: DataFrame, weights: Sequence[int], percent: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, source, h, size) per row of ``docs``, numbered, and the targets of the sources."""
    sized = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.xxhash64("text").alias("h"),
                        word_count(F.col("text").cast("string")).alias("size"))
    rows = running(sized.withColumn("_one", F.lit(1)), [], [
        F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("source").asc_nulls_last()], "_one", "sizes")
    rows = staged(rows.select("doc_id", "source", "h", "size", F.col("_before").alias("row")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, staged(targets(sizes, weights, percent, passes), "targets")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, passes: int = PASSES,
        seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row of ``docs``.

    A null or blank text has size 0 and is never taken; a null source is a source, the last one; rows that are
    equal, or share a doc_id, are queued and answered each for itself; ties are broken by the order in which the rows
    were sorted once. An empty table gives no rows; where all texts are blank every target is 0.
    """
    rows, shared = measured(docs, weights, percent, passes)
    times = queue(rows.select("row", "source", "size"), shared, percent, passes, seed)
    return (
        rows.join(times, "row", "left")
        .join(shared.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"),
                (F.coalesce("times", F.lit(0)) * F.col("size")).cast("bigint").alias("taken"))
    )


def taken(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, passes: int = PASSES,
          seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it, the same columns.

    Rows are found again by (doc_id, source, hash of the text). Where several rows have the same three, what the
    mix takes of them is shared out evenly.
    """
    rows, shared = measured(docs, weights, percent, passes)
    times = queue(rows.select("row", "source", "size"), shared, percent, passes, seed)
    key = ["_i", "_s", "_h"]
    totals = staged(rows.join(times, "row", "left").groupBy(
        F.col("doc_id").alias("_ti"), F.col("source").alias("_ts"), F.col("h").alias("_th")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("times", F.lit(0))).alias("_t")).where("_t > 0"), "totals")
    wide = docs.select(
        F.col("doc_id").cast("bigint").alias("_i"), F.col("source").cast("string").alias("_s"),
        F.xxhash64("text").alias("_h"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
        .alias("_row"))

    def matched(some: DataFrame) -> DataFrame:
        return wide.join(some, F.col("_i").eqNullSafe(F.col("_ti")) & F.col("_s").eqNullSafe(F.col("_ts"))
                         & (F.col("_h") == F.col("_th")))

    alone = matched(totals.where("_n = 1")).select("_row", F.col("_t").alias("_times"))
    out = alone
    equal = totals.where("_n > 1")
    if not equal.isEmpty():
        numbered = running(matched(equal).withColumn("_one", F.lit(1)), key, [], "_one", "equal-rows")
        out = alone.unionByName(numbered.select("_row", (
            F.floor(F.col("_t") / F.col("_n")) + F.when(F.col("_before") < F.col("_t") % F.col("_n"), 1).otherwise(0)
        ).cast("bigint").alias("_times")).where("_times > 0"))
    repeated = out.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return repeated.select([F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
