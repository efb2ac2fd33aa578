"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_value, staged

by_value(__name__)

BITS = 64
BLOCK = 1 << 14  # codes of a bucket block; larger buckets are split
CROWD = 1 << 16  # queries that meet a block at once
FOUND = "query bigint, code bigint, first bigint, distance int"


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The signs of the first ``bits`` coordinates as one number; missing ones count as not positive."""
    return F.aggregate(
        F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def segments(count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the segments: about as wide as the logarithm of the number of codes."""
    m = max(2, min(8, round(bits / max(8.0, math.log2(max(2, count))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def verifier(parts: list[tuple[int, int]], radius: int, k: int):
    """What is done with a block and the queries sent to it: each query's ``k`` nearest among the codes whose
    segment is exactly ``radius`` away."""

    def verify(key: tuple, index: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        shift, width = parts[int(key[0])]
        mask = np.uint64((1 << width) - 1)
        own, first = index["code"].to_numpy(), index["first"].to_numpy()
        pieces = (own.view(np.uint64) >> np.uint64(shift)) & mask
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for q in asking["query"].to_numpy():
            u = np.int64(q).view(np.uint64)
            hit = np.flatnonzero(np.bitwise_count(pieces ^ ((u >> np.uint64(shift)) & mask)) == radius)
            if len(hit):
                far = np.bitwise_count(own[hit].view(np.uint64) ^ u)
                near = np.lexsort((first[hit], far))[:k]
                out.append((q, own[hit[near]], first[hit[near]], far[near]))
        queries = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
        columns = [np.concatenate([x[i] for x in out]) if out else np.array([]) for i in (1, 2, 3)]
        return pd.DataFrame({"query": queries, "code": columns[0].astype(np.int64),
                             "first": columns[1].astype(np.int64), "distance": columns[2].astype(np.int32)})

    return verify


def top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """(query, code, first, distance): for each of ``queries`` (query, distinct) the ``k`` nearest of ``codes``
    (code, distinct, and first), ties by first.

    Every code lies in one bucket per segment; buckets are named by the segment's leading bits. Round r sends each
    open query to the buckets whose leading bits are within r of its own, where codes whose segment is exactly r away
    are verified. After round r every code within m (r + 1) - 1 is found, so a query closes when its k-th distance
    is no more than that. A bucket is cut into blocks of bounded size, and many queries into crowds.
    """
    codes, queries = staged(codes.select("code", "first"), "mih-codes"), staged(queries.select("query"), "mih-queries")
    count, asked = codes.count(), queries.count()
    parts = segments(count, bits)
    lead = max(1, min(min(w for _, w in parts) - 1, math.ceil(math.log2(max(2, count / BLOCK)))))
    crowds = max(1, math.ceil(asked / CROWD))

    def segment(column: str) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(F.col(column), s + w - lead).bitwiseAND(
            F.lit((1 << lead) - 1)).cast("int").alias("lead")) for i, (s, w) in enumerate(parts)])

    placed = codes.select("code", "first", F.explode(segment("code")).alias("p")).select("code", "first", "p.*")
    blocks = staged(placed.groupBy("seg", "lead").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "mih-blocks")
    rows = placed.join(blocks, ["seg", "lead"]).select(
        "seg", "lead", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"), "code",
        "first")
    rows = staged(rows.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1)))), "mih-index")
    best, open_ = None, queries

    for r in range(max(w for _, w in parts) + 1):
        flips = [f for f in range(1 << lead) if f.bit_count() <= r]
        sent = (
            open_.select("query", F.explode(segment("query")).alias("p")).select("query", "p.*")
            .withColumn("lead", F.explode(F.array(*[F.col("lead").bitwiseXOR(F.lit(f)) for f in flips])))
            .join(blocks, ["seg", "lead"])
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("crowd", F.pmod(F.xxhash64("query"), F.lit(crowds)).cast("int"))
            .select("seg", "lead", "block", "crowd", "query")
        )

        keys = ["seg", "lead", "block", "crowd"]
        found = rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(
            verifier(parts, r, k), FOUND)
        if best is not None:
            found = found.unionByName(best)
        best = staged(nearest(found.distinct(), k), "mih-best")
        last = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        covered = len(parts) * (r + 1) - 1
        left = last.where((F.col("n") >= min(k, count)) & (F.col("far") <= covered))
        open_ = staged(open_.join(left, "query", "left_anti"), "mih-open")
        if open_.isEmpty():
            break
    return best


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per query: what a query has at any time is a few blocks' k nearest."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["distance", "first"])[:k]

    return found.groupBy("query").applyInPandas(cut, FOUND)


def search(rows: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row whose id is divisible by ``every`` its ``k`` nearest others.

    ``rows``: (vec_id, embedding). Rows are ranked by the Hamming distance of their sign codes, then vec_id. Equal codes
    are one code with its ``k`` + 1 smallest ids, so that a vector that a third of all rows share is searched once. A
    null embedding has the code of an empty vector; rows with a null id are no neighbours; a repeated id is one row.
    """
    coded = rows.where("vec_id is not null").select(
        F.col("vec_id").cast("bigint"), F.coalesce(sign_code(F.col("embedding")), F.lit(0)).alias("code"))
    coded = staged(coded.groupBy("vec_id").agg(F.min("code").alias("code")), "codes")
    sizes = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    shared = sizes.where("n > 1").select("code")
    alone = sizes.where("n = 1").select("code", F.array("least").alias("ids"))
    many = few_smallest(coded.join(shared, "code", "left_semi"), k + 1)
    index = staged(alone.unionByName(many), "index")
    asking = coded.where(F.col("vec_id") % every == 0)
    found = top_k(index.withColumn("first", F.col("ids")[0]), asking.select(F.col("code").alias("query")).distinct(), k + 1)
    lists = found.join(index, "code").select("query", F.struct("distance", "ids").alias("near")) \
        .groupBy("query").agg(F.collect_list("near").alias("near"))  # k + 1 codes of k + 1 ids at most
    ordered = F.array_sort(F.flatten(F.transform("near", lambda n: F.transform(
        n["ids"], lambda i: F.struct(n["distance"].alias("distance"), i.alias("id"))))))
    near = lists.select("query", ordered.alias("near"))
    own = asking.join(near, asking["code"] == near["query"])
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("vec_id")), 1, k)
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.col("n.distance").alias("distance"))


def few_smallest(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): the ``k`` smallest ids of each code; every task first cuts its own rows to ``k`` a code."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch])
            kept = kept.sort_values("vec_id").groupby("code", sort=False).head(k)
        if kept is not None:
            yield kept

    cut_rows = rows.select("code", "vec_id").mapInPandas(cut, "code bigint, vec_id bigint")
    cut_rows = cut_rows.repartition("code", F.pmod(F.xxhash64("vec_id"), F.lit(64))).mapInPandas(
        cut, "code bigint, vec_id bigint")  # 64 lists of k a code at most
    return cut_rows.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k).alias("ids"))
