"""Hard-negative mining: blocks score the anchors, one secondary-sort shuffle brings an anchor's rows in descending score,
and a streaming iterator opens a window for each positive and hands out negatives."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_value, staged

by_value(__name__)

CELLS = 1 << 19  # components of a block of rows, and of a crowd of anchors
STRIP = 1 << 20  # scores that a task computes at once
EXACT = 1 << 53  # whole numbers that a double holds
POSITIVE, NEGATIVE = 0, 1
FOUND = "key binary, anchor bigint, kind tinyint, score bigint, id bigint"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x)."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows that take part: an id, a label, and only finite components."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
                       "embedding")
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "id", "label", quantised(F.col("embedding")).alias("vector"))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` whole numbers; shorter ones end in zeros."""
    array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; one beyond 64 bits is the nearest 64-bit number."""
    largest = max(1, *(int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) for x in (a, b)))
    if a.shape[1] * largest * largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is: anchor, score downwards, positives first, id."""
    keys = np.empty(len(ids), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    sign = np.uint64(1 << 63)
    keys["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ sign
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ sign)
    keys["kind"] = kind
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ sign
    raw, size = keys.tobytes(), keys.itemsize
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def batch_of(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """``found``: (anchor, kind, scores, ids) as rows of FOUND."""
    sizes = [len(ids) for *_, ids in found]
    anchor = np.repeat(np.array([x[0] for x in found], np.int64), sizes)
    kind = np.repeat(np.array([x[1] for x in found], np.int8), sizes)
    score = np.concatenate([x[2] for x in found] or [np.array([], np.int64)])
    ids = np.concatenate([x[3] for x in found] or [np.array([], np.int64)])
    keys = [k for a, kind_, s, i in found for k in packed(np.full(len(i), a), s, kind_, i)]
    return pa.table({"key": pa.array(keys, pa.binary()), "anchor": anchor, "kind": kind, "score": score, "id": ids})


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def scorer(width: int, per_anchor: Callable) -> Callable:
    """What a block does: scores its rows against a crowd of anchors and keeps ``per_anchor``'s few rows of each."""

    def score(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return batch_of([])
        rows = rows.sort_by("id")
        ids, labels = (rows[c].to_numpy() for c in ("id", "label"))
        own = matrix(rows["vector"], width)
        asked, groups = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        theirs = matrix(anchors["vector"], width)
        thresholds = anchors["scores"].to_pylist() if "scores" in anchors.column_names else [None] * len(asked)
        strip, found = max(1, STRIP // len(ids)), []
        for at in range(0, len(asked), strip):
            scores = products(theirs[at:at + strip], own)
            for i, line in enumerate(scores, at):
                found += per_anchor(int(asked[i]), labels == groups[i], line, ids, thresholds[i])
        return batch_of(found)

    return score


def best_positives(count: int) -> Callable:
    """The ``count`` best other rows of the anchor's label in a block; rows come by id, so a stable sort settles ties."""

    def of(anchor: int, same: np.ndarray, scores: np.ndarray, ids: np.ndarray, _) -> list:
        which = np.flatnonzero(same & (ids != anchor))
        which = which[np.argsort(~scores[which], kind="stable")[:count]]  # ~s falls as s rises, without overflow
        return [(anchor, POSITIVE, scores[which], ids[which])]

    return of


def best_negatives(count: int, low: int, high: int) -> Callable:
    """For each window of the anchor's positives the first ``count`` rows of other labels in a block."""

    def of(anchor: int, same: np.ndarray, scores: np.ndarray, ids: np.ndarray, positives: list[int]) -> list:
        which = np.flatnonzero(~same & (ids != anchor))
        which = which[np.argsort(~scores[which], kind="stable")]
        falling, keep = ~scores[which], set()
        for positive in set(positives):
            least, most = window(positive, low, high)
            if least <= most:
                start, end = np.searchsorted(falling, ~most), np.searchsorted(falling, ~least, side="right")
                keep.update(range(start, min(end, start + count)))
        chosen = which[sorted(keep)]
        return [(anchor, NEGATIVE, scores[chosen], ids[chosen])] if keep else []

    return of


def by_blocks(rows: DataFrame, anchors: DataFrame, width: int, per_anchor: Callable) -> DataFrame:
    """All rows against all anchors, tile by tile: blocks of rows meet crowds of anchors, both of bounded size.

    A tile's keys are (block, crowd); ids are dealt by hash, so no label, source or repeated vector can fill one.
    """
    side = max(1, CELLS // max(1, width))
    blocks = max(1, -(-rows.count() // side))
    crowds = max(1, -(-anchors.count() // side))

    def dealt(some: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return some.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    tiles = ["block", "crowd"]
    left = dealt(rows, "block", blocks, "crowd", crowds).groupBy(*tiles)
    right = dealt(anchors, "crowd", crowds, "block", blocks).groupBy(*tiles)
    return left.cogroup(right).applyInArrow(scorer(width, per_anchor), FOUND)


def in_order(found: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's rows in one partition, partitions sorted by the packed key alone."""
    return found.repartition("anchor").sortWithinPartitions("key")


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, kind, id) of a packed key."""
    anchor, score, kind, row = struct.unpack(">QQBQ", key)
    sign = 1 << 63
    return anchor - sign, sign - 1 - score, kind, row - sign


def first_positives(count: int) -> Callable:
    """Of a sorted stream, each anchor's first ``count`` positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = taken = None
        for batch in batches:
            keep = []
            for i, a in enumerate(batch["anchor"].to_pylist()):
                anchor, taken = (a, 1) if a != anchor else (a, taken + 1)
                if taken <= count:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def open_windows(count: int, low: int, high: int) -> Callable:
    """Of a sorted stream, the rows of MINED.

    A positive comes before all rows of its window, whose scores are no larger, and opens it; every negative goes to
    the open windows it lies in that are not full. All that is kept at any time are one anchor's windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            for key in batch["key"].to_pylist():
                a, score, kind, row = unpacked(key)
                if a != anchor:
                    anchor, windows = a, []
                if kind == POSITIVE:
                    windows.append([row, score, *window(score, low, high), 0])
                    continue
                for w in windows:
                    if w[4] < count and w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((a, w[0], w[4], row, w[1], score))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in MINED.split(", ")])

    return run


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90) -> DataFrame:
    """MINED rows: for every anchor and positive the first ``negatives`` rows of another label whose score lies between
    ``low`` and ``high`` percent of the positive's.

    ``rows``: (vec_id, embedding, label). Rows without an id or a label, with a null embedding or with a null or
    non-finite component take no part; other columns are not looked at. Anchors are the rows whose id is divisible by
    ``every``. Vectors of unequal lengths are compared as if the shorter ended in zeros, an empty one scores 0 with
    all. Rows that share an id are one row, the one with the smallest label and then vector. Higher scores come first,
    ties by smaller id. A positive with a score below 0 has an empty window, one of 0 takes negatives of score 0.
    Scores are exact; one beyond 64 bits counts as the nearest 64-bit number. An empty table gives no rows.

    Blocks find the positives first. Then they know each anchor's windows, and send on only what a window could
    still take of their rows: what is shuffled per anchor is a few rows a block, not a score for every row.
    """
    kept = staged(usable(rows).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"),
                  "vectors")
    asking = staged(kept.where(F.col("id") % every == 0), "anchors")
    width = kept.agg(F.max(F.size("vector"))).first()[0] or 1
    found = by_blocks(kept, asking, width, best_positives(positives))
    chosen = staged(in_order(found).mapInArrow(first_positives(positives), FOUND), "positives")
    scores = chosen.groupBy("anchor").agg(F.collect_list("score").alias("scores"))  # ``positives`` at most
    against = staged(asking.join(scores, asking["id"] == scores["anchor"]).drop("anchor"), "windows")
    near = by_blocks(kept, against, width, best_negatives(negatives, low, high))
    return in_order(chosen.unionByName(near)).mapInArrow(open_windows(negatives, low, high), MINED)
