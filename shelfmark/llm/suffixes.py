"""Removal of repeated passages: a sparse suffix array over range-partitioned suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_value, id_and_text, staged, values

by_value(__name__)

LENGTH = 200  # bytes of a passage
LEAD = 32  # leading bytes that name a suffix
STRETCH = 1 << 22  # window starts worked on at once; longer texts go on stretch by stretch
BUCKET = 1 << 14  # suffixes sorted at once
HOT = 4096  # different surroundings of one lead that are compared in one bucket
WAYS = 4  # parts into which the windows of a larger lead are cut at once
PLACE = 16  # bits of a place that hold the run's length and the anchor's offset

_B = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 23) - 1)


def lead_hashes(data: np.ndarray, width: int = LEAD) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes (a power of two) from each place on."""
    h, base, span = data.astype(np.uint64) + np.uint64(1), _B, 1
    while span < width:
        h = h[:-span] * base + h[span:]
        base, span = base * base, span * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def runs(text: bytes, length: int = LENGTH, lead: int = LEAD) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, stop, anchor, key) arrays: window starts ``first`` to ``stop`` - 1 share the suffix at ``anchor``.

    A window is a string of ``length`` bytes; its anchor is the place inside whose ``lead`` bytes hash lowest, the
    leftmost of equals. That depends on the window alone, so equal windows have their anchors at equal offsets, and
    only the suffixes at anchors need sorting.
    """
    data, inside = np.frombuffer(text, np.uint8), length - lead + 1
    for start in range(0, len(data) - length + 1, STRETCH):
        own = data[start:start + STRETCH + length - 1]
        with np.errstate(over="ignore"):
            hashes = lead_hashes(own, lead)
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= inside:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if inside > span:
            least = np.minimum(least[:span - inside], least[inside - span:])
        anchors = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        stop = np.append(first[1:], len(anchors))
        at = anchors[first]
        yield first + start, stop + start, at + start, hashes[at].view(np.int64)


def anchored(docs: DataFrame, length: int, lead: int) -> DataFrame:
    """(key, hash, row, place) for each run of windows of (row, text): hash is that of the run's bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for row, text in zip(batch.column(0).to_numpy(), values(batch.column(1))):
                text = (text or "").encode()
                for first, stop, anchor, key in runs(text, length, lead):
                    hashes = np.array([digest(text[s:e]) for s, e in zip(
                        first.tolist(), (stop + (length - 1)).tolist())], np.uint64).view(np.int64)
                    place = first << PLACE | (stop - first) << (PLACE // 2) | (anchor - first)
                    for column, part in zip(columns, (key, hashes, np.full(len(key), row), place)):
                        column.append(part)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns],
                                                 ["key", "hash", "row", "place"])

    return docs.mapInArrow(each, "key bigint, hash bigint, row bigint, place bigint")


def sorted_suffixes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings' order, and the bytes that each shares with the one before it.

    Multikey quicksort with eight bytes as one character: strings are split by their first character, and only those
    that tie are split further by the next one.
    """
    width += -width % 8
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(len(strings))
    group = np.zeros(len(strings), np.int64)  # by place in order: where the place's group begins
    tied = np.arange(len(strings))
    for w in range(words.shape[1]):
        part = order[tied]
        by = np.lexsort((words[part, w], group[tied]))
        order[tied] = part = part[by]
        word, own = words[part, w], group[tied]
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (own[1:] != own[:-1])))
        group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.bincount(group[tied], minlength=len(order))
        tied = tied[size[group[tied]] > 1]
        if not len(tied):
            break
    differs = padded[order[1:]] != padded[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if len(order) > 1 else np.zeros(0, np.int64)
    return order, np.concatenate(([0], common)).astype(np.int64)


def repeated(left: list[bytes], right: list[bytes], count: np.ndarray, length: int, most: int) -> np.ndarray:
    """A row per suffix and a column per offset before its anchor: whether that window occurs again.

    ``left`` are the bytes before the anchors, backwards, ``right`` those from there on. Suffixes are sorted by both
    sides; those that share ``offset`` bytes on the left and the rest on the right have the window in common.
    """
    m = len(left)
    low = length - np.array([len(r) for r in right])
    high = np.array([len(x) for x in left])
    by_left, common_left = sorted_suffixes(left, most)
    by_right, common_right = sorted_suffixes(right, length)
    out = np.zeros((m, most + 1), bool)
    one, other = np.empty(m, np.int64), np.empty(m, np.int64)
    for offset in range(most + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(own):
            continue
        one[by_left] = np.cumsum(common_left < offset)
        other[by_right] = np.cumsum(common_right < length - offset)
        _, which = np.unique(one[own] * (m + 1) + other[own], return_inverse=True)
        out[own, offset] = np.bincount(which, count[own])[which] > 1
    return out


def compared(suffixes: DataFrame, length: int, lead: int) -> DataFrame:
    """(row, first, stop) of windows that occur again, for (lead, left, right, n, row, anchor) within buckets.

    ``left`` is backwards, as the bytes lie from the anchor on. Sampled splitters deal the suffixes by their leading bytes over the tasks and each task has them in order. A
    window's suffix has these bytes in full, so nothing is common to suffixes on two sides of a border between leads,
    and a task sorts bucket by bucket, each of whole leads.
    """
    most = length - lead

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[dict]) -> pa.RecordBatch:
            found = repeated([r["left"] for r in rows], [r["right"] for r in rows],
                             np.array([r["n"] for r in rows]), length, most)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            which, begin = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1]
            anchor = np.array([r["anchor"] for r in rows], np.int64)[which]
            row = np.array([r["row"] for r in rows], np.int64)[which]
            return pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(anchor - end + 1), pa.array(anchor - begin + 1)], ["row", "first", "stop"])

        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(waiting) >= BUCKET and row["lead"] != waiting[-1]["lead"]:
                    yield settle(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield settle(waiting)

    return (
        suffixes.select("lead", "left", "right", "n", "row", "anchor")
        .repartitionByRange("lead").sortWithinPartitions("lead")
        .mapInArrow(each, "row bigint, first bigint, stop bigint")
    )


def shared(a: bytes, b: bytes) -> int:
    """The number of leading bytes that two strings have in common."""
    size = min(len(a), len(b))
    return size - ((int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])).bit_length() + 7) // 8


def alike(suffixes: DataFrame, length: int) -> DataFrame:
    """(row, first, stop) of windows that occur again, for (key, side, other, by_left, row, anchor).

    The suffixes of a key agree in all ``other`` bytes on one side of the anchor and are sorted by the other one, ``side``,
    on the left if ``by_left``: no one has more in common with a suffix than its neighbours. Sampled splitters deal them by
    these bytes, equal ones by their place, so that a key lies in as many buckets as it needs. A bucket hands on the
    first and the last of its suffixes, and these few are compared across the borders.
    """
    names = ["key", "side", "other", "by_left", "row", "anchor"]
    found_names = [*names[:5], "first", "stop"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a stop are runs of windows; those without are a bucket's ends, with their anchor as first."""
        out: list[tuple] = []

        def settle(own: tuple, most: int) -> None:
            _, _, other, by_left, row, anchor = own
            if most + other >= length:
                low, high = (length - other, most) if by_left else (length - most, other)
                out.append((None, None, None, None, row, anchor - high, anchor - low + 1))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], found_names)

        last, most = None, -1
        for batch in batches:
            for own in zip(*(batch[c].to_pylist() for c in names)):
                common = shared(last[1], own[1]) if last and last[0] == own[0] else -1
                if last:
                    settle(last, max(most, common))
                else:
                    out.append((*own, None))
                last, most = own, common
            if out:
                yield packed()
                out = []
        if last:
            settle(last, most)
            out.append((*last, None))
            yield packed()

    ddl = "key bigint, side binary, other int, by_left boolean, row bigint, first bigint, stop bigint"
    order = ["key", "side", "row", "anchor"]
    dealt = suffixes.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(dealt.mapInArrow(neighbours, ddl), "alike")
    ends = found.where("stop is null").withColumnRenamed("first", "anchor").select(*names)  # two a bucket at most
    over = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(neighbours, ddl)
    return found.unionByName(over).where("stop is not null").select("row", "first", "stop")


def divided(texts: DataFrame, length: int, lead: int, hot: int) -> DataFrame:
    """(row, first, stop) of windows that occur again, for (left, right, n, row, anchor) of leads of any size.

    A part has the windows with ``low`` to ``high`` bytes before the anchor. What these have in common, ``low`` bytes on
    the left and ``length - high`` on the right, is the part's key: who is alone with it has no such window in common
    with anyone. Groups of at most ``hot`` are sorted and compared bucket by bucket. Larger ones are compared with
    their neighbours if they agree on one side, as a passage's borders do; others are cut into ``WAYS`` parts. A part of
    one window agrees on both sides, so a few rounds suffice, and windows are never dealt out one by one.
    """
    columns = ["left", "right", "n", "row", "anchor", "low", "high"]
    key = F.xxhash64("low", "high", F.expr("substring(left, 1, low)"), F.expr(f"substring(right, 1, {length} - high)"))
    parts = texts.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - lead))
    few, even = [], []
    while True:
        parts = staged(parts.select(*columns, key.alias("key")), "parts")
        sides = [F.min(F.xxhash64(c)) == F.max(F.xxhash64(c)) for c in ("right", "left")]
        groups = parts.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("low") == F.col("high")).alias("one"),
                                          sides[0].alias("same_right"), sides[1].alias("same_left")).where("members > 1")
        groups = staged(groups, "part-groups")
        large = groups.where(F.col("members") > hot).select("key", "one", "same_right", "same_left")
        small = groups.where(F.col("members") <= hot).select("key")
        few.append(parts.join(large, "key", "left_anti").join(small, "key", "left_semi").drop("low", "high"))
        agree = F.expr("one or same_right or same_left")
        by_left = F.expr("one or same_right")
        side, other = (F.when(by_left, F.col(a)).otherwise(F.col(b)) for a, b in (("left", "right"), ("right", "left")))
        even.append(parts.join(large.where(agree), "key").select(
            "key", side.alias("side"), F.length(other).alias("other"), by_left.alias("by_left"), "row", "anchor"))
        if large.where(~agree).isEmpty():
            break
        width = F.expr(f"(high - low + {WAYS}) div {WAYS}").cast("int")
        cut = parts.join(large.where(~agree).select("key"), "key").withColumn("width", width).withColumn(
            "low", F.explode(F.expr("sequence(low, high, width)"))).withColumn(
            "high", F.least("high", F.expr("low + width - 1")))
        parts = cut.where(f"length(left) >= low and length(right) >= {length} - high").select(
            F.expr("substring(left, 1, high)").alias("left"), F.expr(f"substring(right, 1, {length} - low)").alias("right"),
            "n", "row", "anchor", "low", "high")
    found = compared(reduce(DataFrame.unionByName, few).withColumnRenamed("key", "lead"), length, lead)
    return found.unionByName(alike(reduce(DataFrame.unionByName, even), length))


def passages(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, hot: int = HOT) -> DataFrame:
    """(row, windows) for (row, text): runs (first, stop) of the starts of ``length``-byte strings that start elsewhere too.

    1. Suffixes at anchors are counted by their lead; those whose lead is alone are done with.
    2. Runs of windows with equal bytes are counted as one class each. If a class has two members, all its windows
       occur again; a class is looked into only where its lead has other classes, and only one member of it.
    3. These members' bytes are fetched, range-partitioned by lead, and sorted and compared bucket by bucket.
    4. A lead with more than ``hot`` classes (a passage in a large share of the corpus, at its borders) is no bucket: it is
       divided by more of the bytes until groups are small or agree on one side, and those are range-partitioned by the
       other side, wherever borders fall, and compared with their neighbours.
    """
    found = staged(anchored(docs, length, lead), "anchors")
    again = staged(found.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "shared-leads")
    live = staged(found.join(again, "key"), "suffixes")  # two written tables, so that a hot key can be split
    classes = live.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("m"))
    classes = staged(classes, "suffix-classes")
    leads = staged(classes.groupBy("key").agg(F.count(F.lit(1)).alias("others")).where("others > 1"), "suffix-leads")
    first = F.shiftright("place", PLACE)
    stop = first + F.shiftright("place", PLACE // 2).bitwiseAND(F.lit(255))
    whole = live.join(classes.where("n > 1").select("key", "hash"), ["key", "hash"]).select(
        "row", first.alias("first"), stop.alias("stop"))

    wanted = (
        classes.join(leads, "key").select("m.row", F.struct("m.place", "n", (F.col("others") > hot).alias("hot")).alias("w"))
        .groupBy("row").agg(F.collect_list("w").alias("wanted"))  # a text has one per run of windows at most
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "left", "right", "n", "row", "anchor", "hot"]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for row, text, wants in zip(*[values(batch.column(i)) for i in range(3)]):
                text, out = text.encode(), [[] for _ in names]
                for want in wants:
                    p = want["place"]
                    start, size, anchor = p >> PLACE, p >> PLACE // 2 & 255, (p >> PLACE) + (p & 255)
                    cells = (text[anchor:anchor + lead], text[start:anchor][::-1], text[anchor:start + size - 1 + length],
                             want["n"], row, anchor, want["hot"])
                    for column, cell in zip(out, cells):
                        column.append(cell)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    texts = docs.join(wanted, "row").select("row", "text", "wanted").mapInArrow(
        fetch, "lead binary, left binary, right binary, n bigint, row bigint, anchor bigint, hot boolean")
    texts = staged(texts, "suffix-bytes")
    windows = whole.unionByName(compared(texts.where("not hot"), length, lead))

    if not leads.where(F.col("others") > hot).isEmpty():
        windows = windows.unionByName(divided(texts.where("hot"), length, lead, hot))
    return windows.groupBy("row").agg(F.collect_list(F.struct("first", "stop")).alias("windows"))


def covered(windows: list[dict] | None, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes within ``length``-byte strings that start in ``windows``."""
    if not windows:
        return []
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, [w["first"] for w in windows], 1)
    np.add.at(change, [w["stop"] - 1 + length for w in windows], -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def deduplicated(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    Every byte within a string of ``length`` bytes that also starts anywhere else, in any row, is removed. Null is the
    empty text; texts shorter than ``length`` keep all; equal rows are removed whole; an empty table gives no rows.
    Rows are told apart by a 64-bit hash of id and text, so that equal rows, which have equal results, need no number.
    """
    rows = id_and_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    found = passages(rows.select("row", "text"), length, lead, hot)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        for batch in batches:
            out = [[] for _ in names[1:]]
            for text, windows in zip(values(batch.column(1)), values(batch.column(2))):
                text = (text or "").encode()
                spans = covered(windows, len(text), length)
                kept, upto = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(text[upto:start])
                    upto = end
                kept.update(text[upto:])
                for column, cell in zip(out, (len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest(),
                                              ",".join(f"{s}:{e}" for s, e in spans))):
                    column.append(cell)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    return rows.join(found, "row", "left").select("doc_id", "text", "windows").mapInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string")
