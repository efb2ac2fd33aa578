"""Stateful steps: which paths were seen, and which files have settled.

Times in state are microseconds since 1970, so that nothing depends on a worker's time zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfmark.session import by_value

by_value(__name__)

BURST = "first bigint, first_id bigint, first_size bigint, last bigint, last_id bigint, last_size bigint, n bigint, created boolean"
FIELDS = [f.split()[0] for f in BURST.split(", ")]
BUCKETS = 2048  # groups of paths that share a call and a row of state, whatever the number of paths


def _micros(df: DataFrame, interval: str | None) -> int | None:
    """An interval like ``2 seconds`` or ``30 days`` in microseconds."""
    if interval is None:
        return None
    end = F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}")
    return df.sparkSession.range(1).select(F.unix_micros(end)).first()[0]


def _clock(at: str) -> Column:
    """Microseconds as the time that watermarks go by: after their start in 1970, within what a frame can hold."""
    return F.timestamp_micros(F.greatest(F.least(F.col(at), F.lit(7_000_000_000 * 1_000_000)), F.lit(1)))


def _bucket() -> Column:
    """What state is kept by: a call and a state row for many paths, not for each. Must not change under a checkpoint."""
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(columns)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(bytes(data)).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _first_of_path(expiry: int | None, columns: list[str]):
    """Lets the first event of a path through, and every created one; the state is the last time of a bucket's paths."""

    def stretches(frame: pd.DataFrame) -> Iterator[tuple]:
        """(path, first time, id, last time, row) of a frame's events of a path without a long silence."""
        paths, times, ids = (frame[c].to_numpy() for c in ("path", "at_micros", "tie"))
        codes = pd.factorize(paths, use_na_sentinel=False)[0]
        order = np.lexsort((ids, times, codes))
        new = np.diff(codes[order]) != 0
        if expiry is not None:
            new |= np.diff(times[order]) >= expiry
        starts = np.concatenate(([0], 1 + np.flatnonzero(new)))
        ends = np.concatenate((starts[1:], [len(order)])) - 1
        firsts = order[starts]
        return zip(paths[firsts], times[firsts].tolist(), ids[firsts].tolist(), times[order[ends]].tolist(), firsts.tolist())

    def run(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Of all that is read only the first event of each stretch without a long silence is kept until the end."""
        last = dict(_unpacked(state.get[0])) if state.exists else {}
        found: dict[str, list[tuple]] = {}
        kept: list[pd.DataFrame] = []
        if not state.hasTimedOut:
            for frame in rows:
                if not len(frame):
                    continue
                created = frame["event_type"].to_numpy() == "created"
                if created.any():
                    yield frame.loc[created, columns]
                some = [s for s in stretches(frame)]
                where = len(kept)
                for n, (path, first, tie, until, row) in enumerate(some):
                    found.setdefault(path, []).append((first, tie, until, where, n, bool(created[row])))
                kept.append(frame[columns].iloc[[s[4] for s in some]])
        wanted: list[list[int]] = [[] for _ in kept]
        for path, parts in found.items():
            before = last.get(path)
            for first, _, until, where, n, created in sorted(parts):
                if (before is None or expiry is not None and first - before >= expiry) and not created:
                    wanted[where].append(n)
                before = until if before is None else max(before, until)
            last[path] = before
        for frame, some in zip(kept, wanted):
            if some:
                yield frame.iloc[some]
        if expiry is not None:
            now = state.getCurrentWatermarkMs()
            last = {path: t for path, t in last.items() if (t + expiry) // 1000 + 1 > now}
        if not last:
            state.remove()
            return
        state.update((_packed({"path": pa.array(list(last), pa.string()), "last": pa.array(list(last.values()), pa.int64())}),))
        if expiry is not None:
            state.setTimeoutTimestamp((min(last.values()) + expiry) // 1000 + 1)

    return run


def first_seen(events: DataFrame, expiry: str | None, delay: str) -> DataFrame:
    times = [f.name for f in events.schema if f.dataType.simpleString() == "timestamp"]
    # Whole numbers travel as text: a frame holds numbers beside nulls as floats.
    longs = [f.name for f in events.schema if f.dataType.simpleString() == "bigint"]
    plain = events.select([F.unix_micros(c).cast("string").alias(c) if c in times else
                           F.col(c).cast("string").alias(c) if c in longs else F.col(c) for c in events.columns])
    marked = (
        plain.withColumn("at_micros", F.col("ts").cast("bigint"))
        .withColumn("tie", F.coalesce(F.col("event_id").cast("bigint"), F.lit(2**63 - 1)))
        .withColumn("clock", _clock("at_micros")).withColumn("bucket", _bucket()).withWatermark("clock", delay)
    )
    seen = marked.groupBy("bucket").applyInPandasWithState(
        _first_of_path(_micros(events, expiry), plain.columns), plain.schema, "paths binary", "append",
        GroupStateTimeout.EventTimeTimeout if expiry else GroupStateTimeout.NoTimeout)
    return seen.select([F.timestamp_micros(F.col(c).cast("bigint")).alias(c) if c in times else
                        F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in events.columns])


def merged_bursts(bursts: list[tuple], gap: int) -> list[tuple]:
    """Bursts (of one path) of which none lies within ``gap`` of another."""
    out: list[list] = []
    for b in sorted(bursts, key=lambda b: b[:2]):
        if out and b[0] <= out[-1][3] + gap:
            a = out[-1]
            if (b[3], b[4]) > (a[3], a[4]):
                a[3:6] = b[3:6]
            a[6] += b[6]
            a[7] = a[7] or b[7]
        else:
            out.append(list(b))
    return [tuple(b) for b in out]


def _partial_bursts(gap: int):
    """A task's events as bursts: one row for what a busy path does in a batch."""
    types = [pa.string(), *[pa.bool_() if f == "created" else pa.int64() for f in FIELDS]]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[tuple]] = {}
            for path, at, tie, size, kind in zip(*(batch[c].to_pylist() for c in ("path", "at", "event_id", "size_bytes", "event_type"))):
                by_path.setdefault(path, []).append((at, tie, size, at, tie, size, 1, kind == "created"))
            rows = [(path, *b) for path, some in by_path.items() for b in merged_bursts(some, gap)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", *FIELDS])

    return merge


def _settled(gap: int, expiry: int | None):
    """Holds the open bursts of a bucket's paths until the watermark says that nobody will add to them.

    The state is two tables: the open bursts, and the last time of every path of which a burst was done with.
    """
    types = {f: pa.bool_() if f == "created" else pa.int64() for f in FIELDS}

    def run(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_: dict[str, list[tuple]] = {}
        seen: dict[str, int] = {}
        if state.exists:
            held, last = state.get
            for path, *burst in _unpacked(held):
                open_.setdefault(path, []).append(tuple(burst))
            seen = dict(_unpacked(last))
        if not state.hasTimedOut:
            for batch in rows:
                new: dict[str, list[tuple]] = {}
                columns = [batch[f].tolist() for f in FIELDS]
                for path, *burst in zip(batch["path"].tolist(), *columns):
                    new.setdefault(path, []).append(tuple(
                        None if x is None or x != x else bool(x) if f == "created" else int(x) for f, x in zip(FIELDS, burst)))
                for path, bursts in new.items():
                    open_[path] = merged_bursts(open_.get(path, []) + bursts, gap)
        now = state.getCurrentWatermarkMs()
        out, left, wake = [], [], []
        for path, bursts in open_.items():
            last = seen.get(path)
            for b in sorted(bursts, key=lambda b: b[:2]):
                if (b[3] + gap) // 1000 >= now:
                    left.append((path, *b))
                    wake.append((b[3] + gap) // 1000 + 1)
                    continue
                forgotten = expiry is not None and last is not None and b[0] - last >= expiry
                if b[7] or last is None or forgotten:
                    out.append((path, *b))
                last = b[3] if last is None else max(last, b[3])
            if last is not None:
                seen[path] = last
        if expiry is not None:
            seen = {path: t for path, t in seen.items() if (t + expiry) // 1000 + 1 > now}
            wake += [(t + expiry) // 1000 + 1 for t in seen.values()]
        if left or seen:
            columns = list(zip(*left)) or [()] * (1 + len(FIELDS))
            state.update((
                _packed({"path": pa.array(columns[0], pa.string()),
                         **{f: pa.array(c, t) for c, (f, t) in zip(columns[1:], types.items())}}),
                _packed({"path": pa.array(list(seen), pa.string()), "last": pa.array(list(seen.values()), pa.int64())})))
            if wake:
                state.setTimeoutTimestamp(max(min(wake), now + 1))
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["path", *FIELDS], dtype=object)
            yield found.assign(**{f: [None if x is None else str(x) for x in found[f]] for f in FIELDS if "size" in f})

    return run


def settled_files(events: DataFrame, gap: str, expiry: str | None, delay: str) -> DataFrame:
    width = _micros(events, gap)
    named = events.select("path", F.unix_micros("ts").alias("at"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).alias("event_id"),
                          F.col("size_bytes").cast("bigint"), "event_type")
    partial = named.mapInArrow(_partial_bursts(width), f"path string, {BURST}")
    sizes = {f: F.col(f).cast("string") for f in ("first_size", "last_size")}  # beside nulls a frame would hold floats
    marked = partial.withColumn("clock", _clock("last")).withColumn("bucket", _bucket()).withColumns(sizes).withWatermark(
        "clock", delay)
    settled = marked.groupBy("bucket").applyInPandasWithState(
        _settled(width, _micros(events, expiry)), f"path string, {BURST}".replace("_size bigint", "_size string"),
        "open binary, seen binary", "append", GroupStateTimeout.EventTimeTimeout)
    return settled.select(
        "path", F.when(F.col("created"), "created").otherwise("modified").alias("event_type"),
        F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("ts"), F.col("n").alias("n_events"),
        F.col("first_size").cast("bigint").alias("first_size"), F.col("last_size").cast("bigint").alias("size_bytes"))
