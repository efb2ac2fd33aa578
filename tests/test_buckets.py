"""State by buckets of paths: the calls of a batch do not grow with the paths, and paths of a bucket stay apart."""

import random

from pyspark.sql import functions as F

from shelfmark.session import new_folder
from shelfmark.streaming import arrivals, watch
from test_streaming import END, at, expected_first, expected_settled, run_batches

PATHS = 4000


def many_paths(spark):
    folder = new_folder(spark, "many")
    rows = spark.range(PATHS).select(
        F.col("id").alias("event_id"), F.concat(F.lit("/p"), "id").alias("path"), F.lit("modified").alias("event_type"),
        F.timestamp_seconds(F.col("id") % 60 + 1_704_067_200).alias("ts"), F.lit(1).cast("bigint").alias("size_bytes"))
    rows.coalesce(1).write.parquet(folder)
    return watch.read_events(spark, folder, files_per_batch=1)


def test_state_rows_do_not_grow_with_paths(spark):
    for make in (lambda e: watch.first_seen(e, "1 day", "1 second"), lambda e: watch.settled_files(e, "1 second", "1 day", "1 second")):
        progress = []
        out = watch.run_to_end(make(many_paths(spark)), "many-out", progress=progress)
        assert out.count() >= PATHS * 0.9
        assert 0 < max(p["state_rows"] for p in progress) <= arrivals.BUCKETS < PATHS


def busy(seed):
    rng = random.Random(seed)
    return [(2**60 + i, f"/p{rng.randrange(30)}", rng.choice(["modified"] * 4 + ["created"]), i * 3 + rng.randrange(20),
             None if i % 17 == 0 else 2**61 + rng.randrange(9)) for i in range(300)]


def in_seven(events):
    return [[(i, p, k, at(t), n) for i, p, k, t, n in events[a:a + 43]] for a in range(0, len(events), 43)]


def test_first_seen_of_paths_that_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(arrivals, "BUCKETS", 2)
    events = busy(3)
    got, _ = run_batches(spark, lambda e: watch.first_seen(e, "100 seconds", "60 seconds"), *in_seven(events), [END])
    assert sorted(r.event_id for r in got if r.event_id >= 0) == expected_first(events, 100)
    sizes = {e[0]: e[4] for e in events}
    assert all(r.size_bytes == sizes[r.event_id] for r in got if r.event_id >= 0)


def test_settled_files_of_paths_that_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(arrivals, "BUCKETS", 2)
    events = busy(4)
    got, _ = run_batches(spark, lambda e: watch.settled_files(e, "30 seconds", None, "60 seconds"), *in_seven(events), [END])
    found = [(r.path, str(r.first_ts), str(r.ts), r.n_events, r.first_size, r.size_bytes) for r in got]
    want = expected_settled([(*e[:4], -1 if e[4] is None else e[4]) for e in events], 30)
    assert sorted(found, key=repr) == sorted((tuple(None if x == -1 else x for x in r) for r in want), key=repr)
