import random
import time

import pytest
from pyspark.sql import functions as F

from shelfmark import JobConfig
from shelfmark.session import new_folder
from shelfmark.sources.rules import default_rules
from shelfmark.streaming import watch


def event_rows(spark, *rows):
    return spark.createDataFrame(rows, "event_id bigint, path string, event_type string, ts string, size_bytes bigint").withColumn(
        "ts", F.to_timestamp("ts")
    )


END = (-1, "/_end", "created", "2100-01-01 00:00:00", 0)


def run_batches(spark, make, *batches):
    """The output of a stream over ``batches`` of event rows, one after another, and its progress."""
    folder = new_folder(spark, "in")
    for rows in batches:
        event_rows(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
    progress = []
    out = watch.run_to_end(make(watch.read_events(spark, folder, files_per_batch=1)), "out", progress=progress)
    return out.collect(), progress


def at(n):
    """Second ``n`` of a day that has more of them than a minute."""
    return f"2024-01-{1 + n // 86400:02d} {n // 3600 % 24:02d}:{n // 60 % 60:02d}:{n % 60:02d}"


def test_first_seen_across_batches(spark):
    got, _ = run_batches(
        spark, watch.first_seen,
        [(1, "/a", "modified", at(5), 1), (2, "/a", "modified", at(1), 1), (3, "/b", "created", at(0), 1), (4, "/b", "modified", at(2), 1)],
        [(5, "/a", "modified", at(0), 1), (6, "/b", "created", at(86400), 1), (7, "/c", "modified", at(86400), 1)],
    )
    assert sorted(r.event_id for r in got) == [2, 3, 6, 7]


def expected_first(events, expiry):
    out, last = [], {}
    for i, path, kind, t, _ in sorted(events, key=lambda e: (e[3], e[0])):
        if kind == "created" or path not in last or t - last[path] >= expiry:
            out.append(i)
        last[path] = t
    return sorted(out)


def test_first_seen_with_expiry(spark):
    """Whatever the batches are, a path is new after its silence; memory holds only the paths of that time."""
    rng = random.Random(1)
    events = [(i, f"/p{i // 20}-{rng.randrange(4)}", rng.choice(["modified"] * 5 + ["created"]), i * 10 + rng.randrange(10), 1)
              for i in range(300)]
    batches = [[(i, p, k, at(t), n) for i, p, k, t, n in events[a:a + 30]] for a in range(0, 300, 30)]
    got, progress = run_batches(spark, lambda e: watch.first_seen(e, "100 seconds", "20 seconds"), *batches, [END])
    assert sorted(r.event_id for r in got if r.event_id >= 0) == expected_first(events, 100)
    assert len([p for p in progress if p["rows"]]) == 11 and sum(p["late"] for p in progress) == 0
    paths = len({p for _, p, *_ in events})
    assert max(p["state_rows"] for p in progress) < paths * 0.6
    assert progress[-1]["state_rows"] <= 2


def test_times_beyond_nanoseconds(spark):
    """A file that says it is of the year 2999, or of 1500, is seen like any other."""
    got, _ = run_batches(spark, lambda e: watch.first_seen(e, "1 day", "1 hour"),
                         [(1, "/a", "modified", "1500-01-01 00:00:00", 1), (2, "/b", "modified", "2999-01-01 00:00:00", 1)])
    assert {(r.path, r.ts.year) for r in got} == {("/a", 1500), ("/b", 2999)}


def expected_settled(events, gap):
    out, by_path = [], {}
    for e in sorted(events, key=lambda e: (e[3], e[0])):
        by_path.setdefault(e[1], []).append(e)
    for path, some in by_path.items():
        bursts = []
        for e in some:
            if bursts and e[3] - bursts[-1][-1][3] <= gap:
                bursts[-1].append(e)
            else:
                bursts.append([e])
        out += [(path, at(b[0][3]), at(b[-1][3]), len(b), b[0][4], b[-1][4]) for n, b in enumerate(bursts)
                if n == 0 or any(e[2] == "created" for e in b)]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 7])
def test_settled_files(spark, batches):
    """Out of order within the delay, a busy path, bursts over several batches."""
    rng = random.Random(2)
    events = [(i, "/busy" if i % 3 == 0 else f"/p{rng.randrange(12)}", rng.choice(["modified"] * 3 + ["created"]),
               max(0, i * 3 + rng.randrange(-20, 20)), rng.randrange(100)) for i in range(280)]
    size = -(-len(events) // batches)
    rows = [[(i, p, k, at(t), n) for i, p, k, t, n in events[a:a + size]] for a in range(0, len(events), size)]
    got, progress = run_batches(spark, lambda e: watch.settled_files(e, "30 seconds", None, "60 seconds"), *rows, [END])
    found = sorted((r.path, str(r.first_ts), str(r.ts), r.n_events, r.first_size, r.size_bytes) for r in got)
    assert found == expected_settled(events, 30) and sum(p["late"] for p in progress) == 0


def test_settled_files_are_forgotten(spark):
    rows = [[(1, "/a", "modified", at(0), 1)], [(2, "/b", "modified", at(50), 1)], [(3, "/c", "modified", at(400), 1)],
            [(4, "/a", "modified", at(500), 2), (5, "/c", "modified", at(500), 3)], [END]]
    got, progress = run_batches(spark, lambda e: watch.settled_files(e, "10 seconds", "200 seconds", "5 seconds"), *rows)
    assert sorted((r.path, r.size_bytes) for r in got) == [("/a", 1), ("/a", 2), ("/b", 1), ("/c", 1)]
    assert progress[-1]["state_rows"] <= 1


def test_settings_stay_as_they_were(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    run_batches(spark, lambda e: watch.stable_sessions(e, "1 second"), [END])
    assert spark.conf.get(key, None) == before


def test_watcher_organizes_and_calls_back(spark):
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    event_rows(
        spark, (1, "/in/a.pdf", "created", "2024-01-01 00:00:00", 1), (2, "/in/all_X/b.pdf", "created", "2024-01-01 00:00:00", 1),
        (3, "/in/.hidden", "created", "2024-01-01 00:00:00", 1), (4, "/in/sub/c.txt", "modified", "2024-01-01 00:00:00", 1),
        (5, "/in/.devAI/operations.json", "created", "2024-01-01 00:00:00", 1),
        (6, "/in/open.pdf", "created", "2024-01-01 00:00:09", 1),
        (7, "/in/open.pdf", "modified", "2024-01-01 00:00:10", 1),
    ).write.parquet(folder)
    calls = []
    watcher = watch.Watcher("/in", default_rules(spark), JobConfig(), on_batch=lambda rows, n: calls.append((n, rows.count())))
    query = watcher.start(watch.read_events(spark, folder), out, state, once=True)
    query.awaitTermination()
    assert not watcher.is_running
    log = watcher.read_log(spark, out)
    assert {(r.source, r.destination) for r in log.collect()} == {
        ("/in/a.pdf", "/in/all_Docs/PDFs/a.pdf"), ("/in/sub/c.txt", "/in/all_Docs/Text/c.txt")
    }  # open.pdf is still being written
    assert sum(n for _, n in calls) == 2
    event_rows(spark, (8, "/in/z", "created", "2024-01-01 00:01:00", 1)).write.mode("append").parquet(folder)
    watcher.start(watch.read_events(spark, folder), out, state, once=True).awaitTermination()
    assert {r.source for r in watcher.read_log(spark, out).collect()} == {"/in/a.pdf", "/in/sub/c.txt", "/in/open.pdf"}


def test_watcher_starts_and_stops(spark):
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    event_rows(spark, (1, "/in/a.pdf", "created", "2024-01-01 00:00:00", 1),
               (2, "/in/b.pdf", "created", "2024-01-01 01:00:00", 1)).write.parquet(folder)
    watcher = watch.Watcher("/in", default_rules(spark))
    watcher.start(watch.read_events(spark, folder), out, state)
    assert watcher.is_running
    watcher.query.processAllAvailable()
    watcher.stop()
    assert not watcher.is_running
    assert watcher.read_log(spark, out).count() == 1


def test_watching_a_landing_directory(spark, tmp_path):
    """Files with old times of their own are not late; they settle once the watch goes on."""
    import os

    land, out, state = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "state")
    land.mkdir()
    (land / "old.pdf").write_text("x")
    os.utime(land / "old.pdf", (1, 1))
    watcher = watch.Watcher(str(land), default_rules(spark), JobConfig(watch_settle=0.5))
    for name in ("new.txt", "next.txt"):
        watcher.start(watch.watch_landing_directory(spark, str(land)), out, state, once=True).awaitTermination()
        time.sleep(1)
        (land / name).write_text("y")
    watcher.start(watch.watch_landing_directory(spark, str(land)), out, state, once=True).awaitTermination()
    assert {r.destination for r in watcher.read_log(spark, out).collect()} == {
        f"{land}/all_Docs/PDFs/old.pdf", f"{land}/all_Docs/Text/new.txt"}


def test_landing_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "sub" / "b.txt").write_text("abcd")
    seen = watch.run_to_end(watch.watch_landing_directory(spark, str(tmp_path)), "landing")
    assert len({r.event_id for r in seen.collect()}) == 2
    assert {(r.path, r.size_bytes, r.event_type) for r in seen.collect()} == {
        (f"{tmp_path}/a.txt", 3, "created"), (f"{tmp_path}/sub/b.txt", 4, "created")
    }


def test_bursts(spark):
    folder = new_folder(spark, "in")
    event_rows(
        spark, (1, "/a", "created", "2024-01-01 00:00:00", 1), (2, "/a", "modified", "2024-01-01 00:00:01", 5),
        (3, "/a", "modified", "2024-01-01 00:01:00", 7), (4, "/_end", "created", "2030-01-01 00:00:00", 0),
    ).write.parquet(folder)
    stream = watch.stable_sessions(watch.read_events(spark, folder), "2 seconds")
    got = watch.run_to_end(stream, "bursts").where("path = '/a'").collect()
    assert sorted((r.n_events, r.first_size, r.last_size) for r in got) == [(1, 7, 7), (2, 1, 5)]
