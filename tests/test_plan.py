import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from shelfmark import JobConfig, Organizer
from shelfmark.session import staged
from shelfmark.operators import dedup, scope, validate
from shelfmark.plans import planner

ROOT = "/r"


def ops_of(spark, pairs):
    return spark.createDataFrame(
        [("file", 1, s, d, "classify", "rename", 1, "h", False, "C", "S") for s, d in pairs],
        "kind string, phase int, source string, destination string, reason string, conflict_resolution string, "
        "size_bytes bigint, hash string, is_symlink boolean, category string, subcategory string",
    )


def paths_of(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def sequential_names(pairs, existing):
    """One operation after the other, with all names of the snapshot and the plan taken."""
    taken = set(existing) | {d for _, d in pairs}
    first, out = set(), {}
    for order in (lambda d: not d.endswith("."), lambda d: d.endswith(".")):
        for source, dest in sorted(p for p in pairs if order(p[1])):
            if dest not in existing and dest not in first:
                first.add(dest)
                out[source] = dest
                continue
            p, n = PurePosixPath(dest), 1
            while (name := f"{p.parent}/{p.stem}_{n}{p.suffix}") in taken:
                n += 1
            taken.add(name)
            out[source] = name
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_rename_equals_one_after_the_other(spark, seed, hot_rows):
    rng = random.Random(seed)
    stems = ["a", "fo", "fo_1", "fo.", "fo_1.", "x.tar", ".rc"]
    dests = [f"/r/all_C/S/{s}{e}" for s in stems for e in ("", ".txt")] + ["/r/all_C/S/fo._3"]
    pairs = [(f"/r/in/{i:03d}", rng.choice(dests[:4] * 4 + dests)) for i in range(60)]
    existing = {f"/r/all_C/S/{s}" for s in ("a", "a_2", "a_3.txt", "a_03.txt", "fo_1", "fo._1", "fo_10.txt", "a_1.txt")}
    got = planner.resolve_rename(ops_of(spark, pairs), paths_of(spark, *existing, *[s for s, _ in pairs]), hot_rows)
    got = {r.source: r.final_destination for r in got.collect()}
    assert got == sequential_names(pairs, existing)
    assert len(set(got.values())) == len(pairs) and not set(got.values()) & existing


def test_documented_unique_name(spark):
    existing = ["/r/file.txt", "/r/file_1.txt", "/r/file_2.txt"]
    got = planner.resolve_rename(ops_of(spark, [("/x", "/r/file.txt")]), paths_of(spark, *existing)).first()
    assert got.final_destination == "/r/file_3.txt"


def test_nothing_to_resolve(spark):
    got = planner.resolve_rename(ops_of(spark, [("/x", "/r/a"), ("/y", "/r/b")]), paths_of(spark, "/x", "/y"))
    assert {(r.source, r.final_destination) for r in got.collect()} == {("/x", "/r/a"), ("/y", "/r/b")}


def test_skip_and_overwrite(spark):
    pairs = [("/s1", "/r/a"), ("/s2", "/r/a"), ("/s3", "/r/b"), ("/s4", "/r/b"), ("/s5", "/r/c")]
    existing = paths_of(spark, "/r/b", *[s for s, _ in pairs])
    skip = {r.source: r.status for r in planner.resolve(ops_of(spark, pairs), existing, "skip").collect()}
    assert skip == {"/s1": "planned", "/s2": "skipped", "/s3": "failed", "/s4": "skipped", "/s5": "planned"}
    over = {r.source: r.status for r in planner.resolve(ops_of(spark, pairs), existing, "overwrite").collect()}
    assert over == {"/s1": "overwritten", "/s2": "planned", "/s3": "overwritten", "/s4": "planned", "/s5": "planned"}


def test_scope(spark, inventory):
    rows = inventory(
        ("/r/a.txt", "1"), ("/r/.hidden", "2"), ("/r/all_Docs/PDFs/document.pdf", "3"), ("/r/MyFolder/file.txt", "4"),
        ("/r/.git/config", "5"), ("/r/all_Docs/.git/config", "6"), ("/r/all_Docs/.d/x.txt", "7"), ("/q/z.txt", "8"),
        ("/r/link", "9", 1, 0, True), ("/r/all_X/.git/a/b.txt", "10"),
    )
    got = {r.path: r.scope for r in scope.with_scope(rows, ROOT, JobConfig()).collect()}
    assert got == {
        "/r/a.txt": "file", "/r/.hidden": "hidden", "/r/all_Docs/PDFs/document.pdf": "file",
        "/r/MyFolder/file.txt": "directory", "/r/.git/config": "ignored_directory", "/r/all_Docs/.git/config": "pattern",
        "/r/all_Docs/.d/x.txt": "file", "/q/z.txt": "outside", "/r/link": "symlink", "/r/all_X/.git/a/b.txt": "file",
    }
    loose = JobConfig(ignore_hidden=False, follow_symlinks=True, recursive_globs=True)
    got = {r.path: r.scope for r in scope.with_scope(rows, ROOT, loose).collect()}
    assert got["/r/.hidden"] == "file" and got["/r/link"] == "file" and got["/r/all_X/.git/a/b.txt"] == "pattern"
    assert got["/r/.git/config"] == "directory"


def test_root_directory_as_root(spark, inventory):
    got = {r.path: r.scope for r in scope.with_scope(inventory(("/a.txt", "1"), ("/d/x", "2")), "/", JobConfig()).collect()}
    assert got == {"/a.txt": "file", "/d/x": "directory"}


def test_duplicates(spark, inventory):
    files = inventory(
        ("/r/f.txt", "x", 10, 5), ("/r/f.doc", "x", 10, 1), ("/r/longer.pdf", "x", 10, 0), ("/r/unique.txt", "y", 4),
    )
    sets = dedup.duplicate_sets(dedup.by_content(files))
    row = sets.first()
    assert (sets.count(), row.cnt, row.primary, row.space_wasted) == (1, 3, "/r/f.doc", 20)
    assert {r.path for r in dedup.extras(files, sets).collect()} == {"/r/f.txt", "/r/longer.pdf"}
    assert [r.path for r in dedup.unique_files(dedup.by_content(files)).collect()] == ["/r/unique.txt"]
    assert dedup.waste(sets).first().asDict() == {"sets": 1, "total_duplicates": 2, "space_recoverable": 20}
    assert dedup.waste(sets.where("false")).first().asDict() == {"sets": 0, "total_duplicates": 0, "space_recoverable": 0}


def plan_rows(plan):
    return {(r.phase, r.source, r.destination) for r in plan.ops.collect()}


def test_plan_variants(spark, inventory):
    files = inventory(("/r/a.pdf", "x"), ("/r/bb.pdf", "x"), ("/r/c.txt", "y"), ("/r/all_Duplicates/d/e.pdf", "x"))
    base = {(3, "/r/a.pdf", "/r/all_Docs/PDFs/a.pdf"), (2, "/r/c.txt", "/r/all_Docs/Text/c.txt")}
    extra = {(1, "/r/bb.pdf", "/r/all_Duplicates/bb.pdf")}
    nested = {(1, "/r/all_Duplicates/d/e.pdf", "/r/all_Duplicates/all_Duplicates/d/e.pdf")}

    def rows(**changes):
        return plan_rows(Organizer(spark, JobConfig(**changes)).plan(files, ROOT))

    assert rows() == base | extra
    assert rows(compat_nested=True) == base | extra | nested
    assert rows(isolate_duplicates=False) == base
    assert rows(detect_duplicates=False, compat_skip_copies=True) == {(2, "/r/c.txt", "/r/all_Docs/Text/c.txt")}
    assert {s for _, s, _ in rows(detect_duplicates=False)} == {r.path for r in files.collect()}
    assert rows(strategy="by-size", detect_duplicates=False) >= {(2, "/r/a.pdf", "/r/all_Small/Under1MB/a.pdf")}


def test_similar_extras_get_one_operation(spark, inventory):
    files = inventory(("/r/a.png", "x"), ("/r/bb.png", "x"), ("/r/ccc.png", "y"), ("/r/d.png", "z")).withColumn(
        "sketch", F.when(F.col("path") == "/r/d.png", F.lit(-1)).otherwise(F.lit(7)).cast("bigint")
    )
    rows = plan_rows(Organizer(spark, JobConfig(perceptual_dedup=True)).plan(files, ROOT))
    assert rows == {
        (1, "/r/bb.png", "/r/all_Duplicates/bb.png"), (1, "/r/ccc.png", "/r/all_Duplicates/ccc.png"),
        (3, "/r/a.png", "/r/all_Pics/Photos/a.png"), (2, "/r/d.png", "/r/all_Pics/Photos/d.png"),
    }


def test_custom_classifier(spark, inventory):
    job = Organizer(spark, classifier=lambda f: f.withColumn("category", F.lit("Mine")).withColumn("subcategory", F.lit("All")))
    assert plan_rows(job.plan(inventory(("/r/a.pdf", "x")), ROOT)) == {(2, "/r/a.pdf", "/r/all_Mine/All/a.pdf")}


def run(spark, inventory, **changes):
    files = inventory(
        ("/r/a.pdf", "x"), ("/r/bb.pdf", "x"), ("/r/c.txt", "y"), ("/r/all_Docs/Text/c.txt", "q"),
        ("/r/all_Old/deep/er/z.py", "p"), ("/r/all_Old/.keep/sub/w.py", "o"), ("/r/Stuff/in/x.bin", "s"),
        ("/r/all_Folders/Stuff/y", "t"), ("/r/.hidden", "h"),
    )
    job = Organizer(spark, JobConfig(**changes))
    return job, files, job.apply(job.plan(files, ROOT))


def test_apply_then_undo_gives_the_old_inventory(spark, inventory):
    from shelfmark.session import new_folder
    from shelfmark.sources.oplog import read_log

    job, before, done = run(spark, inventory)
    after = {r.path for r in done.inventory.collect()}
    assert after == {
        "/r/all_Docs/PDFs/a.pdf", "/r/all_Duplicates/bb.pdf", "/r/all_Docs/Text/c_1.txt", "/r/all_Docs/Text/c.txt",
        "/r/all_Code/Python/z.py", "/r/all_Code/Python/w.py", "/r/all_Folders/Stuff_1/in/x.bin",
        "/r/all_Misc/Unsorted/y", "/r/.hidden",
    }
    # The folders directory is a managed one, so what already lies there is organized too.
    assert {r.path for r in done.removed.collect()} == {
        "/r/all_Old/deep/er", "/r/all_Old/deep", "/r/all_Old/.keep/sub", "/r/all_Folders/Stuff"
    }
    folder = new_folder(spark, "log")
    job.write_log(done, folder, "run-1")
    back, outcome = job.undo(done.inventory, read_log(spark, folder), "run-1", ROOT)
    assert {(r.path, r.hash) for r in back.collect()} == {(r.path, r.hash) for r in before.collect()}
    assert {r.undo_status for r in outcome.collect()} == {"ok"}
    metrics = done.metrics().first()
    assert (metrics.files_moved, metrics.files_failed, metrics.success_rate) == (6, 0, 100.0)


def test_dry_run_changes_nothing(spark, inventory):
    job, before, _ = run(spark, inventory)
    done = job.apply(job.plan(before, ROOT), dry_run=True)
    assert {r.path for r in done.inventory.collect()} == {r.path for r in before.collect()}
    assert done.created.isEmpty() and done.removed.isEmpty() and done.metrics().first().files_moved == 6


def test_overwrite_replaces(spark, inventory):
    _, _, done = run(spark, inventory, conflict_resolution="overwrite")
    after = {(r.path, r.hash) for r in done.inventory.collect()}
    assert ("/r/all_Docs/Text/c.txt", "y") in after and ("/r/all_Docs/Text/c.txt", "q") not in after
    assert {r.status for r in done.dir_results.collect()} == {"failed"}


def test_skip_fails_on_existing(spark, inventory):
    _, _, done = run(spark, inventory, conflict_resolution="skip")
    bad = [r for r in done.file_results.collect() if r.status == "failed"]
    assert [r.source for r in bad] == ["/r/c.txt"] and re.search("strategy is SKIP", bad[0].error)
    assert done.metrics().first().success_rate == pytest.approx(500 / 6)


def test_verify_marks_mismatches(spark, inventory):
    job, _, done = run(spark, inventory)
    rescan = done.inventory.withColumn("hash", F.when(F.col("hash") == "y", "other").otherwise(F.col("hash")))
    checked = job.verify(done, rescan)
    assert [r.source for r in checked.file_results.where("status = 'mismatch'").collect()] == ["/r/c.txt"]
    assert checked.metrics().first().files_failed == 1


def test_validation(spark, inventory):
    job, files, _ = run(spark, inventory)
    plan = job.plan(files, ROOT)
    dirs = spark.createDataFrame([("/r", True), ("/r/all_Docs", False)], "path string, writable boolean")
    found = job.validate(plan, available_bytes=1, directories=dirs)
    assert {(r.severity, r.check) for r in found.collect()} == {
        ("error", "space"), ("error", "permission"), ("warning", "existing_target")
    }
    assert not validate.is_valid(found)
    assert validate.is_valid(job.validate(job.resolve(plan), available_bytes=10_000))
    assert [r.check for r in job.validate(job.plan(files.where("false"), ROOT)).collect()] == ["root"]


def test_link_chains(spark, monkeypatch):
    """A chain of 45 links and one of 300, circles and what leads into them; as many rounds as doublings."""
    links = spark.createDataFrame(
        [("/a", "/b"), ("/b", "/c"), ("/c", "/file"), ("/x", "/y"), ("/y", "/x"), ("/m", "/none"), ("/s", "/s"), ("/to-s", "/s")]
        + [(f"/l{i:02d}", f"/l{i + 1:02d}") for i in range(45)] + [("/l45", "/file")]
        + [(f"/n{i:03d}", f"/n{i + 1:03d}") for i in range(300)],
        "path string, target string",
    )
    existing = links.select("path").union(paths_of(spark, "/file"))
    rounds = []
    monkeypatch.setattr(validate, "staged", lambda df, label: rounds.append(label) or staged(df, label))
    bad = {r.path: r.reason for r in validate.unresolved_links(links, existing).collect()}
    assert bad == {"/x": "loop", "/y": "loop", "/m": "broken", "/s": "loop", "/to-s": "loop"} | {
        f"/n{i:03d}": "broken" for i in range(300)}
    assert len(rounds) - 1 <= 9 + 1  # 300 links
    assert validate.unresolved_links(links.where("false"), existing).count() == 0
