"""Scanning, hashing and verifying files on a disk."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import JobConfig, Organizer
from shelfmark.sources import hashing
from shelfmark.sources.files import is_remote
from shelfmark.sources.scan import files_of, list_files, scan_tree


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


ODD_NAMES = {
    "_x": b"1", ".x": b"2", "_dir/.hid/_SUCCESS": b"3", "with blank/é ü.txt": b"4", "%41.txt": b"5", "a:b#c?d.txt": b"6",
    "star*[1].txt": b"7", "line\nbreak": b"8", "deep/" + "/".join("abcdefghij") + "/f": b"9", "empty": b"",
}


@pytest.mark.parametrize("budget", [1, 3, 20_000])
def test_nothing_is_lost(spark, tmp_path, budget):
    put(tmp_path, ODD_NAMES)
    (tmp_path / "hollow" / "inner").mkdir(parents=True)
    entries = scan_tree(spark, str(tmp_path), budget).collect()
    assert {r.path: r.size_bytes for r in entries if r.kind == "file"} == {
        f"{tmp_path}/{n}": len(c) for n, c in ODD_NAMES.items()}
    directories = {r.path for r in entries if r.kind == "directory"}
    assert directories == {str(p) for p in tmp_path.rglob("*") if p.is_dir()}
    assert len(entries) == len(ODD_NAMES) + len(directories)
    assert {r.modified_time.timestamp() for r in entries if r.path.endswith("/_x")} == {
        round(os.stat(tmp_path / "_x").st_mtime, 6)}


def test_links(spark, tmp_path):
    put(tmp_path / "in", {"d/f.txt": b"abc"})
    root = tmp_path / "in"
    (root / "file-link").symlink_to(root / "d/f.txt")
    (root / "loop").symlink_to(root)
    (root / "nowhere").symlink_to(root / "gone")
    (root / "self").symlink_to(root / "self")
    entries = {os.path.relpath(r.path, root): r for r in scan_tree(spark, str(root)).collect()}
    assert set(entries) == {"d", "d/f.txt", "file-link", "loop", "nowhere", "self"}
    assert entries["file-link"].is_symlink and entries["file-link"].size_bytes == 3
    assert entries["file-link"].target == str(root / "d/f.txt")
    assert entries["loop"].kind == "directory" and entries["loop"].is_symlink
    assert {n for n, r in entries.items() if r.kind == "error"} == {"nowhere", "self"}
    scoped = Organizer(spark).plan(Organizer(spark).scan(str(root)), str(root))
    assert {os.path.relpath(r.path, root) for r in scoped.errors.collect()} == {"nowhere", "self"}


def test_what_cannot_be_listed(spark, tmp_path):
    put(tmp_path, {"a/f": b"1"})
    os.mkfifo(tmp_path / "pipe")
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff", "wb") as out:
        out.write(b"x")
    kinds = {r.path: r.kind for r in scan_tree(spark, str(tmp_path)).collect()}
    assert kinds[f"{tmp_path}/pipe"] == "other" and sorted(kinds.values()) == ["directory", "error", "file", "other"]
    assert files_of(scan_tree(spark, str(tmp_path))).where("error is null").count() == 1
    with pytest.raises(ValueError):
        scan_tree(spark, f"{tmp_path}/missing")
    with pytest.raises(ValueError):
        scan_tree(spark, f"{tmp_path}/a/f")


def test_empty_directory(spark, tmp_path):
    assert scan_tree(spark, f"file://{tmp_path}/").count() == 0
    assert Organizer(spark).scan(str(tmp_path)).count() == 0


def test_names_of_stores():
    assert is_remote("s3a://b/k") and is_remote("hdfs://h:1/p") and not is_remote("/a:b") and not is_remote("file:/a")


def digest(content, algorithm, leaf):
    import xxhash

    one = {"sha256": lambda c: hashlib.sha256(c).hexdigest(), "xxhash": lambda c: xxhash.xxh64(c).hexdigest()}[algorithm]
    if len(content) <= leaf:
        return one(content)
    parts = "".join(one(content[i:i + leaf]) for i in range(0, len(content), leaf))
    return "tree:" + hashlib.sha256(parts.encode()).hexdigest()


@pytest.mark.parametrize("algorithm", ["sha256", "xxhash"])
def test_digests(spark, tmp_path, algorithm):
    files = {f"f{n}": bytes(range(256)) * n for n in (0, 1, 2, 3, 16)} | {"same": bytes(range(256)) * 3}
    put(tmp_path, files)
    got = hashing.digests(list_files(spark, str(tmp_path)), algorithm, block_size=100, leaf=512).collect()
    assert {os.path.basename(r.path): r.hash for r in got} == {n: digest(c, algorithm, 512) for n, c in files.items()}
    assert not any(r.error for r in got)


def test_errors_of_any_kind(spark, tmp_path):
    put(tmp_path, {"f": b"abc"})
    paths = [f"{tmp_path}/gone", str(tmp_path), f"{tmp_path}/f/under", "nosuch://store/key", "s3a:///"]
    rows = spark.createDataFrame([(p, n) for p in paths for n in (3, 5000)], "path string, size_bytes bigint")
    got = hashing.digests(rows, leaf=1000).collect()
    assert len(got) == 10 and all(r.hash is None and r.error for r in got)


def test_a_file_that_grew_does_not_look_equal(spark, tmp_path):
    put(tmp_path, {"f": b"x" * 1000})
    listed = hashing.digests(list_files(spark, str(tmp_path)), leaf=300)
    planned = spark.createDataFrame(listed.collect(), listed.schema)
    assert hashing.verify_contents(planned, leaf=300).first().status == "ok"
    put(tmp_path, {"f": b"x" * 1001})
    assert hashing.verify_contents(planned, leaf=300).first().status == "mismatch"


def test_algorithm_is_chosen_once():
    assert hashing.chosen_algorithm("xxhash") == "xxhash"
    assert hashing.chosen_algorithm("sha256") == hashing.chosen_algorithm("md4") == "sha256"


def test_keys_and_hashes_are_apart(spark, tmp_path):
    """A file that was not read has a key and no hash: it is in no resumed run's list of done contents by its size."""
    from shelfmark.operators import dedup, resume

    put(tmp_path, {"a": b"xx", "b": b"xx", "c": b"yy", "alone": b"zzz"})
    got = hashing.hash_files(list_files(spark, str(tmp_path)))
    rows = {os.path.basename(r.path): r for r in got.collect()}
    assert rows["alone"].hash is None and rows["alone"].content_key == "size:3"
    assert rows["a"].hash == rows["a"].content_key == hashlib.sha256(b"xx").hexdigest()
    assert dedup.duplicate_sets(dedup.by_content(got)).count() == 1
    assert {os.path.basename(r.path) for r in dedup.unique_files(dedup.by_content(got)).collect()} == {"c", "alone"}
    progress = got.select(F.lit("r").alias("run_id"), F.lit("/").alias("root"), "hash", F.lit("execution").alias("phase"),
                          F.lit("done").alias("status"), F.current_timestamp().alias("ts"))
    assert [os.path.basename(r.path) for r in resume.remaining(got, progress).collect()] == ["alone"]


@pytest.mark.parametrize("full", [False, True])
def test_integrity_of_a_run(spark, tmp_path, full):
    """Files of one length that change in a move are found when their digests were planned."""
    root = put(tmp_path, {"a.txt": b"one", "b.txt": b"two", "long.txt": b"unique length", "gone.txt": b"unique too"})
    job = Organizer(spark, JobConfig(verify_integrity=full))
    done = job.apply(job.plan(job.scan(str(root)), str(root)))
    for r in done.file_results.collect():
        os.makedirs(os.path.dirname(r.final_destination), exist_ok=True)
        os.rename(r.source, r.final_destination)
    folder = root / "all_Docs/Text"
    (folder / "a.txt").write_bytes(b"oNe")
    (folder / "long.txt").write_bytes(b"UNIQUE length")
    (folder / "gone.txt").unlink()
    got = {os.path.basename(r.source): r.status for r in job.verify(done).file_results.collect()}
    unread = {"long.txt": "mismatch", "gone.txt": "mismatch"} if full else {"long.txt": "ok", "gone.txt": "ok"}
    assert got == {"a.txt": "mismatch", "b.txt": "ok"} | unread


def test_heads(spark, tmp_path):
    text = "é" * 3000
    put(tmp_path, {"short": b"%PDF-1", "cut": text.encode(), "odd": b"a" + text.encode(), "raw": b"\xff" * 5000, "none": b""})
    got = {os.path.basename(r.path): r["head"] for r in hashing.with_heads(list_files(spark, str(tmp_path)), 101).collect()}
    assert got["short"] == b"%PDF-1" and got["none"] == b""
    assert got["cut"].decode() == "é" * 50 and got["odd"].decode() == "a" + "é" * 50 and len(got["raw"]) in (100, 101)
    gone = spark.createDataFrame([(f"{tmp_path}/gone",)], "path string")
    assert hashing.with_heads(gone).first()["head"] is None


def test_types_in_a_run(spark, tmp_path):
    root = put(tmp_path, {"paper.dat": b"%PDF-1.7", "photo": b"\x89PNG\r\n\x1a\n....", "tool.txt": b"#!/bin/sh\necho", "x.mp3": b"\0\1"})
    job = Organizer(spark, JobConfig(use_magic=True))
    inventory = job.scan(str(root))
    assert "content" not in inventory.columns and "head" not in inventory.columns
    got = {os.path.basename(r.source): f"{r.category}/{r.subcategory}" for r in job.plan(inventory, str(root)).ops.collect()}
    assert got == {"paper.dat": "Docs/PDFs", "photo": "Pics/Photos", "tool.txt": "Code/Shell", "x.mp3": "Audio/Music"}


def test_heads_are_read_apart_from_digests(spark, tmp_path, monkeypatch):
    """A task holds one Python worker: what the heads are read for is a written table, not the hashing itself."""
    root = put(tmp_path, {"a.dat": b"%PDF-1.7", "b.dat": b"#!/bin/sh", "c.dat": b"plain"})
    plans, plain = [], hashing.with_heads

    def seen(files, *more):
        plans.append(files._jdf.queryExecution().toString())
        return plain(files, *more)

    monkeypatch.setattr(hashing, "with_heads", seen)
    assert Organizer(spark, JobConfig(use_magic=True)).scan(str(root)).count() == 3
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_progress_is_told(spark, tmp_path):
    root = put(tmp_path, {"a.txt": b"one", "b.txt": b"two", ".hidden": b"x"})
    steps = []
    job = Organizer(spark, on_progress=lambda step, rows: steps.append((step, rows)))
    job.apply(job.plan(job.scan(str(root)), str(root)))
    assert steps == [("listed", 3), ("inventory", 3), ("ops", 2), ("resolved", 2), ("results", 3)]
