import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import JobConfig, Organizer
from shelfmark.operators import resume
from shelfmark.plans import report
from shelfmark.sources import inventory as inv
from shelfmark.sources import layout, oplog, rules


@pytest.fixture
def tree(tmp_path):
    contents = {
        "document.pdf": b"pdf", "image.jpg": b"\xff\xd8\xff", "copy.jpg": b"\xff\xd8\xff", "same_size.txt": b"abc",
        "all_Docs/Text/old.txt": b"text one", "all_Docs/Text/new.md": b"text one", "MyFolder/nested.txt": b"never read",
    }
    for name, content in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path, contents


def test_scan_hashes_only_shared_sizes_in_scope(spark, tree):
    root, _ = tree
    got = {os.path.relpath(r.path, root): r.hash for r in Organizer(spark).scan(str(root)).collect()}
    assert got["MyFolder/nested.txt"] is None
    assert got["image.jpg"] == got["copy.jpg"] == hashlib.sha256(b"\xff\xd8\xff").hexdigest()
    assert got["document.pdf"] != got["same_size.txt"] == hashlib.sha256(b"abc").hexdigest()
    assert got["all_Docs/Text/old.txt"] == got["all_Docs/Text/new.md"]


def test_scan_to_plan(spark, tree):
    root, _ = tree
    job = Organizer(spark)
    plan = job.plan(job.scan(str(root)), str(root))
    got = {(os.path.relpath(r.source, root), os.path.relpath(r.destination, root)) for r in plan.ops.collect()}
    assert got == {
        ("document.pdf", "all_Docs/PDFs/document.pdf"), ("copy.jpg", "all_Pics/Photos/copy.jpg"),
        ("image.jpg", "all_Duplicates/image.jpg"), ("same_size.txt", "all_Docs/Text/same_size.txt"),
        ("all_Docs/Text/old.txt", "all_Duplicates/all_Docs/Text/old.txt"),
    }
    assert [r.destination for r in plan.dir_ops.collect()] == [f"{root}/all_Folders/MyFolder"]


def test_unreadable_files_become_errors(spark, inventory):
    rows = inventory(("/r/a.txt", None), ("/r/b.txt", "x"))
    plan = Organizer(spark).plan(rows, "/r")
    assert [r.path for r in plan.errors.collect()] == ["/r/a.txt"]
    assert [r.source for r in plan.ops.collect()] == ["/r/b.txt"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_inventory_tables(spark, inventory, tmp_path, fmt):
    rows = inventory(("/r/a.txt", "x"), ("/r/b.txt", "y"))
    writer = rows.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(f"{tmp_path}/t")
    assert set(inv.read_inventory(spark, f"{tmp_path}/t", fmt).collect()) == set(rows.collect())


def test_json_log(spark, tmp_path):
    moves = [{"timestamp": "t", "source": f"/a{i}", "destination": f"/b{i}"} for i in range(3)]
    (tmp_path / "ok.json").write_text(json.dumps({"version": "1.0", "root_dir": "/r", "operations": moves}, indent=2))
    got = [(r.op_pos, r.source, r.destination) for r in oplog.read_json_log(spark, str(tmp_path / "ok.json")).collect()]
    assert got == [(i, f"/a{i}", f"/b{i}") for i in range(3)]
    (tmp_path / "none.json").write_text('{"version": "1.0", "root_dir": "/r"}')
    assert oplog.read_json_log(spark, str(tmp_path / "none.json")).first().op_pos is None
    (tmp_path / "bad.json").write_text('{"version": ')
    with pytest.raises(Exception):
        oplog.read_json_log(spark, str(tmp_path / "bad.json")).collect()


def test_layout_keeps_numeric_names(spark, tmp_path):
    rows = spark.createDataFrame([("/a", "2024", "01-02"), ("/b", "2024", "01-03")], "path string, category string, subcategory string")
    layout.write_layout(rows, f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out/category=2024")) == ["subcategory=01-02", "subcategory=01-03"]
    assert set(layout.read_layout(spark, f"{tmp_path}/out", "path string").collect()) == set(rows.collect())


def test_rules_roundtrip(spark, tmp_path):
    table = rules.default_rules(spark)
    rules.save_rules(table, f"{tmp_path}/rules")
    assert set(rules.load_rules(spark, f"{tmp_path}/rules").collect()) == set(table.collect())


def test_config_roundtrip(spark, tmp_path):
    cfg = JobConfig(strategy="hybrid", classification_rules={"Extra": {"Sub": [".x"]}}, ignore_patterns=("*.tmp",))
    rules.save_config(spark, cfg, f"{tmp_path}/cfg")
    assert rules.load_config(spark, f"{tmp_path}/cfg") == cfg
    assert rules.load_config(spark, f"{tmp_path}/missing") == JobConfig()


def test_config_of_a_user(spark, tmp_path, caplog):
    (tmp_path / "own.yaml").write_text("""# mine
strategy: by-extension
ignore_patterns: ["*.tmp", '#*#']   # editors leave them
classification_rules:
  Docs:
    Papers:
      - .pdf
      - .ps
""")
    cfg = rules.load_config(spark, f"{tmp_path}/own.yaml")
    assert cfg.ignore_patterns == ("*.tmp", "#*#") and cfg.classification_rules == {"Docs": {"Papers": [".pdf", ".ps"]}}
    found = {r.rule_ext: r.subcategory for r in rules.extension_lookup(Organizer(spark, cfg).rules).collect()}
    assert found[".pdf"] == "Papers" and ".docx" not in found and found[".mp3"] == "Music"
    for broken in ("strategy: [", "strategy: by-magic", "- a\n- b", "a: 1\n   b: 2", "strategy: *ref"):
        caplog.clear()
        (tmp_path / "broken.yaml").write_text(broken)
        assert rules.load_config(spark, f"{tmp_path}/broken.yaml") == JobConfig()
        assert "broken.yaml" in caplog.text
    (tmp_path / "nothing.yaml").write_text("# only a comment\n")
    assert rules.load_config(spark, f"{tmp_path}/nothing.yaml") == JobConfig()


@pytest.mark.parametrize("text, value", [
    ("a: 1\nb: -2.5\nc: yes\nd: ~\ne: '1'\nf: \"x\\n\"\ng: it's # not\n",
     {"a": 1, "b": -2.5, "c": True, "d": None, "e": "1", "f": "x\n", "g": "it's"}),
    ("a:\n- 1\n- b: 2\n  c: [x, {y: z}, []]\n-\n  - deep\nd: {}\n", {"a": [1, {"b": 2, "c": ["x", {"y": "z"}, []]}, ["deep"]], "d": {}}),
    ("---\n- a: 1\n-\n- 'it''s'\n", [{"a": 1}, None, "it's"]),
    ("url: http://x/y#z\n\"k: 1\": v\n", {"url": "http://x/y#z", "k: 1": "v"}),
    ("", None),
])
def test_plain_yaml(text, value):
    from shelfmark.sources.plain_yaml import plain_yaml

    assert plain_yaml(text) == value


@pytest.mark.parametrize("text", ["a: [1", "a: {b 1}", "a: 1\na: 2", "a:\n\tb: 1", "- 1\nb: 2", "a: 'x", "a: |\n  x", "a: [1] 2"])
def test_broken_yaml(text):
    from shelfmark.sources.plain_yaml import plain_yaml

    with pytest.raises(ValueError, match="line"):
        plain_yaml(text)


def test_resume(spark, inventory):
    files = inventory(("/r/a", "x"), ("/r/b", "x"), ("/r/c", "y"))
    progress = spark.sql(
        "select 'r1' run_id, '/r' root, 'x' hash, 'execution' phase, 'done' status, timestamp '2024-01-01' ts"
    )
    assert [r.path for r in resume.remaining(files, progress).collect()] == ["/r/c"]
    one_copy = progress.withColumn("path", F.lit("/r/a"))
    assert {r.path for r in resume.remaining(files, one_copy, ["path", "hash"]).collect()} == {"/r/b", "/r/c"}
    assert resume.progress_summary(progress, F.lit(0)).first().percent == 0.0


def test_progress_is_saved_and_cleared(spark, inventory, tmp_path):
    folder = f"{tmp_path}/progress"
    assert resume.read_progress(spark, folder).count() == 0
    files = inventory(("/r/a", "x"), ("/r/b", "y"), ("/r/c", "z"), ("/r/unread", None))
    resume.save_progress(files.where("hash = 'x' or hash is null"), folder, "r1", "/r", "execution")
    resume.save_progress(files.where("hash = 'y'"), folder, "r1", "/r", "execution", resume.FAILED)
    saved = resume.read_progress(spark, folder)
    assert {r.path for r in resume.remaining(files, saved).collect()} == {"/r/b", "/r/c", "/r/unread"}
    assert [tuple(r) for r in resume.progress_summary(saved, F.lit(4)).select("root", "completed", "failed").collect()] == [("/r", 2, 1)]
    assert [r.run_id for r in resume.latest_runs(saved).collect()] == ["r1"]
    resume.clear_progress(spark, folder, "r1", "/r")
    saved = resume.read_progress(spark, folder)
    assert resume.latest_runs(saved).count() == 0 and resume.current(saved).count() == 0
    resume.save_progress(files.where("hash = 'z'"), folder, "r2", "/r", "analysis")
    saved = resume.current(resume.read_progress(spark, folder))
    assert {r.path for r in resume.remaining(files, saved).collect()} == {"/r/a", "/r/b", "/r/unread"}
    with pytest.raises(ValueError):
        resume.save_progress(files, folder, "r2", "/r", "dreaming")


def test_reports(spark, inventory, tmp_path):
    files = inventory(("/r/a.pdf", "x", 2048), ("/r/bb.pdf", "x", 2048), ("/r/c.txt", "y"), ("/r/gone.txt", "z"))
    job = Organizer(spark)
    done = job.apply(job.plan(files, "/r"))
    from shelfmark.operators.apply import operation_results

    results = operation_results(done.plan.resolved, files.where("hash <> 'z'"))
    items = {r["item"]: r["value"] for r in report.summary_report(results, done.plan.sets, "/r", created=done.created).collect()}
    assert items == {
        "Status": "COMPLETED WITH ERRORS", "Root Directory": "/r", "Total Files Processed": "3", "Operations Failed": "1",
        "Success Rate": "75.0%", "Duplicate Sets Found": "1", "Duplicate Files": "1", "Space Recoverable": "2.0 KB",
        "Directories Created": "3",
    }
    text = report.text_report(results, done.plan.sets, "/r", done.created, max_directories=2)
    report.save_text_report(text, f"{tmp_path}/text")
    lines = [
        line for part in sorted(os.listdir(f"{tmp_path}/text")) if part.endswith(".txt")
        for line in open(f"{tmp_path}/text/{part}").read().splitlines()
    ]
    assert lines[:5] == ["=" * 80, "ORGANIZATION REPORT", "=" * 80, "Root Directory: /r", "Mode: EXECUTE"]
    assert lines[lines.index("DIRECTORIES CREATED") + 2:][:3] == [
        "  + /r/all_Docs/PDFs", "  + /r/all_Docs/Text", "  ... and 1 more"
    ]
    assert lines[lines.index("ERRORS") + 2:][:2] == ["  ❌ /r/gone.txt", "     Error: Source file does not exist: /r/gone.txt"]
    assert lines[-3:] == ["=" * 80, "END OF REPORT", "=" * 80]
    report.save_json_report(f"{tmp_path}/json", results, files, done.plan.sets, "/r", done.created, done.removed,
                            errors=done.plan.errors, duration_seconds=1.5)
    assert os.path.isdir(f"{tmp_path}/json/errors")
    sets = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json/duplicates").collect()]
    assert sets == [{"hash": "x", "count": 2, "size_bytes": 2048, "primary": "/r/a.pdf", "extras": ["/r/bb.pdf"], "part": 1, "parts": 1}]
    head = json.loads(spark.read.text(f"{tmp_path}/json/summary").first().value)
    assert head["summary"]["successful_operations"] == 3 and head["duplicates"]["sets_found"] == 1
    assert head["summary"]["duration_seconds"] == 1.5 and head["generated_at"][:2] == "20"
    assert spark.read.text(f"{tmp_path}/json/operations/section=failed").count() == 1


def test_report_of_a_large_set(spark, inventory):
    files = inventory(*[(f"/r/{n:05d}", "x") for n in range(1501)])
    sets = files.groupBy("hash").agg(F.count(F.lit(1)).alias("cnt"), F.min("size_bytes").alias("size_bytes"), F.min("path").alias("primary"))
    got = [json.loads(r.document) for r in report.duplicates_section(files, sets, hot_rows=200).collect()]
    assert sorted((d["part"], d["parts"], len(d["extras"])) for d in got) == [(1, 2, 1000), (2, 2, 500)]
    assert sorted(p for d in got for p in d["extras"]) == [f"/r/{n:05d}" for n in range(1, 1501)]


def test_content_and_tags_do_not_travel(spark):
    """Contents are looked at in the scan stage and never shuffled."""
    files = spark.createDataFrame(
        [("/r/a.bin", 4, "x", b"%PDF", False)], "path string, size_bytes bigint, hash string, content binary, is_symlink boolean"
    ).selectExpr("*", "timestamp '2024-01-01' as modified_time")
    plan = Organizer(spark, JobConfig(use_magic=True)).plan(files, "/r")
    assert plan.ops.first().destination == "/r/all_Docs/PDFs/a.bin"
    text = plan.ops._jdf.queryExecution().optimizedPlan().toString()
    for line in text.splitlines():
        if "Aggregate" in line:
            assert "content" not in line
