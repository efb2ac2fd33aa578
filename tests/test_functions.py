import hashlib
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import formats, paths
from shelfmark.functions.globs import glob_regex
from shelfmark.functions.metadata import normalised_tags, organization_key
from shelfmark.functions.sketch import average_sketch, hamming

NAMES = ["a.txt", "a.tar.gz", ".bashrc", "a.", "noext", "..txt", "A.PDF", "a..b", "x._1", "sp ace.jpg"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


def test_path_parts_agree_with_pathlib(spark):
    for folder in ("/", "/r/", "/r.d/x/"):
        rows = spark.createDataFrame([(folder + n,) for n in NAMES], "p string")
        p = F.col("p")
        for r in rows.select(
            "p", paths.suffix(p).alias("suffix"), paths.stem(p).alias("stem"), paths.base_name(p).alias("name"),
            paths.parent(p).alias("parent"), paths.extension(p).alias("ext"),
        ).collect():
            q = PurePosixPath(r.p)
            assert (r.suffix, r.stem, r.name, r.parent, r.ext) == (
                q.suffix, q.stem, q.name, str(q.parent), q.suffix.lower()
            )


def test_ancestors(spark):
    assert one(spark, paths.ancestors(F.lit("/r/a/b/c.txt"), "/r")) == ["/r", "/r/a", "/r/a/b"]
    assert one(spark, paths.ancestors(F.lit("/r/c.txt"), "/r")) == ["/r"]
    assert one(spark, paths.ancestors(F.lit("/a/c.txt"), "/")) == ["/", "/a"]


@pytest.mark.parametrize("size,text", [
    (0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.2 KB"),
    (1024**2, "1.0 MB"), (int(2.5 * 1024**3), "2.5 GB"), (1024**4, "1.0 TB"), (3 * 1024**5, "3.0 PB"),
    (2000 * 1024**5, "2000.0 PB"),
])
def test_format_size(spark, size, text):
    assert one(spark, formats.format_size(F.lit(size).cast("bigint"))) == text


@pytest.mark.parametrize("seconds,text", [
    (0.0, "0.0s"), (2.5, "2.5s"), (59.94, "59.9s"), (60.0, "1m 0s"), (90.0, "1m 30s"), (3599.0, "59m 59s"),
    (3900.0, "1h 5m"), (90000.0, "25h 0m"),
])
def test_format_duration(spark, seconds, text):
    assert one(spark, formats.format_duration(F.lit(seconds))) == text


def test_sanitize_truncate_and_escape(spark):
    assert one(spark, paths.sanitize(F.lit("a\nb\rc\td\x00e\x01f"))) == "a_b_c_def"
    assert one(spark, paths.truncate_middle(F.lit("/" + "x" * 100), 20)) == "/xxxxxxx...xxxxxxxxx"
    assert one(spark, paths.truncate_middle(F.lit("/short"), 20)) == "/short"
    assert one(spark, paths.normalised(F.lit("/a/./b/../../../c//d/"))) == "/c/d"
    assert one(spark, paths.escapes(F.lit("/base/../../etc/passwd"), "/base"))
    assert not one(spark, paths.escapes(F.lit("/base/x/../y"), "/base"))
    assert one(spark, paths.escapes(F.lit("/base/x"), "/base", F.lit("/base2/y")))
    assert not one(spark, paths.escapes(F.lit("/base/x"), "/base", F.lit("../y")))


def test_globs_agree_with_pathlib():
    globs = ["**/.git/**", "*.txt", "a/*/c.py", "/r/*", "/*", "**", "[ab]*.t?t", "[!a]*.txt", "x[]]y", "a.b+c", "*", "?"]
    names = ["/node_modules/x", "/r/a/.git/x/y", "/r/.git/config", "/a.txt", "/r/b.txt", "/r/a/b/c.py", "/r", "/r/x]y",
             "/a.b+c", "/aabbc", "/q", "/r/a.txt"]
    for glob in globs:
        for name in names:
            assert bool(re.search(glob_regex(glob), name)) == PurePosixPath(name).match(glob), (glob, name)


def test_recursive_globs():
    regex = glob_regex("**/.git/**", recursive=True)
    assert re.search(regex, "/r/.git/a/b") and re.search(regex, "/.git/a") and not re.search(regex, "/r/.git")


def test_tags(spark):
    raw = F.create_map(
        F.lit("albumartist"), F.array(F.lit("A"), F.lit("B")), F.lit("date"), F.array(F.lit("1999")),
        F.lit("bitrate"), F.array(F.lit("320.9")), F.lit("width"), F.array(F.lit("5")),
    )
    tags = one(spark, normalised_tags(raw, F.lit(".mp3")))
    assert tags == {"album_artist": "A", "year": "1999", "bitrate": "320"}
    assert one(spark, normalised_tags(raw, F.lit(".jpg"))) == {"width": "5"}
    assert one(spark, normalised_tags(raw, F.lit(".txt"))) == {}
    key = organization_key(normalised_tags(raw, F.lit(".mp3")), F.lit(".mp3"), "id3-artist")
    assert one(spark, key) == "A"
    assert one(spark, organization_key(raw, F.lit(".mp3"), "nonsense")) is None


def test_average_sketch(spark):
    grid = [float(i) for i in range(64)]
    want = sum(1 << i for i in range(32, 64))
    got = one(spark, average_sketch(F.array(*[F.lit(v) for v in grid])))
    assert got & (2**64 - 1) == want
    assert one(spark, average_sketch(F.array(F.lit(1.0)))) is None
    assert one(spark, hamming(F.lit(5).cast("bigint"), F.lit(-1).cast("bigint"))) == 62


def test_sha_and_sniffing(spark):
    from shelfmark.sources.hashing import content_hash
    from shelfmark.sources.mime import sniffed_mime

    assert one(spark, content_hash(F.lit(b"abc"))) == hashlib.sha256(b"abc").hexdigest()
    for content, mime in [
        (b"%PDF-1.4", "application/pdf"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"ID3\x03", "audio/mpeg"),
        (b"\x00\x00\x00\x18ftypmp42", "video/mp4"), (b"PK\x03\x04", "application/zip"),
        (b"<!DOCTYPE html><html>", "text/html"), (b'{"a": 1}', "application/json"), (b"#!/bin/bash\n", "text/x-shellscript"),
        (b"plain words", "text/plain"), (b"", None), (b"\x00\x01", None), (b"\xc3\x28\xff", None),
        (b"RIFF\x00\x00\x00\x00WEBPVP8 ", "image/webp"),
    ]:
        assert one(spark, sniffed_mime(F.lit(content))) == mime
