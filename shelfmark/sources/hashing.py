"""Content hashes of files, and reading the head of each."""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import by_value
from shelfmark.sources.files import blocks, failure, open_at

by_value(__name__)

BLOCK = 65536
LEAF = 256 << 20  # bytes of an object that one task hashes; a larger object is a tree of them
HEAD = 4096  # bytes from which a type is told
TREE = "tree:"


def chosen_algorithm(wanted: str) -> str:
    """The algorithm that all tasks of a job use: ``sha256`` or ``xxhash`` (XXH64, seed 0).

    Decided once, on the driver; a task without the library gives an error row and never another digest. An unknown
    name, and xxHash where its library is missing, mean SHA-256.
    """
    if wanted == "xxhash" and importlib.util.find_spec("xxhash"):
        return "xxhash"
    return "sha256"


def content_hash(content: Column) -> Column:
    """SHA-256 of a value that fits in a row."""
    return F.sha2(content, 256)


def content_group(content: Column) -> Column:
    """64 bits that are equal where contents are: a key to group by within a job, no digest to keep."""
    return F.xxhash64(content)


def _hasher(algorithm: str):
    if algorithm == "xxhash":
        import xxhash

        return xxhash.xxh64()
    return hashlib.sha256()


def _digest(path: str, offset: int, length: int | None, algorithm: str, block_size: int) -> tuple[str | None, str | None]:
    """(digest, error) of a part of an object; one of them is null."""
    try:
        state = _hasher(algorithm)
        for block in blocks(path, offset, length, block_size):
            state.update(block)
        return state.hexdigest(), None
    except Exception as error:  # whatever a store may raise: one object, one error
        return None, failure(error)


def _with_columns(work: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str], rows: int):
    """A task function that adds columns; ``rows`` at a time, so that long reads show progress and stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.record_batch([*part.columns, *work(part)], [*part.schema.names, *names])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def digests(files: DataFrame, algorithm: str = "sha256", block_size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``files`` (path, size_bytes) with ``hash`` and ``error``: what cannot be read has a null hash and a message.

    Objects are read in blocks inside the tasks. One of more than ``leaf`` bytes is cut into leaves that many tasks
    hash, and its hash is the SHA-256 of the leaves' digests in order, marked as such: equal contents have equal hashes,
    since equal sizes are cut alike. The last leaf reads to the object's end, so one that has grown does not look equal.
    """
    algorithm = chosen_algorithm(algorithm)
    files = files.drop("hash", "error")
    large = F.coalesce(F.col("size_bytes") > leaf, F.lit(False))

    def whole(part: pa.RecordBatch) -> list[pa.Array]:
        found = [_digest(path, 0, None, algorithm, block_size) for path in part["path"].to_pylist()]
        return [pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]

    def piece(part: pa.RecordBatch) -> list[pa.Array]:
        found = [
            _digest(path, n * leaf, None if n == last else leaf, algorithm, block_size)
            for path, n, last in zip(*(part[c].to_pylist() for c in ("path", "leaf", "last")))
        ]
        return [pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]

    names, ddl = ["hash", "error"], "hash string, error string"
    small = files.where(~large).repartition("path")
    hashed = small.mapInArrow(_with_columns(whole, names, 64), f"{_ddl(small)}, {ddl}")

    last = F.ceil(F.col("size_bytes") / leaf) - 1
    leaves = files.where(large).select("path", last.cast("bigint").alias("last")).distinct().withColumn(
        "leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).repartition("path", "leaf")
    trees = leaves.mapInArrow(_with_columns(piece, names, 1), f"{_ddl(leaves)}, {ddl}").groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("leaf", "hash"))).alias("parts"), F.min("error").alias("error"))
    joined = F.sha2(F.array_join(F.col("parts.hash"), ""), 256)
    trees = trees.select(
        "path", F.when(F.col("error").isNull(), F.concat(F.lit(TREE), joined)).alias("hash"), "error")
    return hashed.unionByName(files.where(large).join(trees, "path"))


def shared_sizes(files: DataFrame) -> DataFrame:
    """Sizes seen more than once: only such files can have a copy."""
    return files.where("size_bytes is not null").groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("size_bytes")


def hash_files(files: DataFrame, algorithm: str = "sha256", block_size: int = BLOCK, leaf: int = LEAF,
               all_files: bool = False) -> DataFrame:
    """``files`` with ``hash, content_key, error``.

    ``hash`` is a digest of bytes that were read, or null. ``content_key`` is what files are grouped by: the hash, or a key
    of its own for a file whose size nobody shares and which is not read, unless ``all_files`` asks for it. Both are
    null where ``error`` says why the file could not be read. Rows that come with an error keep it.
    """
    known = files.where("error is not null") if "error" in files.columns else files.where("false")
    fine = files.where("error is null").drop("error") if "error" in files.columns else files
    if all_files:
        done = digests(fine, algorithm, block_size, leaf)
    else:
        shared = shared_sizes(fine)
        none = F.lit(None).cast("string")
        alone = fine.join(shared, "size_bytes", "left_anti").withColumn("hash", none).withColumn("error", none)
        done = digests(fine.join(shared, "size_bytes", "left_semi"), algorithm, block_size, leaf).unionByName(alone)
    alone_key = F.concat(F.lit("size:"), F.col("size_bytes"))
    key = F.when(F.col("error").isNull(), F.coalesce("hash", alone_key))
    return done.unionByName(known, allowMissingColumns=True).withColumn("content_key", key)


def with_heads(files: DataFrame, size: int = HEAD) -> DataFrame:
    """``files`` with the first ``size`` bytes of each as ``head``, null where they cannot be read.

    A character of several bytes at the cut is left out as a whole.
    """
    def head(path: str) -> bytes | None:
        try:
            with open_at(path) as stream:
                data = stream.read(size)
        except Exception:  # the hash's error row tells of it
            return None
        if len(data) < size:
            return data
        for back in range(1, 4):
            lead = data[-back]
            if lead >= 0xC0:
                needs = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return data[:-back] if needs > back else data
            if lead < 0x80:
                break
        return data

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([head(path) for path in part["path"].to_pylist()], pa.binary())]

    return files.mapInArrow(_with_columns(work, ["head"], 256), f"{_ddl(files)}, head binary")


def verify_contents(planned: DataFrame, algorithm: str = "sha256", block_size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Reads the objects of ``planned`` (path, size_bytes, hash) anew and compares: ``path, planned_hash, actual_hash,
    status, error``.

    ``status`` is ok, mismatch, missing (nothing there to read) or unverified (no digest was planned, as of a file that
    was never read). Every object with a planned digest is read, whatever other files have its size.
    """
    named = planned.select("path", "size_bytes", F.col("hash").alias("planned_hash"))
    read = digests(named.where("planned_hash is not null"), algorithm, block_size, leaf).withColumnRenamed("hash", "actual_hash")
    rest = named.where("planned_hash is null").withColumn("actual_hash", F.lit(None).cast("string")).withColumn(
        "error", F.lit(None).cast("string"))
    status = (
        F.when(F.col("planned_hash").isNull(), "unverified")
        .when(F.col("actual_hash").isNull(), "missing")
        .when(F.col("planned_hash") == F.col("actual_hash"), "ok")
        .otherwise("mismatch")
    )
    return read.unionByName(rest).select("path", "planned_hash", "actual_hash", status.alias("status"), "error")
