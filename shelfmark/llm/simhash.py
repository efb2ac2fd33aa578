"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfmark.llm.common import by_value, components, id_and_text, staged, values

by_value(__name__)

BITS = 64
CHUNK = 1 << 16  # hashes counted at once
# Pairs of a bucket are compared directly up to this size; members of larger ones go through shared neighbours.
CALM = 32


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of ``text``, repeats included, as an unsigned number."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[words - 1:] if len(found) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, code) for every row; code holds the 64 bits as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t, words) for t in values(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return id_and_text(docs).mapInArrow(each, "doc_id bigint, code bigint")


def pivots(blocks: int = 32) -> list[int]:
    """Reference fingerprints, each with the bits of one block set; the first is zero."""
    width = BITS // blocks
    return [0, *(((1 << width) - 1) << (width * b) for b in range(blocks))]


def distance(code: Column, pivot: int) -> Column:
    return F.bit_count(code.bitwiseXOR(F.lit(pivot - (1 << 64) if pivot >> 63 else pivot)))


def links(codes: DataFrame, radius: int = 2, groups: int = 4) -> DataFrame:
    """Links (a, b) that join all of ``codes`` (distinct) differing in at most ``radius`` = 2 bits.

    Every fingerprint gets its distances to the pivots. From two of them, d(x, 0) and d(x, block), follows how
    many bits of the block are set, so a pair within 2 bits differs in the tables of 2 blocks at most, and of
    the groups of blocks all but 2 agree: the pair meets in a bucket of one choice of groups. Pairs of a bucket
    whose tables differ by more than 2 anywhere are discarded, the others verified. A bucket with more
    than ``CALM`` members doesn't list its pairs: its members are linked through fingerprints next to both
    (two codes are within 2 bits if one code is within 1 bit of both), groups of 65 at most.
    """
    if radius != 2:
        raise ValueError("the shared neighbours are those of radius 2")
    refs = pivots()
    tables = codes.select("code", F.array(*[distance(F.col("code"), p).cast("tinyint") for p in refs]).alias("table"))
    cuts = [round(i * (len(refs) - 1) / groups) for i in range(groups + 1)]

    def digits(g: int) -> Column:
        total = F.lit(0).cast("bigint")
        for b in range(cuts[g], cuts[g + 1]):  # 0, 1 or 2 of the block's two bits are set
            total = total * 3 + (F.col("table")[0] + 2 - F.col("table")[b + 1]).cast("bigint") / F.lit(2)
        return total.cast("bigint")

    parts = tables.select("code", "table", *[digits(g).alias(f"g{g}") for g in range(groups)])
    choices = list(itertools.combinations(range(groups), groups - radius))
    rows = parts.select("code", "table", F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("choice"),
                 F.array(*[F.col(f"g{g}") for g in choice]).alias("at")) for i, choice in enumerate(choices)
    ])).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes, "simhash-buckets")
    calm = (
        rows.join(sizes.where(F.col("n") <= CALM), "key")
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("code", "table"))).alias("m"))  # CALM at most
    )
    first = calm.select(F.posexplode("m").alias("i", "x"), "m")
    pairs = first.select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    apart = F.array_max(F.zip_with("x.table", "y.table", lambda p, q: F.abs(p - q)))
    close = pairs.where(apart <= radius).where(F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= radius)
    found = close.select(F.col("x.code").alias("a"), F.col("y.code").alias("b"))

    dense = sizes.where(F.col("n") > CALM)
    members = rows.join(dense, "key", "left_semi").select("code").distinct()
    flips = [0, *(1 << b for b in range(BITS - 1)), -(1 << 63)]
    around = members.select("code", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"))
    near = (
        around.groupBy(F.col("code").bitwiseXOR(F.col("flip")).alias("z"))
        .agg(F.min("code").alias("a"), F.collect_list("code").alias("m"))  # 65 at most
        .where(F.size("m") > 1).select("a", F.explode("m").alias("b"))
    )
    return found.union(near).where("a <> b").distinct()


def classes(codes: DataFrame, groups: int = 4) -> DataFrame:
    """(code, class_id): the smallest doc_id reachable from each distinct code of (doc_id, code)."""
    firsts = staged(codes.groupBy("code").agg(F.min("doc_id").alias("first_id")), "simhash-codes")
    tree = components(links(firsts.select("code"), groups=groups), "simhash-links")
    rooted = firsts.join(tree.withColumnRenamed("node", "code"), "code", "left") \
        .select("code", "first_id", F.coalesce("root", "code").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return rooted.join(least, "root").select("code", "first_id", "class_id", "root")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and blank texts have the fingerprint zero and are linked like any other; a null doc_id is never a
    component's id unless it has no other; repeated rows are answered each; an empty table gives no rows.
    """
    codes = staged(fingerprints(docs, words), "simhash")
    return codes.join(classes(codes).select("code", "class_id"), "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), F.col("class_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (ties: the least row).

    Rows whose doc_id is theirs alone are chosen by doc_id. Only where a doc_id occurs again, or is null, are the
    fingerprints looked at once more, and the least row of the class's own is taken by an aggregate.
    """
    codes = staged(fingerprints(docs, words), "simhash")
    found = staged(classes(codes), "simhash-classes")
    winner = found.groupBy("root").agg(F.min(F.struct(
        F.coalesce(F.col("first_id"), F.lit((1 << 63) - 1)).alias("o"), F.col("code").alias("c"),
        F.col("first_id").alias("i"))).alias("w")).select(F.col("w.i").alias("_id"), F.col("w.c").alias("_code"))
    winner = staged(winner, "simhash-winners")
    again = staged(codes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
                   .select(F.col("doc_id").alias("_id")), "simhash-again")
    wide = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = F.col(at["doc_id"]).cast("bigint")
    plain = wide.join(winner.join(again, winner["_id"].eqNullSafe(again["_id"]), "left_anti"),
                      own == F.col("_id"), "left_semi")
    twice = wide.join(again, own.eqNullSafe(F.col("_id")), "left_semi")
    schema = StructType([*twice.schema.fields, StructField("_c", LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = values(batch.column(batch.schema.get_field_index(at["text"])))
            codes = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, batch.num_rows)
            yield batch.append_column("_c", pa.array(codes.view(np.int64)))

    twice = twice.mapInArrow(coded, schema)
    twice = (
        twice.join(winner, own.eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_code")), "left_semi")
        .groupBy(at["doc_id"], "_c").agg(F.min(F.struct(*at.values())).alias("r"))
        .select("r.*")
    )
    return plain.unionByName(twice).select([F.col(v).alias(k) for k, v in at.items()])
