"""Personal data: fixed forms, and identifiers found by bootstrapped contextual extraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shelfmark.llm.common import by_value, id_and_text, slices, staged, unused_name, values

by_value(__name__)

# The forms. Possessive runs and starts bound to a run's start find the same matches in linear time.
KINDS = ["email", "ip", "card", "phone", "id"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_SIGNS = "".join(sorted(_LOCAL))
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9_-]++")

# An identifier: a token of these lengths with a digit. A pattern: so many words before, within so many characters.
SHORTEST, LONGEST, BEFORE, REACH = 6, 64, 2, 80
ROUNDS, DOUBT, CONFIDENT = 3, 2.0, 0.7

Span = tuple[int, int, int]  # start, kind's number, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def fixed(text: str) -> list[Span]:
    """Spans of the fixed forms, sorted."""
    found = []
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        if at > end and text[at - 1] in _LOCAL:
            found.append((end + len(text[end:at].rstrip(_LOCAL_SIGNS)), 0, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def others(text: str, known: list[Span]) -> list[tuple[int, int]]:
    """Tokens that look like identifiers and touch no known span."""
    found, upto, i, reach = [], 0, 0, 0
    for m in _DIGIT.finditer(text):
        if m.start() < upto:
            continue
        left = text[max(upto, m.start() - LONGEST):m.start()]
        start = m.start() - len(left) + len(left.rstrip(_TOKEN_SIGNS))
        upto = _TOKEN.match(text, start).end()
        while i < len(known) and known[i][0] < upto:
            reach = max(reach, known[i][2])
            i += 1
        if SHORTEST <= upto - start <= LONGEST and reach <= start:
            found.append((start, upto))
    return found


_TOKEN_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"


def pattern(text: str, start: int) -> str | None:
    """The words before ``start``, without signs and case; None at a text's beginning."""
    words = [w for w in (x.strip(".,;:!?\"'()[]=*#$%&|<>").lower() for x in text[max(0, start - REACH):start].split())
             if w]
    return " ".join(words[-BEFORE:]) or None


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 63)


_FOUND = StructType([StructField("start", LongType()), StructField("end", LongType()),
                     StructField("seed", LongType()), StructField("pattern", LongType()),
                     StructField("instance", LongType())])
_READ = StructType([
    StructField("doc_id", LongType()), StructField("hash", StringType()),
    StructField("counts", ArrayType(LongType())), StructField("base", StringType()),
    StructField("found", ArrayType(_FOUND))])


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, counts, base, found) for every row: spans of the fixed forms in ``base``; in ``found`` all
    entities with their lexical pattern: the seeds (seed = 1), which are those spans, and tokens that may be more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts, bases, found = [], [], [], []
            for text in values(batch.column(1)):
                text = text or ""
                spans = fixed(text)
                hashes.append(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest())
                counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
                bases.append(join(spans))
                rows = []
                for seed, start, end in ([(1, s, e) for s, _, e in spans]
                                         + [(0, s, e) for s, e in others(text, spans)]):
                    before = pattern(text, start)
                    if before is not None:
                        rows.append((start, end, seed, number(before), number(text[start:end].lower())))
                found.append([dict(zip(_FOUND.names, r)) for r in rows])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(hashes, pa.string()), pa.array(counts, pa.list_(pa.int64())),
                pa.array(bases, pa.string()),
                pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in _FOUND.names])))], _READ.names)

    return id_and_text(docs).mapInArrow(each, _READ)


def join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def confident(found: DataFrame, rounds: int = ROUNDS, doubt: float = DOUBT) -> DataFrame:
    """(pattern, trust) after ``rounds`` of scoring over the pattern-instance graph of (pattern, instance, seed).

    Seeds have score 1. A pattern's trust is the mean score of its occurrences, with ``doubt`` unknown ones more;
    another instance's score is the mean trust of the patterns it occurs in. Edges are counted before
    anything else, so that a pattern or instance of many rows is as many edges as it has different partners.
    """
    edges = staged(found.groupBy("pattern", "instance").agg(
        F.count(F.lit(1)).alias("n"), F.max("seed").cast("double").alias("seed")), "pii-edges")
    scores = edges.select("instance", F.col("seed").alias("score"), "pattern", "n", "seed")
    trust = None
    for _ in range(rounds):
        trust = staged(scores.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + doubt)).alias("trust")), "pii-trust")
        means = edges.where("seed = 0").join(trust, "pattern").groupBy("instance").agg(
            (F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("mean"))
        scores = edges.join(means, "instance", "left").select(
            "pattern", "n", F.when(F.col("seed") > 0, 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("score"))
    return trust


def discover(read: DataFrame, rounds: int = ROUNDS, doubt: float = DOUBT, least: float = CONFIDENT) -> DataFrame:
    """(doc_id, hash, more): the further identifiers of a text, as an array of (start, end), where it has any.

    They are the tokens in a pattern whose trust is at least ``least``. Rows of equal id and text share an entry.
    """
    each = read.select("doc_id", "hash", F.explode("found").alias("f")).select("doc_id", "hash", "f.*")
    trust = confident(each, rounds, doubt).where(F.col("trust") >= least).select("pattern")
    new = each.where("seed = 0").join(trust, "pattern", "left_semi")
    return new.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row.

    Null is scanned like the empty text: no spans. Repeated rows are answered each; an empty table gives none. The
    text goes through Python once; all else works on spans.
    """
    read = staged(extract(docs), "pii")
    new = staged(discover(read), "pii-new").withColumnRenamed("doc_id", "_id").withColumnRenamed("hash", "_hash")
    both = read.join(new, read["doc_id"].eqNullSafe(new["_id"]) & (read["hash"] == new["_hash"]), "left")
    base = F.filter(F.split("base", ","), lambda s: s != "")
    placed = F.transform(base, lambda s: F.struct(
        F.split(s, ":")[1].cast("bigint").alias("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("order"), s.alias("span")))
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).cast("bigint").alias("order"),
        F.concat_ws(":", F.lit(KINDS[-1]), s["start"], s["end"]).alias("span")))
    return both.select(
        "doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], "base",
        F.array_join(F.transform(F.array_sort(F.concat(placed, more)), lambda s: s["span"]), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``<KIND>`` in place of every span; n_chars, where there is one, follows the text."""
    read = staged(extract(docs), "pii")
    new = staged(discover(read), "pii-new")
    names = {c.lower(): c for c in docs.columns}
    text, own = names["text"], names["doc_id"]
    hash_name, more = unused_name(docs, "_hash"), unused_name(docs, "_more")
    # The hash is Spark's own: a second Python worker in each task would hold its memory beside the first.
    keyed = docs.withColumn(hash_name, F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))
    at, last = keyed.columns.index(text), len(keyed.columns) - 1

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for value, extra in zip(values(batch.column(at)), values(batch.column(last + 1))):
                if value is None:
                    out.append(None)
                    continue
                spans = sorted(fixed(value) + [(s["start"], 4, s["end"]) for s in extra or []])
                parts, upto = [], 0
                for start, kind, end in spans:
                    if start >= upto:
                        parts += [value[upto:start], f"<{KINDS[kind].upper()}>"]
                    upto = max(upto, end)
                out.append("".join(parts) + value[upto:])
            yield batch.set_column(at, text, pa.array(out, pa.string()))

    new = new.select(F.col("doc_id").alias("_p_id"), F.col("hash").alias("_p_hash"), F.col("more").alias(more))
    joined = keyed.join(new, keyed[own].cast("bigint").eqNullSafe(new["_p_id"]) & (keyed[hash_name] == new["_p_hash"]),
                        "left").drop("_p_id", "_p_hash")
    out = joined.mapInArrow(replaced, joined.schema).drop(hash_name, more)
    if "n_chars" in names:
        kind = docs.schema[names["n_chars"]].dataType
        out = out.withColumn(names["n_chars"], F.when(F.col(text).isNotNull(), F.length(text)).otherwise(
            F.col(names["n_chars"])).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
