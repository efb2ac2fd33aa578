"""Secret scans: fixed forms, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, and what a match must be to count.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|""" \
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short has no part that is long enough
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

# Whole runs of 20 or more with a digit inside.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
# Character classes: the pattern that a candidate fits whole, and the bits that one of its windows must reach.
CLASSES = [("hex", "^[0-9a-fA-F-]+$", 3.0), ("letters and digits", "^[0-9a-zA-Z]+$", 3.7), ("base64", "", 3.9)]
# What lets a value off: numbers and dates, one character, a first word that says it stands for something.
ALLOWED = ["^[0-9-]+$", "^(?:example|EXAMPLE|Example|placeholder|sample|dummy|changeme|PLACEHOLDER|SAMPLE|DUMMY|CHANGEME)",
           "^(.)\\1+$", "(?i)^0x0+$"]
BLOCK = 256  # lengths that are added up at once
WORD_BITS, PER_WORD = 5, 12  # counts of up to WINDOW, so many to a 64-bit number


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` refers to it, inside other lambdas too."""
    return F.transform(F.array(value), use)[0]


def starts_of(lengths: Column) -> Column:
    """Where pieces of these ``lengths`` start when they follow each other.

    Sums go on in blocks, since a list that grows is copied at every step; a block's start is the sum of the blocks before.
    """
    def sums(numbers: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(numbers, zero, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")), lambda acc: acc["found"])

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def spread(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))
        return bound(totals, lambda t: F.flatten(F.zip_with(parts, sums(t, F.lit(0)), sums)))

    return bound(lengths, lambda all_: bound(blocks(all_), spread))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def parts_of(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` and the text between them, which come from the same pattern."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))


def counts(match: Column, pattern: str, group: int, least: int) -> Column:
    """Whether the ``group`` of a match has ``least`` characters."""
    return F.length(match if group == 0 else F.regexp_extract(match, pattern, group)) >= least


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """SPANS of the matches whose ``group`` has ``least`` characters; ``value`` is the match.

    The lengths of matches and gaps in code points give the places. A text without a match is looked through once.
    """
    def placed(p: Column) -> Column:
        gaps = F.slice(p["gaps"], F.lit(1), F.size(p["matches"]))
        lengths = F.zip_with(gaps, p["matches"], lambda g, m: F.length(g) + F.length(m))
        rows = F.arrays_zip(starts_of(lengths).alias("at"), gaps.alias("gap"), p["matches"].alias("match"))
        found = F.transform(rows, lambda r: F.struct(
            (r["at"] + F.length(r["gap"])).alias("start"), F.lit(KINDS.index(kind)).alias("order"),
            (r["at"] + F.length(r["gap"]) + F.length(r["match"])).alias("end"), F.lit(kind).alias("kind"), r["match"].alias("value")))
        return found if least <= 1 else F.filter(found, lambda s: counts(s["value"], pattern, group, least))

    return F.when(text.rlike(pattern), bound(parts_of(text, pattern), placed)).otherwise(F.array().cast(SPANS))


def masked(text: Column, forms: Sequence[tuple[str, int, int]]) -> Column:
    """``text`` with every character of the spans of ``forms`` (pattern, group, least) replaced by one that no candidate
    has; places stay."""
    blank = F.lit("\x01")

    def one(text: Column, pattern: str, group: int, least: int) -> Column:
        return bound(bound(text, lambda t: parts_of(t, pattern)), lambda p: F.array_join(F.zip_with(
            p["gaps"], p["matches"], lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).when(
                counts(m, pattern, group, least), F.repeat(blank, F.length(m))).otherwise(m))), ""))

    for form in forms:
        text = one(text, *form)
    return text


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of ``window`` consecutive characters.

    Counts per character and the sum of c log2 c follow the window: one character enters, one leaves. The counts are
    packed, some to a number, so that a step touches few of them.
    """
    words = -(-len(ALPHABET) // PER_WORD)
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0).alias("n"),
                    F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    weights = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 2)])  # of c, at c
    full = math.log2(window)

    def placed(char: Column) -> Column:
        """Which number a character's count lies in, where in it, and what one more adds to it."""
        place = F.instr(F.lit(ALPHABET), char) - 1
        shift = (place % PER_WORD * WORD_BITS).cast("int")
        return F.struct(F.floor(place / PER_WORD).cast("int").alias("word"), shift.alias("shift"),
                        F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("one"))

    def count(counts: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, at["word"]), at["shift"]).bitwiseAND(
            F.lit((1 << WORD_BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        gone = count(acc["counts"], leaves)
        there = count(acc["counts"], enters) - F.when(leaves["one"] == 0, 0).when(
            (leaves["word"] == enters["word"]) & (leaves["shift"] == enters["shift"]), 1).otherwise(0)
        left = F.when(leaves["one"] == 0, F.lit(0.0)).otherwise(F.get(weights, gone) - F.get(weights, gone - 1))
        total = acc["sum"] - left - F.get(weights, there) + F.get(weights, there + 1)
        counts = F.transform(acc["counts"], lambda c, k: F.when(k == enters["word"], c + enters["one"]).otherwise(c)
                             - F.when(k == leaves["word"], leaves["one"]).otherwise(F.lit(0).cast("bigint")))
        bits = F.when(acc["n"] >= window - 1, full - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), (acc["n"] + 1).alias("n"), total.alias("sum"),
                        F.greatest(acc["best"], bits).alias("best"))

    def folded(chars: Column) -> Column:
        nobody = F.struct(F.lit(0).alias("word"), F.lit(0).alias("shift"), F.lit(0).cast("bigint").alias("one"))
        behind = F.slice(F.concat(F.array_repeat(nobody, window), chars), F.lit(1), F.size(chars))
        return F.aggregate(F.arrays_zip(chars.alias("enters"), behind.alias("leaves")), zero, step, lambda acc: acc["best"])

    return bound(F.transform(F.split(value, ""), placed), folded)


def suspicious(value: Column, allowed: Sequence[str] = tuple(ALLOWED)) -> Column:
    """Whether a candidate's class and entropy make it a secret, and nothing on the allow-list fits it."""
    least = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    fine = F.lit(False)
    for pattern in allowed:
        fine |= value.rlike(pattern)
    return F.when(fine | ~value.rlike("[A-Za-z]"), F.lit(False)).otherwise(window_entropy(value) >= least)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): spans of the fixed forms, and all spans with those of high entropy, sorted by place.

    Null is scanned like the empty text: no spans. What lies in a span of a fixed form belongs to it; candidates are the
    runs outside. Every row is scanned whole and by itself, so equal rows have equal spans, an empty table gives no rows,
    and time grows with a text's length and its number of matches. Spans of one place stand in the order of KINDS.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    forms = [("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 1), ("hex", HEX, 0, 1)]
    base = F.array_sort(F.concat(*[spans(text, pattern, kind, group, least) for kind, pattern, group, least in forms]))

    def more(found: Column) -> Column:
        """The base spans, and what is suspicious outside them."""
        rest = F.when(F.size(found) > 0, masked(text, [f[1:] for f in forms])).otherwise(text)
        added = bound(rest, lambda r: F.filter(spans(r, CANDIDATE, "entropy"), lambda s: suspicious(s["value"])))
        return F.struct(found.alias("base"), added.alias("added"))

    both = docs.select(F.col("doc_id").cast("bigint"), bound(base, more).alias("both"))
    return both.select("doc_id", "both.base", F.array_sort(F.concat("both.base", "both.added")).alias("found"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"),
                             F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                             joined(F.col("found")).alias("spans"))
