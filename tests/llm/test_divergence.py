"""The divergence audit against brute force."""

import random

import brute
import pytest

from shelfmark.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def audited(df, **more):
    out = divergence.audit(df, **more)
    assert sorted(out.columns) == sorted(COLUMNS)
    return sorted(tuple(r) for r in out.select(COLUMNS).collect())


def wanted(df, **more):
    return sorted(brute.divergence([(r.text, r.lang, r.source) for r in df.collect()], **more))


def test_given(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert audited(df) == wanted(df)


def made(spark, seed=1, n=120):
    """A hot language with a hot source, a language without kept terms, groups without terms, nulls, clashing columns."""
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "long" * 50, "x1y", "\U0001f389"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = rng.choice(["s0", "s0", "s1", "sü", "", None])
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 40))), lang, source))
    rows += [(0, "rare unique terms", "xx", "one"), (0, None, "xx", "two"), (0, "", "yy", "alone"), (0, "1 2 3", "en", "empty"),
             (0, "a a a a", "en", "same"), (0, "a a a a", "en", "same"), (0, "z" * 200_000 + " a" * 100_000, "de", "s1")]
    return spark.createDataFrame([(*r, 1, 2, "k", "t") for r in rows],
                                 "doc_id bigint, text string, lang string, source string, p int, value int, term string, terms string")


@pytest.mark.parametrize("sizes", [{}, {"held": 7, "chunk": 10}])
def test_against_brute_force(spark, sizes):
    """Sums sent on once and many times; one chunk, and many."""
    df = made(spark)
    assert audited(df, **sizes) == wanted(df)


def test_vocabulary_size(spark):
    """Of a language's terms the most frequent are kept, ties by term."""
    df = spark.createDataFrame([("a a a b b c c d", "en", "x")] * 3 + [("c q", "fr", "x")] * 3, "text string, lang string, source string")
    got = divergence.counts(df, vocabulary=2).select("lang", "term", "count").collect()
    assert sorted(map(tuple, got)) == [("en", "a", 9), ("en", "b", 6), ("fr", "c", 3), ("fr", "q", 3)]


def test_top(spark):
    df = made(spark, 2)
    assert audited(df, top=3) == wanted(df, top=3)


def test_odd_rows(odd, empty):
    assert audited(odd) == wanted(odd)
    assert audited(empty) == []


def test_no_kept_terms(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, None, None)],
                               "doc_id bigint, text string, lang string, source string")
    assert audited(df) == wanted(df) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_large_counts(spark):
    """Counts far beyond what a document holds: shares stay exact."""
    df = spark.createDataFrame([(10**15, 3, 10**17, 7)], "c bigint, d bigint, n bigint, v bigint")
    from pyspark.sql import functions as F

    row = df.select(divergence.share(F.col("c"), F.col("n"), F.col("v")), divergence.share(F.col("d"), F.col("n"), F.col("v"))).first()
    assert tuple(row) == (1 + 10**9 * (10**15 + 1) // (10**17 + 7), 1 + 10**9 * 4 // (10**17 + 7))
