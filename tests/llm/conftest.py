import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


# Null and empty texts, ties, repeated rows, null ids, odd white space, long words, and columns with clashing names.
ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", "b"), (4, "one", "b"), (5, "One two", None),
    (None, "a b c d", "a"), (None, "a b c d", "a"), (6, "token = 'abcdef12' AKIA" + "Q7" * 9, "a"),
    (7, "mail a@b.c.d_e@f.g, 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (523) 555-1055", "c"),
    (8, "x" * 3000, "c"), (9, "ab" * 2000, "c"), (10, "\u00e9\u0301 \u3000 \U0001f389 end\x00", "z"),
    (11, "spam " * 400, "z"), (12, "spam " * 400, "z"), (13, "line\nline\n\nline\n" * 20, "z"),
    (14, "token=token:abcdefgh api_key:\"0123456789abcdef01234567\" " * 3, "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, s, "x", 1, 2.0) for i, t, s in ODD]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, lang string, row int, size double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
