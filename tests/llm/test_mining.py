"""Hard negatives against brute force."""

import random

import brute
import pytest

from shelfmark.llm import negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
DDL = "vec_id bigint, embedding array<float>, label int, score bigint, anchor bigint, key string, id string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", "i", 3) for r in rows], DDL)


def mined(df, **more):
    out = negatives.mine(df, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.select(COLUMNS).collect())


def vectors(seed, n, size=8, labels=4, step=0.25):
    rng = random.Random(seed)
    return [(i, [rng.randint(-4, 4) * step for _ in range(size)], rng.randrange(labels)) for i in range(n)]


def test_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert mined(df) == sorted(brute.hard_negatives(rows))


@pytest.mark.parametrize("cells", [64, 1 << 19])
def test_ties_and_blocks(spark, cells, monkeypatch):
    """Few different scores, so that ties decide nearly everything; many blocks and crowds, and one."""
    monkeypatch.setattr(negatives, "CELLS", cells)
    rows = vectors(1, 350)
    # A third of all rows share one vector, a hot label has half of them.
    rows = [(i, rows[0][1] if i % 3 == 0 else v, 0 if i % 2 else l) for i, v, l in rows]
    assert mined(frame(spark, rows)) == sorted(brute.hard_negatives(rows))


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.5, 0.0], 2), (200, [0.0, 1.0], 3), (-100, [-1.0, 0.1], 1)]
    assert mined(frame(spark, rows)) == sorted(brute.hard_negatives(rows))


def test_score_zero(spark):
    """A positive of score 0 takes negatives of score 0, also those with smaller ids."""
    rows = [(100, [1.0, 0.0], 1), (101, [0.0, 1.0], 1), (1, [0.0, 2.0], 2), (102, [0.0, 3.0], 2), (103, [-1.0, 0.0], 2)]
    got = mined(frame(spark, rows))
    assert got == sorted(brute.hard_negatives(rows)) and [r[3] for r in got] == [1, 102]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(2, 250)
    odd = [(1000, None, 1), (1001, [None, 1.0], 1), (1002, [nan], 0), (1003, [inf, 0.0], 0), (1004, [1.0], None),
           (None, [1.0], 1), (1100, [-inf], 1), (1200, [], 1), (1201, [1.0] * 20, 1)]
    rows = good + odd
    short = [(i, v + [0.0] * (20 - len(v)) if i in (1200,) else v, l) for i, v, l in rows]
    assert mined(frame(spark, rows)) == sorted(brute.hard_negatives(
        [(i, None if v is None else v + [0.0] * (20 - len(v)) if None not in v else v, l) for i, v, l in short]))


def test_repeated_ids(spark):
    """Rows that share an id are one: the smallest label, then the smallest vector."""
    rows = vectors(3, 150)
    again = [(i, [9.0] * 8, 9) for i, _, _ in rows[::7]] + rows[::5]
    assert mined(frame(spark, rows + again)) == sorted(brute.hard_negatives(rows))


def test_huge_components(spark):
    """Products beyond 2^53 stay exact; scores beyond 64 bits count as the nearest 64-bit number."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2**21, 2**21)) for _ in range(4)], i % 3) for i in range(120)]
    assert mined(frame(spark, rows)) == sorted(brute.hard_negatives(rows))
    top = mined(frame(spark, [(0, [3e38], 1), (1, [3e38], 1), (2, [3e38], 2)]))
    assert top == []


def test_empty(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 1)])) == []


def test_packed_keys():
    import numpy as np

    rng = random.Random(5)
    rows = [(rng.randint(-3, 3), rng.choice([-2**63, -5, 0, 7, 2**63 - 1]), rng.randint(0, 1), rng.randint(-9, 9))
            for _ in range(300)]
    keys = [negatives.packed(np.array([a]), np.array([s]), k, np.array([i]))[0] for a, s, k, i in rows]
    assert [negatives.unpacked(k) for k in keys] == rows
    by_key = sorted(rows, key=lambda r: keys[rows.index(r)])
    assert by_key == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
