import random

import pytest

from shelfmark.operators import similarity


def sequential(sketches, threshold):
    """The defining loop: sketches in order of rank."""
    taken, out = set(), {}
    for i, s in enumerate(sketches):
        if i in taken:
            continue
        for j in range(i + 1, len(sketches)):
            if j not in taken and bin(s ^ sketches[j]).count("1") <= threshold:
                taken.add(j)
                out[sketches[j]] = s
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def clustered(rng, n, centres, spread, bits=64):
    base = [rng.getrandbits(bits) for _ in range(centres)]
    found = []
    while len(found) < n:
        v = rng.choice(base)
        for _ in range(rng.randrange(spread + 1)):
            v ^= 1 << rng.randrange(bits)
        if v not in found:
            found.append(v)
    return found


def compare(spark, sketches, threshold):
    nodes = spark.createDataFrame([(signed(s), f"/f{i:06d}") for i, s in enumerate(sketches)], "sketch bigint, rank string")
    got = {r.sketch: r.leader_sketch for r in similarity.leaders_of(nodes, threshold).collect()}
    want = {signed(k): signed(v) for k, v in sequential(sketches, threshold).items()}
    assert got == want


@pytest.mark.parametrize("threshold", [0, 1, 5, 6, 10])
def test_equals_the_sequential_result(spark, threshold):
    rng = random.Random(threshold)
    compare(spark, clustered(rng, 150, 12, threshold + 2), threshold)


def test_crowded_buckets_are_split_and_capped(spark, monkeypatch):
    """Two thirds of the sketches share half of their bits, and no bucket may list more than 4."""
    monkeypatch.setattr(similarity, "CAP", 4)
    rng = random.Random(7)
    far = [(0xABCDEF01 << 32) | rng.getrandbits(32) for _ in range(80)]
    near = clustered(rng, 40, 1, 5, bits=20)
    sketches = list(dict.fromkeys(far + near + clustered(rng, 40, 40, 3)))
    rng.shuffle(sketches)
    compare(spark, sketches, 5)


def test_chain_in_rank_order(spark):
    """Each is within the threshold of the next only: leaders and members alternate."""
    compare(spark, [(1 << (3 * i)) - 1 for i in range(21)], 3)


def test_sets_and_members(spark):
    files = spark.createDataFrame(
        [("/a/long.png", 5, 0b1111), ("/b.png", 7, 0b1110), ("/c.png", 9, 0b1111), ("/d.png", 3, 1 << 40), ("/e.png", 1, None)],
        "path string, size_bytes bigint, sketch bigint",
    ).selectExpr("*", "timestamp '2024-01-01' as modified_time")
    sets = similarity.similar_sets(files, 1).collect()
    assert len(sets) == 1
    # /b.png comes after the first file of 0b1111, so the latter leads; the shortest path is kept.
    assert (sets[0].hash, sets[0].cnt, sets[0].primary, sets[0].space_wasted) == ("perceptual_000000000000000f", 3, "/b.png", 10)
    members = similarity.similar_members(files, 1)
    assert {(r.path, r.is_primary) for r in members.collect()} == {
        ("/a/long.png", False), ("/b.png", True), ("/c.png", False)
    }
    assert [(r.leader_path, r.path, r.distance) for r in similarity.similar_matches(files, 1).collect()] == [
        ("/a/long.png", "/b.png", 1)
    ]
