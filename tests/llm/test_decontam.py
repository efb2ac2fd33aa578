"""Decontamination against brute force."""

import random

import brute
import numpy as np
import pytest

from shelfmark.llm import decontam

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
DOCS = "doc_id bigint, text string, spans string, items int, words string, item_id bigint"


def judged(spark, docs, items, **more):
    df = spark.createDataFrame([(*d, "s", 1, "w", 2) for d in docs], DOCS)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    if more:
        found = decontam.scan(df, tests, **more)
        return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()), key=repr)
    return sorted((tuple(r) for r in decontam.judge(df, tests).select(COLUMNS).collect()), key=repr)


def cases(seed, n=60, alphabet="abc"):
    """Items and texts over so few words that windows overlap, repeat and nest."""
    rng = random.Random(seed)

    def words(k):
        return [rng.choice(alphabet) for _ in range(k)]

    items = [(i, " ".join(words(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(5, 15)]
    items = [(i, t) for i, t in items if len(t) > 5]
    items += [(7, items[0][1]), (99, items[0][1].upper()), (100, None), (101, " ."), (None, "zeta " * 4)]
    docs = []
    for i in range(n):
        part = rng.choice([t for _, t in items if t]).split()
        docs.append((i, rng.choice([", ", " ", "\n"]).join(words(rng.randint(0, 30)) + part + words(rng.randint(0, 30)))))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (500, None), (501, ""), (502, "é́ zeta-Zeta zeta zeta x")], items


def test_given(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = judged(spark, docs, items)
    assert got == sorted(brute.contaminated(docs, items), key=repr)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_nested_windows(spark, alphabet):
    docs, items = cases(1, alphabet=alphabet)
    assert judged(spark, docs, items) == sorted(brute.contaminated(docs, items), key=repr)


def test_many_shards(spark):
    """Several automata, one after another, find what one finds."""
    docs, items = cases(2)
    one, many = (judged(spark, docs, items, shard=n) for n in (1 << 18, 20))
    assert one == many and any(r[2] for r in one)


def test_long_item_in_pieces(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdef") for _ in range(500)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "q")], "item_id bigint, text string")
    cut = decontam.pieces(items, 10, 64).collect()
    whole = {tuple(words[i:i + 10]) for i in range(491)}
    assert {tuple(p[i:i + 10]) for r in cut if r.item_id == 1 for p in [r.words.split()]
            for i in range(len(p) - 9)} == whole
    assert max(r.n for r in cut) <= 73 and [r.words for r in cut if r.item_id == 2] == ["q"]


@pytest.mark.parametrize("stretch", [3, 7, 64, 1 << 20])
def test_texts_of_any_length(stretch):
    """Texts that go on over many stretches, words longer than one, and texts that share one."""
    docs, items = cases(4, alphabet=["a", "bb", "ccc", "longerthanthat"])
    docs = [(i, t) for i, t in docs if t is not None] + [(600, "x" * 5000 + " " + " ".join(t for _, t in items if t))]
    automaton = decontam.Automaton([(i, decontam.words_of(t)) for i, t in items])
    raw = [t.encode() for _, t in docs]
    bounds = np.cumsum([0, *map(len, raw)])
    found = list(decontam.Reader(automaton, stretch).texts(np.frombuffer(b"".join(raw), np.uint8), bounds))
    got = [(i, n, sum(b - a for a, b in hits), len(items_), bool(hits)) for (i, _), (n, hits, items_, _) in zip(docs, found)]
    assert got == [(i, n, h, k, c) for i, n, h, k, _, c in brute.contaminated(docs, items)]
    for text, (_, hits, _, spans) in zip(raw, found):
        cut = [w for a, b in spans for w in decontam.words_of(text[a:b].decode())]
        words = decontam.words_of(text.decode())
        assert cut == [w for a, b in hits for w in words[a:b]]


def test_very_long_text(spark):
    """Some 6 MB in one text, with a window at its very end and a word of 2 MB."""
    text = "lorem ipsum " * 300_000 + "y" * 2_000_000 + " one two three four five six seven eight nine ten"
    got = judged(spark, [(1, text)], [(3, "One two three four five six seven eight nine TEN")])
    assert got == [(1, 600_011, 10, 1, brute.sha(b"3"), True)]


def test_clean(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"éh, {item.upper()}! the rest of it is fine and so are all of these words here", "a"), (2, item, "b"),
            (3, None, "c"), (4, "nothing", None), (5, f"{item}; " + "word " * 30 + item, "d")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, row string")
    tests = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontam.clean(df, tests)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [
        (1, "éh, ! the rest of it is fine and so are all of these words here", "a"), (3, None, "c"),
        (4, "nothing", None), (5, "; " + "word " * 30, "d")]


def test_nothing_to_find(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    blank = spark.createDataFrame([(1, None), (2, "- ..")], "item_id bigint, text string")
    for items in (none, blank):
        rows = decontam.judge(odd, items).collect()
        assert len(rows) == odd.count() and not any(r.contaminated or r.n_items for r in rows)
    assert decontam.judge(empty, blank).count() == 0
    items = spark.createDataFrame([(1, "spam spam"), (2, "line")], "item_id bigint, text string")
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in decontam.judge(odd, items).select(COLUMNS).collect()), key=repr)
    assert got == sorted(brute.contaminated(pairs, [(1, "spam spam"), (2, "line")]), key=repr)
