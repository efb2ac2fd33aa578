"""Quality rules: statistics of whole texts and an isolation forest over them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfmark.llm.common import by_value, id_and_text, slices, staged, unused_name, values

by_value(__name__)

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# Bounds of the fit: labelled rows taken, trees, rows of a tree; share of good rows that may be lost.
SAMPLE, TREES, ROWS, LOST = 8192, 100, 256, 0.002
SEED = 11
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols", "upper", "digits", "other", "doubled", "word_length", "dup_lines"]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile(r"[^\W\d_]+")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the contract, and ratios that don't depend on a text's length.

    The ratios: symbols, capitals, digits and other signs per character of a word, words equal to the one
    before, mean word length, and repeated lines.
    """
    text = text or ""
    words = _WORD.findall(text)
    if not words:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeats = 0
    if n > 2:
        seen = Counter(zip(words, words[1:], words[2:]))
        if len(seen) < n - 2:
            upto = 0  # words before this one are counted
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if seen[w] > 1:
                    repeats += i + 3 - max(i, upto)
                    upto = i + 3
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    duplicates = len(lines) - len(set(lines))
    joined = "".join(words)
    lower = sum(c.islower() for c in joined) if not joined.isascii() else len(joined.translate(_LOWER_GONE)) - chars
    letters = joined.translate(_LETTERS_GONE) if joined.isascii() else None
    if letters is None:
        alpha = sum(map(len, _UPPER.findall(joined)))
        digits = sum(c.isdigit() for c in joined)
    else:
        alpha = chars - len(letters)
        digits = sum(map(letters.count, "0123456789"))
        lower = -lower
    doubled = sum(map(str.__eq__, words, words[1:]))
    return (
        [n, chars, symbols, duplicates, repeats],
        [symbols / chars, (alpha - lower) / chars, digits / chars, (chars - alpha - digits) / chars, doubled / n,
         min(chars / n, 40.0) / 40, duplicates / max(1, len(lines))],
    )


_LOWER_GONE = {c: None for c in range(97, 123)}
_LETTERS_GONE = _LOWER_GONE | {c: None for c in range(65, 91)}


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Forest:
    """Isolation trees as arrays: per node the feature (-1: leaf), the cut or the leaf's path length, the children."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    mean_path: float
    threshold: float = np.inf

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 for rows that are isolated early."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = rows[every, np.maximum(f, 0)] < self.cut[at]
                at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            total += self.cut[at]
        return np.exp2(-total / max(1, len(self.roots)) / self.mean_path)


def expected_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, size: int = ROWS,
         seed: int = SEED) -> Forest:
    """Random splits of random subsets of ``rows`` within the box from ``low`` to ``high``, down to single rows.

    A split lies anywhere in a node's part of the box, not only between its rows, so that what is the same in all
    ``rows`` still separates what differs there: parts of the box without rows are short paths.
    """
    rng = np.random.default_rng(seed)
    size = min(size, len(rows))
    limit = int(np.ceil(np.log2(max(2, size)))) + rows.shape[1]
    feature, cut, left, right, roots = [], [], [], [], []

    def node(own: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        at = len(feature)
        for out, value in ((feature, -1), (cut, depth + expected_path(len(own))), (left, at), (right, at)):
            out.append(value)
        splits = np.flatnonzero(high > low)
        if depth < limit and len(own) > 1 and len(splits):
            f = int(rng.choice(splits))
            where = rng.uniform(low[f], high[f])
            goes = own[:, f] < where
            feature[at], cut[at] = f, where
            edge = np.where(np.arange(len(low)) == f, where, high), np.where(np.arange(len(low)) == f, where, low)
            left[at] = node(own[goes], low, edge[0], depth + 1)
            right[at] = node(own[~goes], edge[1], high, depth + 1)
        return at

    for _ in range(trees):
        roots.append(node(rows[rng.choice(len(rows), size, replace=False)], low, high, 0))
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(roots),
                  max(expected_path(size), 1e-9))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lost: float = LOST, seed: int = SEED) -> Forest | None:
    """The forest of a bounded sample of labelled rows, and its threshold.

    The sample: the ``sample`` labelled documents with the smallest hashes of their ids. Half of its good rows grow
    the trees, within the box of all its rows; the threshold is the score that all but the share ``lost`` of the other good rows stay under. Without
    20 good rows there is no forest, and only the base rules judge.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample)
    )
    chosen = staged(chosen, "labelled")
    texts = id_and_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # ``sample`` rows at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [statistics(t)[1] for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ratios, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "r", "q"])

    rated = texts.select("doc_id", "text", F.col("_quality").cast("int")).mapInArrow(
        each, "doc_id bigint, r array<double>, q int")
    rated = staged(rated, "labelled-statistics")
    rows = rated.orderBy(F.xxhash64(F.lit(seed), "doc_id", "r"), "r").limit(sample).collect()
    good = np.array([r.r for r in rows if r.q == 1])
    if len(good) < 20:
        return None
    every = np.array([r.r for r in rows])
    forest = grow(good[::2], every.min(axis=0), every.max(axis=0), seed=seed)
    forest.threshold = float(np.quantile(forest.score(good[1::2]), 1 - lost, method="higher"))
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, score) for every row: all statistics of whole texts in one pass.

    A null or blank text has no words and fails the base rules. Rows are judged independently of each other.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in values(batch.column(1))]
            counts = list(zip(*[c for c, _ in found])) or [()] * len(COUNTS)
            failed = np.array([base_failed(c[0], c[-1]) for c, _ in found], bool)
            ratios = np.array([r for _, r in found]).reshape(len(found), len(RATIOS))
            scores = forest.score(ratios) if forest else np.zeros(len(found))
            kept = ~failed & (scores <= (forest.threshold if forest else np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(failed), pa.array(kept),
                 pa.array(scores)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return id_and_text(docs).mapInArrow(each, schema + ", base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    name = unused_name(docs, "_kept")
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in values(batch.column(at))]
            failed = np.array([base_failed(c[0], c[-1]) for c, _ in found], bool)
            ratios = np.array([r for _, r in found]).reshape(len(found), len(RATIOS))
            scores = forest.score(ratios) - forest.threshold if forest else np.zeros(len(found))
            yield from slices([batch.append_column(name, pa.array(np.where(failed, 1.0, scores)))])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(each, schema).where(F.col(name) <= 0).drop(name)
