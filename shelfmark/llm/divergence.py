"""Source divergence audit: count vectors of documents, sums of groups, and what tells the sources of a language apart."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import by_value, staged

by_value(__name__)

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8
MIN_DF = 3
VOCABULARY = 2**31 - 1  # the largest vocabulary there can be: nothing is cut
UNIT = 1_000_000_000
HELD = 400_000  # entries of sums that a task holds before it sends them on
LONG = 1 << 20  # bytes of a text whose terms are not listed at once
ROWS = 50_000
CHUNK = 1 << 18  # (term, source) entries whose pairs are evaluated together
CELLS = 1 << 20
TOP = 200
SUMS = "lang string, source string, term string, count bigint, documents bigint"
PARTIAL = "lang string, source string, other string, value bigint, shared bigint"


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def count_vector(text: bytes) -> Counter:
    """The sparse count vector of a document: how often it has each of its terms."""
    text = text.lower()  # of bytes: A-Z only
    if len(text) <= LONG:
        return Counter(TERM.findall(text))
    return Counter(m[0] for m in TERM.finditer(text))


def summed(held: int = HELD):
    """A task's documents as SUMS: the sum of the vectors of each group, and of how many documents they are."""

    def rows(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in sums.items():
            terms = list(counts)
            for at in range(0, len(terms), ROWS):
                some = terms[at:at + ROWS]
                yield pa.record_batch(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                     pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([counts[t] for t in some], pa.int64()), pa.array([documents[t] for t in some], pa.int64())],
                    [c.split()[0] for c in SUMS.split(", ")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
                vector = count_vector(text.as_py())
                counts, documents = sums.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(counts)
                counts.update(vector)
                documents.update(vector.keys())
                entries += len(counts)
                if entries > held:
                    yield from rows(sums)
                    sums, entries = {}, 0
        yield from rows(sums)

    return add


def counts(docs: DataFrame, min_df: int = MIN_DF, vocabulary: int = VOCABULARY, held: int = HELD) -> DataFrame:
    """(lang, source, term, count) of the terms in at least ``min_df`` documents of their language.

    What a count vectorizer per language with that least document frequency keeps, of which the ``vocabulary`` terms with
    the largest counts, ties by term. The vocabulary stays a table: it grows with the corpus, so it does not pass the
    driver and is not sent to all executors. Every task adds up its own documents; its sums are dealt by term.
    """
    partial = texts_of(docs).mapInArrow(summed(held), SUMS).repartition("lang", "term")  # for both steps below
    groups = partial.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    everywhere = Window.partitionBy("lang", "term")
    kept = groups.withColumn("documents", F.sum("documents").over(everywhere)).where(F.col("documents") >= min_df).drop("documents")
    if vocabulary < VOCABULARY:
        whole = kept.groupBy("lang", "term").agg(F.sum("count").alias("n"))
        place = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("term").asc())
        first = whole.withColumn("place", F.row_number().over(place)).where(F.col("place") <= vocabulary)
        kept = kept.join(first.select("lang", "term"), ["lang", "term"], "left_semi")
    return staged(kept.select("lang", "source", "term", "count"), "counts")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + kinds)), exactly; 1 where there are no terms."""
    most = "decimal(28,0)"
    above = (count.cast("decimal(19,0)") + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.greatest(total + kinds, F.lit(1)).cast("decimal(20,0)")
    return F.when(kinds > 0, F.call_function("div", above.cast(most), below) + 1).otherwise(F.lit(1)).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Languages (lang, kinds, total) and groups (lang, source, kinds, total, own, base), also those without terms.

    kinds: kept terms of the language; total: their occurrences; own: kept terms that the group has; base: the share of
    a term that it has not.
    """
    seen = staged(texts_of(docs).select("lang", "source").distinct(), "groups")
    whole = found.groupBy("lang").agg(F.count_distinct("term").alias("kinds"), F.sum("count").alias("total"))
    zero = F.lit(0).cast("bigint")
    langs = seen.select("lang").distinct().join(whole, "lang", "left").select(
        "lang", F.coalesce("kinds", zero).alias("kinds"), F.coalesce("total", zero).alias("total"))
    own = found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"), F.sum("count").alias("total"))
    groups = seen.join(own, ["lang", "source"], "left").join(langs.select("lang", "kinds"), "lang").select(
        "lang", "source", "kinds", F.coalesce("total", zero).alias("total"), F.coalesce("own", zero).alias("own"))
    base = share(zero, F.col("total"), F.col("kinds"))
    return staged(langs, "langs"), staged(groups.withColumn("base", base), "group-bases")


def evaluate(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """PARTIAL over the entries (source, term, p) of some terms of one language, for all pairs of its groups.

    ``value``: the distances over the terms that either source has, ``shared``: the terms that both have. Terms that
    neither has are not touched.
    """
    names, base = groups["source"].combine_chunks(), groups["base"].to_numpy()
    empty = pa.array([], pa.string())
    if not entries.num_rows or not groups.num_rows:
        return pa.table([empty, empty, empty, pa.array([], pa.int64()), pa.array([], pa.int64())],
                        [c.split()[0] for c in PARTIAL.split(", ")])
    source = pc.index_in(entries["source"], value_set=names).to_numpy()
    term = pc.index_in(entries["term"], value_set=pc.unique(entries["term"])).to_numpy()
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], entries["p"].to_numpy()[order]
    first = np.searchsorted(source, np.arange(len(names) + 1))
    there = np.flatnonzero(first[1:] > first[:-1])
    mine, theirs = np.zeros(int(term.max()) + 1, np.int64), base[source]
    strip = max(1, CELLS // len(names))
    out: list[tuple] = []
    for g in range(len(names)):
        a, b = first[g], first[g + 1]
        mine[term[a:b]] = p[a:b]
        own = mine[term]
        both = own > 0
        gap = np.where(both, own, base[g]) - p
        value = gap * gap // p
        gap = np.where(both, own - theirs, 0)
        value -= gap * gap // theirs  # counted among all of the group's own terms below
        total, shared = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        total[there] = np.add.reduceat(value, first[there])
        shared[there] = np.add.reduceat(both.astype(np.int64), first[there])
        for at in range(a, b, strip):
            gap = p[at:min(b, at + strip), None] - base[None, :]
            total += (gap * gap // base[None, :]).sum(axis=0)
        mine[term[a:b]] = 0
        some = np.flatnonzero((total != 0) | (shared != 0))
        some = some[some != g]
        out.append((np.full(len(some), g), some, total[some], shared[some]))
    columns = [np.concatenate([x[i] for x in out]) for i in range(4)]
    lang = pa.array([groups["lang"][0].as_py()] * len(columns[0]), pa.string())
    return pa.table([lang, names.take(pa.array(columns[0])), names.take(pa.array(columns[1])), columns[2], columns[3]],
                    [c.split()[0] for c in PARTIAL.split(", ")])


def pairs(found: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    Entries are dealt by language and term, so that a large language lies in many chunks, and each adds up its own
    terms; over terms that neither source has, the distance is one constant.
    """
    chunks = max(1, -(-found.count() // chunk))
    entries = found.join(groups.select("lang", "source", "total", "kinds"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("count"), F.col("total"), F.col("kinds")).alias("p"),
        F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"))
    copies = groups.select("lang", "source", "base", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    partial = entries.groupBy("lang", "chunk").cogroup(copies.groupBy("lang", "chunk")).applyInArrow(evaluate, PARTIAL)
    sums = partial.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("own").alias("own_"), F.col("base").alias("base_"))
    zero = F.lit(0).cast("bigint")
    neither = F.col("kinds") - F.col("own") - F.col("own_") + F.coalesce("shared", zero)
    return groups.join(other, "lang").where("source <> other").join(sums, ["lang", "source", "other"], "left").select(
        "lang", "source", F.col("other").alias("item"),
        (F.coalesce("value", zero) + neither * distance(F.col("base"), F.col("base_"))).alias("value"))


def telling_terms(found: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source has more often than its language."""
    whole = found.groupBy("lang", "term").agg(F.sum("count").alias("all")).join(langs, "lang").select(
        "lang", "term", share(F.col("all"), F.col("total"), F.col("kinds")).alias("q"))
    own = found.join(groups.select("lang", "source", "total", "kinds"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("count"), F.col("total"), F.col("kinds")).alias("p"))
    return own.join(whole, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, vocabulary: int = VOCABULARY, chunk: int = CHUNK,
          held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other (``pair``), and the
    ``top`` terms by which it differs from its language (``term``).

    Null texts, languages and sources count as empty ones; other columns are not looked at. A row is a document, also
    where rows are equal. A group without kept terms takes part in pairs, with the smallest shares; a language without
    kept terms has pairs of value 0; a language's only source has no pairs. Ties are ranked by the item's UTF-8 bytes.
    An empty table gives no rows. All arithmetic is on whole numbers, without rounding but the stated floors.
    """
    found = counts(docs, min_df, vocabulary, held)
    langs, groups = groups_of(docs, found)
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    near = pairs(found, groups, chunk).withColumn("rank", F.row_number().over(place))
    terms = telling_terms(found, langs, groups).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return near.withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(columns))
