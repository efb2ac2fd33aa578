"""Benchmark decontamination by a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_value, running, staged, values, worker_store

by_value(__name__)

LENGTH = 10  # words of a window
PIECE = 1 << 15  # words of a piece of a very long item
SHARD = 1 << 18  # words of the items that one automaton holds
STRETCH = 1 << 20  # bytes of texts that are looked at together
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8
PIECES = "item_id bigint, words string, n bigint"
FOUND = ("n_words bigint, n_hit bigint, spans array<struct<start: bigint, end: bigint>>, items array<bigint>")

# Lower-cased byte of a word, or 0.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0
                  for c in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only


class Automaton:
    """Generalised suffix automaton of word sequences.

    A state stands for all substrings that end at the same places. ``long`` gives the items of the windows of
    ``length`` words, by the state that holds the window; ``short`` the items that are shorter, by the state and their
    length.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], length: int = LENGTH) -> None:
        self.length = length
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.short: dict[int, dict[int, set]] = {}
        self.long: dict[int, set] = {}
        coded = []
        for item, words in items:
            if words:
                codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((item, codes))
                last = 0
                for code in codes:
                    last = self._extend(last, code)
        self._name(coded)
        self.least = min((min(len(c), length) for _, c in coded), default=0)
        self.seen = prefilter(list(self.vocabulary))
        self.longest = max(map(len, self.vocabulary), default=0)

    def _state(self, size: int, link: int, onward: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(onward)
        return len(self.size) - 1

    def _split(self, p: int, code: int) -> int:
        """The state for the strings of ``p`` and ``code`` alone, cut off from the longer ones that share a state."""
        q = self.next[p][code]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, code)
        return new

    def window_state(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match that ends in ``state`` and is no shorter."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _name(self, coded: list[tuple[int | None, list[int]]]) -> None:
        for item, codes in coded:
            names = [] if item is None else [item]
            whole = len(codes) < self.length
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.next[state][code]  # of the item's first n words
                if not whole and n >= self.length:
                    self.long.setdefault(self.window_state(state, self.length), set()).update(names)
            if whole:
                self.short.setdefault(self.window_state(state, len(codes)), {}).setdefault(
                    len(codes), set()).update(names)
        # For each state the short items among its suffixes, the nearest state that has any first.
        self.above = [-1] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.above[state] = state if state in self.short else self.above[self.link[state]]

    def follow(self, words: Iterator[tuple[int, bytes]], at: tuple[int, int], hits: list, items: set) -> tuple[int, int]:
        """Streams (place, word); adds (first place, end) of every window that occurs, and its items.

        ``at``: the state and the length of the longest match so far; what they are afterwards is returned.
        """
        state, matched = at
        known, onward, link, size = self.vocabulary.get, self.next, self.link, self.size
        for place, word in words:
            code = known(word, -1)
            while state and code not in onward[state]:
                state = link[state]
                matched = size[state]
            if code not in onward[state]:
                continue
            state = onward[state][code]
            matched += 1
            if matched >= self.length:
                names = self.long.get(self.window_state(state, self.length))
                if names is not None:
                    hits.append((place - self.length + 1, place + 1))
                    items |= names
            above = self.above[state]
            while above > 0:
                for length, names in self.short[above].items():
                    if length <= matched:
                        hits.append((place - length + 1, place + 1))
                        items |= names
                above = self.above[link[above]] if link[above] > 0 else -1
        return state, matched


def mixed(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """20 bits of a word's first and last eight bytes and its size."""
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ (last + size) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``mixed`` of the words between ``starts`` and ``ends`` of ``data``, which is padded by 8 bytes on both sides."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    short = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)  # bits that lie outside a short word
    return mixed(eight[starts + 8] << short, eight[ends] >> short, size.astype(np.uint64))


def prefilter(words: list[bytes]) -> np.ndarray:
    """A table of 2^20 bits that are set for ``words``: what it does not let through is none of them."""
    table = np.zeros(1 << 20, bool)
    if words:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        data = np.frombuffer(bytes(8) + b"".join(words) + bytes(8), np.uint8)
        table[ends_of(data, ends - sizes, ends)] = True
    return table


class Reader:
    """Streams the texts of a batch through an automaton."""

    def __init__(self, automaton: Automaton, stretch: int = STRETCH) -> None:
        self.automaton, self.stretch = automaton, stretch

    def texts(self, buffer: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list, set, list]]:
        """(words, hits, items, byte spans of the hits) of the texts between ``bounds`` of ``buffer``."""
        row = 0
        while row < len(bounds) - 1:
            more = row + 1
            while more < len(bounds) - 1 and bounds[more + 1] - bounds[row] <= self.stretch:
                more += 1
            if bounds[more] - bounds[row] <= self.stretch:
                yield from self._together(buffer, bounds[row:more + 1])
            else:
                yield self._long(buffer[bounds[row]:bounds[more]])
            row = more

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of ``data`` (lower-cased and padded), none across ``cuts``; which may be known."""
        inside = data != 0
        starts, ends = inside[8:-8] & ~inside[7:-9], inside[8:-8] & ~inside[9:-7]
        cuts = cuts[(cuts > 0) & (cuts < len(starts))]
        starts[cuts] |= inside[cuts + 8]
        ends[cuts - 1] |= inside[cuts + 7]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return starts, ends, self.automaton.seen[ends_of(data, starts, ends)]

    def _padded(self, part: np.ndarray) -> np.ndarray:
        data = np.zeros(len(part) + 16, np.uint8)
        np.take(LOWER, part, out=data[8:-8])
        return data

    def _together(self, buffer: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list, set, list]]:
        data = self._padded(buffer[bounds[0]:bounds[-1]])
        cuts = bounds - bounds[0]
        starts, ends, known = self._words(data, cuts)
        firsts = np.searchsorted(starts, cuts)  # of each text's words
        # Runs of words that may be known, within a text; only those of ``least`` words can hold a window.
        edge = np.ones(len(known) + 1, bool)
        edge[1:-1] = known[1:] != known[:-1]
        edge[firsts] = True
        edges = np.flatnonzero(edge)
        least = self.automaton.least
        runs = np.flatnonzero((edges[1:] - edges[:-1] >= least) & known[edges[:-1]]) if len(known) and least else []
        of = np.searchsorted(firsts, edges[:-1][runs], side="right") - 1 if len(runs) else []
        raw = data.tobytes()
        by_text: dict[int, list] = {}
        for text, run in zip(of, runs):
            by_text.setdefault(int(text), []).append((int(edges[run]), int(edges[run + 1])))
        for text in range(len(bounds) - 1):
            first, n = int(firsts[text]), int(firsts[text + 1] - firsts[text])
            hits: list = []
            items: set = set()
            for a, b in by_text.get(text, ()):
                s, e = starts[a:b].tolist(), ends[a:b].tolist()
                self.automaton.follow(((a + i, raw[x + 8:y + 8]) for i, (x, y) in enumerate(zip(s, e))), (0, 0), hits, items)
            hits = merged(hits)
            base = int(cuts[text])
            yield (n, [(a - first, b - first) for a, b in hits], items,
                   [(int(starts[a]) - base, int(ends[b - 1]) - base) for a, b in hits])

    def _long(self, text: np.ndarray) -> tuple[int, list, set, list]:
        """A text of more than a stretch, piece by piece; the automaton's state goes on from one to the next."""
        at, n, state = 0, 0, (0, 0)
        hits: list = []
        items: set = set()
        spans: list = []
        recent: list[tuple[int, int]] = []  # bytes of the last words, as many as a window can have
        while at < len(text):
            end = min(len(text), at + self.stretch)
            data = self._padded(text[at:end])
            starts, ends, known = self._words(data, np.array([], np.int64))
            if end < len(text) and len(ends) and at + ends[-1] == end and LOWER[text[end]]:
                if starts[-1]:  # the last word goes on: next time
                    end = at + int(starts[-1])
                    starts, ends, known = starts[:-1], ends[:-1], known[:-1]
                else:  # a word of more than a stretch
                    while end < len(text) and LOWER[text[end]]:
                        piece = LOWER[text[end:end + self.stretch]]
                        gap = np.flatnonzero(piece == 0)
                        end += int(gap[0]) if len(gap) else len(piece)
                        if len(gap):
                            break
                    starts, ends = np.array([0]), np.array([end - at])
                    known = np.array([end - at <= self.automaton.longest])
                    if known[0]:
                        data = self._padded(text[at:end])
            raw = data.tobytes()
            fresh: list = []
            places = recent + [(at + int(s), at + int(e)) for s, e in zip(starts, ends)]
            base = n - len(recent)
            quiet = np.flatnonzero(~known)
            here = 0
            while here < len(starts):
                stop = int(quiet[i]) if (i := int(np.searchsorted(quiet, here))) < len(quiet) else len(starts)
                if stop == here:
                    state, here = (0, 0), here + 1
                    continue
                state = self.automaton.follow(
                    ((n + i, raw[starts[i] + 8:ends[i] + 8]) for i in range(here, stop)), state, fresh, items)
                here = stop
            for a, b in merged(fresh):
                spans.append((places[a - base][0], places[b - 1 - base][1]))
                hits.append((a, b))
            n += len(starts)
            recent = places[-self.automaton.length:]
            at = end
        return n, merged(hits), items, merged(spans)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def characters(text: np.ndarray, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte spans as spans of code points."""
    if not spans:
        return []
    at = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [{"start": int(at[a]), "end": int(at[b])} for a, b in spans]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its texts begin and end; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def searcher(shared, name: str, keep: list[str]):
    """Adds the columns of FOUND to ``keep`` for the texts of a partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if name not in store:
            for old in [k for k in store if k.startswith("automaton-")]:
                del store[old]
            store[name] = Automaton(*shared.value)
        reader = Reader(store[name])
        for batch in batches:
            buffer, bounds = text_buffer(batch["text"])
            found = list(reader.texts(buffer, bounds))
            spans = [characters(buffer[bounds[i]:bounds[i + 1]], f[3]) for i, f in enumerate(found)]
            yield pa.record_batch(
                [batch[k] for k in keep] + [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([sum(b - a for a, b in f[1]) for f in found], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(f[2]) for f in found], pa.list_(pa.int64()))],
                keep + ["n_words", "n_hit", "spans", "items"])

    return search


def pieces(items: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """Items as PIECES of at most about ``piece`` words: a longer item is cut so that every window lies in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), values(batch["text"])):
                words = words_of(text)
                for a in range(0, max(1, len(words) - length + 1) if words else 0, piece):
                    some = words[a:a + piece + length - 1]
                    yield pa.record_batch([pa.array([item], pa.int64()), pa.array([b" ".join(some).decode()]),
                                           pa.array([len(some)], pa.int64())], ["item_id", "words", "n"])

    return items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def shards(items: DataFrame, length: int = LENGTH, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The items' pieces with the number of their shard, and how many shards there are."""
    placed = running(pieces(items, length), [], [F.col("item_id").asc_nulls_last(), F.col("words").asc()], "n", "pieces")
    placed = staged(placed.select("item_id", "words", F.floor(F.col("_before") / shard).alias("shard")), "shards")
    return placed, (placed.agg(F.max("shard")).first()[0] or 0) + 1


def _search(docs: DataFrame, placed: DataFrame, number: int, length: int, keep: list[str]) -> DataFrame:
    """``docs`` (text and ``keep``) against one shard, whose words, a bounded number, are sent to all executors."""
    items = [(r.item_id, r.words.encode().split(b" ")) for r in placed.where(F.col("shard") == number).collect()]
    shared = docs.sparkSession.sparkContext.broadcast((items, length))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + FOUND
    return docs.select("text", *keep).mapInArrow(searcher(shared, f"automaton-{id(shared)}-{shared._jbroadcast.id()}", keep), schema)


def scan(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH,
         shard: int = SHARD) -> DataFrame:
    """``keep`` and FOUND for every row of ``docs``: its words, those hit, their spans (code points, end exclusive,
    runs of hit words as one) and the items whose windows occur.

    A window is ``length`` words in a row of an item, or all words of a shorter one; an item without words has none.
    A word of a document is hit if it lies in an occurrence of a window. A null text has no words. Items that share an
    id are one item of several texts; one without an id marks words and is not listed. Rows of ``docs`` that are equal
    are answered each for itself; with no items nothing is hit, an empty table gives no rows.

    The items' words are dealt to shards of bounded size. Usually there is one, and documents pass it as they are
    read. With more, each is searched in turn, and what it finds, a row for a contaminated document, is put together.
    """
    names = list(keep)
    docs = docs.select(F.col("text").cast("string"), *names)
    placed, count = shards(items, length, shard)
    if count == 1:
        return _search(docs, placed, 0, length, names)
    numbered = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = [staged(_search(numbered, placed, k, length, ["_row"]).where("n_hit > 0").select("_row", "spans", "items"),
                    "shard") for k in range(count)]
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    gathered = parts.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(
        F.flatten(F.collect_list("items")))).alias("items"))  # of one document: bounded by its words and the shards
    both = numbered.join(gathered, "_row", "left").select(
        "text", *names, F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*names).schema) + ", " + FOUND
    return both.mapInArrow(_joined(names), schema)


def _joined(keep: list[str]):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of several shards as one list, and the words in them."""
        for batch in batches:
            rows = []
            for text, spans in zip(values(batch["text"]), batch["spans"].to_pylist()):
                text = text or ""
                words = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
                starts = [a for a, _ in words]
                hit = merged([(bisect_left(starts, s["start"]), bisect_left(starts, s["end"])) for s in spans])
                rows.append((len(words), sum(b - a for a, b in hit),
                             [{"start": starts[a], "end": words[b - 1][1]} for a, b in hit]))
            yield pa.record_batch(
                [batch[k] for k in keep] + [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], batch.schema.field("spans").type), batch["items"]],
                keep + ["n_words", "n_hit", "spans", "items"])

    return join


def judge(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): see ``scan``."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return scan(docs.select(F.col("doc_id").cast("bigint"), "text"), items, length=length).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))


def clean(docs: DataFrame, items: DataFrame, length: int = LENGTH, coverage: float = 0.5) -> DataFrame:
    """``docs`` without what they share with the items: the same columns.

    Spans of ``length`` words and more (whole shorter items too) are cut out of the texts. A document of whose words
    over the share ``coverage`` would go is left out as a whole. A text without hits stays as it is, a null stays null.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    found = scan(docs.select(whole, F.col("text")), items, ("row",), length).where(
        (F.col("n_hit") == 0) | (F.col("n_hit") <= F.lit(coverage) * F.col("n_words")))
    text = F.col(f"row.c{docs.columns.index('text')}")
    # What is kept: from the end of each span to the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substr(
        text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    cut = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(text)
    return found.select([(cut if c == "text" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
