"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import by_value, id_and_text, slices, values, worker_store

by_value(__name__)

CACHED = 250_000  # chunks of a generation; a worker remembers two
MET = 1 << 22  # marks of chunks met once (hashes may share one): only those met again are remembered
ARCS = 400_000  # arcs a worker keeps; beyond it determinisation starts anew
LOOKAHEAD = 5  # bytes that nearly always decide which tokens fit; the others look further
BATCH = 4096


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Merges as a transducer from bytes to token ids.

    A sequence of tokens is what the merges give exactly if that holds for every two neighbours, and each prefix of a
    piece has at most one such sequence. The nondeterministic machine has the last token as its state and guesses
    the next one. Determinised lazily, it looks ahead for the longest token that the next bytes allow; the arc for
    (state, lookahead) holds the tokens that may follow, longest first, and is made when first met. A token stays
    undone only until the bytes behind it show that nothing can follow; such places are never tried twice.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                after = self.trie[node].get(byte)
                if after is None:
                    after = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = rank
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.longest = max(map(len, ranks), default=0)
        self.arcs: dict[int, tuple[tuple[int, int], ...]] = {}
        self.options: dict[tuple, tuple] = {}  # many arcs have the same
        self.seen: dict[bytes, int] = {}

    def parted(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that no merges make."""
        if token not in self.parts:
            text, pieces = self.bytes[token], None
            pieces = [text[i:i + 1] for i in range(len(text))]
            while len(pieces) > 2:
                found = [self.ranks.get(pieces[i] + pieces[i + 1], token) for i in range(len(pieces) - 1)]
                least = min(found)
                if least >= token:
                    break
                i = found.index(least)
                pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
            self.parts[token] = tuple(self.ranks[p] for p in pieces) if len(pieces) == 2 else None
        return self.parts[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at this edge (0 left, 1 right) of ``token`` while it is made, with the merge that
        makes each and the merge that ends it."""
        if token not in self.edges[side]:
            found, now, until = [], token, 1 << 60
            while True:
                parts = self.parted(now)
                found.append((self.bytes[now], now if parts else -1, until))
                if not parts:
                    break
                now, until = parts[side], now
            self.edges[side][token] = found
        return self.edges[side][token]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before the merges that complete both tokens."""
        for left, born, until in self.edge(a, 1):
            for right, made, over in self.edge(b, 0):
                if born < over and made < until:  # they stand next to each other at some time
                    across = self.ranks.get(left + right)
                    if across is not None and across < until and across <= over:
                        return False
        return True

    def arc(self, key: int, last: int, longest: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of what may follow ``last`` where ``longest`` is the longest token ahead."""
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
            self.options.clear()
        found, text = [], self.bytes[longest]
        for n in range(len(text), 0, -1):
            token = self.ranks.get(text[:n])
            if token is not None and (n == 1 or self.parted(token)) and (last < 0 or self.neighbours(last, token)):
                found.append((token, n))
        arc = tuple(found)
        arc = self.arcs[key] = self.options.setdefault(arc, arc)
        return arc

    def fit(self, ahead: bytes) -> tuple[int, bool]:
        """The longest token that ``ahead`` begins with, and whether more bytes could make it longer."""
        node, longest = 0, -1
        for byte in ahead:
            node = self.trie[node].get(byte)
            if node is None:
                return longest, False
            if self.token[node] >= 0:
                longest = self.token[node]
        return longest, bool(self.trie[node])

    def look(self, ahead: bytes, piece: bytes, at: int) -> int:
        """The longest token at this place; remembered where ``ahead``, its first bytes, decides it."""
        if len(self.seen) >= ARCS:
            self.seen.clear()
        longest, more = self.fit(ahead)
        if more and len(ahead) == LOOKAHEAD:
            self.seen[ahead] = -1
            return self.fit(piece[at:at + self.longest])[0]
        self.seen[ahead] = longest
        return longest

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token stays one
            return [whole]
        arcs, seen = self.arcs, self.seen
        out: list[int] = []
        undo: list[tuple[int, tuple]] = []
        dead: set[int] = set()
        at, last, end = 0, -1, len(piece)
        while at < end:
            ahead = piece[at:at + LOOKAHEAD]
            longest = seen.get(ahead, -1)
            if longest < 0:
                longest = self.look(ahead, piece, at)
            key = (last + 1 << 20) | longest
            options = arcs.get(key)
            if options is None:
                options = self.arc(key, last, longest)
            while True:
                for last, n in options:
                    if at + n not in dead:
                        break
                else:
                    dead.add(at)
                    at, options = undo.pop()
                    out.pop()
                    continue
                break
            undo.append((at, options))
            out.append(last)
            at += n
        return out


class Codec:
    """Encodes and decodes whole texts; chunks met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.vocabulary = self.machine.bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met = bytearray(MET)
        # Letters alone, or with one sign behind, are one piece or two under the usual patterns; asked of this one.
        self.letters = self.split.findall(" ab") == [" ab"] and self.split.findall(" ab.") == [" ab", "."]

    def chunk(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            if self.letters and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                ids = array("I", self.machine.encode(text.encode())).tobytes()
            elif self.letters and text[-1] in ".," and text[1:-1].isalpha() and (text[0] == " " or text[0].isalpha()):
                ids = self.chunk(text[:-1]) + array("I", self.machine.encode(text[-1].encode())).tobytes()
            else:
                found: list[int] = []
                for piece in self.split.findall(text):
                    found += self.machine.encode(piece.encode())
                ids = array("I", found).tobytes()
        if len(text) < 64:
            mark = hash(text) % MET
            if not self.met[mark]:
                self.met[mark] = 1
                return ids
            if len(self.young) >= CACHED:
                self.old = self.young
                self.young = {}
                self.met = bytearray(MET)
            self.young[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers.

        A single blank between two other characters always begins a piece, so texts are cut there.
        """
        if text[:1].isspace() or text[-1:].isspace() or "  " in text or BETWEEN.search(text):
            cuts = [m.start() for m in BLANK.finditer(text)]
            chunks = [text[s:e] for s, e in zip([0, *cuts], [*cuts, len(text)])]
        else:
            words = text.split(" ")
            chunks = [words[0], *[" " + w for w in words[1:]]]
        out = []
        for chunk in chunks:
            ids = self.young.get(chunk)
            out.append(self.chunk(chunk) if ids is None and chunk else ids or b"")
        return b"".join(out)

    def decode(self, ids: bytes, errors: str = "replace") -> Iterator[str]:
        """Text as it comes: bytes that end inside a character wait for the next ids."""
        machine = codecs.getincrementaldecoder("utf-8")(errors)
        numbers = array("I")
        numbers.frombytes(ids)
        for i in range(0, len(numbers), BATCH):
            yield machine.decode(b"".join(map(self.vocabulary.__getitem__, numbers[i:i + BATCH])))
        yield machine.decode(b"", True)


BLANK = regex.compile(r"(?<=\S) (?=\S)")
BETWEEN = re.compile(r"\s \s")  # a blank inside a run of white space


def codec(name: str, pattern: str) -> Codec:
    """The worker's codec for a rank file that ``addFile`` has brought to it; kept over the worker's tasks."""
    kept = worker_store()
    if (name, pattern) not in kept:
        with open(SparkFiles.get(name), "rb") as lines:
            kept[name, pattern] = Codec(read_ranks(lines), pattern)
        gc.freeze()
    return kept[name, pattern]


def ship(spark: SparkSession, rank_file: str) -> str:
    """Brings the rank file to every executor; its name there."""
    spark.sparkContext.addFile(rank_file)
    return rank_file.rsplit("/", 1)[-1]


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every whole text encoded, and its ids decoded again.

    Null is encoded like the empty text: no ids. Rows are independent of each other.
    """
    name = ship(docs.sparkSession, rank_file)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in slices(batches):
            ids = [own.encode(t or "") for t in values(batch.column(1))]
            texts = ["".join(own.decode(i)) for i in ids]
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
            numbers = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), numbers), pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(each, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``, without carrying the ids on."""
    name = ship(docs.sparkSession, rank_file)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in values(batch.column(1)):
                ids = own.encode(text or "")
                back = hashlib.sha256()
                for part in own.decode(ids):
                    back.update(part.encode())
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                 pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(
        each, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
