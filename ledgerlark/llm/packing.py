"""Packing of tokenised documents into sequences by minimum bin slack.

Each partition packs its own documents as a stream. A document's ids (and a closing id) are cut into
whole windows and one rest. Rests wait in a pool of bounded size, as a multiset of lengths. For each
window the longest waiting rest is placed first and a bitset subset-sum dynamic programme over the
multiset of remaining lengths finds the total closest to the capacity; walking the bitsets backwards
gives how many rests of each length to take. What the last windows of a partition lack is cut from other
rests, and a tail shorter than a window goes to sequences of powers of two, which need no padding.

Sequence ids hold the partition in their upper bits. A partition is packed alike on every attempt, as its
rows come from the same split of the input, so a task that is run again yields the same pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, padded bigint"


def byte_of() -> dict[str, int]:
    """The printable stand-ins that a byte-level vocabulary file writes for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(vocabulary: str):
    """A byte-pair encoder over the vocabulary of a byte-level tokenizer file.

    Ids are those that the tokenizers library gives for the file (tests compare them); tiktoken finds them in
    about a fifth of the time for pieces that the cache lacks. It encodes what lies between special tokens.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special, stand_in = {t["content"] for t in model["added_tokens"] if t["special"]}, byte_of()
    ranks = {bytes(stand_in[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Uneven(Exception):
    """A blank before white space or at an end: the piece there is not a blank and a word."""


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a tokenizer file: their strings get these ids wherever they stand in a text."""
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that depend on their surroundings are not read")
    return {t["content"]: t["id"] for t in added}


class PieceCache(dict):
    """By word, the ids of a blank and the word as little-endian bytes; it holds `most` words at most."""

    def __init__(self, vocabulary: str, most: int):
        super().__init__()
        self.encode, self.most = encoder(vocabulary).encode_ordinary, most
        self.added = added_tokens(vocabulary)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def fresh(self, piece: str) -> bytes:
        return array("I", self.encode(piece)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word[:1].strip():
            raise Uneven
        ids = self.fresh(" " + word)
        if len(self) < self.most:
            self[word] = ids
        return ids


def blank_pieces(text: str) -> list[str]:
    """Cut before every blank that a non-space follows.

    The byte-level splitter always begins a new token there, so the ids of the pieces, joined, are those
    of the text.
    """
    first, *rest = text.split(" ")
    out = [first] if first else []
    for word in rest:
        if word and not word[0].isspace() and (out or first):
            out.append(" " + word)
        elif out:
            out[-1] += " " + word
        else:
            out.append(" " + word)
    return out


def token_ids(text: str, cache: PieceCache) -> np.ndarray:
    """Ids of a text: those of its added tokens and, each on its own, of the parts between them."""
    if not any(token in text for token in cache.added):
        return np.frombuffer(plain_ids(text, cache), dtype="<u4")
    parts = [array("I", [cache.added[p]]).tobytes() if k % 2 else plain_ids(p, cache) for k, p in enumerate(cache.cuts.split(text))]
    return np.frombuffer(b"".join(parts), dtype="<u4")


def plain_ids(text: str, cache: PieceCache) -> bytes:
    first, *rest = text.split(" ")
    try:
        found = [cache.fresh(first), *map(cache.__getitem__, rest)]
    except Uneven:
        found = [cache[p[1:]] if p[0] == " " and p[1:2].strip() else cache.fresh(p) for p in blank_pieces(text)]
    return b"".join(found)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) from the multiset `counts` whose total is as close to `room` as can be, not above.

    `reach[k]` holds, as bits, the totals that the first k lengths reach. Long lengths come first and the
    programme ends as soon as `room` itself is reached.
    """
    full = (1 << (room + 1)) - 1
    reach, tried = [1], []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        bits, shift, left = reach[-1], length, min(counts[length], room // length)
        while left > 0:  # doubling: any number of copies up to the count
            take = min(shift // length, left)
            bits |= (bits << (take * length)) & full
            left, shift = left - take, shift * 2
        tried.append(length)
        reach.append(bits)
        if bits >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for k in range(len(tried) - 1, -1, -1):
        used = 0
        while not reach[k] >> total & 1:
            total, used = total - tried[k], used + 1
        if used:
            chosen.append((tried[k], used))
    return chosen


class Packer:
    """Packs the pieces of one partition; `pool` bounds how many rests wait."""

    def __init__(self, window: int, pool: int, first_sequence: int):
        self.window, self.pool, self.sequence = window, pool, first_sequence
        self.rests: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.waiting = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], padded: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, padded))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.emit([(doc, start, ids[start : start + self.window], len(ids))], self.window)
        if whole < len(ids):
            self.put((doc, whole, ids[whole:], len(ids)))
        if self.waiting > self.pool:
            while self.waiting > self.pool // 2:
                self.pack_one()

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.rests[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.waiting += 1

    def take(self, n: int) -> tuple:
        self.waiting -= 1
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        return self.rests[n].popleft()

    def pack_one(self) -> None:
        pieces = [self.take(max(self.counts))]
        for n, times in fill(self.counts, self.window - len(pieces[0][2])):
            pieces += [self.take(n) for _ in range(times)]
        room = self.window - sum(len(p[2]) for p in pieces)
        if room and self.counts:  # no choice fills it: cut what is missing from the longest rest
            doc, start, ids, total = self.take(max(self.counts))
            pieces.append((doc, start, ids[:room], total))
            if len(ids) > room:
                self.put((doc, start + room, ids[room:], total))
            room = max(0, room - len(ids))
        if room and not self.counts:
            self.tail(pieces)
        else:
            self.emit(pieces, self.window)

    def tail(self, pieces: list[tuple]) -> None:
        """The last, partly filled window as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            got, room = [], size
            while room:
                doc, start, ids, total = pieces.pop(0)
                got.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(got, size)
            left -= size

    def finish(self) -> None:
        while self.counts:
            self.pack_one()

    def drain(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, closing_id: int = 1, pool: int = 8192, cached_pieces: int = 300_000) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids.

    `docs` needs doc_id and text; other columns are not read. `vocabulary` is the path of a byte-level
    tokenizer file, the same on every executor. Null and empty texts are documents of the closing id alone.
    Repeated rows are packed once each; a null doc_id stays null. An empty table gives no rows. `padded` is
    the length a sequence has with padding: `window`, or its own length where that is a power of two.
    Memory holds one Arrow batch and at most `pool` rests of under `window` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(vocabulary, cached_pieces)
        packer = Packer(window, pool, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc, np.append(token_ids(text.as_py() or "", cache), np.uint32(closing_id)).astype("<u4"))
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
