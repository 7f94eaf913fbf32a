"""Similarity join of word-shingle sets by PartEnum signatures.

Sets are put into bands of sizes. Within a band, two sets with Jaccard similarity of at least the threshold
differ in at most k elements. The domain of shingles is hashed into n1 partitions of three parts each. With
n1 > k / 2, sets that close have a partition with at most one difference, hence two of its three parts in
common: of the three two-part subsets of each partition, one is equal. The hash of a set's elements in such a
subset is a signature, and sufficiently similar sets share at least one. A set near the lower end of its band
also signs for the band below, where k allows for such guests.

A subset without elements would be shared by everybody. So n1 exceeds what is needed by `spare`
partitions: a set with at most `spare` partitions that have an empty subset is met by its neighbours in a
full one. Sets with more sign again under another hashing of the domain; both sides of a pair that is not
met under one hashing sign under the next. After the last one empty subsets sign too, so no link is lost.

Texts are read a chunk at a time, and every step works on all sets of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_written, free_shuffles, written

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
LEVELS = 6
ALL_BANDS = range(90)


def mixed(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (U64(seed) if np.isscalar(seed) else seed)) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


BYTES = mixed(np.arange(1, 257, dtype=U64), 11)[LOWER]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x2545F4914F6CDD1D
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers firsts[i] .. firsts[i] + sizes[i] - 1 of every i, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - sizes), sizes)


def chunks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, their bounds by row) of chunks of about `most` bytes; a longer text is one chunk. Null texts are empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(elements, their bounds by text): sorted distinct 64-bit hashes of each text's shingles of so many words; of fewer words, of all at once.

    A-Z are lower-cased, words are what blanks and U+0009 to U+000D leave; texts without words have none.
    """
    inside, any_bytes = ~BLANKS[raw], bounds[:-1] < bounds[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    for edge, at in ((first, bounds[:-1][any_bytes]), (last, bounds[1:][any_bytes] - 1)):
        edge[at] = inside[at]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(1 << max(19, int(len(raw) + 1).bit_length()))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=sums[1:])
    word = mixed((sums[stops] - sums[starts]) * down[starts], 23)
    at = np.searchsorted(starts, bounds)
    held = np.diff(at)
    runs = [mixed(word, 31)]  # runs[k]: hashes of k + 1 words in a row
    for k in range(1, words):
        runs.append(mixed(runs[-1][:-1] + word[k:], 31 + k) if len(runs[-1]) else runs[-1])
    sizes = np.where(held < words, np.minimum(held, 1), held - words + 1)
    elements = np.zeros(int(sizes.sum()), U64)
    to = np.concatenate(([0], np.cumsum(sizes)))
    long = held >= words
    elements[spread(to[:-1][long], sizes[long])] = runs[-1][spread(at[:-1][long], sizes[long])]
    for k in range(1, words):
        few = held == k
        elements[to[:-1][few]] = runs[k - 1][at[:-1][few]]
    for lo, hi in zip(to[:-1].tolist(), to[1:].tolist()):
        if hi - lo > 1:
            elements[lo:hi].sort()
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    new[to[:-1][sizes > 0]] = True
    return elements[new], np.concatenate(([0], np.cumsum(new)))[to]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The set of one text."""
    [(_, _, raw, bounds)] = chunks(pa.array([text], pa.string()))
    return shingle_sets(raw, bounds, words)[0]


def fingerprints(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set; 0 for empty ones."""
    sizes = np.diff(at)
    out, some = np.zeros(len(sizes), U64), sizes > 0
    if some.any():
        out[some] = mixed(np.add.reduceat(mixed(elements, 97), at[:-1][some], dtype=U64) ^ sizes[some].astype(U64), 5)
    return out


def band(level: int) -> tuple[int, int]:
    """Sizes of band `level`: the upper end is half as much again as the lower."""
    lo = 1
    for _ in range(level):
        lo = lo * 3 // 2 + 1
    return lo, lo * 3 // 2


def shape(level: int, percent: int) -> tuple[int, int, int]:
    """(k, n1, spare) of a band: the most differences, partitions, and those that may have an empty subset.

    Sets of sizes a <= b at the threshold differ in at most (a + b) * (1 - t) / (1 + t) elements, where a is in
    the band and b is at most a / t.
    """
    hi = band(level)[1]
    k = (hi + hi * 100 // percent) * (100 - percent) // (100 + percent)
    need = k // 2 + 1
    spare = 1 + need // 6
    return k, need + spare, spare


@lru_cache(8)
def shapes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends, upper ends and shapes of all bands. A partner must lie at most one band away."""
    if percent < 67:
        raise ValueError("bands are laid for thresholds of 67 percent and more")
    return np.array([band(x)[0] for x in ALL_BANDS]), np.array([band(x)[1] for x in ALL_BANDS]), np.array([shape(x, percent) for x in ALL_BANDS])


def signatures(elements: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of all sets; equal sets only are near where k is 0, and those are one node."""
    lows, highs, forms = shapes(percent)
    size = np.diff(at)
    level, row = np.searchsorted(lows, size, "right") - 1, np.flatnonzero(size)
    guest = row[level[row] > 0]
    guest = guest[100 * highs[level[guest] - 1] >= percent * size[guest]]
    row, level = np.concatenate((row, guest)), np.concatenate((level[row], level[guest] - 1))
    some = forms[level, 0] > 0
    row, level = row[some], level[some]
    sigs, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for turn in range(LEVELS):
        if not len(row):
            break
        n1, spare, sizes = forms[level, 1], forms[level, 2], size[row]
        own = elements[spread(at[row], sizes)]
        base = np.concatenate(([0], np.cumsum(n1)))
        part = ((mixed(own, 1000 + turn) >> U64(32)) * np.repeat((3 * n1).astype(U64), sizes) >> U64(32)).astype(np.int64) + np.repeat(3 * base[:-1], sizes)
        sums, held = np.zeros(3 * base[-1], U64), np.zeros(3 * base[-1], bool)
        np.add.at(sums, part, mixed(own, 2000 + turn))
        held[part] = True
        sums, held = sums.reshape(-1, 3), held.reshape(-1, 3)
        full = np.stack([held[:, i] | held[:, j] for i, j in ((0, 1), (0, 2), (1, 2))], axis=1)
        done = np.add.reduceat(~full.all(axis=1), base[:-1], dtype=np.int64) <= spare
        if turn == LEVELS - 1:
            full |= ~np.repeat(done, n1)[:, None]
        place = (np.arange(len(sums)) - np.repeat(base[:-1], n1)) * 3
        seed, owner = np.repeat((100_000 + level * LEVELS + turn).astype(U64), n1), np.repeat(row, n1)
        for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            ok = full[:, which]
            sigs.append(mixed(sums[ok, i] + mixed(sums[ok, j], 7) + (place[ok] + which).astype(U64), seed[ok]))
            rows.append(owner[ok])
        row, level = row[~done], level[~done]
    return np.concatenate(sigs), np.concatenate(rows)


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of sketches: powers of two, over twice and up to four times the elements, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(2 * np.maximum(sizes, 1) + 1)).astype(np.int64))


def sketches(elements: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, parities of the numbers of its elements in hash buckets.

    Bits in which two sketches differ are differences of the sets, so their number bounds these from below.
    """
    sizes = np.diff(at)
    bits = sketch_bits(sizes)
    base = np.concatenate(([0], np.cumsum(bits)))
    bucket = (mixed(elements, 555) % np.repeat(bits.astype(U64), sizes)).astype(np.int64) + np.repeat(base[:-1], sizes)
    odd = (np.bincount(bucket, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[lo:hi] for lo, hi in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def folded(raw: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches, which lie in `raw` from at[i] to at[i + 1] (64-bit words), folded to width[i] words: (words, where each begins)."""
    own, to = np.diff(at), np.cumsum(width) - width
    out = np.zeros(int(width.sum()), U64)
    for wide, narrow in set(zip(own.tolist(), width.tolist())):
        rows = np.flatnonzero((own == wide) & (width == narrow))
        words = raw[(at[rows][:, None] + np.arange(wide)).ravel()].reshape(len(rows), wide // narrow, narrow)
        out[(to[rows][:, None] + np.arange(narrow)).ravel()] = np.bitwise_xor.reduce(words, axis=1).ravel()
    return out, to


def differences(words: np.ndarray, at: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """In how many bits the sketches i and j differ, which have equal widths; `most` words are held at a time."""
    out = np.zeros(len(i), np.int64)
    for wide in np.unique(width[i]).tolist():
        pairs = np.flatnonzero(width[i] == wide)
        for lo in range(0, len(pairs), max(1, most // wide)):
            some, column = pairs[lo : lo + max(1, most // wide)], np.arange(wide)
            out[some] = np.bitwise_count(words[at[i[some]][:, None] + column] ^ words[at[j[some]][:, None] + column]).sum(axis=1, dtype=np.int64)
    return out


def rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        least, before = np.minimum(label[i], label[j]), label.copy()
        for side in (label[i], label[j], i, j):
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            return label


def forest(near: Iterator[tuple[int, np.ndarray]], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links (i, js) those that join two trees; `label` has each node's tree and is kept up."""
    for i, js in near:
        while len(js := js[label[js] != label[i]]):
            yield i, int(js[0])
            label[label == label[js[0]]] = label[i]


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


ROWS = "slot int, doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, sketch binary, kind int, nodes binary, counts binary, sigs binary"


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of ROWS, null where no column is given."""
    types = {"slot": pa.int32(), "kind": pa.int32(), "sketch": pa.binary(), "nodes": pa.binary(), "counts": pa.binary(), "sigs": pa.binary()}
    names = [x.split()[0] for x in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, types.get(c, pa.int64()))) for c in names], names=names)


def read_texts(docs: DataFrame, words: int, percent: int, slots: int, hot: int = 64) -> DataFrame:
    """Rows of each text (its set's fingerprint `node`, size and sketch) and rows of signatures, put together by slot.

    Signatures of the distinct sets of a task are collected in lots, larger where there are more slots. A row of kind 0 has, for one
    slot, the nodes of a lot, how many signatures each has there, and their lower halves. A signature that more
    than `hot` sets of a lot have is dealt out over all slots (kind 1: whole signatures, by node); one of its
    nodes goes to the signature's own slot as well (kind 2), where the rows of other lots meet it.
    """
    most = min(4_000_000, 6250 * slots)

    def laid(slot: np.ndarray, node: np.ndarray, sig: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        known, at = np.unique(node, return_inverse=True)
        order = np.argsort(slot.astype(np.int64) * max(1, len(known)) + at)
        slot, node, sig = slot[order], node[order], sig[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else slot
        runs = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (slot[1:] != slot[:-1])))) if len(slot) else slot
        counts = np.diff(np.append(runs, len(slot))).astype(np.int32)
        held, sig = node[runs], sig.astype(np.uint32) if kind == 0 else sig
        cut, ends = np.searchsorted(runs, np.append(first, len(slot))), np.append(first, len(slot))
        columns: dict[str, list] = {"nodes": [], "counts": [], "sigs": []}
        for i in range(len(first)):
            columns["nodes"].append(held[cut[i] : cut[i + 1]].tobytes())
            columns["counts"].append(counts[cut[i] : cut[i + 1]].tobytes())
            columns["sigs"].append(sig[ends[i] : ends[i + 1]].tobytes())
        for at in range(0, len(first), 20_000):
            n = len(first[at : at + 20_000])
            yield _batch(n, slot=pa.array(slot[first[at : at + n]].astype(np.int32)), kind=pa.array([kind] * n, pa.int32()), **{c: pa.array(v[at : at + n], pa.binary()) for c, v in columns.items()})

    def lot(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        ordered = np.sort(sig)
        common = np.unique(ordered[hot:][ordered[hot:] == ordered[:-hot]]) if len(sig) > hot else sig[:0]
        many = np.isin(sig, common) if len(common) else np.zeros(len(sig), bool)
        slot = mixed(sig, 9) % U64(slots)
        yield from laid(slot[~many], node[~many], sig[~many], 0)
        yield from laid(mixed(node[many] ^ sig[many], 3) % U64(slots), node[many], sig[many], 1)
        one = np.flatnonzero(many)[np.unique(sig[many], return_index=True)[1]]
        yield from laid(slot[one], node[one], sig[one], 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, held = [], [], 0
        for batch in batches:
            for lo, hi, raw, bounds in chunks(batch.column("text")):
                elements, at = shingle_sets(raw, bounds, words)
                node, sizes = fingerprints(elements, at), np.diff(at)
                some = sizes > 0
                new = np.zeros(len(node), bool)
                new[np.unique(node, return_index=True)[1]] = True
                new &= some & np.fromiter((x not in seen for x in node.tolist()), bool, len(node))
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(node[new].tolist())
                rows = batch.slice(lo, hi - lo)
                where = mixed(rows.column("text_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(U64) ^ rows.column("doc_id").fill_null(-1).to_numpy().view(U64), 4) % U64(slots)
                drawn = sketches(elements, at)
                yield _batch(
                    hi - lo, slot=pa.array(where.astype(np.int32)), doc_id=rows.column("doc_id"), text_hash=rows.column("text_hash"), n_shingles=pa.array(sizes),
                    node=pa.array(node.view(np.int64), mask=~some), sketch=pa.array([s if k else None for s, k in zip(drawn, new)], pa.binary()),
                )
                drop = np.repeat(new, sizes)
                sig, row = signatures(elements[drop], np.concatenate(([0], np.cumsum(sizes[new]))), percent)
                sigs.append(sig)
                nodes.append(node[new][row])
                held += len(sig)
                if held > most:
                    yield from lot(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        if held:
            yield from lot(sigs, nodes)

    return _text(docs).select("doc_id", "text_hash", "text").mapInArrow(run, ROWS)


def member_sets(rows: dict[int, list[tuple[bytes, bytes, bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, sizes, members) of the signatures of a slot that several nodes share; equal member sets come out once.

    A group is named by its members, one of a signature dealt out by that signature, so that its parts meet.
    """

    def read(kind: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        found = rows.get(kind, [])
        node, count = (np.frombuffer(b"".join(x[i] for x in found), t) for i, t in ((0, U64), (1, np.int32)))
        return np.repeat(node, count), np.frombuffer(b"".join(x[2] for x in found), dtype)

    def groups(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct nodes of each signature: (nodes in order of signatures, signatures, where each begins, how many nodes it has)."""
        (known, who), (sigs, which) = (np.unique(x, return_inverse=True) for x in (node, sig))
        both = np.unique(which.astype(np.int64) * max(1, len(known)) + who)
        size = np.bincount(both // max(1, len(known)), minlength=len(sigs))
        return known[both % max(1, len(known))], sigs, np.cumsum(size) - size, size

    nodes, sigs, _, size = groups(*read(1, U64))
    yield mixed(sigs, 13).view(np.int64), size, nodes.view(np.int64)
    (node, half), (extra, whole) = read(0, np.uint32), read(2, U64)
    nodes, sigs, first, size = groups(np.concatenate((node, extra)), np.concatenate((half, whole.astype(np.uint32))))
    if not len(sigs):
        return
    name = mixed(np.add.reduceat(mixed(nodes, 77), first, dtype=U64), 78)
    whole = np.unique(whole)
    dealt = np.searchsorted(sigs, whole.astype(np.uint32))  # two whole signatures may have one lower half
    keep = np.zeros(len(sigs), bool)
    keep[np.unique(name, return_index=True)[1]] = True
    keep &= size > 1
    keep[dealt] = False
    for names, at in ((name[keep], np.flatnonzero(keep)), (mixed(whole, 13), dealt)):
        yield names.view(np.int64), size[at], nodes[spread(first[at], size[at])].view(np.int64)


def met(rows: DataFrame, slots: int) -> DataFrame:
    """The rows of texts as they are, and one row (group, members) for each set of nodes that share a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        names = ["doc_id", "text_hash", "n_shingles", "node", "sketch"]
        for batch in batches:
            kinds = batch.column("kind")
            plain = batch.filter(kinds.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*(plain.column(c) for c in names), pa.nulls(plain.num_rows, pa.int64()), pa.nulls(plain.num_rows, pa.list_(pa.int64()))], names=[*names, "group", "members"])
            signed = batch.filter(kinds.is_valid())
            for slot, kind, *row in zip(*(signed.column(c).to_pylist() for c in ("slot", "kind", "nodes", "counts", "sigs"))):
                held.setdefault(slot, {}).setdefault(kind, []).append(row)
        for slot in sorted(held):
            for group, size, nodes in member_sets(held.pop(slot)):
                ends = np.concatenate(([0], np.cumsum(size)))
                for at in range(0, len(group), 20_000):
                    part, end = group[at : at + 20_000], ends[at : at + 20_001]
                    lists = pa.ListArray.from_arrays(pa.array((end - end[0]).astype(np.int32)), pa.array(nodes[end[0] : end[-1]]))
                    empty = [pa.nulls(len(part), pa.binary() if c == "sketch" else pa.int64()) for c in names]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(part), lists], names=[*names, "group", "members"])

    return rows.repartitionById(slots, F.col("slot")).mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, sketch binary, group bigint, members array<bigint>")


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, which come sorted by `task`."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy()
        start = 0
        for end in [*(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]:
            part = batch.slice(start, end - start)
            if rest and rest[0].column("task")[0] != part.column("task")[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
            start = end
    if rest:
        yield pa.Table.from_batches(rest)


def _links(found: list[tuple[int, int]], node: np.ndarray) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])


def _dealt(rows: DataFrame, group: str, across: bool, columns: list[str]) -> DataFrame:
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("side", side)
    if across:
        others = F.filter(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda x: x != F.col("side"))
        rows = rows.withColumn("other", F.explode(others))
    else:
        rows = rows.withColumn("other", F.col("side"))
    task = F.xxhash64(group, F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(task.alias("task"), "side", (F.col("side") == F.col("other")).alias("own"), *columns)


def likely(members: DataFrame, nodes: DataFrame, percent: int, across: bool) -> DataFrame:
    """Links (a, b) that connect those members of a group whose pairs' sketches don't rule the threshold out: of each task, a tree.

    A group's members are cut into blocks, first each on its own, then (across) every two of them, so a group of
    any size is compared in bounded memory. members: group, node, component, blocks.
    """
    rows = _dealt(members.join(nodes, "node"), "group", across, ["node", "component", "n_shingles", "sketch"])

    def compared(part: pa.RecordBatch) -> pa.RecordBatch:
        task, node, component, size, side = (part.column(c).to_numpy() for c in ("task", "node", "component", "n_shingles", "side"))
        own, drawn = part.column("own").to_numpy(zero_copy_only=False), part.column("sketch")
        offsets = np.frombuffer(drawn.buffers()[1], np.int32)[drawn.offset : drawn.offset + len(drawn) + 1].astype(np.int64)
        raw = np.frombuffer(drawn.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes(), U64)
        first = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        held = np.diff(np.append(first, len(task)))
        at = (offsets - offsets[0]) // 8
        width = np.repeat(np.minimum.reduceat(np.diff(at), first), held)
        words, to = folded(raw, at, width)
        after = np.repeat(first + held, held) - np.arange(len(task)) - 1  # later rows of the row's task
        ends, links = np.cumsum(after), []
        lo = 0
        while lo < len(task):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000, "right")))
            i, j = np.repeat(np.arange(lo, hi), after[lo:hi]), spread(np.arange(lo, hi) + 1, after[lo:hi])
            ok = (component[i] != component[j]) & (own[i] | (side[i] != side[j])) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            ok = differences(words, to, width, i, j) * (100 + percent) <= (100 - percent) * (size[i] + size[j])
            links.append((i[ok], j[ok]))
            lo = hi
        root = rooted(len(task), np.concatenate([i for i, _ in links]), np.concatenate([j for _, j in links]))
        moved = np.flatnonzero(root != np.arange(len(task)))
        pairs = np.unique(np.stack([node[moved], node[root[moved]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            task = batch.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1])) if len(task) else 0  # the last task may go on
            if cut or (rest and len(task) and rest[0].column("task")[0].as_py() != task[0]):
                yield compared(pa.concat_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest and sum(map(len, rest)):
            yield compared(pa.concat_batches(rest))

    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def overlaps(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bit matrix: for each set, which of the elements that several sets have it has."""
    known, which, count = np.unique(elements, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    row, keep = np.repeat(np.arange(len(at) - 1), np.diff(at)), count[which] > 1
    column, row = column[which[keep]], row[keep]
    bits = np.zeros((len(at) - 1, max(1, -(-int((count > 1).sum()) // 64))), U64)
    np.bitwise_or.at(bits, (row, column >> 6), U64(1) << (column & 63).astype(U64))
    return bits


def verified(families: DataFrame, docs: DataFrame, words: int, percent: int, across: bool) -> DataFrame:
    """Links (a, b) between nodes of a family whose sets are similar enough, of each task as few as join the same nodes.

    families: family, node, doc_id and text_hash of a row that has the node's text, component, blocks. Every set
    of a block is compared exactly with every other that is not yet in its component; blocks as in `likely`.
    """
    wanted = families.withColumnRenamed("doc_id", "wanted_id").withColumnRenamed("text_hash", "wanted_hash")
    rows = _text(docs).where("text is not null").join(wanted, F.expr("doc_id <=> wanted_id and text_hash = wanted_hash"))
    rows = _dealt(rows, "family", across, ["node", "component", "text"])

    def near(bits: np.ndarray, size: np.ndarray, side: np.ndarray, own: bool, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(size) - 1):
            apart = (label[i + 1 :] != label[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
            if not own:
                apart &= side[i + 1 :] != side[i]
            at = i + 1 + np.flatnonzero(apart)
            if len(at):
                both = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
                yield i, at[100 * both >= percent * (size[i] + size[at] - both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_task(batches):
            node = part.column("node").to_numpy()
            once = np.sort(np.unique(node, return_index=True)[1])
            if len(once) < 2:
                continue
            part = part.take(pa.array(once)).combine_chunks()
            node, component, side = (part.column(c).to_numpy() for c in ("node", "component", "side"))
            sets, sizes = [], []
            for _, _, raw, bounds in chunks(part.column("text").chunk(0)):
                elements, at = shingle_sets(raw, bounds, words)
                sets.append(elements)
                sizes.append(np.diff(at))
            size, label = np.concatenate(sizes), np.unique(component, return_inverse=True)[1]
            bits = overlaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))))
            found = list(forest(near(bits, size, side, part.column("own")[0].as_py(), label), label))
            if found:
                yield _links(found, node)

    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def _joined(rows: DataFrame, key: str, blocks: str, compare: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """(node, component) by the links that `compare` finds within the groups named by `key`: in each block on its own,
    then across the blocks of those of several blocks that these links leave in several components."""
    size = rows.groupBy(key).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr(f"cast({blocks} as int)").alias("blocks")).where("lo < hi")
    links = written(compare(rows.join(size.select(key, "blocks"), key).withColumn("component", F.col("node")), False), "links")
    found = written(components(links), "joined")
    large = written(size.where("blocks > 1").select(key, "blocks"), "large")
    if not large.isEmpty():
        labelled = rows.join(large, key).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        still = labelled.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(key)
        more = written(compare(labelled.join(still, key), True), "links")
        drop_written(found)
        found = written(components(links.unionByName(more)), "joined")
        drop_written(more)
    drop_written(links, large)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 2048, slots: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of each row: the smallest doc_id that links reach.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. Rows with equal sets are
    one node. Null texts and texts without words have no shingles and link with nothing, not even with each
    other. Repeated rows come out once each; rows with a null doc_id stay, but lend no number to their
    component, which is null if they are all it has. An empty table gives no rows. Other columns are not read.
    text_hash, xxhash64 of the text, tells rows of one doc_id apart.

    Sets that share a signature are candidates. Sketches, which bound the differences of two sets from below,
    rule out most pairs; what they leave falls into families, and within each all sets are compared exactly. A
    task says only which links join components, so no group is ever expanded to pairs, and the result is that of
    comparing all pairs of sets. Groups of more than `block` members are compared block by block, and only while
    they hold more than one component. `slots` is the number of parts the signatures are dealt into, about
    1.5 million to each unless it is given.
    """
    if slots is None:
        slots = max(64, -(-(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0) // 12_000_000))
    table = written(met(read_texts(docs, words, percent, slots), slots), "met")
    free_shuffles(docs.sparkSession)
    rows = table.where("group is null").select("doc_id", "text_hash", "n_shingles", "node")
    drawn = table.where("sketch is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    members = table.where("group is not null").select("group", F.explode("members").alias("node")).distinct()
    firsts = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))

    families = _joined(members, "group", f"ceil(count(*) / {block})", lambda rest, across: likely(rest, drawn, percent, across))
    known = families.withColumnRenamed("component", "family").join(firsts, "node").select("family", "node", "n_shingles", "first.doc_id", "first.text_hash")
    size = f"greatest(ceil(count(*) / {block}), ceil(sum(n_shingles) / 500000))"
    found = _joined(known, "family", size, lambda rest, across: verified(rest.drop("n_shingles"), docs, words, percent, across))

    of_node = firsts.join(found, "node", "left").select("node", F.col("least").alias("doc_id"), F.coalesce("component", "node").alias("component"))
    named = of_node.join(of_node.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    drop_written(families)
    return rows.join(named, "node", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
