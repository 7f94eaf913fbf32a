"""Conversation structure repair by target alignment.

A sound conversation's role initials are `(s?(ua)+)?`: empty, or an optional system turn and then user and assistant
in turn. A conversation is aligned with every feasible length of that alternating string, as Wagner and Fischer do,
and the cheapest edits of all lengths count. A turn is kept (0), rerolled to user or assistant (3) or deleted (4;
blank and repeated turns must be), a turn without text is inserted (3), and a truncated turn that stays adds 3.

The table is filled from the ends: its column says how many symbols of the target are still to come, so all lengths of
a form share it, and the optional system turn has a column of its own. A greedy repair is the incumbent: cells whose
count of turns and of symbols left differ by more than its cost pays for (Ukkonen's band) are not looked at. The backtrace
follows all lengths of least cost at once and takes the ASCII-least edit at every step, which compares their audits.
Rows of the table are kept at every k-th turn, k about the square root of the turns, and filled in again between them.

Two passes over the turns, each sorted within its conversation: the first carries a byte and a digest for each turn and
leaves the audit, the second streams the texts past it. Neither holds the texts of a conversation. A conversation stays in one task, as its audit
and its digest, one value each, ask for; what is held of it there is its turns' bytes and digests and the band of the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Costs of the edits, and what a truncated turn adds where it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT, SYSTEM, OTHER = range(4)
BROKEN, DROPPED = 4, 8  # flags of a turn's code: truncated, must be deleted
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
NEVER = 1 << 40

ORDER = ["turn_", "role_", "text_", "copy_"]


def damaged(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn and the turns' role and text after damage, with `copy_` for the order of a repeated one.

    crc32 of `conv_id:turn` modulo 20 says what happens to a row: 0 drops it, 1 empties its text, 2 removes . ! and ?
    from it, 3 repeats it, 4 makes its role user. A null is one blank in all of these; null turns stay null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("fate", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).where("fate != 0")
    rows = rows.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate")


def turn_code() -> Column:
    """A turn's kind by the initial of its role, with flags for a blank and for a truncated text."""
    first = F.substring("role", 1, 1)
    kind = F.when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "s", SYSTEM).otherwise(OTHER)
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    return (kind + F.when(end == "", DROPPED).when(~end.isin(".", "!", "?"), BROKEN).otherwise(0)).cast("int")


def greedy(codes: bytes) -> int:
    """Cost of a repair that takes turn by turn what suits, as the incumbent."""
    cost, at, started = 0, 0, False
    for c in codes:
        kind = c & 3
        if c & DROPPED or (kind == SYSTEM and started):
            cost += DELETE
            continue
        if kind == SYSTEM:
            at = 0
        elif kind == at:
            at ^= 1
        elif kind == OTHER:
            cost += REROLE
            at ^= 1
        else:
            cost += INSERT
        cost, started = cost + (TRUNCATED if c & BROKEN else 0), True
    first = next((c & 3 for c in codes if not c & DROPPED), None)
    only_system = first == SYSTEM and sum(not c & DROPPED and c & 3 != SYSTEM for c in codes) == 0
    return min(cost + (2 * INSERT if only_system else INSERT if at else 0), DELETE * len(codes))


class Table:
    """Least costs of aligning the turns from i on with the last m symbols of the alternating string, within the band."""

    def __init__(self, codes: bytes):
        self.codes, self.n = codes, len(codes)
        limit = greedy(codes)
        self.below, self.above = limit // DELETE, limit // INSERT + 2
        self.step = max(16, math.isqrt(self.n))
        self.kept: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        # Least cost with the system turn still to come: turns before it go, and one or more pairs follow.
        self.system = np.full(self.n + 1, NEVER, np.int64)
        row = None
        for i in range(self.n, -1, -1):
            after, row = row, self.filled(i, row)
            if i < self.n:
                self.system[i] = DELETE + self.system[i + 1]
                if codes[i] & 3 == SYSTEM and not codes[i] & DROPPED:
                    low = self.low(i + 1)
                    pairs = after[(low & 1 if low else 2) :: 2]
                    if len(pairs):
                        self.system[i] = min(self.system[i], self.own(i) + int(pairs.min()))
            if i % self.step == 0 or i == self.n:
                self.kept[i] = row
        self.first = row

    def low(self, i: int) -> int:
        return max(0, self.n - i - self.below)

    def own(self, i: int) -> int:
        return TRUNCATED if self.codes[i] & BROKEN else 0

    def filled(self, i: int, after: np.ndarray | None) -> np.ndarray:
        """Row i of the table, by m from `low(i)` on, from row i + 1."""
        low, high = self.low(i), self.n - i + self.above
        m = np.arange(low, high + 1)
        if after is None:
            return INSERT * m
        best, start = np.full(len(m), NEVER, np.int64), self.low(i + 1)
        same = np.clip(m - start, 0, len(after) - 1)
        inside = (m >= start) & (m < start + len(after))
        best[inside] = DELETE + after[same[inside]]
        c = self.codes[i]
        if not c & DROPPED:
            before, has = m - 1 - start, (m - 1 >= start) & (m - 1 < start + len(after))
            change = np.where((m & 1) == (c & 3), 0, REROLE) if c & 3 < 2 else np.full(len(m), REROLE)
            best[has] = np.minimum(best[has], after[before[has]] + change[has] + self.own(i))
        return np.minimum.accumulate(best - INSERT * m) + INSERT * m

    def row(self, i: int) -> np.ndarray:
        """Row i again: the rows between two kept ones are filled in together."""
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min((i // self.step + 1) * self.step, self.n)
            self.block, row = {}, self.kept[end]
            for k in range(end - 1, i // self.step * self.step, -1):
                self.block[k] = row = self.filled(k, row)
        return self.block[i]

    def cost(self, i: int, m: int) -> int:
        at = m - self.low(i)
        row = self.row(i)
        return int(row[at]) if 0 <= at < len(row) else NEVER


@lru_cache(200_000)
def aligned(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation's turn codes; of equal costs the ASCII-least audit.

    Audits are the initials of the edits: Delete, Insert, Keep, Rerole.
    """
    table = Table(codes)
    n, low = table.n, table.low(0)
    even = {low + k: int(c) for k, c in enumerate(table.first) if (low + k) % 2 == 0}
    best = min([*even.values(), int(table.system[0])])
    # States with equal audits so far: symbols to come, or None where the system turn and then pairs are to come.
    states: set[tuple[int, int | None]] = {(0, m) for m, c in even.items() if c == best} | ({(0, None)} if table.system[0] == best else set())
    audit = []
    while (n, 0) not in states:
        ways: dict[str, set] = {}
        for i, m in states:
            here = int(table.system[i]) if m is None else table.cost(i, m)
            c = codes[i] if i < n else DROPPED
            if i < n and here == DELETE + (int(table.system[i + 1]) if m is None else table.cost(i + 1, m)):
                ways.setdefault("D", set()).add((i + 1, m))
            if m is None:
                if i < n and c & 3 == SYSTEM and not c & DROPPED:
                    for pairs in range(2, n - i + table.above + 1, 2):
                        if here == table.own(i) + table.cost(i + 1, pairs):
                            ways.setdefault("K", set()).add((i + 1, pairs))
            elif m:
                if here == INSERT + table.cost(i, m - 1):
                    ways.setdefault("I", set()).add((i, m - 1))
                if not c & DROPPED:
                    kept = c & 3 == m & 1
                    if here == (0 if kept else REROLE) + table.own(i) + table.cost(i + 1, m - 1):
                        ways.setdefault("K" if kept else "R", set()).add((i + 1, m - 1))
        least = min(ways)
        audit.append(least)
        states = ways[least]
    return best, "".join(audit)


STRUCTURE = "key string, conv_id long, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def structure(turns: DataFrame) -> DataFrame:
    """key, conv_id, n, blank, duplicate, truncated, illegal, cost and audit of each conversation of `turns`.

    `turns` has key, conv_id, role, text and the columns of ORDER. A turn's first fault counts: blank, duplicate (role and text
    seen before in the conversation, by a digest of 128 bits), truncated. Neighbours are illegal whose initials are not su, ua or au.
    """
    slim = turns.select("key", "conv_id", turn_code().alias("code"), F.unhex(F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"))).alias("digest"), *ORDER)
    schema = pa.schema([("key", pa.string()), *[(k, pa.int64()) for k in ("conv_id", "n", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def done(key: str, conv: int, codes: bytearray, counts: list[int], illegal: int) -> tuple:
        return (key, conv, len(codes), *counts, illegal, *aligned(bytes(codes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, conv, codes, seen, counts, illegal, last = None, None, bytearray(), set(), [0, 0, 0], 0, None
            for key, conv_id, code, digest in _runs(batches):
                if key != now:
                    if now is not None:
                        yield done(now, conv, codes, counts, illegal)
                    now, conv, codes, seen, counts, illegal, last = key, conv_id, bytearray(), set(), [0, 0, 0], 0, None
                kind = code & 3
                if last is not None and (last, kind) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                    illegal += 1
                last = kind
                if code & DROPPED:
                    counts[0] += 1
                elif digest in seen:
                    counts[1] += 1
                    code = kind | DROPPED
                elif code & BROKEN:
                    counts[2] += 1
                seen.add(digest)
                codes.append(code)
            if now is not None:
                yield done(now, conv, codes, counts, illegal)

        yield from _batched(found(), schema)

    return slim.repartition("key").sortWithinPartitions("key", *ORDER).select("key", "conv_id", "code", "digest").mapInArrow(run, STRUCTURE)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(key, line) of the repaired turns of sorted rows (key, audit of a head row or null, role, text)."""
    edits, at, role = "", 0, 0

    def inserted(key: str) -> Iterator[tuple[str, str]]:
        nonlocal at, role
        while at < len(edits) and edits[at] == "I":
            yield key, ("user:", "assistant:")[role]
            at, role = at + 1, role ^ 1

    now = None
    for key, audit, own, text in rows:
        if audit is not None:
            if now is not None:
                yield from inserted(now)
            now, edits, at, role = key, audit, 0, 0
            yield key, None
            continue
        yield from inserted(key)
        edit, at = edits[at], at + 1
        if edit == "K":
            yield key, f"{own}:{text}"
            role = {"u": 1, "a": 0}.get(own[:1], 0)
        elif edit == "R":
            yield key, f"{('user', 'assistant')[role]}:{text}"
            role ^= 1
    if now is not None:
        yield from inserted(now)


def _heads(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after a head row for each conversation with its audit, sorted within conversations."""
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"turn_": "long", "role_": "string", "text_": "long", "copy_": "int"}
    head = found.select("key", "audit", null("string").alias("role"), null("string").alias("text"), F.lit(0).alias("body"), *[null(t).alias(c) for c, t in kinds.items()])
    rows = turns.select("key", null("string").alias("audit"), "role", "text", F.lit(1).alias("body"), *ORDER)
    return head.unionByName(rows).repartition("key").sortWithinPartitions("key", "body", *ORDER).select("key", "audit", "role", "text")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(key, position, line): the repaired turns of each conversation as `role:text`, in order."""
    schema = pa.schema([("key", pa.string()), ("position", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            position = 0
            for key, line in _repaired(_runs(batches)):
                position = 0 if line is None else position + 1
                if line is not None:
                    yield key, position, line

        yield from _batched(lines(), schema)

    return _heads(turns, found).mapInArrow(run, "key string, position long, line string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(key, repaired_sha256): digest of each conversation's repaired lines, joined by newlines; texts stream past."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            now, state, first = None, None, True
            for key, line in _repaired(_runs(batches)):
                if line is None:
                    if now is not None:
                        yield now, state.hexdigest()
                    now, state, first = key, hashlib.sha256(), True
                    continue
                state.update((line if first else f"\n{line}").encode("utf-8", "surrogatepass"))
                first = False
            if now is not None:
                yield now, state.hexdigest()

        yield from _batched(sums(), schema)

    return _heads(turns, found).mapInArrow(run, "key string, repaired_sha256 string")


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` of conv_id, turn, role, text and copy with their key, which a null conv_id has too, and the columns of ORDER.

    Turns ascend, nulls first; those of one number by role and a hash of the text, copies right after the original.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return rows.withColumns({"key": key, "turn_": F.col("turn"), "role_": F.col("role"), "text_": F.xxhash64("text"), "copy_": F.col("copy")})


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of `keyed` turns.

    gaps counts the numbers that are missing between a conversation's least and greatest turn, nulls aside. Equal rows
    of one turn are repeated turns. An empty table gives no rows; a null conv_id is a conversation; other columns are not read.
    """
    found = written(structure(turns), "structure")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = turns.groupBy("key").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    return found.join(gaps, "key").join(digests(turns, found), "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
