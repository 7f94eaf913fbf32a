"""Strict scanner of bulk CSV that splits: byte ranges are parsed on their own and put in order by folds over them.

Spark's text reader gives the lines of each byte range. Whether a range begins within quotes depends on all before it, so
a first pass sums a range up for both cases: quotes toggle the state wherever they stand, and a line ends a row where the
state is outside. The sums are folded in the order of files and ranges, which gives the state and the row number at the
start of each; a second pass then parses every range knowing both. Rows that reach over the end of a range are
put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import GateError

SUMS = "file long, block long, odd boolean, head string, " + ", ".join(f"{name}{state} {kind}" for state in (0, 1) for name, kind in (("ends", "long"), ("first", "long"), ("last", "long"), ("widths", "map<long,long>")))
ROW = "sourceRowNumber"


def part_name(file: int, block: int) -> str:
    """Name of a stored part; names sort as their files and ranges do."""
    return f"part-{file:08}-{block:08}.txt.gz"


def place(parts: bool) -> tuple[Column, Column]:
    """(file, block) of what is read: its path and the first byte of the range, or, with `parts`, what the names of stored parts say."""
    path = F.col("_metadata.file_path")
    if not parts:
        return path, F.col("_metadata.file_block_start")
    return F.regexp_replace(path, "-[0-9]{8}[.]txt[.]gz$", ""), F.regexp_extract(path, "-([0-9]{8})[.]txt[.]gz$", 1).cast("long")


def lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """value, file (a hash of its path) and block (the first byte of the range) of each line; ranges are as long as the session splits files."""
    file, block = place(parts)
    return spark.read.option("lineSep", "\n").text(path).select("value", F.xxhash64(file).alias("file"), block.alias("block"))


def paths(spark: SparkSession, path: str, parts: bool = False) -> dict[int, str]:
    """Path of each file by its hash."""
    file, _ = place(parts)
    return {r["file"]: r["path"] for r in spark.read.format("binaryFile").load(path).select(F.xxhash64(file).alias("file"), file.alias("path")).distinct().collect()}


def cells(row: str) -> list[str]:
    """Cells of a row: a quote opens or closes anywhere, two within quotes are one, carriage returns outside quotes go."""
    if '"' not in row:
        return (row.replace("\r", "") if "\r" in row else row).split(",")
    out, now = [], []
    parts = row.split('"')
    for k, part in enumerate(parts):
        if k & 1:
            now.append(part)
        elif not part and 0 < k < len(parts) - 1:
            now.append('"')
        else:
            ended = part.replace("\r", "").split(",")
            if len(ended) > 1:
                out += ["".join([*now, ended[0]]), *ended[1:-1]]
                now = []
            now.append(ended[-1])
    return [*out, "".join(now)]


@dataclass
class Sums:
    """What a range holds if it begins outside (0) or within (1) quotes: rows ended, commas before the first end and after the last, widths of the rows between."""

    quoted: bool = False
    ends: list[int] = field(default_factory=lambda: [0, 0])
    commas: list[int] = field(default_factory=lambda: [0, 0])
    first: list[int] = field(default_factory=lambda: [0, 0])
    widths: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))
    head: list[str] = field(default_factory=list)

    def line(self, text: str, keep_head: bool) -> None:
        """Take the next line; `keep_head` keeps the first row of a file."""
        if '"' in text:
            parts = text.split('"')
            outside, within = sum(p.count(",") for p in parts[::2]), sum(p.count(",") for p in parts[1::2])
            flips = not len(parts) & 1
        else:
            outside, within, flips = text.count(","), 0, False
        if keep_head and not self.ends[0]:
            self.head.append(text)
        for state in (0, 1):
            self.commas[state] += within if self.quoted != bool(state) else outside
        self.quoted ^= flips
        state = int(self.quoted)  # the case in which this line ends outside quotes
        if not self.ends[state]:
            self.first[state] = self.commas[state]
        else:
            width = self.commas[state] + 1
            self.widths[state][width] = self.widths[state].get(width, 0) + 1
        self.ends[state] += 1
        self.commas[state] = 0

    def row(self, file: int, block: int) -> tuple:
        return (file, block, self.quoted, "\n".join(self.head) if block == 0 else None, *(x for s in (0, 1) for x in (self.ends[s], self.first[s], self.commas[s], list(self.widths[s].items()))))


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """Batches as runs of lines of one range."""
    for batch in batches:
        values, files, blocks = (batch.column(k) for k in range(3))
        ids = list(zip(files.to_pylist(), blocks.to_pylist()))
        texts, start = values.to_pylist(), 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[start]:
                yield ids[start], texts[start:k]
                start = k


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums for each range of a partition."""
    long, widths = pa.int64(), pa.map_(pa.int64(), pa.int64())
    types, names = [long, long, pa.bool_(), pa.string(), *[long, long, long, widths] * 2], [x.split()[0] for x in SUMS.split(", ")]
    made: dict[tuple[int, int], Sums] = {}
    for at, texts in ranges(batches):
        sums = made.setdefault(at, Sums())
        for text in texts:
            sums.line(text, at[1] == 0)
    rows = [sums.row(*at) for at, sums in made.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


@dataclass(frozen=True)
class Layout:
    """header of the files; the start of each range (file, block): whether within quotes, the number of the next row that ends, whether that is a header; data rows in all."""

    header: list[str]
    starts: dict[tuple[int, int], tuple[bool, int, bool]]
    rows: int


def layout(spark: SparkSession, path: str, parts: bool = False) -> Layout:
    """Fold the sums of all ranges, by file and first byte; a breach of the contract raises GateError.

    Refused are: an empty file, quotes left open at the end of a file, files with different headers, and a row that has
    another number of cells than the header, a blank line among them. A row for each range reaches the driver.
    Row numbers go on from file to file; the first header is 1, those of further files have no number. With `parts`, parts of a
    file (`part_name`) are its ranges.
    """
    files = paths(spark, path, parts)
    sums = {(r["file"], r["block"]): r for r in lines(spark, path, parts).mapInArrow(summed, SUMS).collect()}
    if empty := sorted(set(files) - {file for file, _ in sums}, key=files.get) or ([None] if not files else []):
        raise GateError(f"{files.get(empty[0], path)} is empty")
    header, starts, number, widths = None, {}, 1, {}
    file, commas, quoted, opens = None, 0, False, True
    for at in sorted(sums, key=lambda k: (files[k[0]], k[1])):
        r = sums[at]
        if at[0] != file:
            if quoted:
                break
            file, own, commas, opens = at[0], cells(r["head"]), 0, True
            number -= header is not None
            header = header or own
            if own != header:
                raise GateError(f"{files[file]} has another header")
        state = int(quoted)
        starts[at] = (quoted, number, opens)
        if ends := r[f"ends{state}"]:
            for width, n in [*r[f"widths{state}"].items(), *([] if opens else [(commas + r[f"first{state}"] + 1, 1)])]:
                widths[width] = widths.get(width, 0) + n
            number, commas, opens = number + ends, 0, False
        commas, quoted = commas + r[f"last{state}"], quoted ^ r["odd"]
    if quoted:
        raise GateError(f"quotes are left open at the end of {files[file]}")
    if wrong := {w: n for w, n in widths.items() if w != len(header)}:
        raise GateError(f"{sum(wrong.values())} rows have another number of cells than the header, {len(header)}: {sorted(wrong)[:3]}")
    return Layout(header, starts, number - 2)


def scan(spark: SparkSession, path: str, made: Layout, names: list[str], parts: bool = False) -> DataFrame:
    """All rows of a file or a folder of files as string columns, with sourceRowNumber, from 2 on without gaps in the order of files.

    `made` is their layout, which has checked the contract. Every range is a task's own work; where the range
    before ended within quotes, the pieces of the row that reaches over are collected by its number. A task holds a batch of
    lines and one row.
    """
    starts, width = made.starts, len(made.header)
    held = lines(spark, path, parts)

    def parse(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[tuple[int, int, str]]:
        """(number, block, text) of whole rows, or of the pieces of rows that reach over an end of their range."""
        at, quoted, number, skip, now, cut = None, False, 0, False, [], False
        for own, texts in ranges(batches):
            if own != at:
                if pieces and at and now and not skip:
                    yield number, at[1], "\n".join(now)
                at, now, (quoted, number, skip) = own, [], starts[own]
                cut = quoted  # the row under way began in an earlier range
            for text in texts:
                now.append(text)
                if '"' in text:
                    quoted ^= text.count('"') & 1 == 1
                if not quoted:
                    if not skip and cut == pieces:
                        yield number, at[1], text if len(now) == 1 else "\n".join(now)
                    number, now, cut, skip = number + 1, [], False, False
        if pieces and at and now and not skip:
            yield number, at[1], "\n".join(now)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((number, cells(text)) for number, _, text in parse(batches, False))

    def batched(rows: Iterator[tuple[int, list[str]]], size: int = 5000) -> Iterator[pa.RecordBatch]:
        numbers, taken = [], []
        for number, row in rows:
            numbers.append(number)
            taken.append(row)
            if len(taken) == size:
                yield batch(numbers, taken)
                numbers, taken = [], []
        if taken:
            yield batch(numbers, taken)

    def batch(numbers: list[int], taken: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in zip(*taken)], pa.array(numbers, pa.int64())], [f"c{k}" for k in range(width)] + [ROW])

    schema = T.StructType([*[T.StructField(f"c{k}", T.StringType()) for k in range(width)], T.StructField(ROW, T.LongType())])
    rows = held.mapInArrow(whole, schema)
    if any(quoted and not skip for quoted, _, skip in starts.values()):

        def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, block, text in parse(batches, True):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block]), pa.array([text])], ["number", "block", "text"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from batched((n, cells(t)) for n, t in zip(*(b.column(k).to_pylist() for k in range(2))))

        cut = held.mapInArrow(cuts, "number long, block long, text string").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
        rows = rows.unionByName(cut.mapInArrow(joined, schema))
    return rows.toDF(*names, ROW)
