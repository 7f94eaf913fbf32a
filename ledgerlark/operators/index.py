"""Search index: rows in search order with their rank, cut into blocks, and postings of character trigrams for keywords.

Any page of any filter is found from the numbers of matching rows of each block: the blocks before it are only counted, by
their narrow columns, and the rows of the page are read from the one or few blocks that hold them. A keyword of three characters or more
is looked up first: rows that hold all its trigrams are the only candidates, and blocks without any are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.registry import GateError
from ..sources.storage import written
from . import search

GRAM, BUCKETS = 3, 64


def ranked(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """`rows` with `rank`, from 0 on in the given order: sorted by ranges, as many as given, then numbered by the numbers of rows of the ranges before.

    The sorted ranges are written, as their bounds are sampled and would differ from run to run.
    """
    placed = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("at__", 33))
    placed = written(placed, "placed")
    counts = placed.groupBy("part__").agg(F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range.
    return placed.join(F.broadcast(counts.select("part__", before.alias("before__"))), "part__").withColumn("rank", F.col("before__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))).drop("at__", "part__", "before__")


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "organization", "corporateNumber"))


def grams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(0)))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    rows: DataFrame
    postings: DataFrame
    n_rows: int


def build(rows: DataFrame, path: str, block: int = 100_000) -> int:
    """Write the index of `rows` below `path`, which must be new; returns how many rows it holds.

    rows: the columns of search, an id among them. Postings list the ranks of a block for each trigram, as gaps are of no use to
    the reader, in full; a list is as long as a block at most.
    """
    spark = rows.sparkSession
    placed = ranked(rows, search.search_order()).withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    placed.write.mode("errorifexists").partitionBy("block").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    held = stored.select("rank", "block", F.explode(grams(haystack())).alias("gram")).groupBy("gram", "block").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    held.withColumn("bucket", bucket(F.col("gram"))).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    n = stored.count()
    if n != rows.count():
        raise GateError("the index has other rows than the release")
    return n


def read(spark: SparkSession, path: str, n_rows: int) -> Index:
    """The index below `path`; refused where it has more or fewer rows than its metadata says."""
    rows = spark.read.parquet(f"{path}/rows")
    if (found := rows.count()) != n_rows:
        raise GateError(f"the index has {found} rows instead of {n_rows}")
    return Index(rows, spark.read.parquet(f"{path}/postings"), n_rows)


def candidates(index: Index, needle: str) -> DataFrame | None:
    """(block, rank) of the rows that hold all trigrams of a needle; None where it is too short to have one."""
    low = needle.lower()
    found = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    if not found:
        return None
    spark = index.rows.sparkSession
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in found], "gram string").select(bucket(F.col("gram")).alias("b")).distinct().collect()]
    lists = index.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(found)).groupBy("block").agg(F.collect_list("ranks").alias("lists")).where(F.size("lists") == len(found))
    common = F.aggregate(F.slice("lists", 2, len(found)), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select("block", F.explode(common).alias("rank"))


def matching(index: Index, c: search.Criteria) -> DataFrame:
    """The rows that fit the criteria; by the postings where the keyword has a trigram, and only blocks with candidates are read."""
    rows, near = index.rows, candidates(index, c.query) if c.query else None
    if near is not None:
        blocks = [r["block"] for r in near.select("block").distinct().collect()]  # as many as there are blocks at most
        rows = rows.where(F.col("block").isin(blocks)).join(near.select("rank"), "rank", "left_semi")
    return rows.where(search.matches(c))


def page(index: Index, c: search.Criteria, known_agencies: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(rows of the page, total, pages), as `search.result` finds them, in order of rank.

    The counts by block reach the driver, a number for each block. A page beyond the last and an unknown agency are refused.
    """
    if c.agency != "all" and not (c.agency in known_agencies if known_agencies is not None else not index.rows.where(F.col("sourceAgency") == c.agency).isEmpty()):
        raise ValueError(f"agency {c.agency}")
    found = matching(index, c)
    counts = sorted((r["block"], r["count"]) for r in found.groupBy("block").count().collect())
    total = sum(n for _, n in counts)
    pages = max(1, -(-total // R.PAGE_SIZE))
    if c.page > pages:
        raise ValueError(f"page {c.page} of {pages}")
    start, wanted, skipped, seen = (c.page - 1) * R.PAGE_SIZE, [], 0, 0
    for block, n in counts:
        if seen + n <= start:
            skipped = seen + n
        elif seen < start + R.PAGE_SIZE:
            wanted.append(block)
        seen += n
    return found.where(F.col("block").isin(wanted)).orderBy("rank").offset(start - skipped).limit(R.PAGE_SIZE), total, pages
