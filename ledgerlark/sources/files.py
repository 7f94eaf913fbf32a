"""Files in and out: bulk CSV under a contract, HTML and embedded JSON scans, staged year-partitioned JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..functions.registry import GateError
from . import scanner
from .storage import drop, hadoop_path

# Headers of the dashboard's table, in order.
DASHBOARD_HEADERS = ["", "省庁", "財務情報", "特許情報", "届出・認定・行政処分情報", "補助金情報", "調達情報", "表彰情報", "職場情報"]
ADOPTIONS = "props struct<pageProps: struct<count: string, total: bigint, listView: array<struct<id: string, name: string, address: string, subsidy: string, year: string, times: string, plan: string>>>>"


def read_bulk_csv(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """All columns as strings plus sourceRowNumber, from 2 on, of a file or a folder of files; rows of another width are refused.

    Files are split and read by many tasks (`scanner`); one pass checks them and finds where their rows begin. With `parts`,
    `path` is a folder that `write_lines` wrote, which gives the rows of the files themselves.
    """
    made = scanner.layout(spark, path, parts)
    names = [header_cell(x) for x in made.header]
    if len(set(names)) != len(names):
        raise GateError("duplicate header")
    return scanner.scan(spark, path, made, names, parts)


def header_cell(x: str | None) -> str:
    return " ".join((x or "").lstrip("﻿").split())


def cells(row_html: Column) -> Column:
    """Text of the cells of a table row."""
    return F.transform(F.regexp_extract_all(row_html, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), S.strip_html)


def dashboard_rows(html: Column) -> Column:
    """Cells of every table row of a page, as an array of arrays of text."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def dashboard_counts(pages: DataFrame, html: str, label: str) -> DataFrame:
    """subsidies and procurements of the one row that `label` names; null where a page breaks the contract.

    The table is the one whose id is corporateActivityNumbersTable, with the known headers in its head. A page
    without any markup of a table's kind is read as rows of a label, a total and three parts that add up to it.
    """
    own, page = pages.columns, F.col("html__")
    table = F.regexp_extract(page, r"""(?is)<table\b[^>]*\bid=["']corporateActivityNumbersTable["'][^>]*>(.*?)</table>""", 1)
    rows = pages.withColumn("html__", F.coalesce(F.col(html), F.lit(""))).withColumn("table__", table)
    head = F.regexp_extract("table__", r"(?is)<thead\b[^>]*>.*?<tr\b[^>]*>(.*?)</tr>.*?</thead>", 1)
    rows = rows.withColumns({"head__": cells(head), "rows__": dashboard_rows(F.regexp_extract("table__", r"(?is)<tbody\b[^>]*>(.*?)</tbody>", 1)), "plain__": dashboard_rows(page)})
    body, old = F.filter("rows__", lambda r: F.get(r, F.lit(1)) == label), F.get(F.filter("plain__", lambda r: F.get(r, F.lit(0)) == label), F.lit(0))
    ok = (F.col("head__") == F.array(*[F.lit(h) for h in DASHBOARD_HEADERS])) & (F.size(body) == 1) & (F.size(F.get(body, F.lit(0))) == len(DASHBOARD_HEADERS))
    number = lambda row, k: S.parse_count(F.get(row, F.lit(k)))
    legacy = (F.col("table__") == "") & ~page.rlike(r"(?i)<(?:!doctype|html|table|thead|tbody)\b") & (F.size(old) == 5) & (number(old, 1) == number(old, 2) + number(old, 3) + number(old, 4))
    pick = lambda new, before: F.when(ok, number(F.get(body, F.lit(0)), new)).when(legacy, number(old, before))
    return rows.select(*own, pick(5, 2).alias("subsidies"), pick(6, 3).alias("procurements"))


def adoption_rows(pages: DataFrame, html: str, base: str | None = None) -> DataFrame:
    """The rows of adoption pages, from the JSON that a script element carries; with `base`, sourceUrl is the address of each below it.

    Pages that `adoptions.page_faults` finds malformed have no rows here: ask it first, and refuse them.
    """
    text = F.regexp_extract(html, r'''(?is)<script[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>''', 1)
    listed = pages.withColumn("json__", F.from_json(text, ADOPTIONS)).select("*", F.posexplode("json__.props.pageProps.listView").alias("position", "row__"))
    fields = {"id": "id", "name": "name", "prefecture": "address", "subsidy": "subsidy", "year": "year", "round": "times", "plan": "plan"}
    keep = [c for c in pages.columns if c != html]
    address = [S.component_url(f"{base}/", F.trim(F.col("row__.id"))).alias("sourceUrl")] if base else []
    return listed.select(*keep, F.col("json__.props.pageProps.total").alias("total"), "position", *[F.trim(F.col(f"row__.{v}")).alias(k) for k, v in fields.items()], *address)


def public_rows(records: DataFrame) -> DataFrame:
    """The public fields; amountRaw only where the amount is unknown and the cell was not blank."""
    raw = F.when(F.col("amount").isNull() & (S.clean_cell(F.col("amountRaw")) != ""), F.col("amountRaw"))
    return records.withColumn("amountRaw", raw).select(*R.PUBLIC)


def year_key(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("unclassified"))


def write_dataset(records: DataFrame, metadata: DataFrame, path: str) -> None:
    """The full data set below `path`: all records, and the summary, which is the metadata without them."""
    records.write.mode("errorifexists").json(f"{path}/records")
    metadata.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")


def write_lines(spark: SparkSession, source: str, path: str) -> None:
    """The lines of a file or a folder of files as they are, below `path`, gzipped in parts that follow one another: a part for each range of each file, files in the order of their paths.

    The reader deals files to tasks by size, so parts are told apart by file and range, and a rename puts them in order.
    """
    held = scanner.lines(spark, source).withColumn("at__", F.monotonically_increasing_id()).sortWithinPartitions("file", "block", "at__").drop("at__")
    held.write.partitionBy("file", "block").option("maxRecordsPerFile", 0).mode("errorifexists").option("lineSep", "\n").option("compression", "gzip").text(f"{path}/_parts")
    number = {file: n for n, (file, _) in enumerate(sorted(scanner.paths(spark, source).items(), key=lambda x: x[1]))}
    fs, parts = hadoop_path(spark, f"{path}/_parts")
    below = lambda place: sorted((int(x.getPath().getName().partition("=")[2]), x.getPath()) for x in fs.listStatus(place) if x.isDirectory())
    for file, folder in below(parts):
        for block, (_, held_in) in enumerate(below(folder)):
            [part] = [x.getPath() for x in fs.listStatus(held_in) if x.getPath().getName().startswith("part-")]
            if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{scanner.part_name(number[file], block)}")):
                raise GateError(f"a part of {source} could not be named")
    drop(spark, f"{path}/_parts")


def write_evidence(spark: SparkSession, raw: dict[str, str], corrections: DataFrame, snapshot: dict, path: str) -> None:
    """Evidence of a run below `path`: the lines of each kind's file or files as they are (`write_lines`), the corrections, and the snapshot.

    Lines end with a newline alone, carriage returns stay in them, so the unzipped parts are the files' bytes; a missing last newline is added.
    """
    for kind, source in raw.items():
        write_lines(spark, source, f"{path}/{kind}")
    corrections.write.mode("errorifexists").json(f"{path}/corrections")
    spark.createDataFrame([json.dumps(snapshot)], "string").coalesce(1).write.mode("errorifexists").text(f"{path}/snapshot")


def set_hash(df: DataFrame, by: list[str], key: str, buckets: int | None = None) -> DataFrame:
    """Rows, repeated keys beyond the first, and the hash of the set of keys of each group, from one shuffle.

    The hash is a tree: buckets of keys, sorted, then the sorted bucket hashes, so no group is gathered whole: a bucket holds
    a share of 1 / `buckets` of a group. Unless it is given, the number follows from the number of rows: 4,096, doubled
    until a bucket has about 50,000 of them.
    """
    if buckets is None:
        buckets, n = 4096, df.count()
        while buckets * 50_000 < n:
            buckets *= 2
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4 if buckets <= 65_536 else 12), 16, 10).cast("long") % buckets
    held = df.groupBy(*by, bucket.alias("bucket__")).agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("keys__"))
    leaves = held.select(*by, "bucket__", F.size("keys__").alias("n__"), F.size(F.array_distinct("keys__")).alias("distinct__"), F.sha2(F.array_join("keys__", "\n"), 256).alias("leaf__"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket__", "leaf__"))), lambda x: x["leaf__"])
    return leaves.groupBy(*by).agg(F.sum("n__").cast("long").alias("rows"), F.sum(F.col("n__") - F.col("distinct__")).cast("long").alias("repeated"), F.sha2(F.array_join(ordered, "\n"), 256).alias("set_hash"))
