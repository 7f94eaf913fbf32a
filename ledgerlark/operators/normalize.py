"""Bulk rows of a kind to typed funding records, with scan statistics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S


def aliases(spark) -> DataFrame:
    """(name, canonical) of the known publishers, a fixed table of 27 rows."""
    return spark.createDataFrame(sorted(R.ALIASES.items()), "alias_name string, canonical string")


def with_publisher(df: DataFrame, name: str, alias: DataFrame | None = None) -> DataFrame:
    """Adds publisherCanonical by exact match of the column `name`; null where it is no alias."""
    alias = alias if alias is not None else F.broadcast(aliases(df.sparkSession))  # 27 rows; a given table is joined as Spark sees fit
    return df.join(alias, df[name] == alias["alias_name"], "left").drop("alias_name").withColumnRenamed("canonical", "publisherCanonical")


def suspicious(name, markers: list[str] = R.MARKERS):
    """Whether a name holds any marker."""
    out = F.lit(False)
    for marker in markers:
        out = out | name.contains(marker)
    return out


def check_headers(columns: list[str], kind: str) -> None:
    """Names must be unique and hold all required ones."""
    required = [v for k, v in R.HEADERS[kind].items() if k != "notes"]
    if len(set(columns)) != len(columns):
        raise ValueError("duplicate header")
    if missing := [c for c in required if c not in columns]:
        raise ValueError(f"missing header: {', '.join(missing)}")


def typed_rows(raw: DataFrame, kind: str) -> DataFrame:
    """All rows of a bulk file with cleaned and typed columns and the flags is_recipient and is_eligible.

    `raw` has string columns as published and sourceRowNumber. Absent optional columns are empty. Cells are cleaned once;
    what follows reads the cleaned columns.
    """
    head = R.HEADERS[kind]
    check_headers([c for c in raw.columns if c != "sourceRowNumber"], kind)
    c = F.col
    names = {"organization": head["name"], "date__": head["date"], "program": head["program"], "amount__": head["amount"], "sourceAgency": head["agency"], "sourceKey": head["key"]}
    optional = {"dataQuality": R.OPTIONAL["quality"], "sourceSystem": R.OPTIONAL["system"], "sourceRetrievedAt": R.OPTIONAL["retrieved"], "sourceUpdatedAt": R.OPTIONAL["updated"], "notes": head["notes"]}
    names |= {name: column for name, column in optional.items() if column in raw.columns}
    # One expression cleans all cells: inlined a dozen times it would make a method that the JVM doesn't compile.
    cells = F.transform(F.array(*[c(f"`{column}`") for column in names.values()]), S.clean_cell)
    rows = raw.withColumn("cells__", cells).select(
        S.digits_only(c(head["corporate"])).alias("corporateNumber"), *[F.get("cells__", F.lit(k)).alias(name) for k, name in enumerate(names)], *[F.lit("").alias(name) for name in optional if name not in names],
        F.coalesce(c(head["date"]), F.lit("")).alias("dateRaw"), F.coalesce(c(head["amount"]), F.lit("")).alias("amountRaw"), c("sourceRowNumber").cast("long").alias("sourceRowNumber"), F.lit(R.STAGES[kind]).alias("stage"),
    )
    rows = S.with_date(S.with_amount(rows, "amount", c("amount__")), "own__", c("date__"))
    rows = rows.withColumns({"date": c("own__").cast("string"), "fiscalYear": S.fiscal_year(c("own__"))}).drop("date__", "own__", "amount__")
    rows = with_publisher(rows, "sourceAgency")
    rows = rows.withColumn("is_recipient", S.valid_corporate_number(c("corporateNumber")) & (c("organization") != ""))
    return rows.withColumn("is_eligible", c("is_recipient") & c("publisherCanonical").isNotNull())


#: Texts that every record of a kind has.
KIND_NAMES = {"subsidy": "補助金", "procurement": "調達"}


def with_identity(rows: DataFrame, kind: str, ingest: str) -> DataFrame:
    """`rows` with id, sourceRecordHash and what names the source, where they are eligible; else null."""
    c, ok = F.col, F.col("is_eligible")
    made = S.stable_id(F.lit(kind), c("sourceKey"), c("sourceRowNumber"), c("dateRaw"), c("corporateNumber"), c("amountRaw"), c("program"), c("sourceAgency"))
    out = S.with_semantic_hash(rows.withColumn("id", F.when(ok, made)), "sourceRecordHash", [(c(name), name in ("fiscalYear", "amount")) for name in R.SEMANTIC], ok)
    texts = {"sourceName": F.lit(f"GビズINFO 全件CSV（{KIND_NAMES[kind]}）"), "sourceUrl": F.concat(F.lit("https://info.gbiz.go.jp/hojin/ichiran?hojinBango="), "corporateNumber"), "quality": F.lit("aggregated"), "ingestSource": F.lit(ingest)}
    return out.withColumns({name: F.when(ok, value) for name, value in texts.items()})


COUNTERS = ["total_rows", "recipient_rows", "eligible_rows", "missing_date", "missing_program", "missing_amount", "missing_key"]


def counters() -> list[Column]:
    """Counters of rows with is_recipient and is_eligible."""
    ok = F.col("is_eligible")
    return [
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_recipient").alias("recipient_rows"), F.count_if("is_eligible").alias("eligible_rows"),
        F.count_if(ok & F.col("date").isNull()).alias("missing_date"), F.count_if(ok & (F.col("program") == "")).alias("missing_program"),
        F.count_if(ok & F.col("amount").isNull()).alias("missing_amount"), F.count_if(ok & (F.col("sourceKey") == "")).alias("missing_key"),
    ]


def statistics(rows: DataFrame) -> DataFrame:
    """One row of counters: one pass, partial sums before the shuffle."""
    return rows.agg(*counters())


def unmatched_agencies(rows: DataFrame) -> DataFrame:
    """(name, rows, suspicious) of recipients' publishers that are no alias."""
    name = F.when(F.col("sourceAgency") == "", R.NO_AGENCY).otherwise(F.col("sourceAgency"))
    counted = rows.where("is_recipient and publisherCanonical is null").groupBy(name.alias("name")).agg(F.count("*").alias("rows"))
    return counted.withColumn("suspicious", suspicious(F.col("name")))


def top_unmatched(counted: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent, ties in Japanese order."""
    return counted.orderBy(F.desc("rows"), F.collate("name", "ja"), "name").limit(n)


@dataclass(frozen=True)
class Import:
    """What one pass over a bulk file left: its records, the counters of all its rows (one row) and its unmatched publishers."""

    records: DataFrame
    statistics: DataFrame
    unmatched: DataFrame


def import_kind(raw: DataFrame, kind: str, folder: str, ingest: str = R.INGEST) -> Import:
    """Import a bulk file in one pass, to `folder`, which must be new.

    The pass writes records, and of recipients whose publisher is no alias the name only; the counters are observed
    while it runs. Records and names are told apart by `is_eligible`, by which the files are read back.
    """
    seen, rows = Observation(f"import-{uuid.uuid4().hex}"), typed_rows(raw, kind)
    kept = with_identity(rows.observe(seen, *counters()).where("is_recipient"), kind, ingest)
    names = [c for c in kept.columns if c not in ("is_recipient", "is_eligible")]
    part = kept.select("is_eligible", *[F.col(c) if c == "sourceAgency" else F.when(F.col("is_eligible"), F.col(c)).alias(c) for c in names])
    part.write.mode("errorifexists").parquet(folder)
    spark = raw.sparkSession
    stored = spark.read.schema(part.schema).parquet(folder)
    found = spark.createDataFrame([tuple(seen.get[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
    unmatched = stored.where("not is_eligible").select("sourceAgency", F.lit(True).alias("is_recipient"), F.lit(None).cast("string").alias("publisherCanonical"))
    return Import(stored.where("is_eligible").drop("is_eligible"), found, unmatched_agencies(unmatched))


def union_of(imports: dict[str, Import]) -> Import:
    """The imports of all kinds together, with the kind in statistics and unmatched."""
    parts = [(i.records, i.statistics.withColumn("kind", F.lit(k)), i.unmatched.withColumn("kind", F.lit(k))) for k, i in imports.items()]
    return Import(*[reduce(DataFrame.unionByName, side) for side in zip(*parts)])
