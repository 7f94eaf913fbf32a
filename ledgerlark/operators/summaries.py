"""Counts, hashes and documents that describe a snapshot: publishers, years, rules, evidence, manifest, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..sources.files import year_key

AUDITED = R.AUDITED


def publisher_counts(records: DataFrame) -> DataFrame:
    """(publisher, rows) of the canonical publishers."""
    return records.where("publisherCanonical is not null").groupBy(F.col("publisherCanonical").alias("publisher")).agg(F.count("*").alias("rows"))


def unmatched_totals(counted: DataFrame) -> DataFrame:
    """One row: rows and names of unmatched publishers (name, rows, suspicious), of all and of the suspicious ones."""
    bad = F.col("suspicious")
    return counted.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unmatched_rows"), F.count("*").alias("unmatched_names"),
        F.coalesce(F.sum(F.when(bad, F.col("rows"))), F.lit(0)).alias("suspicious_rows"), F.count_if(bad).alias("suspicious_names"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """One row: fiscal_years (distinct, ascending) and undated_rows."""
    years = records.groupBy("fiscalYear").agg(F.count("*").alias("n"))
    return years.agg(F.array_sort(F.collect_list("fiscalYear")).alias("fiscal_years"), F.coalesce(F.sum(F.when(F.col("fiscalYear").isNull(), F.col("n"))), F.lit(0)).alias("undated_rows"))


def count_map(counted: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """by and a map of key to value, in key order; one row for each group of a bounded number of keys."""
    return counted.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))


def schema_hash(headers: Column) -> Column:
    """sha256 of the cleaned headers, an array of strings, joined by U+001F."""
    return F.sha2(F.array_join(F.transform(headers, S.clean_cell), S.SEPARATOR), 256)


def pairs_hash(pairs: DataFrame, first: str, second: str, number: bool) -> DataFrame:
    """One row, `sha256`: hash of the JSON [[first, second], ...] in Japanese order of the first.

    The rule table and the distribution of unmatched publishers are hashed so; both are as long as there are names.
    """
    item = F.concat(F.lit("["), S.json_value(F.col(first)), F.lit(","), S.json_value(F.col(second), number), F.lit("]"))
    held = F.array_sort(F.collect_list(F.struct(F.collate(first, "ja").alias("order"), F.col(first).alias("name"), item.alias("json"))))
    return pairs.agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(held, lambda e: e["json"]), ","), F.lit("]")), 256).alias("sha256"))


def manifest(records: DataFrame) -> DataFrame:
    """(year_key, file, rows) of the files by year."""
    years = records.groupBy(year_key(F.col("fiscalYear")).alias("year_key")).agg(F.count("*").alias("rows"))
    return years.select("year_key", F.concat(F.lit("commitments-"), "year_key", F.lit(".json")).alias("file"), "rows")


def evidence(changes: DataFrame, previous: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """`changes` with the structs `before` and `after` of the audited fields; null on the side that lacks the key."""
    keep = [c for c in AUDITED if c in previous.columns]
    old = previous.select(*keys, F.struct(*keep).alias("before"))
    new = candidate.select(*keys, F.struct(*keep).alias("after"))
    return changes.join(old, keys, "left").join(new, keys, "left")


def change_lines(changes: DataFrame) -> DataFrame:
    """(key, field, before, after), one row for each changed field, of `evidence` rows with `changedFields`."""
    text = lambda side: F.map_from_arrays(F.array(*[F.lit(c) for c in AUDITED]), F.array(*[F.col(f"{side}.{c}").cast("string") for c in AUDITED]))
    rows = changes.select("key", F.explode("changedFields").alias("field"), text("before").alias("b"), text("after").alias("a"))
    return rows.select("key", "field", F.try_element_at("b", F.col("field")).alias("before"), F.try_element_at("a", F.col("field")).alias("after"))


def merged_sources(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources of the registry that are enabled: those that are known keep their metadata, new ones start empty.

    current: id, name, record_count, last_checked, status. registry: id, name, enabled.
    """
    on = enabled(registry)
    kept = current.join(on.select("id"), "id", "left_semi")
    new = on.join(current.select("id"), "id", "left_anti").select("id", "name", F.lit(0).cast("long").alias("record_count"), F.lit("未取得").alias("last_checked"), F.lit("watch").alias("status"))
    return kept.select(*new.columns).unionByName(new)


def enabled(registry: DataFrame) -> DataFrame:
    return registry.where("coalesce(enabled, false)")


def failure_receipt(failures: DataFrame, message: str = "message") -> DataFrame:
    """`failures` with the message cut at the limit; its first UTF-16 units are those of its first characters but for signs beyond the basic plane."""
    return failures.withColumn(message, F.substring(F.coalesce(F.col(message), F.lit("")), 1, R.MOST_MESSAGE))


def failure_body(run: Column, at: Column, reason: Column, table: Column) -> Column:
    """Text of the notice that an update was stopped."""
    said = [F.concat(F.lit(name), value) for name, value in zip(R.STOPPED_FIELDS, (run, at, S.escape_table(F.coalesce(reason, F.lit(R.STOPPED_REASON)))))]
    lines = [R.STOPPED, "", *said, R.STOPPED_EVIDENCE, "", R.STOPPED_TABLE, F.coalesce(table, F.lit(R.STOPPED_NO_TABLE))]
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def today_in_tokyo(now: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(now, "Asia/Tokyo"), "yyyy-MM-dd")
