"""Snapshots on a layout that joins by key without moving them: files bucketed and sorted by stage and source key."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from . import site

KEYS = ["stage", "sourceKey"]


def table_name(path: str) -> str:
    return f"snapshot_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def write(records: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store `records` below `path`, which must be new, in so many buckets; returns the stored rows.

    A bucket is a task's share of later joins: choose as many as keep one within memory. Two snapshots join without any exchange
    if they have equally many.
    """
    name = table_name(path)
    spark = records.sparkSession
    records.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet").option("path", path).mode("errorifexists").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; every session names them anew
    site.write_text(spark, f"{path}.layout.json", json.dumps({"buckets": buckets, "schema": records.schema.json()}))
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored snapshot, with their layout."""
    layout = json.loads(site.read_text(spark, f"{path}.layout.json")[0])
    columns = ", ".join(f"`{f['name']}` {f['type']}" for f in json.loads(layout["schema"])["fields"])
    keys, name = ", ".join(KEYS), table_name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)
