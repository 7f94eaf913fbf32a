"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import ledgerlark.plans.gate_suite  # noqa: F401, registers more queries
from ledgerlark.plans.suite import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, str(DATA)), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_published_rows_hold_those_without_a_key(spark):
    assert QUERIES["published_rows"](spark, str(DATA)).where("sourceKey = ''").count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["adoption_pages", "adoption_query_echo"])
def test_pages_are_judged_by_many_tasks(spark, name):
    rows = QUERIES[name](spark, str(DATA)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) == spark.sparkContext.defaultParallelism > 1
