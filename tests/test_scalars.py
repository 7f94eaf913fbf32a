import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S


def run(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "0": 0, "-6,528,000": -6528000, "△151,706,000円": -151706000, "▲7": -7, "": None, "　": None, None: None, "(5)": -5, "￥5": 5, "¥5": None, "12.0": 12, "12.5": None, "5d": None,
        "0x1F": 31, "0b101円": 5, "0o17": 15, "-0x1F": None, "()": None, "-": None, "△(5)": None, "(△5)": None, "+5": 5, ".5e1": 5, "1e400": None, "NaN": None, "Infinity": None, "x": None,
        "円": 0, ",": 0, "5 円": 5, "1e3": 1000, "9007199254740991": 9007199254740991, "9007199254740992": None, "abc": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string").withColumn("clean", S.clean_cell(F.col("v")))
    assert [r.out for r in S.with_amount(rows, "out", F.col("clean")).orderBy("i").collect()] == list(cases.values())


def test_dates(spark):
    cases = {
        "": None, None: None, "2026年4月1日": "2026-04-01", "契約 2026年4月1日 付": "2026-04-01", "20260401": "2026-04-01", "2026-4-1": "2026-04-01", "2026/04/02": "2026-04-02", "2026/04-02": "2026-04-02",
        "2026-02-30": None, "0050-01-01": None, "0100-01-01": "0100-01-01", "x2026-04-01": None,
    }
    assert run(spark, S.parse_date, list(cases)) == list(cases.values())


def test_fiscal_year(spark):
    assert run(spark, lambda c: S.fiscal_year(F.to_date(c)), ["2026-03-31", "2026-04-01", None]) == [2025, 2026, None]


def test_corporate_number(spark):
    def digit(body):
        return 9 - sum(int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(body)) % 9

    good = [f"{digit(b)}{b}" for b in ("000012050002", "123456789012", "999999999999")]
    bad = [f"{(int(g[0]) + 1) % 10}{g[1:]}" for g in good] + ["", "12345", None, "x" * 13]
    assert run(spark, S.valid_corporate_number, good + bad) == [True] * 3 + [False] * len(bad)


def test_text_rules(spark):
    assert run(spark, S.clean_cell, ["﻿ a 　 b\n", None, "a﻿b"]) == ["a b", "", "a b"]
    assert run(spark, S.strip_html, ["<p>a&nbsp;&amp; b<script>x</script></p><STYLE>y</STYLE>c", "&lt;"]) == ["a & b c", "&lt;"]
    assert run(spark, S.parse_count, ["0", "1,234", "01", "12,34", "", "7"]) == [0, 1234, None, None, None, 7]
    assert run(spark, S.escape_table, ["a|b\nc", None]) == ["a\\|b c", "null"]
    assert run(spark, S.application_round, ["3", "３", "第3回"]) == ["第3回", "第３回", "第3回"]


@pytest.mark.parametrize("value, want", [("a", '"a"'), (None, "null"), ('q"\\', '"q\\"\\\\"')])
def test_json_values(spark, value, want):
    assert run(spark, S.json_value, [value]) == [want]
