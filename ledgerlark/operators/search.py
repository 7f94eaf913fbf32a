"""Filtered, ordered and paged row search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R


@dataclass(frozen=True)
class Criteria:
    query: str = ""
    agency: str = "all"
    stage: str = "all"
    year: str = "all"
    page: int = 1


def criteria(params: dict[str, str]) -> Criteria:
    """Search parameters, trimmed and checked; missing ones take their defaults.

    A blank agency means all; a blank page is refused. Lengths count UTF-16 units.
    """
    units = lambda s: len(s.encode("utf-16-le")) // 2
    query, agency = params.get("q", "").strip(), params.get("agency", "all").strip() or "all"
    stage, year, page = params.get("stage", "all"), params.get("year", "all"), params.get("page", "1").strip()
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?", page or "0", re.ASCII):
        raise ValueError("page")
    number = float(page or 0)
    if units(query) > R.MOST_QUERY or units(agency) > R.MOST_QUERY:
        raise ValueError("too long")
    if stage not in ("all", *R.STAGES.values()):
        raise ValueError("stage")
    if year not in ("all", "unclassified") and not (len(year) == 4 and year.isascii() and year.isdigit()):
        raise ValueError("year")
    if not 1 <= number <= R.MOST_PAGES or number != int(number):
        raise ValueError("page")
    return Criteria(query, agency, stage, year, int(number))


def matches(c: Criteria) -> Column:
    """The filter of the criteria; equalities reach the scan."""
    out = F.lit(True)
    if c.query:
        out = out & F.lower(F.concat_ws(" ", "organization", "corporateNumber")).contains(c.query.lower())
    if c.agency != "all":
        out = out & (F.col("sourceAgency") == c.agency)
    if c.stage != "all":
        out = out & (F.col("stage") == c.stage)
    if c.year == "unclassified":
        out = out & F.col("fiscalYear").isNull()
    elif c.year != "all":
        out = out & (F.col("fiscalYear") == int(c.year))
    return out


def search_order() -> list[Column]:
    """Year and date descending, nulls last, organization in Japanese order, then unique by id."""
    return [F.col("fiscalYear").desc_nulls_last(), F.col("date").desc_nulls_last(), F.collate("organization", "ja"), F.col("organization"), F.col("id")]


def stored_order() -> list[Column]:
    """Amount and date descending, nulls last, id."""
    return [F.col("amount").desc_nulls_last(), F.col("date").desc_nulls_last(), F.col("id")]


def result(df: DataFrame, c: Criteria, known_agencies: list[str] | None = None, total: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows of the page, total, pages). A page beyond the last and an agency that is not known are refused.

    The agency is looked up in `known_agencies` where they are given, else in the rows. A `total` that the caller
    has already counted for the same criteria saves the counting scan.
    """
    if c.agency != "all":
        known = c.agency in known_agencies if known_agencies is not None else not df.where(F.col("sourceAgency") == c.agency).isEmpty()
        if not known:
            raise ValueError(f"agency {c.agency}")
    found = df.where(matches(c))
    total = found.count() if total is None else total
    pages = max(1, -(-total // R.PAGE_SIZE))
    if c.page > pages:
        raise ValueError(f"page {c.page} of {pages}")
    return found.orderBy(*search_order()).offset((c.page - 1) * R.PAGE_SIZE).limit(R.PAGE_SIZE), total, pages


def page(df: DataFrame, c: Criteria) -> DataFrame:
    """The rows of a page, as `result` finds them."""
    return result(df, c)[0]


def agencies(df: DataFrame) -> DataFrame:
    """Distinct raw publisher names in Japanese order."""
    return df.select("sourceAgency").distinct().orderBy(F.collate("sourceAgency", "ja"), "sourceAgency")


def adoption_page_check(totals: DataFrame) -> DataFrame:
    """pages and expected rows of a result page from (total, page)."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / R.ADOPTION_PAGE_SIZE)).cast("long")
    rows = F.when(F.col("page") < pages, F.lit(R.ADOPTION_PAGE_SIZE)).when(F.col("page") == pages, F.col("total") - (pages - 1) * R.ADOPTION_PAGE_SIZE)
    return totals.select("*", pages.alias("pages"), rows.cast("long").alias("expected_rows"))


def adoption_violations(rows: DataFrame, prefecture: str = "", subsidy: str = "") -> DataFrame:
    """Rows of adoption pages that break the search: another prefecture or programme, or a repeated id."""
    wrong = F.lit(False)
    if prefecture:
        wrong = wrong | ~F.col("prefecture").eqNullSafe(F.lit(prefecture))
    if subsidy:
        wrong = wrong | ~F.col("subsidy").eqNullSafe(F.lit(subsidy))
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("reason"))
    return rows.where(wrong).select("id", F.lit("filter").alias("reason")).unionByName(repeated)


def adoption_criteria(params: dict[str, list[str]], programmes: set[str]) -> dict[str, str | int]:
    """page (1 to 20,000), keyword (20 code points), prefecture (01 to 47) and programme, each given once at most."""
    if any(len(v) > 1 for v in params.values()):
        raise ValueError("given twice")
    one = {k: v[0].strip() for k, v in params.items() if v}
    page, keyword, prefecture, programme = one.get("page", "1"), one.get("keyword", ""), one.get("prefecture", ""), one.get("subsidy", "")
    if not (page.isascii() and page.isdigit() and len(page) <= 5 and 1 <= int(page) <= 20_000):
        raise ValueError("page")
    if len(keyword) > 20:
        raise ValueError("keyword")
    if prefecture and not (len(prefecture) == 2 and prefecture.isascii() and prefecture.isdigit() and 1 <= int(prefecture) <= 47):
        raise ValueError("prefecture")
    if programme and programme not in programmes:
        raise ValueError("subsidy")
    return {"page": int(page), "keyword": keyword, "prefecture": prefecture, "subsidy": programme}
