"""Pages of the adoption search: structural checks of the JSON that each page carries, and of what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..operators.gates import Rules, first_fault

SCRIPT = r"""(?is)<script[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
ROW_FIELDS = {"id": "id", "name": "name", "prefecture": "address", "subsidy": "subsidy", "year": "year", "round": "times", "plan": "plan"}
NEEDED = ("id", "name", "subsidy")


def kind(v: Column, path: str) -> Column:
    """Type of a JSON value: OBJECT, ARRAY, STRING, BIGINT and so on; null where it is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def is_kind(v: Column, path: str, name: str) -> Column:
    return F.coalesce(kind(v, path) == name, F.lit(False))


def text_of(v: Column, path: str) -> Column:
    return F.trim(F.try_variant_get(v, path, "string"))


def echoed(c: str, field: str, single: bool) -> Column:
    """A query value, empty where it is missing, of a string or (single) of an array of one string; null where it has another form."""
    path, v = f"{'$.props.pageProps.query' if single else '$.query'}.{field}", F.col(c)
    if not single or field == "keyword":
        return F.when(kind(v, path).isNull(), "").when(is_kind(v, path, "STRING"), text_of(v, path))
    only = is_kind(v, path, "ARRAY") & is_kind(v, f"{path}[0]", "STRING") & kind(v, f"{path}[1]").isNull() & (text_of(v, f"{path}[0]") != "")
    return F.when(kind(v, path).isNull(), "").when(only, text_of(v, f"{path}[0]"))


def page_rules() -> Rules:
    """Conditions that make a page malformed, in order, over `html`, `json`, `list` (an array of variants), `total` and `pages`."""
    v, props = F.col("json"), "$.props.pageProps"
    text = lambda x, f, need: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get(x, f"$.{f}", "variant")), "^[A-Z]+", 0) == "STRING", F.lit(False)) & (F.trim(F.try_variant_get(x, f"$.{f}", "string")) != "" if need else F.lit(True))

    def good_row(x: Column) -> Column:
        out = F.lit(True)
        for name, field in ROW_FIELDS.items():
            out = out & text(x, field, name in NEEDED)
        return out

    ids = F.transform("list", lambda x: F.trim(F.try_variant_get(x, "$.id", "string")))
    return [
        ("no search data", ~F.coalesce(F.col("html").contains("__NEXT_DATA__"), F.lit(False))), ("no script", ~F.col("html").rlike(SCRIPT)), ("not JSON", v.isNull()),
        ("not an object", ~(is_kind(v, "$", "OBJECT") & is_kind(v, "$.props", "OBJECT") & is_kind(v, props, "OBJECT"))), ("no list", ~is_kind(v, f"{props}.listView", "ARRAY")),
        ("too many rows", F.size("list") > R.ADOPTION_PAGE_SIZE), ("page count", ~(is_kind(v, f"{props}.total", "BIGINT") & F.coalesce(F.col("pages") >= 0, F.lit(False)))),
        ("row count", ~is_kind(v, f"{props}.count", "STRING") | F.col("total").isNull()), ("row", ~F.forall("list", good_row)), ("repeated id", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("empty result", (F.col("total") == 0) & ((F.col("pages") != 1) | (F.size("list") > 0))), ("pages", (F.col("total") > 0) & (F.col("pages") != F.ceil(F.col("total") / R.ADOPTION_PAGE_SIZE))),
    ]


def query_rules() -> Rules:
    """Conditions under which a page does not apply the query it was asked: keyword, prefecture and programme of both must agree."""
    out = []
    for field, asked in (("keyword", "keyword"), ("prefCode", "prefCode"), ("subsidyCodes", "subsidyCodes")):
        out.append((f"{field} was not applied", ~(echoed("json", asked, False) == echoed("json", field, True))))
    page = F.coalesce(text_of(F.col("json"), "$.query.page"), F.lit("1"))
    return [("page of the query", ~(page.rlike("^[0-9]{1,5}$") & page.try_cast("int").between(1, 20_000))), *out]


def parsed(pages: DataFrame, html: str) -> DataFrame:
    """`pages` with json (variant), list, pages and total of the search data; null where they are missing or malformed."""
    rows = pages.withColumn("html", F.col(html)).withColumn("json", F.try_parse_json(F.nullif(F.regexp_extract("html", SCRIPT, 1), F.lit(""))))
    at = lambda field, kind_: F.try_variant_get(F.col("json"), f"$.props.pageProps.{field}", kind_)
    return rows.withColumns({"list": at("listView", "array<variant>"), "pages": at("total", "bigint"), "total": S.parse_count(at("count", "string"), leading_zeros=True)})


def page_faults(pages: DataFrame, html: str, with_query: bool = False) -> DataFrame:
    """`pages` with `fault`: the first check that a page fails; null where it can be read."""
    own = [c for c in pages.columns]
    return parsed(pages, html).withColumn("fault__", first_fault(page_rules() + (query_rules() if with_query else []))).select(*own, F.col("fault__").alias("fault"))


def answer_faults(answers: DataFrame) -> DataFrame:
    """`answers` with `fault`: how a page's answer breaks the criteria it was asked by.

    Columns: asked and query (structs of page, keyword, prefecture and programme), total, pages, and rows, an array
    of (prefecture, subsidy) as named by the criteria where these are not empty.
    """
    c = F.col
    last = F.when(c("asked.page") < c("pages"), R.ADOPTION_PAGE_SIZE).otherwise(c("total") - (c("pages") - 1) * R.ADOPTION_PAGE_SIZE)
    rules = [(f"{f} was not applied", ~c(f"query.{f}").eqNullSafe(c(f"asked.{f}"))) for f in ("page", "keyword", "prefecture", "programme")]
    rules += [
        ("page out of range", F.when(c("total") == 0, c("asked.page") != 1).otherwise(c("asked.page") > c("pages"))), ("rows of the page", F.size("rows") != F.when(c("total") == 0, 0).otherwise(last)),
        ("prefecture", (c("asked.prefecture") != "") & F.exists("rows", lambda r: ~r["prefecture"].eqNullSafe(c("asked.prefecture")))),
        ("programme", (c("asked.programme") != "") & F.exists("rows", lambda r: ~r["subsidy"].eqNullSafe(c("asked.programme")))),
    ]
    return answers.withColumn("fault", first_fault(rules))


def oversized(files: DataFrame, most: int = R.MOST_ADOPTION_BYTES) -> DataFrame:
    """Rows of (content) whose body, in bytes, exceeds the limit."""
    return files.where(F.octet_length("content") > most)
