"""Scalar rules of funding records as native Column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that cells are cleaned of, as a character class: separators of any kind, tabs to carriage returns, U+FEFF.
SPACE = r"[\s\p{Z}\uFEFF]"
SAFE = 9007199254740991
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SEPARATOR = "\x1f"


def clean_cell(c: Column) -> Column:
    """Runs of white space, byte order marks among them, become one blank, the ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


# Y-M-D or Y/M/D, YYYYMMDD, and Y年M月D日 anywhere.
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$|^[0-9]{8}$|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"


def parse_date(c: Column) -> Column:
    """ISO date of Y-M-D or Y/M/D, else of YYYYMMDD, else of the first Y年M月D日 within; else null. Years below 100 are null.

    Each step reads the one before once, so nothing is evaluated twice.
    """
    apart = F.regexp_replace(dashed(clean_cell(c)), "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.regexp_replace(apart, "^00[0-9]{2}-.*$", "").try_cast("date").cast("string")


def dashed(clean: Column) -> Column:
    """The date of a cleaned cell with dashes between its parts, or as eight digits; empty where there is none."""
    return F.translate(F.regexp_extract(clean, DATE, 0), "/年月日", "---")


def with_date(df: DataFrame, name: str, clean: Column) -> DataFrame:
    """`df` with the date of a cleaned cell as `parse_date` finds it, as a date."""
    f, d = F.col("found__"), F.col("day__")
    solid = F.concat_ws("-", F.substring(f, 1, 4), F.substring(f, 5, 2), F.substring(f, 7, 2))
    rows = df.withColumn("found__", dashed(clean)).withColumn("day__", F.when(F.length(f) == 8, solid).otherwise(f).try_cast("date"))
    return rows.withColumn(name, F.when(F.year(d) >= 100, d)).drop("found__", "day__")


def is_iso_date(c: Column) -> Column:
    """Whether a text is a date as `parse_date` writes it."""
    return F.coalesce(c.rlike("^(?!00)[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def fiscal_year(date: Column) -> Column:
    """Year that begins in April."""
    return F.year(date) - (F.month(date) <= 3).cast("int")


def with_amount(df: DataFrame, name: str, clean: Column) -> DataFrame:
    """`df` with the amount of a cleaned cell: whole yen, or null where it is blank, not a whole number or beyond exact doubles.

    Commas and the signs 円 and ￥ go, leading △ or ▲ and parentheses are a minus; a cell of signs alone is 0. Unsigned
    numbers may be hexadecimal, octal or binary after 0x, 0o or 0b. The steps are columns of their own, as the later
    ones read the earlier ones more than once; plain digits take the first alone.
    """
    p, b, n = F.col("plain__"), F.col("bare__"), F.col("number__")
    radix = F.lit(None).cast("double")
    for mark, digits, base, most in (("xX", "0-9a-fA-F", 16, 14), ("oO", "0-7", 8, 18), ("bB", "01", 2, 53)):  # more digits are beyond exact doubles
        radix = F.when(b.rlike(f"^0[{mark}]0*[{digits}]{{1,{most}}}$"), F.conv(F.substring(b, 3, 1000), base, 10).try_cast("double")).otherwise(radix)
    rows = df.withColumn("plain__", F.trim(F.translate(clean, ",円￥", "")))
    rows = rows.withColumn("fast__", F.when(p == "", F.when(clean != "", 0)).when(p.rlike("^-?[0-9]{1,15}$"), p.try_cast("long")).cast("long"))
    minus = F.trim(F.regexp_replace(F.regexp_replace(p, "^[△▲]", "-"), r"^\((.*)\)$", "-$1"))
    rows = rows.withColumn("bare__", F.when(F.col("fast__").isNull() & p.rlike("[0-9]"), minus))
    rows = rows.withColumn("number__", F.when(b.rlike(NUMBER), b.try_cast("double")).when(b.startswith("0"), radix))
    found = F.when((n == F.floor(n)) & (F.abs(n) <= SAFE), n.cast("long"))
    return rows.withColumn(name, F.coalesce("fast__", found)).drop("plain__", "fast__", "bare__", "number__")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def valid_corporate_number(c: Column) -> Column:
    """13 digits of which the first is the check digit of the others."""
    total = F.lit(0)
    for k in range(1, 13):
        total = total + F.substring(c, k + 1, 1).try_cast("int") * (2 if k % 2 else 1)
    return F.coalesce(c.rlike("^[0-9]{13}$") & (F.substring(c, 1, 1).try_cast("int") == 9 - total % 9), F.lit(False))


def strip_html(c: Column) -> Column:
    """Text of HTML: scripts, styles and tags become blanks, two entities are read, white space is collapsed."""
    text = F.regexp_replace(c, r"(?i)<script[\s\S]*?</script>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", " "), r"<[^>]+>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)&nbsp;|&#160;", " "), "(?i)&amp;", "&")
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def parse_count(c: Column, leading_zeros: bool = False) -> Column:
    """A count in plain or comma-grouped digits; null where it is neither."""
    plain = "[0-9]+" if leading_zeros else "0|[1-9][0-9]*"
    return F.when(c.rlike(f"^(?:{plain}|[1-9][0-9]{{0,2}}(?:,[0-9]{{3}})+)$"), F.replace(c, F.lit(","), F.lit("")).try_cast("long"))


def stable_id(kind: Column, key: Column, *others: Column) -> Column:
    """gbiz- and 16 hex digits of the key of a record or, where it has none, of its row."""
    by_key = F.concat_ws(SEPARATOR, kind, F.lit("key"), key)
    by_row = F.concat_ws(SEPARATOR, kind, F.lit("row"), *[F.coalesce(c.cast("string"), F.lit("")) for c in others])
    return F.concat(F.lit("gbiz-"), F.substring(F.sha2(F.when(key != "", by_key).otherwise(by_row), 256), 1, 16))


def small_escapes(json: Column) -> Column:
    """JSON whose escapes of control characters, which end in a digit or a capital, have small letters."""
    for digit in "ABCDEF":
        json = F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return json


def unbracketed(json: Column) -> Column:
    """The items of a JSON array of strings and nulls, which don't begin or end with a bracket."""
    return F.rtrim(F.ltrim(json, F.lit("[")), F.lit("]"))


def json_value(c: Column, number: bool = False) -> Column:
    """JSON text of one value: null, a bare number or a quoted string with small hex in escapes."""
    if number:
        return F.coalesce(c.cast("string"), F.lit("null"))
    json = unbracketed(F.to_json(F.array(c.cast("string"))))
    return F.when(json.contains("\\u00"), small_escapes(json)).otherwise(json)


def json_array(strings_and_numbers: list[tuple[Column, bool]]) -> Column:
    """JSON array of the values, True marks numbers; neighbouring strings are written together. Escapes are as Spark writes them."""
    parts: list[Column] = []
    for number, run in itertools.groupby(strings_and_numbers, key=lambda x: x[1]):
        values = [c for c, _ in run]
        if number:
            parts += [F.coalesce(c.cast("string"), F.lit("null")) for c in values]
        else:
            parts.append(unbracketed(F.to_json(F.array(*[c.cast("string") for c in values]))))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def hash_of_json(json: Column) -> Column:
    """sha256 of JSON text, with small letters in its escapes."""
    return F.sha2(F.when(json.contains("\\u00"), small_escapes(json)).otherwise(json), 256)


def with_semantic_hash(df: DataFrame, name: str, strings_and_numbers: list[tuple[Column, bool]], where: Column | None = None) -> DataFrame:
    """`df` with the sha256 of the JSON array of the values, where `where` holds; the JSON is a column of its own, as it is read more than once."""
    json = json_array(strings_and_numbers)
    return df.withColumn("json__", json if where is None else F.when(where, json)).withColumn(name, hash_of_json(F.col("json__"))).drop("json__")


def escape_table(c: Column, present: Column | None = None) -> Column:
    """A cell of a Markdown table; a null says so, and a value that is not `present` is a dash."""
    if present is not None:
        return F.when(present, escape_table(c)).otherwise("—")
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("null")), r"\|", r"\\|"), r"\r?\n", " ")


def application_year(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{4}$"), F.concat(c, F.lit("年"))).otherwise(c)


def application_round(c: Column) -> Column:
    return F.when(c.rlike("^[0-9０-９]+$"), F.concat(F.lit("第"), c, F.lit("回"))).otherwise(c)


def shown_amount(amount: Column, raw: Column) -> Column:
    """Grouped yen, else the published text, else a mark for a blank."""
    return F.when(amount.isNotNull(), F.concat(F.format_number(amount, 0), F.lit("円"))).when(clean_cell(raw) != "", raw).otherwise("（空欄）")


def signed_count(c: Column) -> Column:
    """Grouped difference with its sign; unknown ones say so."""
    return F.when(c.isNull(), "未照合").otherwise(F.concat(F.when(c > 0, "+").otherwise(""), F.format_number(c, 0)))


def tokyo_time(utc: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(utc, "Asia/Tokyo"), "yyyy/MM/dd HH:mm")


def component_url(base: str, c: Column) -> Column:
    """`base` and the percent-encoded value: blanks as %20, and ~ ! ' ( ) as they are."""
    out = F.url_encode(c)
    for code, sign in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.concat(F.lit(base), out)


def query_url(base: str, given: dict[str, Column], defaults: dict[str, str]) -> Column:
    """`base` with the form-encoded values that are neither null nor their default, in the given order."""
    parts = [F.when(c.isNotNull() & (c != defaults.get(k, "")), F.concat(F.lit(f"{k}="), F.url_encode(c))) for k, c in given.items()]
    text = F.concat_ws("&", *parts)
    return F.when(text == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}?"), text))


def coverage_years(years: Column, undated: Column) -> Column:
    """Text of an ascending array of fiscal years and a number of undated rows."""
    first, last = F.get(years, F.lit(0)).cast("string"), F.get(years, F.size(years) - 1).cast("string")
    span = F.when(F.size(years) == 1, F.concat(first, F.lit("年度"))).otherwise(F.concat(first, F.lit("–"), last, F.lit("年度（認定日・受注日基準）")))
    none = F.when(undated > 0, "日付の記載なしのみ").otherwise("収録なし")
    return F.when(F.size(years) == 0, none).otherwise(F.concat(span, F.when(undated > 0, "、日付の記載なしあり").otherwise("")))


def shown_count(c: Column, unit: str = "件") -> Column:
    """Grouped count with its unit; unknown ones say so."""
    return F.coalesce(F.concat(F.format_number(c, 0), F.lit(unit)), F.lit("未照合"))
