"""One query per operator over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..operators import continuity, gates, normalize, search
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """`rows` over all cores by `key`: the tables are single files, which one task reads up to some megabytes."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


DATED = "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END"
FISCAL = f"year({DATED}) - CAST(month({DATED}) <= 3 AS INT)"


def dated():
    return F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))


def by_priority(*values):
    """The value of an order's priority class, 1 to 5."""
    out = F.lit(None)
    for k, v in enumerate(values, 1):
        out = F.when(F.col("o_orderpriority").startswith(str(k)), v).otherwise(out)
    return out


@query(f"SELECT coalesce(CAST({FISCAL} AS VARCHAR), 'unclassified') AS year_key, count(*) AS n_rows FROM orders GROUP BY 1")
def fiscal_year_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(files.year_key(S.fiscal_year(dated())).alias("year_key")).agg(F.count("*").alias("n_rows"))


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN concat_ws('-', year(o_orderdate), month(o_orderdate), day(o_orderdate)) WHEN '2' THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN '3' THEN strftime(o_orderdate, '%Y%m%d') WHEN '4' THEN '契約 ' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日付' ELSE year(o_orderdate) || '-02-30' END AS raw,
  CASE WHEN o_orderpriority NOT LIKE '5%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def parse_date_variants(spark, sf_dir):
    d = F.col("o_orderdate")
    y, m, n = F.year(d).cast("string"), F.month(d).cast("string"), F.day(d).cast("string")
    raw = by_priority(F.concat_ws("-", y, m, n), F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "yyyyMMdd"), F.concat(F.lit("契約 "), y, F.lit("年"), m, F.lit("月"), n, F.lit("日付")), F.concat(y, F.lit("-02-30")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("parsed", S.parse_date(F.col("raw")))


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN format('{:,}', v) || '円' WHEN '2' THEN '△' || v WHEN '3' THEN '(' || v || ')' WHEN '4' THEN '￥' || v ELSE '' END AS raw,
  CASE left(o_orderpriority, 1) WHEN '2' THEN -v WHEN '3' THEN -v WHEN '5' THEN NULL ELSE v END AS amount FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)""")
def parse_amount_variants(spark, sf_dir):
    v = F.floor("o_totalprice").cast("long")
    text = v.cast("string")
    raw = by_priority(F.concat(F.format_number(v, 0), F.lit("円")), F.concat(F.lit("△"), text), F.concat(F.lit("("), text, F.lit(")")), F.concat(F.lit("￥"), text), F.lit(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("clean", S.clean_cell(F.col("raw")))
    return S.with_amount(rows, "amount", F.col("clean")).drop("clean")


RE2_SPACE = r"[\x{9}-\x{D} \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(chr(12288) || coalesce(text, '') || chr(160), '{RE2_SPACE}+', ' ', 'g'))) AS cleaned FROM documents")
def clean_cell(spark, sf_dir):
    marked = F.concat(F.lit("﻿　"), F.coalesce("text", F.lit("")), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.clean_cell(marked)).alias("cleaned"))


@query(rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '{RE2_SPACE}+', ' ', 'g'))) AS stripped FROM pages""")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(S.strip_html(F.col("html"))).alias("stripped"))


DIGIT_SUM = " + ".join(f"CAST(substr(number, {k + 1}, 1) AS INT) * {2 if k % 2 else 1}" for k in range(1, 13))


@query(f"SELECT c_custkey, number, CAST(substr(number, 1, 1) AS INT) = 9 - ({DIGIT_SUM}) % 9 AS valid FROM (SELECT c_custkey, (c_custkey % 10) || lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS number FROM customer)")
def check_digit(spark, sf_dir):
    number = F.concat((F.col("c_custkey") % 10).cast("string"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.digits_only(number).alias("number")).withColumn("valid", S.valid_corporate_number(F.col("number")))


@query("""SELECT o_orderkey, 'gbiz-' || substr(sha256(CASE WHEN o_orderstatus <> 'F' THEN concat_ws(chr(31), 'subsidy', 'key', o_orderkey) ELSE concat_ws(chr(31), 'subsidy', 'row', o_custkey, coalesce(NULLIF(o_orderpriority, '5-LOW'), '')) END), 1, 16) AS id FROM orders""")
def stable_id(spark, sf_dir):
    key = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).otherwise("")
    other = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.stable_id(F.lit("subsidy"), key, F.col("o_custkey"), other).alias("id"))


@query("""SELECT o_orderkey, sha256('[' || concat_ws(',', CAST(to_json('a"\\' || o_orderstatus) AS VARCHAR), coalesce(CAST(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS VARCHAR), 'null'),
  coalesce(CAST(to_json(NULLIF(o_orderpriority, '5-LOW')) AS VARCHAR), 'null')) || ']') AS hash FROM orders""")
def semantic_hash(spark, sf_dir):
    customer = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    fields = [(F.concat(F.lit('a"\\'), F.col("o_orderstatus")), False), (customer, True), (priority, False)]
    return S.with_semantic_hash(table(spark, sf_dir, "orders"), "hash", fields).select("o_orderkey", "hash")


@query("""SELECT n_name, CASE WHEN r_name <> 'ASIA' THEN r_name END AS publisher, contains(n_name, '_1') AS suspicious, count(*) AS customers
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def agency_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    alias = nation.join(region.where("r_name != 'ASIA'"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("alias_name"), F.col("r_name").alias("canonical"))
    rows = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))
    named = normalize.with_publisher(rows, "n_name", alias)
    return named.select("n_name", F.col("publisherCanonical").alias("publisher"), normalize.suspicious(F.col("n_name"), ["_1"]).alias("suspicious"), "customers")


IMPORTED = "(SELECT *, c_acctbal >= 0 AS rec, c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' AS elig FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""SELECT count(*) AS total_rows, count_if(rec) AS recipient_rows, count_if(elig) AS eligible_rows, count_if(elig AND o_orderstatus = 'P') AS missing_date, count_if(elig AND o_orderpriority = '5-LOW') AS missing_program,
  count_if(elig AND o_totalprice < 10000) AS missing_amount, count_if(elig AND c_mktsegment = 'MACHINERY') AS missing_key FROM {IMPORTED}""")
def import_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    rows = rows.selectExpr(
        "c_acctbal >= 0 as is_recipient", "c_acctbal >= 0 and c_mktsegment != 'BUILDING' as is_eligible", "if(o_orderstatus = 'P', null, o_orderdate) as date",
        "if(o_orderpriority = '5-LOW', '', o_orderpriority) as program", "if(o_totalprice < 10000, null, o_totalprice) as amount", "if(c_mktsegment = 'MACHINERY', '', c_mktsegment) as sourceKey",
    )
    return normalize.statistics(rows)


@query("SELECT CASE WHEN source = '' THEN '（発行元なし）' ELSE source END AS name, count(*) AS n_rows, contains(source, 'NEDO') AS suspicious FROM documents WHERE source IS NOT NULL GROUP BY ALL ORDER BY n_rows DESC, name LIMIT 20")
def unmatched_top20(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("sourceAgency"), F.lit(True).alias("is_recipient"), F.lit(None).cast("string").alias("publisherCanonical"))
    return normalize.top_unmatched(normalize.unmatched_agencies(rows)).withColumnRenamed("rows", "n_rows")


SEARCHED = "(SELECT c_name AS organization, lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS corporateNumber, CASE WHEN c_mktsegment <> 'BUILDING' THEN 2000 + c_nationkey END AS fiscalYear, c_custkey AS id, c_mktsegment FROM customer)"


def searchable(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.selectExpr(
        "c_name as organization", "lpad(cast(c_custkey as string), 13, '0') as corporateNumber", "n_name as sourceAgency", "if(c_mktsegment = 'HOUSEHOLD', 'contracted', 'subsidy_published') as stage",
        "if(c_mktsegment = 'BUILDING', null, 2000 + c_nationkey) as fiscalYear", "cast(null as string) as date", "c_custkey as id",
    )


@query(f"""SELECT organization, corporateNumber, fiscalYear, id FROM {SEARCHED} WHERE contains(lower(organization || ' ' || corporateNumber), '1 00') AND c_mktsegment <> 'HOUSEHOLD'
  ORDER BY fiscalYear DESC NULLS LAST, organization, id LIMIT 100""")
def search_page(spark, sf_dir):
    wanted = search.criteria({"q": " 1 00 ", "stage": "subsidy_published"})
    return search.page(searchable(spark, sf_dir), wanted).select("organization", "corporateNumber", "fiscalYear", "id")


@query(f"SELECT id, organization FROM {SEARCHED} WHERE fiscalYear IS NULL ORDER BY organization, id LIMIT 100")
def search_unclassified(spark, sf_dir):
    return search.page(searchable(spark, sf_dir), search.criteria({"year": "unclassified", "page": "1e0"})).select("id", "organization")


@query("SELECT DISTINCT n_name AS agency FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct_agencies(spark, sf_dir):
    return search.agencies(searchable(spark, sf_dir)).select(F.col("sourceAgency").alias("agency"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount, strftime({DATED}, '%Y-%m-%d') AS date FROM orders
  ORDER BY amount DESC NULLS LAST, date DESC NULLS LAST, id LIMIT 100""")
def stored_order_top(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("long")).alias("amount"), F.date_format(dated(), "yyyy-MM-dd").alias("date"))
    return rows.orderBy(*search.stored_order()).limit(100)


DIFF = """(SELECT coalesce(p.k, c.k) AS id, CASE WHEN c.k IS NULL THEN 'removed' WHEN p.k IS NULL THEN 'added' WHEN p.a IS DISTINCT FROM c.a OR p.b IS DISTINCT FROM c.b THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN c.k IS NULL OR p.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN p.a IS DISTINCT FROM c.a THEN 'amount' END, CASE WHEN p.b IS DISTINCT FROM c.b THEN 'stage' END) END AS fields, p.b AS old_stage, c.b AS new_stage
  FROM (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS a, NULLIF(o_orderpriority, '2-HIGH') AS b FROM orders WHERE o_orderstatus <> 'P') p
  FULL JOIN (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) + CAST(o_orderpriority = '1-URGENT' AS INT) AS a, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'x|y' ELSE NULLIF(o_orderpriority, '2-HIGH') END AS b
  FROM orders WHERE o_orderpriority <> '5-LOW') c ON p.k = c.k)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority"))
    amount = F.floor("o_totalprice").cast("long")
    old = orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("id"), amount.alias("amount"), stage.alias("stage"))
    moved = F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F"), "x|y").otherwise(stage)
    new = orders.where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("id"), (amount + (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("amount"), moved.alias("stage"))
    return old, new


@query(f"SELECT id, status, fields FROM {DIFF}")
def continuity_diff(spark, sf_dir):
    diff = continuity.snapshot_diff(*snapshots(spark, sf_dir), ["id"], ["amount", "stage"])
    return diff.select("id", "status", F.array_join("changedFields", ",").alias("fields"))


@query(f"""SELECT count_if(status <> 'added') AS previous_rows, count_if(status <> 'removed') AS candidate_rows, count_if(status = 'removed') AS removed_rows, count_if(status = 'added') AS added_rows,
  count_if(status = 'changed') AS changed_rows, count_if(contains(fields, 'stage')) AS identity_changes FROM {DIFF}""")
def continuity_gate(spark, sf_dir):
    return continuity.diff_counts(continuity.snapshot_diff(*snapshots(spark, sf_dir), ["id"], ["amount", "stage"]))


@query(f"SELECT id, '| ' || id || ' | stage | ' || coalesce(replace(old_stage, '|', '\\|'), 'null') || ' | ' || coalesce(replace(new_stage, '|', '\\|'), 'null') || ' |' AS line FROM {DIFF} WHERE contains(fields, 'stage')")
def correction_table(spark, sf_dir):
    diff = continuity.snapshot_diff(*snapshots(spark, sf_dir), ["id"], ["amount", "stage"]).where(F.array_contains("changedFields", "stage"))
    changes = diff.select(F.col("id").alias("key"), F.lit("stage").alias("field"), F.col("p.stage").alias("before"), F.col("c.stage").alias("after"))
    return continuity.correction_table(changes).select(F.col("key").alias("id"), "line")


COUNTED = "(SELECT o_orderpriority AS counter, count_if(o_orderstatus = 'F') AS previous, count_if(o_orderstatus <> 'P') AS candidate FROM orders GROUP BY 1)"


@query(f"SELECT counter, candidate - previous AS growth, greatest(1000, CAST(ceil(previous * 5 / 100) AS BIGINT)) AS growth_limit, candidate - previous BETWEEN 0 AND greatest(1000, CAST(ceil(previous * 5 / 100) AS BIGINT)) AS passed FROM {COUNTED}")
def snapshot_gate(spark, sf_dir):
    counters = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("counter")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("previous"), F.count_if(F.col("o_orderstatus") != "P").alias("candidate"))
    return continuity.snapshot_verdicts(counters)


@query("""SELECT o_orderstatus AS kind, count_if(o_totalprice > 20000) - count_if(o_totalprice > 10000) AS gap, CASE WHEN o_orderstatus <> 'P' THEN count(*) - count_if(o_totalprice > 20000) END AS difference,
  CASE WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN count(*) = count_if(o_totalprice > 20000) THEN 'matched' ELSE 'different' END AS status FROM orders GROUP BY 1""")
def import_audit(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count_if(F.col("o_totalprice") > 20000).alias("eligible"), F.count_if(F.col("o_totalprice") > 10000).alias("imported"), F.count("*").alias("n"))
    return continuity.import_audit(counts.withColumn("dashboard", F.when(F.col("kind") != "P", F.col("n"))))


@query("SELECT md5(text) AS text_md5, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("text_md5"))
    return continuity.duplicate_keys(hashed, ["text_md5"])


@query(f"""WITH leaves AS (SELECT coalesce(CAST({FISCAL} AS VARCHAR), 'unclassified') AS year_key, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS BIGINT) % 4096 AS b, count(*) AS n,
  sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS leaf FROM orders GROUP BY 1, 2)
  SELECT year_key, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(leaf, chr(10) ORDER BY b)) AS set_hash FROM leaves GROUP BY 1""")
def release_receipt(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(files.year_key(S.fiscal_year(dated())).alias("year_key"), F.col("o_orderkey").alias("id"))
    return files.set_hash(rows, ["year_key"], "id").select("year_key", F.col("rows").alias("n_rows"), "set_hash")


@query("SELECT DISTINCT year_key, 'commitments-' || year_key || '.json' AS file FROM (SELECT coalesce(CAST(" + FISCAL + " AS VARCHAR), 'unclassified') AS year_key FROM orders)")
def manifest(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(files.year_key(S.fiscal_year(dated())).alias("year_key")).distinct()
    return years.select("year_key", F.concat(F.lit("commitments-"), "year_key", F.lit(".json")).alias("file"))


@query(f"""SELECT o_orderkey AS id, CAST({FISCAL} AS INT) AS fiscalYear, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'F' THEN 'n/a' END AS amountRaw, o_orderstatus AS stage FROM orders""")
def public_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    blank = [F.lit("").alias(c) for c in ("organization", "corporateNumber", "sourceAgency", "program", "sourceKey", "sourceSystem", "date")]
    adapted = rows.select(
        F.col("o_orderkey").alias("id"), S.fiscal_year(dated()).alias("fiscalYear"), F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("long")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", " 　").otherwise("n/a").alias("amountRaw"), F.col("o_orderstatus").alias("stage"), F.lit(2).alias("sourceRowNumber"), *blank,
    )
    return files.public_rows(adapted).select("id", "fiscalYear", "amount", "amountRaw", "stage")


@query("SELECT stage, count(*) AS n_rows FROM (SELECT 'subsidy_published' AS stage FROM orders UNION ALL SELECT 'contracted' FROM lineitem) GROUP BY 1")
def union_kinds(spark, sf_dir):
    subsidy = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(R.STAGES["subsidy"]).alias("stage"))
    procurement = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit(R.STAGES["procurement"]).alias("stage"))
    return subsidy.unionByName(procurement).groupBy("stage").agg(F.count("*").alias("n_rows"))


@query("SELECT n_name, count(*) AS subsidies, CASE WHEN n_name <> 'NATION_3' THEN CAST(sum(c_custkey) AS BIGINT) END AS procurements FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def dashboard_rows(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("a"), F.sum("c_custkey").alias("b"))
    head = "<tr>" + "".join(f"<th class='h'>{h}</th>" for h in files.DASHBOARD_HEADERS) + "</tr>"
    last = F.when(F.col("n_name") == "NATION_3", F.lit("01")).otherwise(F.format_number("b", 0))
    html = F.concat(F.lit(f"<table id='corporateActivityNumbersTable'><thead>{head}</thead><tbody><tr><td>1</td><td> <b>省</b></td><td>0</td><td>0</td><td>0</td><td>"), F.col("a").cast("string"), F.lit("</td><td>&nbsp;"), last, F.lit("</td><td>0</td><td>0</td></tr></tbody></table>"))
    return files.dashboard_counts(counts.select("n_name", html.alias("html")), "html", "省").select("n_name", "subsidies", "procurements")


@query("SELECT c_custkey, k AS position, c_custkey || '-' || k AS id, c_name AS name, c_mktsegment AS subsidy, 2 AS total FROM customer, (SELECT unnest([0, 1]) AS k)")
def embedded_json(spark, sf_dir):
    item = "named_struct('id', concat(cast(c_custkey as string), '-{k}'), 'name', concat(' ', c_name, ' '), 'address', 'x', 'subsidy', c_mktsegment, 'year', '2025', 'times', '1', 'plan', '<p>')"
    body = F.expr(f"to_json(named_struct('props', named_struct('pageProps', named_struct('count', '2', 'total', 2, 'listView', array({item.format(k=0)}, {item.format(k=1)})))))")
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('<html><script>1</script><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>")).alias("html"))
    return files.adoption_rows(pages, "html").selectExpr("c_custkey", "position", "id", "name", "subsidy", "cast(total as int) as total")


@query("""SELECT c_custkey, greatest(1, CAST(ceil(c_custkey / 20) AS BIGINT)) AS pages, CASE WHEN c_nationkey + 1 < greatest(1, CAST(ceil(c_custkey / 20) AS BIGINT)) THEN 20
  WHEN c_nationkey + 1 = greatest(1, CAST(ceil(c_custkey / 20) AS BIGINT)) THEN c_custkey - (c_nationkey) * 20 END AS expected_rows FROM customer""")
def adoption_page_check(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("total"), (F.col("c_nationkey") + 1).alias("page"))
    return search.adoption_page_check(totals).select("c_custkey", "pages", "expected_rows")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '（空欄）' WHEN o_orderstatus = 'O' THEN 'n/a' ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '円' END AS amount, year(o_orderdate) || '年' AS year_text,
  '第' || o_custkey || '回' AS round_text, CASE WHEN o_orderstatus = 'P' THEN '未照合' ELSE CASE WHEN o_custkey > 700 THEN '+' ELSE '' END || format('{:,}', o_custkey - 700) END AS signed FROM orders""")
def display_texts(spark, sf_dir):
    amount = F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("long"))
    raw = F.when(F.col("o_orderstatus") == "O", "n/a")
    signed = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") - 700)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.shown_amount(amount, raw).alias("amount"), S.application_year(F.year("o_orderdate").cast("string")).alias("year_text"),
        S.application_round(F.col("o_custkey").cast("string")).alias("round_text"), S.signed_count(signed).alias("signed"),
    )


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d %H:%M') AS tokyo FROM events")
def tokyo_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.tokyo_time(F.col("ts").cast("timestamp")).alias("tokyo"))


@query("SELECT event_type, count(*) AS n_rows, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS with_k, CAST(max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS max_k FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count("p.k").alias("with_k"), F.max("p.k").alias("max_k"))


@query("SELECT c_custkey, 'https://example.org/q=' || url_encode(c_name || ' ' || c_mktsegment) AS url FROM customer")
def record_urls(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.component_url("https://example.org/q=", F.concat_ws(" ", "c_name", "c_mktsegment")).alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS n FROM orders")
def count_texts(spark, sf_dir):
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("0"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderstatus") == "F", F.format_number("o_orderkey", 0)).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_count(text).alias("n"))


@query("""SELECT CAST(0 AS BIGINT) + count_if(o_orderstatus = 'P') AS foreign_rows, count_if(o_orderpriority = '5-LOW') AS incomplete,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS repeated FROM orders""")
def public_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as id", "if(o_orderpriority = '5-LOW', null, o_orderpriority) as organization", "'1234567890123' as corporateNumber", "'k' as sourceKey", "'contracted' as stage", "'a' as sourceAgency", "'s' as sourceSystem", "'' as program",
        "1L as sourceRowNumber", "1 as fiscalYear", "'1' as file_year", "if(o_orderstatus = 'P', 'other', 'own') as ingestSource",
    )
    found = gates.verdicts(rows, gates.public_rules("own")).groupBy().pivot("rule", ["another source", "required fields"]).agg(F.sum("failures")).toDF("foreign_rows", "incomplete")
    repeated = continuity.duplicate_keys(rows, ["id"]).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("repeated"))
    return found.join(repeated, how="cross")  # one row with one row


@query("SELECT DISTINCT id, reason FROM (SELECT CAST(c_nationkey AS VARCHAR) AS id, 'filter' AS reason FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'repeated' FROM customer GROUP BY c_nationkey HAVING count(*) > 1)")
def adoption_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as string) as id", "'x' as prefecture", "c_mktsegment as subsidy")
    return search.adoption_violations(rows, subsidy="BUILDING").distinct()


@query("SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS sources, count_if(text IS NULL) AS blank FROM documents GROUP BY 1")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("sources"), F.count_if(F.col("text").isNull()).alias("blank"))
