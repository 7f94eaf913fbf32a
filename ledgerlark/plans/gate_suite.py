"""Queries of imports, gates and summaries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..operators import continuity, gates, index, normalize, search, summaries, throttle
from ..sources import adoptions, files, site
from ..sources.storage import scratch
from .suite import DATED, DIGIT_SUM, FISCAL, dated, dealt, query, searchable, snapshots, table

# The bulk columns of both files, made from orders: a valid number for all but one priority, four publishers, some blanks.
BODY = "lpad(CAST(o_custkey * 7919 AS {}), 12, '0')"
CHECKED = "CAST(9 - ({}) % 9 AS {}) || {}"
PUBLISHERS = "CASE o_orderkey % 4 WHEN 0 THEN '特許庁' WHEN 1 THEN 'NEDO' WHEN 2 THEN '経済産業省関東経済産業局' ELSE 'NEDO支部' END"
CANONICAL = "CASE o_orderkey % 4 WHEN 0 THEN '特許庁' WHEN 1 THEN 'NEDO' WHEN 2 THEN '関東経済産業局' END"
NUMBERED = f"(SELECT *, {CHECKED.format(DIGIT_SUM, 'VARCHAR', 'substr(number, 2)')} AS corp FROM (SELECT *, '0' || {BODY.format('VARCHAR')} AS number FROM orders))"


def bulk(spark, sf_dir, kind="subsidy") -> DataFrame:
    """Orders as the raw string columns of a kind's file; the procurement file has notes and a quality too."""
    rows, head = table(spark, sf_dir, "orders").withColumn("number", F.expr(f"'0' || {BODY.format('STRING')}")), R.HEADERS[kind]
    cells = {
        "corporate": f"if(o_orderpriority = '5-LOW', '0', '') || {CHECKED.format(DIGIT_SUM, 'STRING', 'substr(number, 2)')}", "name": "' 株式会社　' || o_custkey", "date": "if(o_orderstatus = 'P', '', date_format(o_orderdate, 'yyyy/MM/dd'))",
        "program": "if(o_orderpriority = '2-HIGH', '　', o_orderpriority)", "amount": "if(o_orderpriority = '3-MEDIUM', '非公開', cast(floor(o_totalprice) as string) || '円')", "agency": PUBLISHERS, "key": "if(o_orderkey % 7 = 0, '', 'K' || o_orderkey)",
    } | ({"notes": "' 備考 ' || o_orderstatus"} if kind == "procurement" else {})
    more = ["'A  1' as `データ品質`"] if kind == "procurement" else []
    return dealt(rows, "o_orderkey").selectExpr(*[f"{value} as `{head[name]}`" for name, value in cells.items()], *more, "cast(o_orderkey + 1 as long) as sourceRowNumber")


def imported(spark, sf_dir, kind="subsidy") -> normalize.Import:
    return normalize.import_kind(bulk(spark, sf_dir, kind), kind, scratch(spark, f"import-{kind}"))


RECORD = f"""(SELECT *, '株式会社 ' || o_custkey AS org, {PUBLISHERS} AS agency, {CANONICAL} AS canonical, CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE o_orderpriority END AS program,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS date_raw, strftime({DATED}, '%Y-%m-%d') AS date_, {FISCAL} AS fy, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'K' || o_orderkey END AS key,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN '非公開' ELSE CAST(floor(o_totalprice) AS BIGINT) || '円' END AS amount_raw, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount_ FROM {NUMBERED} WHERE o_orderpriority <> '5-LOW')"""
KIND_ID = "'gbiz-' || substr(sha256(CASE WHEN key <> '' THEN concat_ws(chr(31), '{0}', 'key', key) ELSE concat_ws(chr(31), '{0}', 'row', o_orderkey + 1, date_raw, corp, amount_raw, program, agency) END), 1, 16)"
IMPORTED_ID = KIND_ID.format("subsidy")
KIND_HASH = """sha256('["{}","' || key || '","' || org || '","' || corp || '","' || agency || '","' || canonical || '","' || program || '",' || coalesce('"' || date_ || '"', 'null') || ',"' || date_raw || '",'
  || coalesce(CAST(fy AS VARCHAR), 'null') || ',' || coalesce(CAST(amount_ AS VARCHAR), 'null') || ',"' || amount_raw || '","{}","{}",""]')"""
RECORD_SQL = "SELECT {} AS id, org AS organization, corp AS \"corporateNumber\", date_ AS date, CAST(fy AS INT) AS \"fiscalYear\", amount_ AS amount, canonical AS \"publisherCanonical\", {} AS hash FROM " + RECORD + " WHERE canonical IS NOT NULL"
STATS_SQL = f"""SELECT (SELECT count(*) FROM orders) AS total_rows, count(*) AS recipient_rows, count_if(canonical IS NOT NULL) AS eligible_rows, count_if(canonical IS NOT NULL AND date_ IS NULL) AS missing_date,
  count_if(canonical IS NOT NULL AND program = '') AS missing_program, count_if(canonical IS NOT NULL AND amount_ IS NULL) AS missing_amount, count_if(canonical IS NOT NULL AND key = '') AS missing_key FROM {RECORD}"""
SHOWN = ["id", "organization", "corporateNumber", "date", "fiscalYear", "amount", "publisherCanonical"]


@query(RECORD_SQL.format(IMPORTED_ID, KIND_HASH.format("subsidy_published", "", "")))
def import_records(spark, sf_dir):
    return imported(spark, sf_dir).records.select(*SHOWN, F.col("sourceRecordHash").alias("hash"))


@query(RECORD_SQL.format(KIND_ID.format("procurement"), KIND_HASH.format("contracted", "備考 ' || o_orderstatus || '", "A 1")))
def import_procurements(spark, sf_dir):
    return imported(spark, sf_dir, "procurement").records.select(*SHOWN, F.col("sourceRecordHash").alias("hash"))


@query(STATS_SQL)
def import_statistics(spark, sf_dir):
    return imported(spark, sf_dir).statistics


@query(f"SELECT agency AS name, count(*) AS n_rows, true AS suspicious FROM {RECORD} WHERE canonical IS NULL GROUP BY 1")
def import_unmatched(spark, sf_dir):
    return imported(spark, sf_dir).unmatched.withColumnRenamed("rows", "n_rows")


@query(f"""SELECT stage, count(*) AS n_rows, count(DISTINCT id) AS ids, CAST(sum(amount_) AS BIGINT) AS checksum, min(address) AS address, min(name) AS name FROM (SELECT *, 'subsidy_published' AS stage, {IMPORTED_ID} AS id, 'GビズINFO 全件CSV（補助金）' AS name FROM {RECORD}
  UNION ALL SELECT *, 'contracted', {KIND_ID.format('procurement')}, 'GビズINFO 全件CSV（調達）' FROM {RECORD}), (SELECT 'https://info.gbiz.go.jp/hojin/ichiran?hojinBango=' AS address) WHERE canonical IS NOT NULL GROUP BY 1""")
def import_both_kinds(spark, sf_dir):
    both = normalize.union_of({kind: imported(spark, sf_dir, kind) for kind in R.STAGES})
    address = F.regexp_replace("sourceUrl", "[0-9]{13}$", "")
    return both.records.groupBy("stage").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("ids"), F.sum("amount").alias("checksum"), F.min(address).alias("address"), F.min("sourceName").alias("name"))


def _rules(*named: tuple[str, str], source: str, by: str = "") -> str:
    """SQL of verdict rows: a SELECT for each (rule, expression)."""
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(f"SELECT {head}{k} AS position, '{rule}' AS rule, CAST(n AS BIGINT) AS failures FROM (SELECT {value} + 0 * count(*) AS n FROM {source}{tail})" for k, (rule, value) in enumerate(named, 1))


@query(_rules(("nothing is eligible", "CAST(count_if(o_totalprice > 20000) = 0 AS INT)"), ("imported rows differ from eligible ones", "(SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderstatus HAVING count_if(o_totalprice > 20000) <> count_if(o_totalprice > 10000)))"),
              ("rows of another stage", "count_if(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"), source="orders"))
def import_gate(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(
        F.expr("count_if(o_totalprice > 20000)").alias("eligible"), F.expr("count_if(o_totalprice > 10000)").alias("imported"), F.expr("count_if(o_orderpriority = '1-URGENT' and o_orderstatus = 'F')").alias("other_stage")
    )
    return gates.import_gate(counts)


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN 'rows without a key' WHEN k = 1 THEN 'suspicious publishers' WHEN k = 2 THEN 'no baseline' WHEN k = 3 THEN 'no dashboard counts' WHEN k = 4 THEN 'total_subsidy is unknown'
  WHEN k = 5 THEN 'total_procurement decreased' WHEN grown > greatest(1000, CAST(ceil(100 * c_custkey * 5 / 100) AS BIGINT)) THEN 'eligible_subsidy grew too much' WHEN k = 7 THEN 'bytes_procurement is not positive'
  WHEN k = 8 THEN 'subsidy: more eligible rows than the dashboard counts' WHEN k = 9 THEN 'procurement: the gap to the dashboard grew' END AS fault FROM (SELECT *, c_custkey % 11 AS k, CASE WHEN c_custkey % 11 = 6 THEN c_nationkey * 300 ELSE 0 END AS grown FROM customer)""")
def snapshot_continuity(spark, sf_dir):
    n = "100L * c_custkey"
    previous = f"named_struct('imported_at', '2026', 'record_count', {n}, 'total_subsidy', {n}, 'total_procurement', {n}, 'eligible_subsidy', {n}, 'eligible_procurement', {n}, 'bytes_subsidy', 9L, 'bytes_procurement', 9L, 'dashboard_subsidy', {n}, 'dashboard_procurement', {n}, 'gap_subsidy', if(k = 2, null, 50000L), 'gap_procurement', 5L)"
    current = f"named_struct('missing_key_rows', if(k = 0, 1L, 0L), 'suspicious_rows', if(k = 1, 2L, 0L), 'total_subsidy', if(k = 4, null, {n}), 'total_procurement', if(k = 5, {n} - 1, {n}), 'eligible_subsidy', {n} + grown, 'eligible_procurement', {n}, 'bytes_subsidy', 8L, 'bytes_procurement', if(k = 7, 0L, 8L))"
    dashboard = f"named_struct('subsidy', if(k = 3, null, if(k = 8, {n} - 1, {n} + grown)), 'procurement', if(k = 9, {n} + 6, {n} + 5))"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 11 as k", "if(c_custkey % 11 = 6, c_nationkey * 300, 0) as grown").selectExpr("c_custkey", f"{previous} as previous", f"{current} as current", f"{dashboard} as dashboard")
    return gates.snapshot_continuity(rows).select("c_custkey", "fault")


VALID_RULES = [
    ("repeated id", "count(*) - count(DISTINCT id)"), ("route fields", "0"), ("corporate number", "0"), ("no key", "count_if(key = '')"), ("hash", "count_if(o_orderkey % 11 = 0)"), ("publisher", "count_if(o_orderkey % 13 = 0)"),
    ("amount", "count_if(o_orderkey % 17 = 0)"), ("date or fiscal year", "count_if(o_orderkey % 19 = 0)"), ("stage", "count_if(o_orderkey % 23 = 0)"), ("address of the source", "count_if(o_orderkey % 29 = 0)"), ("source", "0"),
    ("record count", "CAST(count(*) <> (SELECT count(*) FROM orders) AS INT)"), ("publisher rules", "1"), ("import counts", "1"), ("import counts by kind", "1"), ("dashboard differences", "1"),
]


@query(_rules(*VALID_RULES, source=f"(SELECT *, {IMPORTED_ID} AS id FROM {RECORD} WHERE canonical IS NOT NULL)"))
def validate_snapshot(spark, sf_dir):
    records = imported(spark, sf_dir).records.withColumn("k", F.col("sourceRowNumber") - 1)
    stored = lambda n, bad, good: F.when(F.col("k") % n == 0, bad).otherwise(good)
    c = F.col
    broken = records.withColumns({
        "publisherCanonical": stored(13, F.lit("他"), c("publisherCanonical")), "amount": stored(17, F.lit(9007199254740992), c("amount")), "fiscalYear": stored(19, F.lit(1900), c("fiscalYear")),
        "stage": stored(23, F.lit("paid"), c("stage")), "sourceUrl": stored(29, F.lit("http://x"), F.lit("https://x")),
    })
    whole = [(c(name), name in ("fiscalYear", "amount")) for name in R.SEMANTIC]
    broken = S.with_semantic_hash(broken, "whole", whole).withColumn("sourceRecordHash", stored(11, F.lit("00"), c("whole"))).drop("whole")
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    source = n.selectExpr("n as record_count", "n as eligible", "n + 1 as imported", "0L as gap", "1L as imported_subsidy", "1L as eligible_subsidy", "0L as imported_procurement", "0L as eligible_procurement", "n + 5 as dashboard", "n as dashboard_subsidy", "5L as dashboard_procurement", "5L as difference", "n - 1 as difference_subsidy", "6L as difference_procurement", "'00' as rules_sha256")
    return gates.validate(broken.drop("k"), source)


LEFT_OUT = [("repeated id", "0"), ("route fields", "1"), ("corporate number", "count_if(c_custkey % 3 = 0)"), ("no key", "0"), ("hash", "0"), ("publisher", "0"), ("amount", "0"), ("date or fiscal year", "0"), ("stage", "0"), ("address of the source", "0"),
            ("source", "1"), ("record count", "1"), ("publisher rules", "0"), ("import counts", "0"), ("import counts by kind", "0"), ("dashboard differences", "0")]


@query(_rules(*LEFT_OUT, source="customer"))
def validate_without_source(spark, sf_dir):
    number = F.expr(f"if(c_custkey % 3 = 0, '1', {CHECKED.format(DIGIT_SUM, 'STRING', 'substr(number, 2)')})")
    rows = table(spark, sf_dir, "customer").withColumn("number", F.expr("'0' || lpad(cast(c_custkey as string), 12, '0')")).withColumn("corporateNumber", number)
    named = {"id": "c_custkey", "sourceKey": "c_name", "sourceAgency": "'NEDO'", "publisherCanonical": "'NEDO'", "stage": "'contracted'", "sourceUrl": "'https://x'", "amount": "1L", "fiscalYear": "2024", "date": "'2025-03-31'", "sourceRecordHash": "''", "route": "'a>b'"}
    blank = [c for c in R.SEMANTIC if c not in named and c != "corporateNumber"]
    return gates.validate(rows.selectExpr("corporateNumber", *[f"{v} as {k}" for k, v in named.items()], *[f"'' as {c}" for c in blank]), spark.createDataFrame([], "record_count long"))


PAGE_FAULTS = ["no search data", "no script", "not JSON", "not an object", "no list", "too many rows", "page count", "row count", "row", "repeated id", "empty result", "pages"]


@query("SELECT c_custkey, CASE c_custkey % 14 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(PAGE_FAULTS)) + " END AS fault FROM customer")
def adoption_pages(spark, sf_dir):
    one = "named_struct('id', concat('r', i), 'name', c_name, 'address', '東京都', 'subsidy', c_mktsegment, 'year', '2025', 'times', '1', 'plan', '')"
    rows = f"transform(sequence(1, case k when 5 then 21 when 10 then 1 else 3 end), i -> {one})"
    listed = f"case k when 4 then '5' when 8 then replace(to_json({rows}), '\"year\":\"2025\"', '\"year\":2025') when 9 then replace(to_json({rows}), '\"r2\"', '\" r1\"') else to_json({rows}) end"
    total = "case k when 6 then '\"1\"' when 11 then '2' else '1' end"
    body = f"concat('{{\"props\":', if(k = 3, '[]', concat('{{\"pageProps\":{{\"count\":', if(k = 7, '\"1,00\"', if(k = 10, '\"0\"', '\"3\"')), ',\"total\":', {total}, ',\"listView\":', {listed}, '}}}}')), if(k = 2, '', '}}'))"
    html = f"case k when 0 then '<html/>' when 1 then '<p>__NEXT_DATA__</p>' else concat('<script id=''__NEXT_DATA__''>', {body}, '</script>') end"
    pages = dealt(table(spark, sf_dir, "customer"), "c_custkey").withColumn("k", F.expr("c_custkey % 14")).select("c_custkey", F.expr(html).alias("html"))
    return adoptions.page_faults(pages, "html").select("c_custkey", "fault")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'page of the query' WHEN 1 THEN 'keyword was not applied' WHEN 2 THEN 'prefCode was not applied' WHEN 3 THEN 'subsidyCodes was not applied' END AS fault FROM customer""")
def adoption_query_echo(spark, sf_dir):
    asked = "concat('{\"page\":\"', if(k = 0, '0', '7'), '\",\"keyword\":\" ', c_name, '\",\"prefCode\":\"13\"', if(k = 4, ',\"subsidyCodes\":\"a\"', ''), '}')"
    applied = "concat('{\"keyword\":\"', if(k = 1, 'other', c_name), '\",\"prefCode\":', if(k = 2, '[\"13\",\"14\"]', '[\"13\"]'), if(k in (3, 4), ',\"subsidyCodes\":[\"a\"]', ''), '}')"
    html = f"concat('<script id=\"__NEXT_DATA__\">', '{{\"query\":', {asked}, ',\"props\":{{\"pageProps\":{{\"count\":\"0\",\"total\":1,\"listView\":[],\"query\":', {applied}, '}}}}}}</script>')"
    pages = dealt(table(spark, sf_dir, "customer"), "c_custkey").withColumn("k", F.expr("c_custkey % 6")).select("c_custkey", F.expr(html).alias("html"))
    return adoptions.page_faults(pages, "html", with_query=True).select("c_custkey", "fault")


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN 'page was not applied' WHEN k = 1 THEN 'programme was not applied' WHEN asked > pages THEN 'page out of range' WHEN 3 <> CASE WHEN asked < pages THEN 20 ELSE c_custkey - (pages - 1) * 20 END THEN 'rows of the page'
  WHEN c_mktsegment <> 'BUILDING' THEN 'programme' END AS fault FROM (SELECT *, c_custkey % 5 AS k, greatest(1, CAST(ceil(c_custkey / 20) AS BIGINT)) AS pages, greatest(1, CAST(ceil(c_custkey / 20) AS BIGINT)) + CAST(c_custkey % 5 = 2 AS INT) AS asked FROM customer)""")
def adoption_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumns({"k": F.expr("c_custkey % 5"), "pages": F.expr("greatest(1L, ceil(c_custkey / 20))")})
    rows = rows.selectExpr(
        "c_custkey", "named_struct('page', pages + if(k = 2, 1, 0), 'keyword', '', 'prefecture', '東京都', 'programme', 'BUILDING') as asked", "c_custkey as total", "pages",
        "named_struct('page', pages + if(k = 2, 1, 0) + if(k = 0, 1, 0), 'keyword', '', 'prefecture', '東京都', 'programme', if(k = 1, '', 'BUILDING')) as query", "array_repeat(named_struct('prefecture', '東京都', 'subsidy', c_mktsegment), 3) as rows",
    )
    return adoptions.answer_faults(rows).select("c_custkey", "fault")


@query("SELECT page_id FROM pages WHERE strlen(html) > 2000")
def oversized_bodies(spark, sf_dir):
    return adoptions.oversized(table(spark, sf_dir, "pages").withColumnRenamed("html", "content"), 2000).select("page_id")


@query(f"SELECT canonical AS publisher, count(*) AS n_rows FROM {RECORD} WHERE canonical IS NOT NULL GROUP BY 1")
def publisher_counts(spark, sf_dir):
    return summaries.publisher_counts(imported(spark, sf_dir).records).withColumnRenamed("rows", "n_rows")


@query("""SELECT CAST(sum(n) AS BIGINT) AS unmatched_rows, count(*) AS unmatched_names, CAST(coalesce(sum(n) FILTER (contains(source, '1')), 0) AS BIGINT) AS suspicious_rows, count_if(contains(source, '1')) AS suspicious_names
  FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)""")
def unmatched_totals(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("rows"))
    return summaries.unmatched_totals(counted.withColumn("suspicious", normalize.suspicious(F.col("name"), ["1"])))


YEARS = f"(SELECT o_orderpriority AS p, {FISCAL} AS fy FROM orders)"


@query(f"""SELECT array_to_string(list(DISTINCT fy ORDER BY fy) FILTER (fy IS NOT NULL), ',') AS years, count_if(fy IS NULL) AS undated_rows, CASE WHEN min(fy) = max(fy) THEN min(fy) || '年度' ELSE min(fy) || '–' || max(fy) || '年度（認定日・受注日基準）' END || CASE WHEN count_if(fy IS NULL) > 0 THEN '、日付の記載なしあり' ELSE '' END AS shown,
  format('{{:,}}', count_if(fy IS NULL)) || '件' AS shown_rows FROM {YEARS}""")
def coverage(spark, sf_dir):
    found = summaries.coverage(table(spark, sf_dir, "orders").select(S.fiscal_year(dated()).alias("fiscalYear")))
    return found.select(F.array_join("fiscal_years", ",").alias("years"), "undated_rows", S.coverage_years(F.col("fiscal_years"), F.col("undated_rows")).alias("shown"), S.shown_count(F.col("undated_rows")).alias("shown_rows"))


@query("SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def count_maps(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = summaries.count_map(counted, "o_orderpriority", "n", "o_orderstatus")
    return maps.select("o_orderstatus", F.expr("array_join(transform(map_entries(counts), e -> concat(e.key, '=', e.value)), ',')").alias("counts"))


@query("SELECT c_custkey, sha256(c_name || chr(31) || c_mktsegment || chr(31) || 'a b') AS hash FROM customer")
def header_hash(spark, sf_dir):
    headers = F.array(F.concat(F.lit("﻿"), F.col("c_name")), F.concat(F.lit("　"), "c_mktsegment", F.lit(" ")), F.lit("a \t b"))
    return table(spark, sf_dir, "customer").select("c_custkey", summaries.schema_hash(headers).alias("hash"))


@query("SELECT sha256('[' || string_agg('[\"' || n_name || '\",\"' || r_name || '\"]', ',' ORDER BY n_name) || ']') AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey")
def rule_hash(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return summaries.pairs_hash(pairs, "n_name", "r_name", number=False)


@query("SELECT sha256('[' || string_agg('[\"' || p || '\",' || n || ']', ',' ORDER BY p) || ']') AS sha256 FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)")
def distribution_hash(spark, sf_dir):
    return summaries.pairs_hash(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n", number=True)


@query(f"SELECT coalesce(CAST(fy AS VARCHAR), 'unclassified') AS year_key, 'commitments-' || coalesce(CAST(fy AS VARCHAR), 'unclassified') || '.json' AS file, count(*) AS n_rows, NULL AS fault FROM {YEARS} GROUP BY 1, 2")
def year_manifest(spark, sf_dir):
    made = summaries.manifest(table(spark, sf_dir, "orders").select(S.fiscal_year(dated()).alias("fiscalYear"))).withColumnRenamed("rows", "n_rows")
    return made.withColumn("fault", gates.file_name_fault(F.col("year_key"), F.col("file")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'form' WHEN event_id % 3 = 1 THEN 'year' END AS fault FROM events")
def manifest_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("cast(1000 + event_id % 9000 as string)").alias("year"))
    name = F.expr("case event_id % 3 when 0 then concat('../commitments-', year, '.json') when 1 then 'commitments-unclassified.json' else concat('commitments-', year, '.json') end")
    return rows.select("event_id", gates.file_name_fault(F.col("year"), name).alias("fault"))


@query("""SELECT p.id AS key, u.field, CASE WHEN u.field = 'amount' THEN CAST(p.a AS VARCHAR) ELSE p.b END AS before, CASE WHEN u.field = 'amount' THEN CAST(c.a AS VARCHAR) ELSE c.b END AS after
  FROM (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS a, NULLIF(o_orderpriority, '2-HIGH') AS b FROM orders WHERE o_orderstatus <> 'P') p
  JOIN (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) + CAST(o_orderpriority = '1-URGENT' AS INT) AS a, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'x|y' ELSE NULLIF(o_orderpriority, '2-HIGH') END AS b
  FROM orders WHERE o_orderpriority <> '5-LOW') c ON p.id = c.id, (SELECT unnest(['amount', 'stage']) AS field) u WHERE CASE WHEN u.field = 'amount' THEN p.a <> c.a ELSE p.b IS DISTINCT FROM c.b END""")
def change_lines(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    blank = {c: F.lit(None).cast("string") for c in summaries.AUDITED if c not in ("id", "amount", "stage")}
    old, new = old.withColumns(blank), new.withColumns(blank)
    changes = continuity.snapshot_diff(old, new, ["id"], ["amount", "stage"]).where("status = 'changed'").select("id", "changedFields")
    return summaries.change_lines(summaries.evidence(changes, old, new, ["id"]).withColumn("key", F.col("id")))


@query("""SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS record_count, 'd' AS last_checked, 'healthy' AS status FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 5
  UNION ALL SELECT c_custkey, c_name, 0, '未取得', 'watch' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <= 5""")
def merged_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    current = rows.where("c_nationkey > 5").selectExpr("c_custkey as id", "c_name as name", "cast(c_nationkey as long) as record_count", "'d' as last_checked", "'healthy' as status")
    return summaries.merged_sources(current, rows.selectExpr("c_custkey as id", "c_name as name", "c_mktsegment = 'BUILDING' as enabled"))


@query("SELECT doc_id, md5(left(coalesce(text, ''), 2000)) AS message FROM documents")
def failure_receipts(spark, sf_dir):
    return summaries.failure_receipt(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))).select("doc_id", F.md5("message").alias("message"))


@query("""SELECT c_custkey, md5('GビズINFOの自動更新を停止しました。検証済みの前回データを維持し、新しいデータは公開していません。' || chr(10) || chr(10) || '- 実行: ' || c_name || chr(10) || '- 検出日時: 2026' || chr(10) || '- 理由: ' || CASE WHEN c_nationkey > 3 THEN c_mktsegment || '\\|x' ELSE '更新処理失敗' END
  || chr(10) || '- 証跡: この実行の `gbiz-source-evidence` artifact' || chr(10) || chr(10) || '### 訂正候補' || chr(10) || CASE WHEN c_nationkey > 7 THEN 'T' ELSE '訂正候補の詳細は証跡artifactを確認してください。' END) AS body FROM customer""")
def failure_bodies(spark, sf_dir):
    reason, made = F.expr("if(c_nationkey > 3, concat(c_mktsegment, '|x'), null)"), F.expr("if(c_nationkey > 7, 'T', null)")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(summaries.failure_body(F.col("c_name"), F.lit("2026"), reason, made)).alias("body"))


@query(f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'gbiz-' ELSE 'x' END || o_orderkey AS id, CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime({DATED}, '%Y-%m-%d') END AS date, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST({FISCAL} AS INT) END AS "fiscalYear",
  coalesce(CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime({DATED}, '%Y-%m-%d') END, '') AS "dateRaw", CAST(o_custkey AS VARCHAR) AS "amountRaw", CASE WHEN o_orderkey % 2 = 0 THEN 'IPA' ELSE 'old' END AS "publisherCanonical", 'gbiz-bulk-csv' AS "ingestSource", '' AS program
  FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'F'""")
def rederived_records(spark, sf_dir):
    date = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(dated(), "yyyy/MM/dd")).otherwise(F.date_format(dated(), "yyyy-MM-dd"))
    old = table(spark, sf_dir, "orders").select(
        F.expr("concat(if(o_orderkey % 3 = 0, 'gbiz-', 'x'), o_orderkey)").alias("id"), date.alias("date"), F.lit(1).alias("fiscalYear"), F.lit(None).cast("string").alias("dateRaw"), F.col("o_custkey").cast("long").alias("amount"),
        F.lit(None).cast("string").alias("amountRaw"), F.expr("if(o_orderkey % 2 = 0, '', 'old')").alias("publisherCanonical"), F.lit("独立行政法人情報処理推進機構").alias("sourceAgency"), F.lit(None).cast("string").alias("program"),
        F.lit(None).cast("string").alias("sourceKey"), F.expr("if(o_orderstatus = 'F', 'gbiz-bulk-csv', null)").alias("ingestSource"), F.lit("a>b").alias("route"),
    )
    new = gates.rederived(old)
    return new.drop("route").select("id", "date", "fiscalYear", "dateRaw", "amountRaw", "publisherCanonical", "ingestSource", "program")


def published(spark, sf_dir) -> DataFrame:
    """Orders as published rows with planted faults."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('r', if(o_orderkey % 31 = 0, 0, o_orderkey)) as id", "year(o_orderdate) as fiscalYear", "if(o_orderkey % 5 = 0, 'unclassified', cast(year(o_orderdate) as string)) as file_year", "o_orderstatus as file",
        "if(o_orderkey % 7 = 0, '', '社') as organization", "if(o_orderkey % 11 = 0, '12', '1234567890123') as corporateNumber", "'NEDO' as sourceAgency", "'p' as program", "if(o_orderkey % 13 = 0, 'paid', 'contracted') as stage",
        "'k' as sourceKey", "cast(o_orderkey % 17 as long) as sourceRowNumber", "'s' as sourceSystem", "if(o_orderkey % 3 = 0, 'other', 'gbiz-bulk-csv') as ingestSource",
    )


@query(_rules(("another source", "count_if(o_orderkey % 3 = 0)"), ("file of another year", "count_if(o_orderkey % 5 = 0)"), ("required fields", "count_if(o_orderkey % 7 = 0)"), ("corporate number", "count_if(o_orderkey % 11 = 0)"),
              ("stage", "count_if(o_orderkey % 13 = 0)"), ("row number", "count_if(o_orderkey % 17 = 0)"), source="orders"))
def public_verdicts(spark, sf_dir):
    return gates.verdicts(published(spark, sf_dir), gates.public_rules())


@query(_rules(("commit", "1"), ("manifest", "0"), ("file without a receipt", "max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)"), ("bytes of a file", "max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)"), ("rows of a file", "max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)"),
              ("form of a row", "count_if(o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)"), ("repeated id", "greatest(count_if(o_orderkey % 31 = 0) - 1, 0)"), ("whole release", "1"), source="orders"))
def sync_verdicts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("file")).agg(F.count("*").alias("rows")).selectExpr("file", "10L as bytes", "'a' as sha256", "rows", "true as is_array")
    receipts = counts.where("file != 'P'").selectExpr("file", "bytes", "if(file = 'F', 'b', sha256) as sha256", "if(file = 'O', rows + 1, rows) as rows")
    facts = counts.agg(F.sum("rows").alias("record_count")).selectExpr("'c' as commit", "'d' as expected_commit", "'m' as manifest_sha256", "'m' as manifest_found_sha256", "record_count", "'x' as id_set_sha256")
    return gates.sync_verdicts(published(spark, sf_dir), counts, receipts, facts)


RELEASE_FAULTS = ["manifest", "file map", "file map", "schema version", "commit", "record count", "hashes", "files", "sources", "sources", "generated at", "manifest hash", "file list"]


@query("SELECT c_custkey, CASE c_custkey % 16 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(RELEASE_FAULTS)) + " END AS fault FROM customer")
def release_faults(spark, sf_dir):
    sha = "sha2(c_name, 256)"
    snap = lambda k, name: f"named_struct('sha256', if(k = {k}, 'x', {sha}), 'bytes', 1L, 'filename', '{name}')"
    entry = "named_struct('year', if(k = 1, concat('y', y), cast(y as string)), 'file', concat('commitments-', if(k = 2, 2001, y), '.json'))"
    rows = table(spark, sf_dir, "customer").withColumn("k", F.expr("c_custkey % 16")).selectExpr(
        "c_custkey", "if(k = 3, 2, 1) as schema_version", f"upper(substr({sha}, 1, if(k = 4, 39, 40))) as commit", "if(k = 5, -1L, c_custkey) as record_count", f"if(k = 6, 'x', {sha}) as manifest_sha256", f"upper({sha}) as id_set_sha256",
        f"transform(sequence(2001, 2003), y -> named_struct('name', concat('commitments-', y, '.json'), 'bytes', if(k = 7, -5L, 5L), 'rows', 1L, 'sha256', {sha})) as files", "'t' as generated_at", "if(k = 0, null, if(k = 10, 'u', 't')) as manifest_generated_at",
        f"named_struct('csvRetrievedAt', if(k = 8, null, 't'), 'subsidy', {snap(9, 'a')}, 'procurement', {snap(99, 'b')}) as sources", f"if(k = 11, 'y', {sha}) as manifest_found_sha256", f"transform(sequence(2003, if(k = 12, 2002, 2001)), y -> {entry}) as manifest_entries",
    )
    return rows.withColumn("fault", gates.first_fault(gates.release_rules())).select("c_custkey", "fault")


ANSWER_FAULTS = ["form of a row", "repeated id", "commit", "generated at", "page size", "totals", "page", "rows", "agencies"]


@query("SELECT event_id, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(ANSWER_FAULTS)) + " END AS fault FROM events")
def response_faults(spark, sf_dir):
    row = "named_struct('id', if(k = 1, 'same', concat('r', i)), 'organization', if(k = 0, '', '社'), 'corporateNumber', '1234567890123', 'sourceAgency', 'NEDO', 'program', '', 'stage', 'contracted', 'sourceKey', 'k', 'sourceRowNumber', i, 'sourceSystem', 's')"
    rows = table(spark, sf_dir, "events").withColumn("k", F.expr("event_id % 11")).selectExpr(
        "event_id", f"transform(sequence(1L, if(k = 7, 101L, 2L)), i -> {row}) as rows", "'a' as release_commit", "if(k = 2, 'b', 'a') as commit", "'t' as release_generated_at", "if(k = 3, null, 't') as generated_at", "if(k = 4, 99, 100) as page_size",
        "event_id as asked", "if(k = 6, event_id + 1, event_id) as page", "event_id as total", "if(k = 5, 0, 1) as pages", "if(k = 8, array('a', null), array('a')) as agencies",
    )
    return rows.withColumn("fault", gates.first_fault(gates.answer_rules())).select("event_id", "fault")


@query("SELECT count(*) AS n, count_if(o_orderstatus = 'F') AS subsidy, count_if(o_orderstatus = 'O') AS procurement FROM orders")
def stage_totals(spark, sf_dir):
    return gates.stage_counts(table(spark, sf_dir, "orders").select(F.expr("case o_orderstatus when 'F' then 'subsidy_published' when 'O' then 'contracted' end").alias("stage")))


@query("SELECT page_id, coalesce(starts_with(url, 'https://'), false) AS https FROM pages")
def https_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(gates.https(F.col("url")), F.lit(False)).alias("https"))


@query("""SELECT c_custkey AS id, c_name AS organization, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 100) AS BIGINT) AS pages FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name < 'NATION_2'
  ORDER BY CASE WHEN c_mktsegment <> 'BUILDING' THEN 2000 + c_nationkey END DESC NULLS LAST, c_name, c_custkey LIMIT 100 OFFSET CASE WHEN (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name < 'NATION_2') > 100 THEN 100 ELSE 0 END""")
def search_second_page(spark, sf_dir):
    rows = searchable(spark, sf_dir).where("sourceAgency < 'NATION_2'")
    n = rows.count()
    found, total, pages = search.result(rows, search.criteria({"page": "2" if n > 100 else "1"}), total=n)
    return found.select("id", "organization", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


@query("""SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' ORDER BY CASE WHEN c_mktsegment <> 'BUILDING' THEN 2000 + c_nationkey END DESC NULLS LAST, c_name, c_custkey LIMIT 100""")
def search_agency(spark, sf_dir):
    rows = searchable(spark, sf_dir)
    known = [r["sourceAgency"] for r in search.agencies(rows).collect()]  # the names of publishers
    return search.result(rows, search.criteria({"agency": "NATION_3 "}), known)[0].select("id")


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS today FROM events")
def tokyo_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", summaries.today_in_tokyo(F.col("ts").cast("timestamp")).alias("today"))


@query("""SELECT c_custkey, 'https://example.org/s' || CASE WHEN c_nationkey = 1 AND c_mktsegment = 'BUILDING' THEN '' ELSE '?' || concat_ws('&', CASE WHEN c_nationkey <> 1 THEN 'page=' || c_nationkey END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'keyword=a+' || c_mktsegment END) END AS url,
  'https://example.org/r/a~b!c''d(e)%20' || c_custkey AS record FROM customer""")
def query_urls(spark, sf_dir):
    keyword = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("a "), "c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.query_url("https://example.org/s", {"page": F.col("c_nationkey").cast("string"), "keyword": keyword}, {"page": "1"}).alias("url"),
        S.component_url("https://example.org/r/", F.concat(F.lit("a~b!c'd(e) "), F.col("c_custkey").cast("string"))).alias("record"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderkey END AS n FROM orders")
def counts_with_zeros(spark, sf_dir):
    text = F.expr("case left(o_orderpriority, 1) when '1' then concat('00', o_orderkey) when '2' then format_number(o_orderkey, 0) when '4' then concat(o_orderkey, ',1') else cast(o_orderkey as string) end")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_count(text, leading_zeros=True).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS subsidies, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS BIGINT) END AS procurements FROM customer")
def plain_dashboards(spark, sf_dir):
    html = F.expr("concat('<tr><td>省</td><td>', c_custkey + c_nationkey + 2, '</td><td>', c_custkey, '</td><td>', c_nationkey, '</td><td>', if(c_custkey % 3 = 0, 1, 2), '</td></tr>')")
    return files.dashboard_counts(table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "html", "省").drop("html")


@query("SELECT o_orderkey, sha256('[\"a\\u001fb\\u007f' || o_orderstatus || '\\u000c\\\\u001F\"]') AS hash FROM orders".replace("\\u007f", chr(127)).replace("\\u000c", "\\f"))
def escaped_hash(spark, sf_dir):
    text = F.concat(F.lit("a\x1fb\x7f"), "o_orderstatus", F.lit("\f\\u001F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.hash_of_json(S.json_array([(text, False)])).alias("hash"))


SNAPSHOTS = {"csvRetrievedAt": "2026-01-02T00:00:00Z"} | {kind: {"sha256": "0" * 64, "bytes": 1, "filename": f"{kind}.csv"} for kind in R.STAGES}


def published_site(spark, sf_dir, keyless: bool = False) -> str:
    """The bulk rows of orders, imported and published, those without a key only with `keyless`; the folder of the version."""
    records = imported(spark, sf_dir).records.where(F.lit(keyless) | (F.col("sourceKey") != "")).withColumn("sourceSystem", F.lit("s"))
    return site.publish(records, scratch(spark, "site"), "one", "2026-01-02T03:04:05Z", "a" * 40, SNAPSHOTS, keyless)


@query(f"SELECT {IMPORTED_ID} AS id, date_ AS date, amount_ AS amount, CASE WHEN amount_ IS NULL THEN amount_raw END AS \"amountRaw\", key AS \"sourceKey\" FROM {RECORD} WHERE canonical IS NOT NULL")
def published_rows(spark, sf_dir):
    return site.read_years(spark, published_site(spark, sf_dir, keyless=True)).rows.select("id", "date", "amount", "amountRaw", "sourceKey")


@query(f"SELECT 'commitments-' || coalesce(CAST(fy AS VARCHAR), 'unclassified') || '.json' AS file, count(*) AS n_rows, true AS listed FROM {RECORD} WHERE canonical IS NOT NULL AND key <> '' GROUP BY 1")
def verified_files(spark, sf_dir):
    path = published_site(spark, sf_dir)
    read, receipts, facts = site.sync_facts(spark, path, "a" * 40)
    gates.refuse(gates.sync_verdicts(read.rows, read.files, receipts, facts))
    manifest = site.client_view(spark, path).select(F.inline("manifest_entries")).select("file", F.lit(True).alias("listed"))
    return read.rows.groupBy("file").agg(F.count("*").alias("n_rows")).join(manifest, "file", "left").select("file", "n_rows", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) + 1 AS n, CASE WHEN o_orderpriority = '5-LOW' THEN 'a,\"b\"' || chr(10) || 'c' ELSE o_orderpriority END AS cell FROM orders")
def bulk_csv_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", 'a,"b"\nc').otherwise(F.col("o_orderpriority")).alias("cell"))
    path = scratch(spark, "evidence")
    rows.write.options(header=True, compression="gzip", escape='"').csv(f"{path}/csv")
    files.write_evidence(spark, {"subsidy": f"{path}/csv"}, spark.range(1), {}, f"{path}/audit")  # bytes for bytes, so it reads as the files themselves
    return files.read_bulk_csv(spark, f"{path}/audit/subsidy", parts=True).selectExpr("cast(id as long) as id", "cast(sourceRowNumber as long) as n", "cell")


@query("""SELECT CAST(sum(e) AS BIGINT) AS eligible, CAST(sum(i) AS BIGINT) AS imported, CAST(sum(e) - sum(i) AS BIGINT) AS gap, CAST(sum(n) AS BIGINT) AS dashboard, CAST(sum(n) - sum(e) AS BIGINT) AS difference, CASE WHEN sum(n) = sum(e) THEN 'matched' ELSE 'different' END AS status
  FROM (SELECT count_if(o_totalprice > 20000) AS e, count_if(o_totalprice > 10000) AS i, count(*) AS n FROM orders GROUP BY o_orderstatus)""")
def import_totals(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.expr("count_if(o_totalprice > 20000)").alias("eligible"), F.expr("count_if(o_totalprice > 10000)").alias("imported"), F.count("*").alias("dashboard"))
    return continuity.import_totals(counts)


CONTINUITY = """SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS position, unnest(['the previous snapshot is empty', 'keys of the previous snapshot are blank or repeated', 'keys of the candidate snapshot are blank or repeated', 'an identity field of a record changed',
  'keys are missing', 'an identity field of a row changed', 'corrections beyond the limit']) AS rule, unnest([0, 0, CAST(count_if(o_orderkey % 10 = 7) AS BIGINT), count_if(o_orderkey % 10 IN (2, 7)), count_if(o_orderkey % 10 IN (1, 7)), count_if(o_orderkey % 10 = 2),
  greatest(count_if(o_orderkey % 10 IN (2, 3)) - greatest(1, least(100, CAST(ceil(count(*) * 2 / 1000) AS BIGINT))), 0)]) AS failures FROM orders"""


@query(CONTINUITY)
def continuity_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 10 as k", "cast(o_orderkey as string) as id", "'contracted' as stage", "cast(o_orderkey as string) as sourceKey", "'1' as corporateNumber", "'IPA' as publisherCanonical", "o_totalprice as amount")
    new = rows.where("k != 1").withColumns({"corporateNumber": F.expr("if(k = 2, '2', '1')"), "amount": F.expr("if(k = 3, amount + 1, amount)"), "sourceKey": F.expr("if(k = 7, ' ', sourceKey)")})
    counts = continuity.continuity_counts(rows.drop("k"), new.drop("k"), ["stage", "sourceKey"], ["corporateNumber", "publisherCanonical", "amount"])
    return continuity.continuity_verdicts(counts, allow_corrections=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS amount FROM orders")
def radix_amounts(spark, sf_dir):
    text = F.expr("case o_orderkey % 4 when 0 then concat('0x', lower(hex(o_orderkey)), '円') when 1 then concat('0B', bin(o_orderkey)) when 2 then concat('0o', conv(o_orderkey, 10, 8)) else concat('-0x', hex(o_orderkey)) end")
    return S.with_amount(table(spark, sf_dir, "orders").select("o_orderkey", S.clean_cell(text).alias("clean")), "amount", F.col("clean")).drop("clean")


def indexed(spark, sf_dir, block: int) -> index.Index:
    """The search index of the customers."""
    path = scratch(spark, "index")
    return index.read(spark, path, index.build(searchable(spark, sf_dir).withColumn("fiscalYear", F.col("fiscalYear").cast("int")), path, block))


RANKED = """(SELECT c_custkey AS id, c_name AS organization, lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS number, n_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(2000 + c_nationkey AS INT) END AS "fiscalYear", c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SEARCH_ORDER = 'ORDER BY "fiscalYear" DESC NULLS LAST, organization, id'


@query(f'SELECT id, organization, "fiscalYear", row_number() OVER ({SEARCH_ORDER}) - 1 AS rank FROM {RANKED}')
def search_index(spark, sf_dir):
    return indexed(spark, sf_dir, 1000).rows.select("id", "organization", "fiscalYear", "rank")


@query(f"SELECT id, organization, (SELECT count(*) FROM {RANKED} WHERE segment <> 'HOUSEHOLD') AS total FROM {RANKED} WHERE segment <> 'HOUSEHOLD' {SEARCH_ORDER} LIMIT 100 OFFSET (SELECT (count(*) - 1) // 100 * 100 FROM {RANKED} WHERE segment <> 'HOUSEHOLD')")
def search_last_page(spark, sf_dir):
    made = indexed(spark, sf_dir, 400)
    n = index.matching(made, search.criteria({"stage": "subsidy_published"})).count()
    rows, total, _ = index.page(made, search.criteria({"stage": "subsidy_published", "page": str(-(-n // 100))}))
    return rows.select("id", "organization", F.lit(total).cast("long").alias("total"))


@query(f"SELECT id, organization FROM {RANKED} WHERE contains(lower(organization || ' ' || number), '7 00') AND segment <> 'HOUSEHOLD' {SEARCH_ORDER} LIMIT 100")
def search_keyword(spark, sf_dir):
    return index.page(indexed(spark, sf_dir, 400), search.criteria({"q": "7 00", "stage": "subsidy_published"}))[0].select("id", "organization")


@query("SELECT (SELECT count(*) FROM orders) AS n_records, max(o_orderdate) AS newest FROM orders")
def dataset_files(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), scratch(spark, "dataset")
    files.write_dataset(orders, orders.agg(F.max("o_orderdate").alias("newest")), path)
    n = spark.read.schema(orders.schema).json(f"{path}/records").agg(F.count("*").alias("n_records"))
    return n.crossJoin(spark.read.schema(orders.select(F.col("o_orderdate").alias("newest")).schema).json(f"{path}/summary"))  # one row with one row


def _windows_sql(seconds: int, limit: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS opened FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1
  UNION ALL SELECT e.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL {seconds} SECOND GROUP BY 1)
  SELECT e.user_id, e.event_id, opened, row_number() OVER (PARTITION BY e.user_id, opened ORDER BY e.ts, e.event_id) AS position, row_number() OVER (PARTITION BY e.user_id, opened ORDER BY e.ts, e.event_id) <= {limit} AS accepted
  FROM events e JOIN w ON w.user_id = e.user_id AND e.ts >= opened AND e.ts < opened + INTERVAL {seconds} SECOND"""


@query(_windows_sql(60, 30))
def request_windows(spark, sf_dir):
    return throttle.anchored_windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query(_windows_sql(86_400, 2))
def day_windows(spark, sf_dir):
    return throttle.anchored_windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400, 2)


@query("""SELECT 'custkey and status' AS rule, CAST(sum(n - 1) AS BIGINT) AS failures FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) UNION ALL
  SELECT 'key', CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) FROM orders UNION ALL SELECT 'priority', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY nullif(o_orderpriority, '5-LOW'))""")
def repeated_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("priority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return gates.repeated_by_rule(rows, {"custkey and status": ["o_custkey", "o_orderstatus"], "key": ["o_orderkey"], "priority": ["priority"]})
