"""Quality gates as verdict rows: each rule in order with the number of rows that break it.

A gate is one aggregation over the rows it judges. `refuse` raises on the first rule that fails, which is all
that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from .continuity import GateError, growth_limit

Rules = list[tuple[str, Column]]


def verdicts(rows: DataFrame, rules: Rules, by: tuple[str, ...] = ()) -> DataFrame:
    """by, position, rule and failures: how many rows make the rule's condition true; an unknown one counts as broken."""
    counts = rows.groupBy(*by).agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(f"n{k}") for k, (_, bad) in enumerate(rules)])
    listed = [F.struct(F.lit(k + 1).alias("position"), F.lit(name).alias("rule"), F.col(f"n{k}").alias("failures")) for k, (name, _) in enumerate(rules)]
    return counts.select(*by, F.inline(F.array(*listed)))


def first_fault(rules: Rules) -> Column:
    """Name of the first rule whose condition is true or unknown; null where all hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules])


def refuse(found: DataFrame) -> None:
    """Raise GateError for the first rule of `found` that has failures."""
    for r in found.where("failures > 0").orderBy("position").limit(1).collect():
        raise GateError(f"{r['rule']}: {r['failures']}")


def repeated_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row, `failures`: rows beyond the first of their key."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("failures"))


def repeated_by_rule(rows: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(rule, failures): rows beyond the first of their key, for several keys at once from one shuffle of (rule, 128-bit hash of the key)."""
    names = {rule: k for k, rule in enumerate(keys)}
    listed = [F.struct(F.lit(names[rule]).alias("rule"), F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("key")) for rule, columns in keys.items()]
    per_key = rows.select(F.inline(F.array(*listed))).groupBy("rule", "key").agg((F.count("*") - 1).alias("more"))
    sums = per_key.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("rule") == k, F.col("more"))), F.lit(0)).alias(f"n{k}") for k in names.values()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"n{k}").alias("failures")) for rule, k in names.items()])))


def blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


# Imports.


def import_gate(counts: DataFrame) -> DataFrame:
    """Verdicts on rows of (kind, eligible, imported, other_stage): something was eligible, all of it was imported, each kind has its own stage."""
    total = counts.agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"), F.count_if(~F.col("eligible").eqNullSafe(F.col("imported"))).alias("n_gap"), F.coalesce(F.sum("other_stage"), F.lit(0)).alias("n_stage"))
    rules = [("nothing is eligible", (F.col("eligible") == 0).cast("long")), ("imported rows differ from eligible ones", F.col("n_gap")), ("rows of another stage", F.col("n_stage"))]
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(name).alias("rule"), n.alias("failures")) for k, (name, n) in enumerate(rules, 1)])))


# Snapshots.

COUNTERS = ["total_subsidy", "total_procurement", "eligible_subsidy", "eligible_procurement"]
BASELINE = ["record_count", *COUNTERS, "bytes_subsidy", "bytes_procurement", "dashboard_subsidy", "dashboard_procurement", "gap_subsidy", "gap_procurement"]


SNAPSHOT = ", ".join(f"{f} long" for f in ["missing_key_rows", "suspicious_rows", *COUNTERS, "bytes_subsidy", "bytes_procurement"])


def whole(c: Column) -> Column:
    """Whether a long is there and exact as a double."""
    return c.isNotNull() & (F.abs(c) <= S.SAFE)


def snapshot_rules() -> Rules:
    """Conditions that break the continuity of a snapshot, in order, over structs `previous`, `current` and `dashboard`."""
    p, c = (lambda f: F.col(f"previous.{f}")), (lambda f: F.col(f"current.{f}"))
    unknown = F.lit(False)
    for f in BASELINE:
        unknown = unknown | ~whole(p(f))
    rules = [
        ("rows without a key", c("missing_key_rows") != 0), ("suspicious publishers", c("suspicious_rows") != 0), ("no baseline", p("imported_at").isNull() | unknown),
        ("no dashboard counts", ~(whole(F.col("dashboard.subsidy")) & whole(F.col("dashboard.procurement")))),
    ]
    for f in COUNTERS:
        limit = growth_limit(p(f))
        rules += [(f"{f} is unknown", ~whole(c(f))), (f"{f} decreased", c(f) < p(f)), (f"{f} grew too much", c(f) - p(f) > limit)]
    rules += [(f"bytes_{k} is not positive", ~(whole(c(f"bytes_{k}")) & (c(f"bytes_{k}") > 0))) for k in R.STAGES]
    for k in R.STAGES:
        gap = F.col(f"dashboard.{k}") - c(f"eligible_{k}")
        rules += [(f"{k}: more eligible rows than the dashboard counts", gap < 0), (f"{k}: the gap to the dashboard grew", gap > p(f"gap_{k}"))]
    return rules


def snapshot_continuity(snapshots: DataFrame) -> DataFrame:
    """`snapshots` with `fault`: the first rule that a snapshot breaks, null where it may replace the previous one."""
    return snapshots.withColumn("fault", first_fault(snapshot_rules()))


# Records.


def canonical_publisher(name: Column) -> Column:
    """The canonical name of a known publisher, by exact match; else null."""
    pairs = [F.lit(x) for pair in sorted(R.ALIASES.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def coherent_date(date: Column, year: Column) -> Column:
    """Whether there is neither a date nor a year, or an ISO date and the fiscal year it falls in."""
    return (date.isNull() & year.isNull()) | F.coalesce(S.is_iso_date(date) & (S.fiscal_year(date.try_cast("date")) == year), F.lit(False))


def record_rules() -> Rules:
    """Conditions that make a record invalid, in order, over the records with their own hash in `hash__`."""
    c = F.col
    return [
        ("corporate number", ~S.valid_corporate_number(c("corporateNumber"))), ("no key", blank("sourceKey")), ("hash", ~blank("sourceRecordHash") & (c("sourceRecordHash") != c("hash__"))),
        ("publisher", ~canonical_publisher(c("sourceAgency")).eqNullSafe(c("publisherCanonical"))), ("amount", c("amount").isNotNull() & (F.abs("amount") > S.SAFE)),
        ("date or fiscal year", ~coherent_date(c("date"), c("fiscalYear"))), ("stage", ~F.coalesce(c("stage").isin(*R.STAGES.values()), F.lit(False))),
        ("address of the source", ~F.coalesce(https(c("sourceUrl")), F.lit(False))),
    ]


def record_verdicts(records: DataFrame) -> DataFrame:
    """Verdicts on every record, one pass; hashes are made once, in columns before the rules."""
    hashed = S.with_semantic_hash(records, "hash__", [(F.col(name), name in ("fiscalYear", "amount")) for name in R.SEMANTIC])
    return verdicts(hashed, record_rules())


def https(c: Column) -> Column:
    return c.startswith("https://")


def banned_fields(columns: list[str]) -> list[str]:
    """Fields of money routes, which no published row may have."""
    return [c for c in columns if c in R.ROUTE_FIELDS]


def source_rules(rules_sha256: Column) -> Rules:
    """Conditions under which a source's metadata contradict its records, over `sources` (how many there are), `source` and the counts `records`.

    Metadata that is not there is not judged, but for the source itself: without exactly one, nothing holds.
    """
    s, n = (lambda f: F.col(f"source.{f}")), (lambda f: F.col(f"records.{f}"))
    csv, board = s("eligible").isNotNull(), s("dashboard").isNotNull() & s("eligible").isNotNull()
    differs = lambda a, b: ~a.eqNullSafe(b)
    by_kind = F.lit(False)
    for kind in R.STAGES:
        by_kind = by_kind | differs(s(f"difference_{kind}"), s(f"dashboard_{kind}") - s(f"eligible_{kind}"))
    return [
        ("source", F.col("sources") != 1), ("record count", differs(s("record_count"), n("n"))), ("publisher rules", (F.coalesce(s("rules_sha256"), F.lit("")) != "") & differs(s("rules_sha256"), rules_sha256)),
        ("import counts", csv & (differs(s("imported"), s("record_count")) | differs(s("gap"), s("eligible") - s("imported")) | differs(s("gap"), F.lit(0)))),
        ("import counts by kind", csv & (differs(s("imported_subsidy"), n("subsidy")) | differs(s("eligible_subsidy"), n("subsidy")) | differs(s("imported_procurement"), n("procurement")) | differs(s("eligible_procurement"), n("procurement")))),
        ("dashboard differences", board & (differs(s("dashboard"), s("dashboard_subsidy") + s("dashboard_procurement")) | differs(s("difference"), s("dashboard") - s("eligible")) | by_kind)),
    ]


#: What the metadata of a source may say; what it doesn't say is null.
SOURCE = ["record_count", "eligible", "imported", "gap", "dashboard", "difference", *[f"{x}_{k}" for k in R.STAGES for x in ("imported", "eligible", "dashboard", "difference")]]


def stage_counts(records: DataFrame) -> DataFrame:
    """One row: records, and records of each kind's stage."""
    return records.agg(F.count("*").alias("n"), *[F.count_if(F.col("stage") == stage).alias(kind) for kind, stage in R.STAGES.items()])


def rules_hash() -> Column:
    """Hash of the publisher table: the JSON of its pairs, in Japanese order of the names as published; 27 pairs."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in R.ALIASES.items()])
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(F.collate(p["a"], "ja").alias("order"), p["a"].alias("a"), p["b"].alias("b"))))
    return F.sha2(F.to_json(F.transform(ordered, lambda p: F.array(p["a"], p["b"]))), 256)


def validate(records: DataFrame, source: DataFrame) -> DataFrame:
    """Verdicts on a whole snapshot: unique ids, no route fields, every record, then the metadata of its source.

    `source` has one row; columns of SOURCE and rules_sha256 that it lacks are unknown. With none or several rows the rule `source` fails.
    """
    spark = records.sparkSession
    head = repeated_rows(records, ["id"]).select(F.lit(1).alias("position"), F.lit("repeated id").alias("rule"), "failures")
    fields = spark.range(1).select(F.lit(2).alias("position"), F.lit("route fields").alias("rule"), F.lit(len(banned_fields(records.columns))).cast("long").alias("failures"))
    rows = record_verdicts(records).withColumn("position", F.col("position") + 2)
    known = [F.col(c).cast("long").alias(c) if c in source.columns else F.lit(None).cast("long").alias(c) for c in SOURCE]
    known.append((F.col("rules_sha256") if "rules_sha256" in source.columns else F.lit(None)).cast("string").alias("rules_sha256"))
    one = source.select(F.struct(*known).alias("source")).agg(F.count("*").alias("sources"), F.first("source").alias("source"))  # a row even without any source
    both = one.join(stage_counts(records).select(F.struct("*").alias("records")), how="cross")  # one row with one row
    meta = verdicts(both, source_rules(rules_hash())).withColumn("position", F.col("position") + 2 + len(record_rules()))
    return head.unionByName(fields).unionByName(rows).unionByName(meta)


# Records of older snapshots.


def is_member(ingest: str = R.INGEST) -> Column:
    """Whether a stored record belongs to the bulk source: by its mark or by its id."""
    return F.col("ingestSource").eqNullSafe(F.lit(ingest)) | F.coalesce(F.col("id").cast("string").startswith("gbiz-"), F.lit(False))


def rederived(old: DataFrame, ingest: str = R.INGEST) -> DataFrame:
    """Members among old records in today's form: no route fields, dates and amounts only where they are valid, blanks instead of nulls."""
    c = F.col
    rows = old.where(is_member(ingest)).drop(*R.ROUTE_FIELDS)
    date = F.when(S.is_iso_date(c("date")), c("date"))
    amount = F.when(F.abs("amount") <= S.SAFE, c("amount"))
    rows = rows.withColumns({"dateRaw": F.coalesce("dateRaw", date, F.lit("")), "amountRaw": F.coalesce("amountRaw", amount.cast("string"), F.lit("")), "publisherCanonical": F.coalesce(F.when(~blank("publisherCanonical"), c("publisherCanonical")), canonical_publisher(c("sourceAgency")), F.lit(""))})
    rows = rows.withColumns({"date": date, "amount": amount, "ingestSource": F.lit(ingest)} | {f: F.coalesce(c(f), F.lit("")) for f in ("program", "sourceAgency", "sourceKey")})
    return rows.withColumn("fiscalYear", S.fiscal_year(F.try_to_date("date", "yyyy-MM-dd")))


# Public rows, releases and answers.

NUMBER_13 = "^[0-9]{13}$"


def public_rules(ingest: str | None = R.INGEST, keyless: bool = False) -> Rules:
    """Conditions that keep a row out of a public file; `file_year` is the year of the file it stands in. Without `ingest` the rows are public ones already; with `keyless` a key may be blank."""
    c = F.col
    rules = [("another source", ~c("ingestSource").eqNullSafe(F.lit(ingest)))] if ingest else []
    if ingest:
        rules.append(("file of another year", ~F.coalesce(c("fiscalYear").cast("string"), F.lit("unclassified")).eqNullSafe(c("file_year"))))
    required = blank("id") | blank("organization") | blank("sourceAgency") | (c("sourceKey").isNull() if keyless else blank("sourceKey")) | blank("sourceSystem") | c("program").isNull()
    return rules + [
        ("required fields", required), ("corporate number", ~F.coalesce(c("corporateNumber").rlike(NUMBER_13), F.lit(False))), ("stage", ~F.coalesce(c("stage").isin(*R.STAGES.values()), F.lit(False))),
        ("row number", ~(whole(c("sourceRowNumber")) & (c("sourceRowNumber") >= 1))),
    ]


def sync_rule() -> Column:
    """Whether a published row has what the search index needs; looser than `record_rules`: the check digit is not looked at."""
    c = F.col
    return ~blank("id") & c("organization").isNotNull() & F.coalesce(c("corporateNumber").rlike(NUMBER_13), F.lit(False)) & c("sourceAgency").isNotNull() & F.coalesce(c("stage").isin(*R.STAGES.values()), F.lit(False)) & c("sourceKey").isNotNull()


def file_name_fault(year: Column, file: Column) -> Column:
    """Why an entry of a manifest is refused; null where year and file name agree."""
    return F.when(~F.coalesce(file.rlike(r"^commitments-(?:[0-9]{4}|unclassified)\.json$"), F.lit(False)), "form").when(~F.concat(F.lit("commitments-"), year, F.lit(".json")).eqNullSafe(file), "year")


def sync_verdicts(rows: DataFrame, files: DataFrame, receipts: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts on what was read of a release before it is indexed.

    rows: published rows with `file`; files: (file, bytes, sha256, rows, is_array) as read; receipts: (file, bytes, sha256, rows) of the release;
    facts: one row of commit, expected_commit, manifest_sha256, manifest_found_sha256, record_count and id_set_sha256.
    """
    from ..sources.files import set_hash

    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    told = receipts.select("file", *[F.col(c).alias(f"told_{c}") for c in ("bytes", "sha256", "rows")])
    missing = F.col("told_bytes").isNull()
    per_file = files.join(told, "file", "left").agg(
        F.count_if(missing).alias("r1"), F.count_if(~missing & (differs("bytes", "told_bytes") | differs("sha256", "told_sha256"))).alias("r2"), F.count_if(~missing & (~F.coalesce("is_array", F.lit(False)) | differs("rows", "told_rows"))).alias("r3")
    )
    bad = rows.agg(F.count_if(~sync_rule()).alias("r4"))
    ids = set_hash(rows, [], "id").agg(F.max("rows").alias("found"), F.max("repeated").alias("repeated"), F.max("set_hash").alias("found_set"))
    one = per_file.join(bad, how="cross").join(ids, how="cross").join(facts, how="cross")  # single rows
    whole = differs("record_count", "found") | differs("id_set_sha256", "found_set")
    named = {"commit": differs("commit", "expected_commit").cast("long"), "manifest": differs("manifest_sha256", "manifest_found_sha256").cast("long"), "file without a receipt": F.col("r1"), "bytes of a file": F.col("r2"), "rows of a file": F.col("r3"), "form of a row": F.col("r4"), "repeated id": F.coalesce("repeated", F.lit(0)), "whole release": whole.cast("long")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("rule"), v.alias("failures")) for k, (n, v) in enumerate(named.items(), 1)])))


YEAR_KEY, YEAR_FILE = "^([0-9]{4}|unclassified)$", "^commitments-([0-9]{4}|unclassified)[.]json$"


def release_rules() -> Rules:
    """Conditions under which a client refuses a release, over `site.client_view`: the manifest, the receipt, then what they say of each other.

    manifest_entries is an array of (year, file), files one of (name, bytes, rows, sha256), sources a struct of csvRetrievedAt, subsidy and procurement (sha256, bytes, filename).
    """
    c, hexes = F.col, lambda col, n: F.coalesce(col.rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.lit(False))
    natural = lambda col: whole(col) & (col >= 0)
    entry = lambda e: F.coalesce(e["year"].rlike(YEAR_KEY) & e["file"].rlike(YEAR_FILE), F.lit(False))
    fine = lambda f: F.coalesce(f["name"].rlike(YEAR_FILE), F.lit(False)) & hexes(f["sha256"], 64) & natural(f["bytes"]) & natural(f["rows"])
    named = F.transform("manifest_entries", lambda e: e["file"])
    snapshot = lambda k: hexes(c(f"sources.{k}.sha256"), 64) & whole(c(f"sources.{k}.bytes")) & c(f"sources.{k}.filename").isNotNull()
    return [
        ("manifest", c("manifest_generated_at").isNull() | c("manifest_entries").isNull()), ("file map", (F.size("manifest_entries") == 0) | ~F.forall("manifest_entries", entry) | (F.size(F.array_distinct(named)) != F.size(named))),
        ("schema version", ~c("schema_version").eqNullSafe(F.lit(1))), ("commit", ~hexes(c("commit"), 40)), ("record count", ~natural(c("record_count"))), ("hashes", ~(hexes(c("manifest_sha256"), 64) & hexes(c("id_set_sha256"), 64))),
        ("files", ~F.coalesce(F.forall("files", fine), F.lit(False))), ("sources", ~F.coalesce(c("sources.csvRetrievedAt").isNotNull() & snapshot("subsidy") & snapshot("procurement"), F.lit(False))),
        ("generated at", ~c("generated_at").eqNullSafe(c("manifest_generated_at"))), ("manifest hash", ~c("manifest_sha256").eqNullSafe(c("manifest_found_sha256"))), ("file list", ~F.array_sort(F.transform("files", lambda f: f["name"])).eqNullSafe(F.array_sort(named))),
    ]


def answer_row(r: Column) -> Column:
    """Whether a row of an answer has the public form; r is a struct of the public fields."""
    filled = lambda f: F.coalesce(r[f] != "", F.lit(False))
    out = r["program"].isNotNull() & F.coalesce(r["corporateNumber"].rlike(NUMBER_13), F.lit(False)) & F.coalesce(r["stage"].isin(*R.STAGES.values()), F.lit(False)) & whole(r["sourceRowNumber"]) & (r["sourceRowNumber"] >= 1)
    for f in ("id", "organization", "sourceAgency", "sourceKey", "sourceSystem"):
        out = out & filled(f)
    return F.coalesce(out, F.lit(False))


def answer_rules(page_size: int = R.PAGE_SIZE) -> Rules:
    """Conditions under which a client refuses an answer: its rows, then (commit, generated_at) of it and of the release, the page's size, totals, the page asked for and given, and agencies."""
    c = F.col
    ids = F.transform("rows", lambda r: r["id"])
    return [
        ("form of a row", c("rows").isNull() | ~F.forall("rows", answer_row)), ("repeated id", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("commit", ~c("commit").eqNullSafe(c("release_commit"))), ("generated at", ~c("generated_at").eqNullSafe(c("release_generated_at"))), ("page size", ~c("page_size").eqNullSafe(F.lit(page_size))),
        ("totals", ~F.coalesce((c("total") >= 0) & (c("pages") >= 1), F.lit(False))), ("page", ~c("page").eqNullSafe(c("asked"))), ("rows", ~F.coalesce(F.size("rows") <= page_size, F.lit(False))), ("agencies", ~F.coalesce(F.forall("agencies", lambda a: a.isNotNull()), F.lit(False))),
    ]
