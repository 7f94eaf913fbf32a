import gzip
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import registry as R
from ledgerlark.functions import scalars as S
from ledgerlark.operators import continuity, gates, index, normalize, search, summaries
from ledgerlark.sources import files, site, snapshots


def number(body):
    return f"{9 - sum(int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(body)) % 9}{body}"


A, B = number("000012050002"), number("123456789012")
HEAD = "法人番号,商号または名称,証明日,名称,金額,発行元,キー情報,対象\n"


@pytest.fixture(scope="module")
def subsidy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "subsidy.csv"
    path.write_text(HEAD + f'{A},甲社,,,0,経済産業省,k1,\n{A},乙社,2026/04/02,"計,画","-6,528,000",経済産業省関東経済産業局,k2,x\n{A},丙社,,,1,どこか省,k3,\n9{A[1:] if A[0] != "9" else A[1:]},丁社,,,1,IPA,k4,\n{B},戊社,,,1,経済産業省別室,k5,\n{B},,,,1,IPA,k6,\n')
    return files.read_bulk_csv(spark, str(path))


@pytest.fixture(scope="module")
def imported(subsidy, tmp_path_factory):
    return normalize.import_kind(subsidy, "subsidy", str(tmp_path_factory.mktemp("import") / "subsidy"))


def test_import(imported):
    records, stats, unmatched = imported.records, imported.statistics, imported.unmatched
    rows = {r.sourceKey: r for r in records.collect()}
    assert set(rows) == {"k1", "k2"} or A[0] == "9"
    assert (rows["k1"].amount, rows["k1"].date, rows["k1"].fiscalYear, rows["k1"].program) == (0, None, None, "")
    assert (rows["k2"].amount, rows["k2"].date, rows["k2"].fiscalYear, rows["k2"].publisherCanonical) == (-6528000, "2026-04-02", 2026, "関東経済産業局")
    assert rows["k1"].id.startswith("gbiz-") and len(rows["k1"].sourceRecordHash) == 64
    assert {r["name"]: r.suspicious for r in unmatched.collect()} == {"どこか省": False, "経済産業省別室": True}
    first = stats.first()
    assert (first.total_rows, first.eligible_rows, first.missing_date) == (6, 2, 1)


def test_csv_contract(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(HEAD + "1,2\n")
    with pytest.raises(continuity.GateError):
        files.read_bulk_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "dup.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        files.read_bulk_csv(spark, str(tmp_path / "dup.csv"))
    with pytest.raises(ValueError, match="missing"):
        normalize.check_headers(["法人番号"], "subsidy")


def snapshot(spark, n, **changes):
    fields = ["id", *R.SEMANTIC]
    rows = []
    for i in range(n):
        row = dict.fromkeys(R.SEMANTIC, "v") | {"id": f"i{i}", "sourceKey": f"k{i}", "stage": "contracted", "fiscalYear": 2026, "amount": i}
        rows.append(tuple((row | changes.get(f"k{i}", {}))[f] for f in fields))
    kinds = ", ".join(f"{f} {'bigint' if f in ('amount', 'fiscalYear') else 'string'}" for f in fields)
    return spark.createDataFrame(rows, kinds)


def test_continuity(spark):
    old = snapshot(spark, 50)
    assert continuity.assert_continuity(old, old)["changed_rows"] == 0
    assert continuity.assert_continuity(old, snapshot(spark, 51))["added_rows"] == 1
    one = snapshot(spark, 50, k3={"amount": -1, "program": "w"})
    counts = continuity.assert_continuity(old, one, allow_corrections=True)
    assert (counts["changed_rows"], counts["correction_limit"]) == (1, 1)
    for previous, candidate, allow, message in [
        (old.where("false"), old, False, "empty"), (old, snapshot(spark, 49), True, "missing"), (old, one, False, "changed"),
        (old, snapshot(spark, 50, k3={"corporateNumber": "x"}), True, "identity"), (old, snapshot(spark, 50, k3={"amount": -1}, k4={"amount": -1}), True, "limit"),
        (old, old.union(old), False, "repeated"),
    ]:
        with pytest.raises(continuity.GateError, match=message):
            continuity.assert_continuity(previous, candidate, allow)
    diff = continuity.snapshot_diff(old, one, ["stage", "sourceKey"], ["amount", "program"]).where("status = 'changed'").first()
    assert diff.changedFields == ["amount", "program"]
    limits = spark.createDataFrame([(1000,), (69501,)], "n long").select(continuity.correction_limit(F.col("n")), continuity.growth_limit(F.col("n"))).collect()
    assert sorted(map(tuple, limits)) == [(2, 1000), (100, 3476)]


def test_stored_snapshots_join_without_moving(spark, tmp_path):
    old, new = snapshot(spark, 60), snapshot(spark, 61, k3={"program": "w"})
    ids = lambda df: df.withColumn("id", S.stable_id(F.when(F.col("stage") == "contracted", "procurement"), F.col("sourceKey")))
    old, new = ids(old.withColumn("stage", F.lit("contracted"))), ids(new.withColumn("stage", F.lit("contracted")))
    a, b = snapshots.write(old, f"{tmp_path}/a", 8), snapshots.write(new, f"{tmp_path}/b", 8)
    assert a.count() == 60 and snapshots.read(spark, f"{tmp_path}/a").columns == old.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = continuity.snapshot_diff(a, b, ["stage", "sourceKey"], ["program"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        plan = continuity.snapshot_diff(a, spark.createDataFrame(new.collect(), new.schema), ["stage", "sourceKey"], ["program"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert "Exchange" not in a.groupBy("stage", "sourceKey").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found, want = continuity.assert_continuity(a, b, True), continuity.assert_continuity(old, new, True)
    assert found == want and (found["added_rows"], found["changed_rows"], found["moved_ids"]) == (1, 1, 0)
    moved = b.withColumn("corporateNumber", F.when(F.col("sourceKey") == "k5", "9").otherwise(F.col("corporateNumber")))
    with pytest.raises(continuity.GateError, match="identity field of a record"):
        continuity.assert_continuity(a, moved, True)


def test_search(spark):
    rows = [(f"id{i:03}", "甲社" if i % 2 else "乙社", f"{i:013}", "経済産業省", "contracted", None if i == 7 else 2026, None) for i in range(105)]
    df = spark.createDataFrame(rows, "id string, organization string, corporateNumber string, sourceAgency string, stage string, fiscalYear int, date string")
    page = lambda **p: search.page(df, search.criteria(p))
    assert (page().count(), page(page="2").count()) == (100, 5)
    assert [r.id for r in page(year="unclassified").collect()] == ["id007"]
    assert page(q="社 0000000000001").count() == 1 and page(stage="subsidy_published").count() == 0
    with pytest.raises(ValueError, match="page 3 of 2"):
        page(page="3")
    for bad in ({"stage": "paid"}, {"page": ""}, {"page": "1.5"}, {"year": "26"}, {"q": "😀" * 51}, {"page": "10001"}):
        with pytest.raises(ValueError):
            search.criteria(bad)
    assert search.criteria({"page": "1e1", "agency": " "}) == search.Criteria(page=10)


SNAPSHOTS = {"csvRetrievedAt": "t"} | {k: {"sha256": "0" * 64, "bytes": 1, "filename": k} for k in R.STAGES}


def publish(records, root, version="one"):
    return site.publish(records.withColumn("sourceSystem", F.lit("s")), str(root), version, "2026-01-01T00:00:00Z", "A" * 40, SNAPSHOTS)


def test_files_manifest_receipt_and_pointer(spark, imported, tmp_path):
    path = publish(imported.records, tmp_path / "site")
    names = {p.name: p for p in Path(path).iterdir() if not p.name.startswith(".")}
    assert set(names) == {"commitments-2026.json", "commitments-unclassified.json", "manifest.json", "release.json"}
    manifest, release = (json.loads(names[f].read_text()) for f in ("manifest.json", "release.json"))
    assert manifest["commitments"] == {"2026": "commitments-2026.json", "unclassified": "commitments-unclassified.json"}
    for name, told in release["files"].items():
        raw = names[name].read_bytes()
        assert (told["sha256"], told["bytes"], told["rows"]) == (hashlib.sha256(raw).hexdigest(), len(raw), len(json.loads(raw)))
    [row] = json.loads(names["commitments-unclassified.json"].read_text())
    assert row["date"] is None and row["amount"] == 0 and "amountRaw" not in row
    assert release["manifestSha256"] == hashlib.sha256(names["manifest.json"].read_bytes()).hexdigest() and release["recordCount"] == 2
    assert site.current(spark, f"{tmp_path}/site") == path
    for broken in (imported.records.union(imported.records), imported.records.withColumn("organization", F.lit(""))):
        with pytest.raises(continuity.GateError):
            publish(broken, tmp_path / "site", "two" if broken is None else f"v{hash(broken) % 1000}")
        assert site.current(spark, f"{tmp_path}/site") == path


def test_rows_without_a_key_are_published_where_asked(spark, imported, tmp_path):
    records = imported.records.withColumn("sourceKey", F.when(F.col("sourceKey") != "k2", F.col("sourceKey")).otherwise(""))
    with pytest.raises(continuity.GateError, match="required fields"):
        publish(records, tmp_path / "site")
    path = site.publish(records.withColumn("sourceSystem", F.lit("s")), f"{tmp_path}/site", "two", "2026-01-01T00:00:00Z", "A" * 40, SNAPSHOTS, keyless=True)
    assert sorted(r.sourceKey for r in site.read_years(spark, path).rows.collect())[0] == "" and site.current(spark, f"{tmp_path}/site") == path


def test_a_large_year_is_written_and_read_in_parts(spark, tmp_path):
    """No task holds a whole year: parts of at most 40 rows follow one another as the array that a single file is."""
    blank = [F.lit("x").alias(c) for c in ("organization", "corporateNumber", "sourceAgency", "program", "amountRaw", "stage", "sourceKey", "sourceSystem", "date")]
    records = spark.range(230).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 200, F.lit(None)).otherwise(2000 + F.col("id") % 2).cast("int").alias("fiscalYear"), (F.col("id") % 7).alias("amount"), F.lit(1).alias("sourceRowNumber"), *blank)
    assert site.write_years(records, f"{tmp_path}/parts", 40) == site.write_years(records, f"{tmp_path}/files") == 230
    place, parts = lambda v, key: tmp_path / v / f"commitments-{key}.json", sorted((tmp_path / "parts" / "commitments-unclassified.json").glob("part-*.json"))
    assert [p.read_text().count("\n") for p in parts] == [40] * 5 and b"".join(p.read_bytes() for p in parts) == place("files", "unclassified").read_bytes()
    assert all(place("parts", key).read_bytes() == place("files", key).read_bytes() for key in (2000, 2001))
    ids = [r["id"] for r in json.loads(place("files", "unclassified").read_text())]
    assert ids == sorted((f"r{k}" for k in range(200)), key=lambda x: (-(int(x[1:]) % 7), x))
    read, one = (site.read_years(spark, f"{tmp_path}/{v}") for v in ("parts", "files"))
    assert sorted(map(tuple, read.rows.collect())) == sorted(map(tuple, one.rows.collect())) and read.rows.count() == 230
    found, whole = ({r.file: r for r in x.files.collect()} for x in (read, one))
    big = found["commitments-unclassified.json"]
    assert (big.bytes, big.rows, big.is_array) == (sum(p.stat().st_size for p in parts), 200, True) and big.sha256 == hashlib.sha256("\n".join(hashlib.sha256(p.read_bytes()).hexdigest() for p in parts).encode()).hexdigest()
    assert all(found[f] == whole[f] for f in whole if f != big.file) and (whole[big.file].bytes, whole[big.file].rows) == (big.bytes, 200)
    held, form = parts[1].read_text(), lambda: {r.file: r.is_array for r in site.read_years(spark, f"{tmp_path}/parts").files.collect()}[big.file]
    for bad in ("[" + held[1:], held.rstrip("\n") + "]\n", held[:-3], None):
        (parts[1].parent / f".{parts[1].name}.crc").unlink(missing_ok=True)
        parts[1].unlink() if bad is None else parts[1].write_text(bad)
        assert form() is False


def test_a_release_in_parts_is_verified(spark, imported, tmp_path, monkeypatch):
    monkeypatch.setattr(site.write_years, "__defaults__", (1,))
    records = imported.records.union(imported.records.withColumns({"id": F.concat("id", F.lit("x")), "sourceKey": F.concat("sourceKey", F.lit("x"))}))
    path = publish(records, tmp_path / "site")
    assert len(list((Path(path) / "commitments-2026.json").glob("part-*.json"))) == 2
    read, receipts, facts = site.sync_facts(spark, path, "A" * 40)
    gates.refuse(gates.sync_verdicts(read.rows, read.files, receipts, facts))
    assert sorted((r.file, r["count"]) for r in read.rows.groupBy("file").count().collect()) == [("commitments-2026.json", 2), ("commitments-unclassified.json", 2)]
    part = sorted((Path(path) / "commitments-2026.json").glob("part-*.json"))[1]
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(part.read_text().replace("乙社", "丁社"))
    read, receipts, facts = site.sync_facts(spark, path, "A" * 40)
    with pytest.raises(continuity.GateError, match="bytes of a file"):
        gates.refuse(gates.sync_verdicts(read.rows, read.files, receipts, facts))


def test_sync_uses_what_it_checked(spark, imported, tmp_path):
    path = publish(imported.records, tmp_path / "site")
    done = site.sync(spark, f"{tmp_path}/site", f"{tmp_path}/index", "A" * 40, "now", index.build)
    assert (done["recordCount"], done["agencies"]) == (2, ["経済産業省", "経済産業省関東経済産業局"])
    made = index.read(spark, done["objectKey"], 2)
    assert [r.sourceKey for r in index.page(made, search.criteria({"q": "乙社"}), done["agencies"])[0].collect()] == ["k2"]
    with pytest.raises(continuity.GateError, match="3"):
        index.read(spark, done["objectKey"], 3)
    before = (tmp_path / "index" / "current.json").read_text()
    with pytest.raises(continuity.GateError, match="commit"):
        site.sync(spark, f"{tmp_path}/site", f"{tmp_path}/index", "b" * 40, "now", index.build)
    for name, change, message in (("commitments-2026.json", lambda t: t.replace("乙社", "丁社"), "bytes of a file"), ("manifest.json", lambda t: t + " ", "manifest")):
        file = Path(path) / name
        held = file.read_text()
        (file.parent / f".{name}.crc").unlink(missing_ok=True)
        file.write_text(change(held))
        with pytest.raises(continuity.GateError, match=message):
            site.sync(spark, f"{tmp_path}/site", f"{tmp_path}/index", "A" * 40, "later", index.build)
        file.write_text(held)
    assert (tmp_path / "index" / "current.json").read_text() == before


def test_index_pages_equal_a_full_sort(spark, tmp_path):
    rows = [(f"id{i:04}", f"{'甲乙丙'[i % 3]}株式会社 No.{i % 40}", f"{i:013}", f"省{i % 2}", ("contracted", "subsidy_published")[i % 3 == 0], None if i % 7 == 0 else 2000 + i % 5, None if i % 11 else "2026-01-01") for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, organization string, corporateNumber string, sourceAgency string, stage string, fiscalYear int, date string")
    df.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    made = index.read(spark, f"{tmp_path}/index", index.build(df, f"{tmp_path}/index", 100))
    for params in ({}, {"page": "15"}, {"q": "株式会社 no.3", "page": "2"}, {"q": "丙"}, {"q": "社 "}, {"q": "zzz"}, {"q": "7 0000000000"}, {"year": "unclassified", "page": "3"}, {"agency": "省1", "stage": "contracted", "page": "5"}):
        c = search.criteria(params)
        (want, *counts), (got, *found) = search.result(df, c), index.page(made, c)
        assert counts == found and [r.id for r in want.collect()] == [r.id for r in got.collect()], params
    with pytest.raises(ValueError, match="page 16 of 15"):
        index.page(made, search.criteria({"page": "16"}))


def test_dashboard_contract(spark):
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    good = ["1", "省", "0", "0", "0", "1,234", "56", "0", "0"]
    head = row(files.DASHBOARD_HEADERS, "th")
    swapped = row([*files.DASHBOARD_HEADERS[:5], "調達情報", "補助金情報", *files.DASHBOARD_HEADERS[7:]], "th")
    page = lambda h, body, name="corporateActivityNumbersTable": f"<table id='{name}'><thead>{h}</thead><tbody>{body}</tbody></table>"
    old = lambda *cells: row(["省", *cells])
    html = [page(head, row(good)), page(swapped, row(good)), page(head, row(good) * 2), page(head, row([*good[:5], "", *good[6:]])), page(head, row(good), "renamed"), old(10, "1,234", 5, 1), old(10, 4, 5, 1), old(10, 4, 5, 2), None]
    pages = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    got = [(r.subsidies, r.procurements) for r in files.dashboard_counts(pages, "html", "省").orderBy("i").collect()]
    assert got == [(1234, 56), (None, None), (None, None), (None, 56), (None, None), (None, None), (4, 5), (None, None), (None, None)]


def test_adoption_rules(spark):
    rows = spark.createDataFrame([("a", "01", "p"), ("a", "01", "p"), ("b", "02", "p"), ("c", "01", "q")], "id string, prefecture string, subsidy string")
    assert sorted(map(tuple, search.adoption_violations(rows, "01", "p").collect())) == [("a", "repeated"), ("b", "filter"), ("c", "filter")]
    assert search.adoption_criteria({"page": ["20000"], "keyword": ["😀" * 20], "prefecture": ["47"], "subsidy": ["p"]}, {"p"})["page"] == 20000
    for bad in ({"page": ["0"]}, {"page": ["20001"]}, {"page": ["1", "2"]}, {"keyword": ["😀" * 21]}, {"prefecture": ["48"]}, {"subsidy": ["x"]}):
        with pytest.raises(ValueError):
            search.adoption_criteria(bad, {"p"})


def test_embedded_json(spark):
    text = '{"props":{"pageProps":{"count":"1","total":1,"listView":[{"id":"x","name":" 甲社 ","address":"東京都","subsidy":"s","year":"2025","times":"3","plan":"p"}]}}}'
    pages = spark.createDataFrame([(1, f'<script id="__NEXT_DATA__" type="application/json">{text}</script>'), (2, "<html></html>"), (3, None)], "page int, html string")
    [row] = files.adoption_rows(pages, "html").collect()
    assert (row.page, row.total, row.id, row.name, row.prefecture, row.round) == (1, 1, "x", "甲社", "東京都", "3")


def test_search_refuses_numbers_and_unknown_agencies(spark):
    for page in ("1_0", "١", "inf", "nan", "1e400", "0x1", "-1"):
        with pytest.raises(ValueError, match="page"):
            search.criteria({"page": page})
    df = spark.createDataFrame([("a", "社", "1", "経済産業省", "contracted", 2026, None)], "id string, organization string, corporateNumber string, sourceAgency string, stage string, fiscalYear int, date string")
    with pytest.raises(ValueError, match="agency"):
        search.result(df, search.criteria({"agency": "他"}))
    assert search.result(df, search.criteria({"agency": "経済産業省"}))[1:] == (1, 1)


def test_evidence_and_dataset_are_written(spark, subsidy, tmp_path):
    raw = 'a,b\r\n"x\r\ny",2\n日本,"q""q"\n'.encode() * 50
    (tmp_path / "raw.csv").write_bytes(raw)
    files.write_evidence(spark, {"subsidy": f"{tmp_path}/raw.csv"}, spark.range(1), {"n": 1}, f"{tmp_path}/audit")
    assert b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "audit" / "subsidy").glob("part-*.gz"))) == raw
    assert site.source_receipt(spark, f"{tmp_path}/raw.csv") == {"sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw), "filename": "raw.csv"}
    one = spark.createDataFrame([(1, "m")], "n int, message string")
    files.write_dataset(subsidy, one, f"{tmp_path}/data")
    assert spark.read.json(f"{tmp_path}/data/summary").first().message == "m"


def test_gates_refuse_the_first_rule(spark):
    counts = spark.createDataFrame([("subsidy", 3, 3, 0), ("procurement", 2, 1, 4)], "kind string, eligible long, imported long, other_stage long")
    with pytest.raises(continuity.GateError, match="imported rows differ"):
        gates.refuse(gates.import_gate(counts))
    gates.refuse(gates.import_gate(counts.where("kind = 'subsidy'")))
    with pytest.raises(continuity.GateError, match="nothing is eligible"):
        gates.refuse(gates.import_gate(counts.where("false")))
    assert gates.banned_fields(["id", "route", "flowDepth"]) == ["route", "flowDepth"]


def test_rule_hash_of_the_publishers(spark):
    found = summaries.pairs_hash(normalize.aliases(spark), "alias_name", "canonical", number=False).first().sha256
    assert found.startswith("eb670af0") and spark.range(1).select(gates.rules_hash()).first()[0] == found
