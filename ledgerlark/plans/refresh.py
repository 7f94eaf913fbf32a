"""A refresh from end to end: import both files, judge them against the dashboard and the previous snapshot, publish or keep what was there."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..functions.registry import GateError
from ..operators import continuity, gates, normalize, summaries
from ..sources import files, site, snapshots
from ..sources.storage import hadoop_path, scratch

# The dashboard's rows that count towards the snapshot.
DASHBOARD_LABELS = ["経済産業省 (小計)", "特許庁"]

RECORD = (
    "id string, fiscalYear int, date string, dateRaw string, organization string, corporateNumber string, sourceAgency string, publisherCanonical string, program string, amount long, amountRaw string, stage string, sourceKey string, sourceRowNumber long, "
    "dataQuality string, sourceSystem string, sourceRetrievedAt string, sourceUpdatedAt string, notes string, sourceName string, sourceUrl string, quality string, ingestSource string, sourceRecordHash string"
)
SOURCE = ", ".join(f"{c} long" for c in dict.fromkeys([*gates.SOURCE, *gates.BASELINE])) + ", imported_at string, rules_sha256 string, status string"


@dataclass(frozen=True)
class Outcome:
    published: bool
    message: str
    path: str | None = None


def dashboard(pages: DataFrame, html: str) -> dict[str, int | None]:
    """Subsidies and procurements of the dashboard, one page, all labels together; None where a row breaks its contract."""
    out: dict[str, int | None] = {"subsidy": 0, "procurement": 0}
    for label in DASHBOARD_LABELS:
        row = files.dashboard_counts(pages, html, label).first()
        for kind, found in (("subsidy", row["subsidies"]), ("procurement", row["procurements"])):
            out[kind] = None if found is None or out[kind] is None else out[kind] + found
    return out


def previous(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, source metadata, one row) of the data set that the pointer names: as stored by key, or, where it is older than that, in today's form."""
    path = site.current(spark, f"{root}/data")
    fs, place = hadoop_path(spark, f"{path}/by_key.layout.json")
    records = snapshots.read(spark, f"{path}/by_key") if fs.exists(place) else gates.rederived(spark.read.schema(RECORD).json(f"{path}/records"))
    return records, spark.read.schema(SOURCE).json(f"{path}/summary")


def buckets(rows: int, share: int = 500_000) -> int:
    """A power of two, so that it seldom changes from one snapshot to the next: about `share` rows a bucket, 4 buckets at least."""
    return max(4, 1 << max(0, -(-rows // share) - 1).bit_length())


def accept(spark: SparkSession, records: DataFrame, source: DataFrame, root: str, version: str, generated_at: str, commit: str, receipts: dict) -> str:
    """Write the data set, validate what was written, store it by key for the next run, publish it, then flip the pointers, the site's first."""
    path = f"{root}/data/v={version}"
    names = [x.split()[0] for x in RECORD.split(", ")]
    files.write_dataset(records.select(*names), source, path)
    stored, told = spark.read.schema(RECORD).json(f"{path}/records"), spark.read.schema(SOURCE).json(f"{path}/summary")
    gates.refuse(gates.validate(stored, told))
    snapshots.write(stored, f"{path}/by_key", buckets(stored.count()))
    published = site.publish(stored, f"{root}/site", version, generated_at, commit, receipts)
    site.flip(spark, f"{root}/data/pointer.json", json.dumps({"version": version, "path": path}))
    return published


def refresh(spark: SparkSession, csv: dict[str, str], pages: DataFrame, html: str, root: str, version: str, now: str, commit: str) -> Outcome:
    """One run, in order: import, unique ids, import audit, records against the previous ones, snapshot against the previous one, evidence, validation, publication.

    csv: the file or folder of each kind; `pages` has the dashboard's page in the column `html`. The first rule that fails ends the run: a receipt of the failure
    is written and both pointers stay as they were.
    """
    audit = f"{root}/audit/v={version}"
    try:
        old, source = previous(spark, root)
        both = normalize.union_of({kind: normalize.import_kind(files.read_bulk_csv(spark, csv[kind]), kind, scratch(spark, f"import-{kind}")) for kind in R.STAGES})
        gates.refuse(gates.repeated_by_rule(both.records, {"repeated id": ["id"]}).withColumn("position", F.lit(1)))
        stats = {r["kind"]: r for r in both.statistics.collect()}
        stored = {r["stage"]: r["count"] for r in both.records.groupBy("stage").count().collect()}
        board, bad = dashboard(pages, html), both.unmatched.where("suspicious").agg(F.sum("rows").alias("n")).first()["n"] or 0
        counts = [(k, stats[k]["eligible_rows"], stored.get(stage, 0), 0, board[k]) for k, stage in R.STAGES.items()]
        counted = spark.createDataFrame(counts, "kind string, eligible long, imported long, other_stage long, dashboard long")
        gates.refuse(gates.import_gate(counted))
        changes = continuity.assert_continuity(old, both.records, allow_corrections=True)
        receipts = {k: site.source_receipt(spark, csv[k]) for k in R.STAGES}
        made = measured(stats, receipts, bad)
        total = continuity.import_totals(counted).first()
        judged = source.select(F.struct("*").alias("previous")).join(spark.createDataFrame([json.dumps(made)], "string").select(F.from_json("value", gates.SNAPSHOT).alias("current"), F.from_json(F.lit(json.dumps(board)), "subsidy long, procurement long").alias("dashboard")), how="cross")  # one row with one row
        fault = gates.snapshot_continuity(judged).first()["fault"]
        if fault:
            raise GateError(fault)
        told = made | {"record_count": total["imported"], "imported": total["imported"], "eligible": total["eligible"], "gap": total["gap"], "dashboard": total["dashboard"], "difference": total["difference"], "imported_at": now, "status": "healthy"}
        for k, stage in R.STAGES.items():
            told |= {f"imported_{k}": stored.get(stage, 0), f"dashboard_{k}": board[k], f"difference_{k}": board[k] - stats[k]["eligible_rows"], f"gap_{k}": board[k] - stats[k]["eligible_rows"]}
        row = spark.createDataFrame([json.dumps(told)], "string").select(F.from_json("value", SOURCE).alias("s")).select("s.*").withColumn("rules_sha256", gates.rules_hash())
        lines = continuity.snapshot_diff(old, both.records, ["stage", "sourceKey"], [f for f in R.SEMANTIC if f not in ("stage", "sourceKey")]).where("status = 'changed'").select("stage", "sourceKey", "changedFields")
        files.write_evidence(spark, csv, summaries.evidence(lines, old, both.records, ["stage", "sourceKey"]), made | changes, audit)
        path = accept(spark, both.records, row, root, version, now, commit, {"csvRetrievedAt": now} | receipts)
        return Outcome(True, f"{total['imported']} records", path)
    except GateError as e:
        receipt = summaries.failure_receipt(spark.createDataFrame([(now, str(e))], "failedAt string, message string")).first()
        fs, place = hadoop_path(spark, audit)
        fs.mkdirs(place)
        site.write_text(spark, f"{audit}/failure.json", json.dumps(receipt.asDict(), ensure_ascii=False) + "\n")
        return Outcome(False, str(e))


def measured(stats: dict, receipts: dict, suspicious: int) -> dict:
    """What `gates.snapshot_rules` look at of the new files."""
    out = {"missing_key_rows": sum(s["missing_key"] for s in stats.values()), "suspicious_rows": suspicious}
    for kind, s in stats.items():
        out |= {f"total_{kind}": s["total_rows"], f"eligible_{kind}": s["eligible_rows"], f"bytes_{kind}": receipts[kind]["bytes"]}
    return out
