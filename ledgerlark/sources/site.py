"""The published site: a JSON array of public rows for each year, their manifest, a receipt of all of it, and a pointer.

The rows of all years are sorted by ranges and numbered, and a task writes a bounded number of them. A year of more rows is a folder
under the name of its file, whose parts, one after another, are the array. Readers hash, count and parse a file or a part from one read
of its bytes, and go on with the rows of that read alone: what was checked is what is used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.registry import GateError
from ..operators import gates, index, search
from . import files
from .storage import drop, hadoop_path, scratch

PART_ROWS = 100_000  # rows of a file or part, some tens of megabytes
ROWS = "id string, fiscalYear int, date string, organization string, corporateNumber string, sourceAgency string, program string, amount long, amountRaw string, stage string, sourceKey string, sourceRowNumber long, sourceSystem string"


def json_row() -> Column:
    """JSON of a public row; unknown values are null, but amountRaw is only there where it has a value."""
    text = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return F.when(F.col("amountRaw").isNull(), text([c for c in R.PUBLIC if c != "amountRaw"])).otherwise(text(R.PUBLIC))


def file_of(year_key: Column) -> Column:
    return F.concat(F.lit("commitments-"), year_key, F.lit(".json"))


def part_of(k: int) -> str:
    return f"part-{k:08}.json"


def write_years(records: DataFrame, path: str, most: int = PART_ROWS) -> int:
    """`commitments-<year>.json` below `path`, which must be new, in stored order, a row a line; returns how many rows were written.

    A year of more than `most` rows is a folder of that name with parts of `most` rows. Spark writes a folder for each part, which a
    rename gives its published name.
    """
    spark = records.sparkSession
    rows = files.public_rows(records).withColumn("year_key", files.year_key(F.col("fiscalYear")))
    counts = sorted((r["year_key"], r["count"]) for r in rows.groupBy("year_key").count().collect())  # a row for each year
    starts, slots, names = [], [], []
    for key, n in counts:
        parts = -(-n // most)
        starts.append(starts[-1] + counts[len(starts) - 1][1] if starts else 0)
        slots.append(len(names))
        names += [f"commitments-{key}.json" + (f"/{part_of(k)}" if parts > 1 else "") for k in range(parts)]
    if not counts:
        return 0
    years = spark.createDataFrame([(key, n, start, slot) for (key, n), start, slot in zip(counts, starts, slots)], "year_key string, n__ long, start__ long, slot__ long")
    ranked = index.ranked(rows, [F.col("year_key"), *search.stored_order()], len(names)).join(F.broadcast(years), "year_key").withColumn("at__", F.col("rank") - F.col("start__"))
    framed = F.concat(F.when(F.col("at__") == 0, "[").otherwise(","), json_row(), F.when(F.col("at__") == F.col("n__") - 1, "]").otherwise(""))
    placed = ranked.select((F.col("slot__") + F.floor(F.col("at__") / most)).cast("int").alias("slot"), "rank", framed.alias("value"))
    seen = Observation()
    dealt = placed.observe(seen, F.count(F.lit(1)).alias("n")).repartition(len(names), "slot").sortWithinPartitions("slot", "rank").drop("rank")
    dealt.write.partitionBy("slot").option("maxRecordsPerFile", 0).mode("errorifexists").text(f"{path}/_parts")
    fs, held = hadoop_path(spark, f"{path}/_parts")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(held):
        if folder.isDirectory():
            name = names[int(folder.getPath().getName().partition("=")[2])]
            [part] = [x.getPath() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
            target = path_of(f"{path}/{name}")
            if not (fs.mkdirs(target.getParent()) and fs.rename(part, target)):
                raise GateError(f"{name} could not be named")
    drop(spark, f"{path}/_parts")
    return seen.get["n"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, as one write."""
    fs, place = hadoop_path(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> tuple[str, str]:
    """(text, sha256) of a small file, from one read."""
    row = spark.read.format("binaryFile").load(path).first()
    return bytes(row["content"]).decode(), hashlib.sha256(bytes(row["content"])).hexdigest()


def flip(spark: SparkSession, pointer: str, text: str) -> None:
    """Replace a small file by another in one rename."""
    write_text(spark, f"{pointer}.new", text)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{pointer}.new", pointer))
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), conf).rename(new, old, options)


@dataclass(frozen=True)
class Read:
    """Files of a version as one read found them: (file, bytes, sha256, rows, is_array), and their rows with file."""

    files: DataFrame
    rows: DataFrame


def read_years(spark: SparkSession, path: str) -> Read:
    """Read all year files once: bytes, hash, rows and form come from the same bytes as the rows that are stored and used from then on.

    A task holds one file or part. Of a year in parts, the hash is that of its parts' hashes in their order, and it is an array if its parts
    are one after another: none is missing, the first alone opens it and the last alone closes it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{commitments-*,part-*}.json").load(path)
    name = lambda group: F.regexp_extract("path", "/(commitments-[^/]+[.]json)(?:/(part-[0-9]+[.]json))?$", group)
    raw = found.select(name(1).alias("file"), name(2).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text")).where("file != ''")
    ends = raw.withColumns({"head": F.when(F.col("part") != "", F.left("text", F.lit(1))), "closed": F.when(F.col("part") != "", F.col("text").rlike(r"\]\s*\z"))})
    whole = F.when(F.col("part") == "", F.col("text")).otherwise(F.concat(F.lit("["), F.substr("text", F.lit(2)), F.when(F.col("closed"), "").otherwise("]")))
    parsed = ends.withColumn("list", F.from_json(whole, f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ROWS.split(', ')) }>>"))
    own = ["file", "part", "bytes", "sha256", "head", "closed", "good"]
    flat = parsed.withColumn("good", F.col("list").isNotNull()).select(*own, F.explode_outer("list").alias("row"))
    folder = scratch(spark, "read")
    flat.write.parquet(folder)
    stored = spark.read.schema(flat.schema).parquet(folder)
    pieces = stored.groupBy(*own).agg(F.count("row").alias("rows"))
    listed = pieces.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct(*[c for c in own if c != "file"]))).alias("parts"))  # a name and a hash for each part
    n, one = F.size("parts"), F.col("parts")[0]
    follows = lambda p, k: p["good"] & (p["part"] == F.format_string("part-%08d.json", k)) & (p["head"] == F.when(k == 0, "[").otherwise(",")) & (p["closed"] == (k == n - 1))
    single = (n == 1) & (one["part"] == "")
    receipts = listed.select(
        "file", "bytes", F.when(single, one["sha256"]).otherwise(F.sha2(F.array_join(F.transform("parts", lambda p: p["sha256"]), "\n"), 256)).alias("sha256"),
        F.when(single, one["good"]).otherwise(F.forall(F.transform("parts", follows), lambda x: F.coalesce(x, F.lit(False)))).alias("is_array"), "rows",
    )
    return Read(receipts, stored.where("row is not null").select("file", "row.*"))


def source_receipt(spark: SparkSession, path: str) -> dict:
    """sha256, bytes and filename of a bulk file of less than two gigabytes; of a folder, the hash of its files' hashes in the order of their names."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    if not found:
        raise GateError(f"{path} is empty")
    sha = found[0]["sha256"] if len(found) == 1 else hashlib.sha256("\n".join(r["sha256"] for r in found).encode()).hexdigest()
    return {"sha256": sha, "bytes": sum(r["length"] for r in found), "filename": path.rstrip("/").rsplit("/", 1)[-1]}


def release_of(spark: SparkSession, read: Read, manifest_sha256: str, generated_at: str, commit: str, sources: dict) -> dict:
    """The receipt of a version: commit, time, rows, hashes, the sources' snapshots, and bytes, hash and rows of each file (a row for each year)."""
    ids = files.set_hash(read.rows, [], "id").first()
    listed = {r["file"]: {"sha256": r["sha256"], "bytes": r["bytes"], "rows": r["rows"]} for r in read.files.orderBy("file").collect()}
    return {"schemaVersion": 1, "commitSha": commit, "generatedAt": generated_at, "recordCount": ids["rows"], "manifestSha256": manifest_sha256, "idSetSha256": ids["set_hash"], "sourceSnapshots": {"gbiz": sources}, "files": listed}


def publish(records: DataFrame, root: str, version: str, generated_at: str, commit: str, sources: dict, keyless: bool = False) -> str:
    """Write a version, read it back, check its rows, give it a manifest and a receipt, then flip the pointer; a failure leaves the old pointer.

    sources: csvRetrievedAt, and sha256, bytes and filename of `subsidy` and `procurement`. Rows without a key are refused, unless `keyless`
    publishes them as well, as the index takes them.
    """
    spark, path = records.sparkSession, f"{root}/v={version}"
    n = write_years(records, path)
    read = read_years(spark, path)
    ids = files.set_hash(read.rows, [], "id").first()
    if not ids or ids["rows"] != n or ids["repeated"]:
        raise GateError("written rows differ from the records")
    in_file = F.regexp_extract("file", "^commitments-(.*)[.]json$", 1)
    gates.refuse(gates.verdicts(read.rows.withColumns({"file_year": in_file, "ingestSource": F.lit(R.INGEST)}), gates.public_rules(keyless=keyless)))
    named = {r["file"][12:-5]: r["file"] for r in read.files.select("file").collect()}  # a row for each year
    manifest = json.dumps({"generatedAt": generated_at, "commitments": dict(sorted(named.items()))}, indent=2, ensure_ascii=False) + "\n"
    write_text(spark, f"{path}/manifest.json", manifest)
    release = release_of(spark, read, hashlib.sha256(manifest.encode()).hexdigest(), generated_at, commit, sources)
    write_text(spark, f"{path}/release.json", json.dumps(release, indent=2, ensure_ascii=False) + "\n")
    gates.refuse(gates.verdicts(client_view(spark, path), gates.release_rules()))
    flip(spark, f"{root}/pointer.json", json.dumps({"version": version, "path": path}))
    return path


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that the pointer names."""
    return spark.read.schema("version string, path string").json(f"{root}/pointer.json").first()["path"]


def client_view(spark: SparkSession, path: str) -> DataFrame:
    """One row of what `gates.release_rules` look at: the receipt, the manifest and the hash of its bytes."""
    (text, sha), (told, _) = read_text(spark, f"{path}/manifest.json"), read_text(spark, f"{path}/release.json")
    pair = "struct<sha256:string,bytes:long,filename:string>"
    release = F.from_json(F.lit(told), f"schemaVersion int, commitSha string, generatedAt string, recordCount long, manifestSha256 string, idSetSha256 string, sourceSnapshots struct<gbiz:struct<csvRetrievedAt:string,subsidy:{pair},procurement:{pair}>>, files map<string,struct<sha256:string,bytes:long,rows:long>>")
    manifest = F.from_json(F.lit(text), "generatedAt string, commitments map<string,string>")
    row = spark.range(1).select(release.alias("r"), manifest.alias("m"))
    return row.select(
        F.col("r.schemaVersion").alias("schema_version"), F.col("r.commitSha").alias("commit"), F.col("r.recordCount").alias("record_count"), F.col("r.manifestSha256").alias("manifest_sha256"), F.col("r.idSetSha256").alias("id_set_sha256"), F.col("r.generatedAt").alias("generated_at"),
        F.col("r.sourceSnapshots.gbiz").alias("sources"), F.expr("transform(map_entries(r.files), e -> named_struct('name', e.key, 'bytes', e.value.bytes, 'rows', e.value.rows, 'sha256', e.value.sha256))").alias("files"),
        F.col("m.generatedAt").alias("manifest_generated_at"), F.expr("transform(map_entries(m.commitments), e -> named_struct('year', e.key, 'file', e.value))").alias("manifest_entries"), F.lit(sha).alias("manifest_found_sha256"),
    )


def sync_facts(spark: SparkSession, path: str, expected_commit: str) -> tuple[Read, DataFrame, DataFrame]:
    """(read, receipts, facts) that `gates.sync_verdicts` judges: the rows of one read, the receipt's files, and one row of the rest."""
    view, read = client_view(spark, path), read_years(spark, path)
    receipts = view.select(F.inline("files")).withColumnRenamed("name", "file")
    listed = view.select(F.inline("manifest_entries")).select("file")
    facts = view.select(F.lit(expected_commit).alias("expected_commit"), "commit", "manifest_sha256", "manifest_found_sha256", "record_count", "id_set_sha256")
    return Read(read.files.join(listed, "file", "left_semi"), read.rows.join(listed, "file", "left_semi")), receipts, facts


def sync(spark: SparkSession, root: str, index_root: str, expected_commit: str, synced_at: str, build: Callable[[DataFrame, str], int]) -> dict:
    """Verify the current version and build the search index of its rows, then flip the index pointer; returns the metadata.

    `build` writes rows below a folder and says how many (`index.build`). A release that fails a rule leaves the old index.
    """
    path = current(spark, root)
    read, receipts, facts = sync_facts(spark, path, expected_commit)
    gates.refuse(gates.sync_verdicts(read.rows, read.files, receipts, facts))
    found = facts.first()
    key = f"{index_root}/{expected_commit}"
    n = build(read.rows, key)
    agencies = [r["sourceAgency"] for r in search.agencies(read.rows).collect()]  # the names of publishers
    metadata = {"schemaVersion": 1, "releaseCommit": expected_commit, "recordCount": n, "idSetSha256": found["id_set_sha256"], "objectKey": key, "agencies": agencies, "syncedAt": synced_at}
    flip(spark, f"{index_root}/current.json", json.dumps(metadata, ensure_ascii=False))
    return metadata
