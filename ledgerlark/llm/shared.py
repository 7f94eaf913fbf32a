"""Helpers of the training-data operators: tables, cut lineage, ASCII lower case, match positions."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by `spark.checkpoint.dir`, else the checkpoint folder that the session has
    already; only where neither is set and all runs on one machine a new temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back, which cuts its lineage.

    The files survive lost executors. `drop_written` removes them once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by `written`, through the file system that holds them."""
    for df in tables:
        spark, path = df.sparkSession, df.written_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does once their plans are collected.

    The session keeps the last plan, so a small query takes its place; the driver's Python lets go of its
    plans in the background, hence the pauses.
    """
    gc.collect()
    spark.range(1).count()
    time.sleep(1)
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def bound(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it in `body` by `name`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sums(values: str) -> str:
    """SQL for inclusive prefix sums of an array of longs, in log2(n) passes over it and no quadratic copying."""
    steps = "filter(transform(sequence(0, 30), k -> shiftleft(1, k)), s -> s < size(v))"
    return bound(values, "v", f"aggregate({steps}, v, (acc, s) -> transform(acc, (x, i) -> if(i >= s, x + get(acc, i - s), x)))")


def match_spans(text: str, pattern: str) -> str:
    """SQL for the array of (start, end, value) of the leftmost non-overlapping matches of a Java pattern.

    Positions are code points, ends exclusive. Lengths of the pieces between matches and of the matches
    themselves add up to the positions. The pattern must not match the empty string and holds no quotes.
    """
    found = f"named_struct('gaps', split({text}, r'{pattern}', -1), 'hits', regexp_extract_all({text}, r'{pattern}', 0))"
    ends = running_sums("transform(f.hits, (m, i) -> cast(char_length(get(f.gaps, i)) + char_length(m) as bigint))")
    spans = bound(ends, "e", "transform(f.hits, (m, i) -> named_struct('start', get(e, i) - char_length(m), 'end', get(e, i), 'value', m))")
    return f"if({text} rlike r'{pattern}', {bound(found, 'f', spans)}, cast(array() as array<struct<start:bigint,end:bigint,value:string>>))"


def constant_array(values: list[float]) -> Column:
    """A literal array of doubles; long ones cost one expression and are folded before the query runs."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")
