"""Fixed windows anchored at a key's first event: a request limit, as an analysis of a whole log.

A window begins at a key's first event and holds what falls within its length; the next one begins at the first event after it. So the
windows are a chain from event to event, which can't be cut by the clock. Every event points to the first event that would open the
next window; the chain from each key's first event is found by doubling these pointers, in as many rounds as the logarithm of the
longest chain. Events are numbered once in the order of key and time, and running counts go by blocks of numbers, so a key with most
of the events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .index import ranked

BLOCK = 100_000


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over all rows up to their own `rank`: sums within blocks of ranks, after those of the blocks before."""
    rows = rows.withColumn("block__", F.floor(F.col("rank") / BLOCK).cast("long")).withColumn("own__", value.cast("long"))
    sums = rows.groupBy("block__").agg(F.sum("own__").alias("sum__"))
    before = F.coalesce(F.sum("sum__").over(Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    within = F.sum("own__").over(Window.partitionBy("block__").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums.select("block__", before.alias("before__")), "block__").withColumn(name, within + F.col("before__")).drop("block__", "own__", "before__")


def pointers(events: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(numbered, links): events (key, at, id) with their number `node`, and for each node the node of the first event of its key `seconds` or more later.

    Events and probes at the ends of their windows are sorted together; a probe points to the event that comes next.
    """
    probe = events.select("key", (F.col("at") + F.expr(f"interval {seconds} seconds")).alias("at"), F.lit(0).alias("kind"), "id", F.col("at").alias("of"))
    both = written(events.select("key", "at", F.lit(1).alias("kind"), "id", F.col("at").alias("of")).unionByName(probe), "probes")
    placed = ranked(both, [F.col("key"), F.col("at"), F.col("kind"), F.col("id"), F.col("of")])
    counted = written(running(placed, F.col("kind"), "n"), "counted")
    numbered = counted.where("kind = 1").select((F.col("n") - 1).alias("node"), "key", "at", "id")
    own = numbered.select("node", "key", F.col("at").alias("of"), "id")
    ends = counted.where("kind = 0").select("key", "of", "id", F.col("n").alias("next"))
    found = own.join(ends, ["key", "of", "id"]).select("node", "key", "next")
    same = numbered.select(F.col("node").alias("next"), F.col("key").alias("key_of_next"))
    return numbered, found.join(same, "next").where("key = key_of_next").select("node", "next")


def chain(first: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that are reached from `first` over `links` (node, next), by doubling."""
    marked, jumps = written(first.select("node"), "marked"), written(links, "jumps")
    while True:
        more = marked.join(jumps, "node").select(F.col("next").alias("node"))
        after = written(marked.unionByName(more), "marked")
        if after.count() == marked.count():
            return after
        marked = after
        jumps = written(jumps.join(jumps.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", F.col("far").alias("next")), "jumps")


def anchored_windows(events: DataFrame, key: str, time: str, event_id: str, seconds: int = 60, limit: int = 30) -> DataFrame:
    """key, event_id, opened (the time of the window's first event), position within the window and accepted (position up to `limit`).

    Events of one time follow each other by id; ids are unique within a key. Rows with a null key or time are in no window and left out.
    """
    rows = events.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(event_id).alias("id")).where("key is not null and at is not null")
    numbered, links = pointers(rows, seconds)
    first = numbered.groupBy("key").agg(F.min("node").alias("node"))
    starts = chain(first, links).withColumn("start", F.lit(1))
    marked = numbered.join(starts, "node", "left").withColumn("rank", F.col("node"))
    windows = written(running(marked, F.coalesce("start", F.lit(0)), "window").drop("rank"), "windows")
    opened = windows.where("start = 1").select("window", F.col("node").alias("from__"), F.col("at").alias("opened"))
    out = windows.join(opened, "window").withColumn("position", F.col("node") - F.col("from__") + 1)
    return out.select(F.col("key").alias(key), F.col("id").alias(event_id), "opened", "position", (F.col("position") <= limit).alias("accepted"))
