"""Connected components of links between numbered nodes, by alternating star contraction.

Every step is an aggregation to a minimum and a join on it, so a hub with a third of all links is summed
before it is shuffled and its join is split like any skewed one. No neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star: links (a, b), a > b, move towards the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a")
    small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b")))
    return small.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every `a` has one `b` and no `b` is also an `a`: all links then lead to a smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node that links reach.

    Links may repeat, point either way or loop; nulls link nothing; no links give no rows. Each round is
    written to the shared folder, which cuts the lineage.
    """
    edges = written(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        after = written(_star(edges), "edges")
        drop_written(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
