"""Near-duplicate vectors by Euclidean p-stable hashing.

A normalised vector falls, in each of several tables, into the bucket of its quantised projections on random
Gaussian directions. Vectors that share a bucket are compared by exact cosine, block against block, so a
bucket of any size is spread over tasks of bounded memory. A pair is looked at in the first table that has
both in one bucket only, so links are counted once and no pair leaves a task: tasks return link counts and a
spanning forest of the links of their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .neardup import rooted, spread
from .shared import drop_written, written

BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaling by the largest component first avoids overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    rng = np.random.default_rng([seed, x.shape[1]])
    axes = rng.standard_normal((x.shape[1], tables * projections))
    shifts = rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ axes + shifts) / width).astype(np.int64).reshape(len(x), tables, projections)
    odd = rng.integers(1, 1 << 62, projections, np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        return (cells * odd).sum(axis=2) ^ np.int64(x.shape[1])


def meets(distance: float, width: float) -> float:
    """Probability that two points at a Euclidean distance fall into one cell of a random projection."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def index_shape(n: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """(tables, projections) for n vectors: a vector meets half an unrelated (orthogonal) one in a table, and a
    pair at the threshold shares a bucket of some table with probability `recall`, closer ones with more."""
    near, far = meets(math.sqrt(2 - 2 * threshold), width), meets(math.sqrt(2), width)
    projections = max(6, math.ceil(math.log(2 * max(n, 1)) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**projections))), projections


def nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds by row) of a column of lists."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def compared(part: pa.RecordBatch, threshold: float, most: int = 1 << 21) -> pa.RecordBatch:
    """(node, n, least): how many other rows each node of whole groups links with, and the smallest node it reaches by
    links of its group. All pairs of a group are looked at, `most` numbers at a time."""
    group, table, node, copies, side = (part.column(c).to_numpy() for c in ("group", "table", "node", "copies", "side"))
    own = part.column("own").to_numpy(zero_copy_only=False)
    (values, at), (keys, key_at) = nested(part.column("embedding")), nested(part.column("keys"))
    dims, tables = np.diff(at), int(key_at[1])
    keys, rows = keys.reshape(len(node), tables), np.empty((len(node), int(dims.max())))
    for dim in np.unique(dims).tolist():
        some = np.flatnonzero(dims == dim)
        rows[some, :dim] = unit(values[spread(at[some], dims[some])].reshape(-1, dim))
        rows[some, dim:] = 0
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    held = np.diff(np.append(first, len(group)))
    after = np.repeat(first + held, held) - np.arange(len(group)) - 1  # later rows of the row's group
    ends, n, links, lo = np.cumsum(after), np.zeros(len(node), np.int64), [], 0
    step = max(1, most // max(rows.shape[1], tables))
    while lo < len(node):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        i, j = np.repeat(np.arange(lo, hi), after[lo:hi]), spread(np.arange(lo, hi) + 1, after[lo:hi])
        ok = (node[i] != node[j]) & (own[i] | (side[i] != side[j])) & (dims[i] == dims[j])
        i, j = i[ok], j[ok]
        ok = (keys[i] == keys[j]).argmax(axis=1) == table[i]  # in the first table that has both in one bucket
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", rows[i], rows[j]) >= threshold
        i, j = i[ok], j[ok]
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        links.append((i, j))
        lo = hi
    root = rooted(len(node), np.concatenate([i for i, _ in links]), np.concatenate([j for _, j in links]))
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[root[some]])], names=["node", "n", "least"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.97, width: float = 2.0, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `vectors` (vec_id, embedding, label).

    Rows link when labels are equal and not null, dimensions are equal and the cosine in double precision
    reaches `threshold`. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label, link with nothing. Equal vectors of a label are one node: they link with each other
    and share all links. n_links counts the other rows linked directly; repeated rows, also of one vec_id,
    count each; a null vec_id is null in its own component unless others are in it. An empty table gives no
    rows. Other columns are not read.

    A pair at the threshold shares a bucket of some table with probability `recall`, closer pairs with more; every
    vector is in the index and nothing caps a bucket. The number of projections grows with the logarithm of the
    number of vectors, so what a vector is compared with by chance stays the same, and the number of tables with a
    root of it (power 0.23 at the defaults).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = "embedding is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)"
    rows = rows.withColumn("fine", F.expr(f"coalesce({fine}, false)")).withColumn("embedding", F.when(F.col("fine"), F.expr("transform(embedding, x -> x + 0d)")))
    grouped = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = written(grouped.withColumn("node", F.xxhash64("label", "embedding")), "vectors")
    tables, projections = index_shape(nodes.count(), threshold, width, recall)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [None] * len(frame)
            for _, at in frame.groupby(frame["embedding"].map(len)).indices.items():
                made = bucket_keys(unit(np.stack(frame["embedding"].iloc[at].tolist())), tables, projections, width, seed)
                for i, k in zip(at, made):
                    keys[i] = k
            yield frame.assign(keys=keys)

    keyed = nodes.mapInPandas(hashed, "label bigint, embedding array<double>, first bigint, copies bigint, node bigint, keys array<bigint>")
    slim = keyed.select("node", F.posexplode("keys").alias("table", "key"), "label").select("node", "table", F.xxhash64("label", "table", "key").alias("bucket"))
    full = slim.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1").select("bucket", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    met = written(slim.join(full, "bucket"), "buckets")
    placed = met.withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    # Each row goes to every pair of blocks that its own is part of: (i, j) with i <= j.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(keyed.select("node", "copies", "embedding", "keys"), "node")
    pairs = pairs.select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        "table", F.col("block").alias("side"), (F.col("block") == F.col("other")).alias("own"), "node", "copies", "embedding", "keys",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
            if cut or (rest and len(group) and rest[0].column("group")[0].as_py() != group[0]):
                yield compared(pa.concat_batches([*rest, batch.slice(0, cut)]), threshold)
                rest = []
            rest.append(batch.slice(cut))
        if sum(map(len, rest)):
            yield compared(pa.concat_batches(rest), threshold)

    dealt = pairs.repartition("group").sortWithinPartitions("group", "node")
    found = written(dealt.mapInArrow(run, "node bigint, n bigint, least bigint"), "vector-links")
    drop_written(met)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    reach = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    of_node = nodes.join(counts, "node", "left").join(reach, "node", "left").select("label", "embedding", "first", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    ids = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of_node.join(ids, "component").select("node", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("fine"), F.xxhash64("label", "embedding")).alias("node")).join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
