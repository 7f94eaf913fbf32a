"""Merkle manifest of a data set: a tree of SHA-256 digests for each source, and one over the sources.

A row is a leaf. Of each source the leaves stand in the order of their ids; runs of 16 become their parents,
level by level, until one node is left, the source's subroot; the subroots, in the order of the sources, give the
root in the same way. A parent keeps a copy of the hash state before each of its children (the midstate of that
slot), so another digest in a slot is folded in by resuming that copy with the replacement and the siblings
to the right of it only: nothing on the left is hashed again.

Leaves are numbered by a range partitioning, so no source has to fit a task; parents are aggregates of 16 rows.
Hash states can't leave their process, therefore leaves are folded in blocks of 256: a task builds the two
levels of its block and one state for each level above it, and all leaves of the block resume copies of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FAN, BLOCK_LEVELS = 16, 2
BLOCK = FAN**BLOCK_LEVELS
PATH = "array<struct<slot:int,kids:array<string>>>"
FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Manifest:
    """leaves (key, i, m, doc_id, leaf and what was kept), blocks (key, block, subroot, path) and the root."""

    leaves: DataFrame
    blocks: DataFrame
    root: str


def framed(*values: Column) -> Column:
    """The values one after another: `-` for a null, else the number of UTF-8 bytes, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf_hash(docs: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row of doc_id, source, lang, n_chars and text; `text` takes the place of the column."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    whole = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in names[:-1]]
    return F.sha2(framed(*whole, F.col("text") if text is None else text), 256)


def depth(nodes: Column) -> Column:
    """How many levels stand above so many nodes."""
    return sum(((nodes > FAN**k).cast("int") for k in range(1, 15)), (nodes > 1).cast("int"))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows` with i, the place of a row among those of its key in the given order, and m, how many the key has.

    A range partitioning deals out even one key with most of the rows; only the numbers of rows of each key in each
    partition are summed up across partitions.
    """
    placed = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at__", F.monotonically_increasing_id())
    placed = written(placed, label).withColumn("part__", F.shiftright("at__", 33))
    counts = placed.groupBy("key", "part__").agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))
    every, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "part__", "first__", F.sum("n__").over(every).alias("m"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    return placed.join(counts, ["key", "part__"]).withColumn("i", F.col("at__") - F.col("first__") + F.col("before__")).drop("at__", "part__", "first__", "before__")


def parents(nodes: DataFrame) -> DataFrame:
    """(key, i, m, digest, kids) of the runs of 16 of nodes (key, i, m, digest); keys with one node are done."""
    runs = nodes.where("m > 1").groupBy("key", F.shiftright("i", 4).alias("i")).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("run"))
    kids = runs.select("key", "i", F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"), F.expr("transform(run, x -> x.digest)").alias("kids"))
    return kids.select("key", "i", "m", F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids")


def grown(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The levels of the trees over leaves (key, i, m, digest), the leaves first."""
    most = leaves.agg(F.max(depth(F.col("m"))).alias("d")).first()["d"] or 0
    levels = [leaves]
    for _ in range(most):
        levels.append(written(parents(levels[-1]), label))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(key, top, digest): the last node of each key and the level it stands in."""
    out = None
    for top, nodes in enumerate(levels):
        last = nodes.where("m = 1").select("key", F.lit(top).alias("top"), "digest")
        out = last if out is None else out.unionByName(last)
    return out


def paths(levels: list[DataFrame], tops: DataFrame, level: int) -> DataFrame:
    """(key, i, subroot, path) of the nodes of a level: slot and run of every step up to the root.

    `tops` has key, top, subroot and the path from the key's last node on. Each level is joined with its own paths by
    key and place, which are unique, and hands them down to its children.
    """
    now = None
    for at in range(len(levels) - 1, level - 1, -1):
        start = tops.where(F.col("top") <= at if at == level else F.col("top") == at).select("key", F.lit(0).cast("long").alias("i"), "subroot", "path")
        if now is not None:
            down = levels[at + 1].select("key", "i", "kids").join(now, ["key", "i"]).select("key", "i", "subroot", "path", "kids", F.posexplode("kids").alias("slot", "kid"))
            own = F.array(F.struct("slot", "kids"))
            start = start.unionByName(down.select("key", (F.col("i") * FAN + F.col("slot")).alias("i"), "subroot", F.concat(own, "path").alias("path")))
        now = start
    return now if now is not None else tops.select("key", F.lit(0).cast("long").alias("i"), "subroot", "path")


def build(docs: DataFrame, **kept: Column) -> Manifest:
    """The manifest of all rows of `docs`; `kept` are further columns to stay with the leaves.

    Leaves of a source ascend by doc_id, nulls first, then by digest; equal rows get a place each. A null source is a
    source of its own and the first. Without any row the root is the digest of the empty string.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # nulls first, bytewise
    slim = written(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(docs).alias("leaf"), *[c.alias(n) for n, c in kept.items()]).withColumn("tie__", F.monotonically_increasing_id()), "leaves")
    leaves = written(ranked(slim, ["doc_id", "leaf", "tie__"], "placed").drop("tie__"), "numbered")
    levels = grown(leaves.select("key", "i", "m", F.col("leaf").alias("digest")), "nodes")
    subs = written(roots(levels), "subroots")
    top = written(ranked(subs.select(F.lit("").alias("key"), F.col("key").alias("of"), "top", "digest"), ["of"], "sources").withColumnRenamed("top", "own"), "ranked")
    above = grown(top.select("key", "i", "m", "digest"), "tops")
    last = roots(above).first()
    root = last["digest"] if last else hashlib.sha256().hexdigest()
    whole = roots(above).select("key", "top", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    over = paths(above, whole, 0).select("i", "path")
    tops = written(top.join(over, "i").select(F.col("of").alias("key"), F.col("own").alias("top"), F.col("digest").alias("subroot"), "path"), "over")
    blocks = paths(levels, tops, BLOCK_LEVELS).withColumnRenamed("i", "block")
    return Manifest(leaves, blocks, root)


class Parent:
    """A node that keeps the hash state before each child slot, and what stands to the right of it."""

    def __init__(self, kids: list[bytes], only: int | None = None):
        self.kids, self.states, state = kids, {}, hashlib.sha256()
        for slot, kid in enumerate(kids):
            if only in (None, slot):
                self.states[slot] = state.copy()
            state.update(kid)
        self.digest = state.hexdigest().encode()
        self.right = {slot: b"".join(kids[slot + 1 :]) for slot in self.states}

    def resumed(self, slot: int, kid: bytes) -> bytes:
        """The node's digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(kid + self.right[slot])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.kids[:slot]) + self.right[slot]


def fold_block(leaves: list[tuple[bytes, bytes]], m: int, path: list[dict]) -> list[tuple[str, str]]:
    """(proof, root) of (leaf, replacement) pairs of a block, whose key has m leaves and whose `path` leads on to the root."""
    steps = [[] for _ in leaves]
    nodes, of, left = [leaf for leaf, _ in leaves], list(range(len(leaves))), m
    for _ in range(BLOCK_LEVELS):
        if left > 1:
            made = [Parent(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
            for k, at in enumerate(of):
                steps[k].append((made[at // FAN], at % FAN))
            nodes, of, left = [p.digest for p in made], [at // FAN for at in of], -(-left // FAN)
    upper = [(Parent([kid.encode() for kid in x["kids"]], x["slot"]), x["slot"]) for x in path]
    beside = b"".join(parent.siblings(slot) for parent, slot in upper)
    out = []
    for own, (_, digest) in zip(steps, leaves):
        proof = hashlib.sha256()
        for parent, slot in own:
            proof.update(parent.siblings(slot))
            digest = parent.resumed(slot, digest)
        proof.update(beside)
        for parent, slot in upper:
            digest = parent.resumed(slot, digest)
        out.append((proof.hexdigest(), digest.decode()))
    return out


def fold(manifest: Manifest, replacement: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf.

    The proof is the digest of the siblings of every step, left to right, from the leaf up to the root. folded_root is
    what the root becomes with the column `replacement` in the leaf's place where it is not null, else with the leaf itself.
    """
    root = manifest.root
    other = F.coalesce(F.col(replacement), F.col("leaf")) if replacement else F.col("leaf")
    rows = manifest.leaves.select("key", F.expr(f"i div {BLOCK}").alias("block"), "i", "m", "doc_id", "leaf", other.alias("other"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(PATH).alias("path"))
    none = F.lit(None)
    heads = manifest.blocks.select("key", "block", F.lit(-1).cast("long").alias("i"), none.cast("long").alias("m"), none.cast("long").alias("doc_id"), none.cast("string").alias("leaf"), none.cast("string").alias("other"), "subroot", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def done() -> pa.RecordBatch:
            found = fold_block([(leaf.encode(), new.encode()) for _, _, leaf, new in held], held[0][0], head["path"])
            rows = [(doc, leaf, head["subroot"], root, proof, folded, folded == root) for (_, doc, leaf, _), (proof, folded) in zip(held, found)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 8)]
            routes = batch.column(8)
            for at, (i, m, doc, leaf, new, subroot) in enumerate(zip(*columns)):
                if i < 0:  # the first row of a block
                    if held:
                        yield done()
                    head, held = {"subroot": subroot, "path": routes[at].as_py()}, []
                else:
                    held.append((m, doc, leaf, new))
        if held:
            yield done()

    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = [x.split()[0] for x in FOLDED.split(", ")]
    return rows.unionByName(heads).repartition("key", "block").sortWithinPartitions("key", "block", "i").mapInArrow(run, FOLDED)
