"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted similarity.

A window that is as long as a benchmark item and similar enough to it shares a shingle with it, even one of
any `missing + 1` shingles chosen beforehand, as no more than `missing` of the item's can be absent. It need
not be where the item has it, as halves may be swapped. So all starts are looked at whose window holds such a
shingle, and a window is laid where enough of its shingles are any of the items' of its length: the exact
similarity of others is too low, whatever the item, and they need no fingerprint. Windows of equal words are fingerprinted once, however many
documents hold them. Fingerprints are cut into radius + 1 blocks of bits: two within the radius agree in a
block at least, so joining on (length, block, bits) finds all of them. At a radius that loses nothing the blocks
are short, so it is the bound on shared shingles that keeps the candidates few. Candidates are then compared exactly,
by the Jaccard similarity of their shingles weighted by how often they occur: the n-th occurrence of a
shingle is a feature of its own, in fingerprints too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

WORD = r"[\p{L}\p{N}]+"
BITS = 64


def words_of(text: str) -> str:
    """SQL: lower-case runs of letters and digits."""
    return f"regexp_extract_all(lower({text}), r'{WORD}', 0)"


def shingles_of(words: str, size: str | int, most: int = 5) -> str:
    """SQL: hashes of all runs of `size` words (`most` at most), in order; of fewer words, of all at once.

    Words are taken one by one: slicing would copy the whole array at every place. Nulls do not count.
    """
    run = ", ".join(f"if({k} < {size}, get({words}, i + {k}), null)" for k in range(most))
    return f"if(size({words}) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size({words}) - {size}, 0)), i -> xxhash64({run})))"


def simhash(shingles: str) -> str:
    """SQL: bit b is set where more than half of the shingles' hashes have it set."""
    held = f"aggregate({shingles}, 0L, (t, h) -> t + (shiftrightunsigned(h, b) & 1L))"
    return f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | shiftleft(if(2 * {held} > size({shingles}), 1L, 0L), b))"


def block_edges(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 blocks that cover all bits."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def blocks_of(fingerprint: str, radius: int) -> str:
    """SQL: array of the bits of each block."""
    return "array(" + ", ".join(f"shiftrightunsigned({fingerprint}, {lo}) & {(1 << n) - 1}L" for lo, n in block_edges(radius)) + ")"


def numbered(shingles: str) -> str:
    """SQL: shingles told apart by their occurrence, so a shingle of weight w is w features."""
    return f"transform({shingles}, (h, i) -> xxhash64(h, size(filter(slice({shingles}, 1, i + 1), x -> x = h))))"


def item_index(benchmark: DataFrame, words: int, radius: int) -> DataFrame:
    """item_id, n_words, size (of its shingles), shingles, features, fingerprint, blocks of each item with words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.expr(words_of("coalesce(cast(text as string), '')")).alias("words"))
    rows = rows.where("size(words) > 0").selectExpr("item_id", "size(words) as n_words", f"least(size(words), {words}) as size", "words")
    rows = rows.withColumn("shingles", F.expr(shingles_of("words", "size", words))).withColumn("features", F.expr(numbered("shingles")))
    return rows.withColumn("fingerprint", F.expr(simhash("features"))).withColumn("blocks", F.expr(blocks_of("fingerprint", radius))).drop("words")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, radius: int = 20, most_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, n_words): items that documents hold.

    One row for each document and item with a window whose weighted shingle similarity reaches `percent`: the
    most similar window, the first of equal ones, by its first word and number of words. text_hash is
    xxhash64 of the text. Words are runs of letters and digits in lower case. A document shorter than an item
    is one window. Items of fewer than `words` words have one shingle. Null and empty texts and items hold
    nothing; repeated rows of documents come out as one; null ids are kept and equal to each other; empty
    tables give no rows. Texts are read whole, other columns not at all. The index of the items is broadcast
    only where a count shows at most `most_broadcast` entries, else joined by shuffling.
    """
    # Written tables keep filters that Spark infers from evaluating fingerprints a second time, inside one another.
    items = written(item_index(benchmark, words, radius), "items")
    # Of the item's shingles at most `missing` can be absent from a window that is similar enough.
    seeds = items.withColumn("missing", F.expr(f"cast(floor(size(shingles) * {100 - percent} / 100) as int)"))
    at = F.expr("transform(sequence(0, missing), k -> cast(k * size(shingles) div (missing + 1) as int))")
    seeds = seeds.select("size", "n_words", "shingles", F.explode(at).alias("at")).selectExpr("size", "n_words", "get(shingles, at) as shingle").distinct()
    known = items.select("size", "n_words", F.explode("shingles").alias("shingle")).distinct()
    counts = seeds.groupBy("size").count().collect()  # one row for each shingle size, `words` at most
    small = sum(r["count"] for r in counts) <= most_broadcast
    ship = F.broadcast if small else (lambda df: df)
    ship_known = F.broadcast if small and known.count() <= most_broadcast else (lambda df: df)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(words_of("text")).alias("words"))
    around = None
    for size in sorted(r["size"] for r in counts) or [words]:
        held = rows.withColumn("shingles", F.expr(shingles_of("words", size, words)))
        # The outer form, as for the other one a filter on the array's size would hash everything a second time.
        # Where the index is too large to broadcast, shingles are shuffled without the words, and hits get them afterwards.
        carried = ["words"] if small else []
        hits = held.select("doc_id", "text_hash", *carried, F.posexplode_outer("shingles").alias("place", "shingle"))
        hits = hits.join(ship(seeds.where(F.col("size") == size).drop("size")), "shingle")
        if not small:
            texts = rows.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "words")
            hits = hits.drop("shingle").distinct().join(texts, F.expr("doc_id <=> of_doc and text_hash = of_hash"))
        # All starts whose window holds the hit, and the words of all of these windows.
        hits = hits.selectExpr("doc_id", "text_hash", "n_words", f"{size} as size", f"greatest(place - n_words + {size}, 0) as lo", "least(place, greatest(size(words) - n_words, 0)) as hi", "words")
        hits = hits.selectExpr("doc_id", "text_hash", "n_words", "size", "lo", "hi", "slice(words, lo + 1, hi - lo + n_words) as around").dropDuplicates(["doc_id", "text_hash", "n_words", "size", "lo", "hi"])
        around = hits if around is None else around.unionByName(hits)
    around = written(around, "around")

    key = ["doc_id", "text_hash", "n_words", "size", "lo", "hi"]
    held = None
    for size in sorted(r["size"] for r in counts) or [words]:
        own = around.where(F.col("size") == size).withColumn("shingles", F.expr(shingles_of("around", size, words)))
        own = own.select(*key, F.posexplode_outer("shingles").alias("place", "shingle"))
        own = own.join(ship_known(known.where(F.col("size") == size).drop("size")), ["n_words", "shingle"]).select(*key, "place")
        held = own if held is None else held.unionByName(own)
    held = held.groupBy(*key).agg(F.sort_array(F.collect_list("place")).alias("places"))
    # Of a and b shingles at least `need` must be shared; a window of them starts between its last one and its first.
    a, b = "(greatest(least(n_words, size(around)) - size, 0) + 1)", "(n_words - size + 1)"
    need = f"cast(({percent} * ({a} + {b}) + {100 + percent - 1}) div {100 + percent} as int)"
    first, last = "greatest(get(places, i + need - 1) - a + 1, 0)", "least(get(places, i), hi - lo)"
    starts = f"array_distinct(flatten(transform(sequence(0, size(places) - need), i -> if({first} <= {last}, sequence({first}, {last}), array()))))"
    same = F.expr(" and ".join(f"around.{c} <=> held.{c}" for c in key))
    laid = around.alias("around").join(held.alias("held"), same).select(*[F.col(f"around.{c}") for c in key], "around", "places")
    laid = laid.withColumn("a", F.expr(a)).withColumn("need", F.expr(need)).where("size(places) >= need")
    laid = laid.select("doc_id", "text_hash", "n_words", "size", "lo", "around", F.explode(F.expr(starts)).alias("rel"))
    laid = laid.selectExpr("doc_id", "text_hash", "n_words", "size", "lo + rel as start", "slice(around, rel + 1, n_words) as window")
    laid = laid.dropDuplicates(["doc_id", "text_hash", "n_words", "size", "start"])
    windows = written(laid.withColumn("content", F.expr("md5(concat_ws(' ', window))")), "windows")

    contents = windows.groupBy("n_words", "size", "content").agg(F.first("window").alias("window"))  # equal contents, equal windows
    prints = contents.withColumn("shingles", F.expr(shingles_of("window", "size", words))).withColumn("features", F.expr(numbered("shingles"))).withColumn("fingerprint", F.expr(simhash("features")))
    prints = written(prints.select("n_words", "content", "features", "fingerprint"), "prints")
    prints = prints.select("n_words", "content", "features", "fingerprint", F.posexplode(F.expr(blocks_of("fingerprint", radius))).alias("block", "bits"))
    wanted = items.selectExpr("item_id", "n_words", "features as item_features", "fingerprint as item_print", "blocks", "posexplode(blocks) as (block, bits)")
    # A pair that agrees in several blocks is taken in the first.
    differ = "bit_count(fingerprint ^ item_print)"
    first = f"array_position(zip_with({blocks_of('fingerprint', radius)}, blocks, (x, y) -> x = y), true) = block + 1"
    near = prints.join(ship(wanted), ["n_words", "block", "bits"]).where(f"{differ} <= {radius} and {first}")
    near = near.withColumn("shared", F.expr("size(array_intersect(features, item_features))")).withColumn("either", F.expr("size(features) + size(item_features) - shared"))
    alike = near.where(f"100 * shared >= {percent} * either").selectExpr("item_id", "n_words", "content", "shared / either as similarity")

    found = windows.drop("window").join(alike, ["n_words", "content"])
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("best"))
    return best.selectExpr("doc_id", "text_hash", "item_id", "best.similarity as similarity", "cast(-best.before as bigint) as start", "cast(best.n_words as bigint) as n_words")


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    hits = contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("hit_doc")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("hit_hash"))
    return docs.join(hits, same, "left_anti")
