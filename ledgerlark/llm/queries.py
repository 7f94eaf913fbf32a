"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, merkle, neardup, oracle, packing, pii, quality, repair, secrets, urls, vectors
from .shared import lower_ascii, table, written


#: Key of the pseudonyms in this query; a production run passes its own.
DEMO_KEY = "pseudonym-key-of-the-query"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return done.selectExpr("doc_id", "text", "cast(size(pii) as bigint) as n_pii", "array_join(sort_array(array_distinct(pii.kind)), ',') as kinds")


def held_out() -> Column:
    """Whether a document belongs to the held-out fold; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.train(docs.where(~held_out()).select("text", "lang"))
    told = langid.predict(docs.select("doc_id", "text"), prototypes)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, so joins read it from shuffles whose tasks can be split where many share an opening.
    convs = written(chat.conversations(table(spark, sf_dir, "conversations")), "conversations")
    pairs = {"opening": chat.pairs_by_opening(convs), "reply": chat.pairs_by_reply(convs)}
    done = [chat.preference_pairs(p).withColumn("kind", F.lit(kind)) for kind, p in pairs.items()]
    spans = "array_join(transform({}, s -> concat(cast(s.start as string), ':', cast(s.end as string))), ',')"
    return done[0].unionByName(done[1]).withColumns({c: F.expr(spans.format(c)) for c in ("chosen_mask", "rejected_mask")})


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    weights = urls.train(spark.createDataFrame(urls.labelled_table(), "host string, path string, blocked boolean"))
    return urls.judge(pages, weights).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(docs))
    found = secrets.scan(docs, model)

    text = "array_join(transform({}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.expr(text.format("filter(spans, s -> s.kind != 'markov')"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(places) as bigint) as n_base",
        "array_min(places.place) as first_word", "array_max(places.place) as last_word",
        "array_join(sort_array(array_distinct(places.label)), ',') as base_labels",
        "array_join(sort_array(array_distinct(concat(places.label, found.label))), ',') as labels",
        "round(score, 9) as score",
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.where(~held_out()), labels.where(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair.report(repair.keyed(repair.damaged(convs))).withColumnRenamed("conv_id", "own")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(found, F.expr("conv_id <=> own"), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    manifest = merkle.build(docs, tampered=F.when(chosen, merkle.leaf_hash(docs, lower_ascii(F.col("text").cast("string")))))
    return merkle.fold(manifest, "tampered")


def _sql_render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"


def _sql_mask(turns: str) -> str:
    upto = f"coalesce(list_sum(list_transform({turns}[1:i], lambda t: length(t.role) + length(t.text) + 13)), 0)"
    span = f"CAST(CAST({upto} AS BIGINT) - length({turns}[i].text) - 8 AS VARCHAR) || ':' || CAST(CAST({upto} AS BIGINT) - 1 AS VARCHAR)"
    kept = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return f"coalesce(array_to_string(list_transform({kept}, lambda i: {span}), ','), '')"


OP3_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY 1),
f AS (SELECT turns[1] AS opening, min(conv_id) AS first_id FROM c GROUP BY 1),
p AS (SELECT 'opening' AS kind, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS c, b.turns AS r FROM c b JOIN f ON b.turns[1] = opening JOIN c a ON a.conv_id = first_id WHERE a.turns <> b.turns
  UNION ALL SELECT 'reply', a.conv_id, b.conv_id, a.turns, list_append(a.turns[1:len(a.turns) - 1], b.turns[-1]) FROM c a JOIN c b ON b.conv_id = a.conv_id + 1
  WHERE a.turns[-1].role = 'assistant' AND b.turns[-1].role = 'assistant' AND a.turns[-1].text <> b.turns[-1].text),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1, least(len(c), len(r))) AS k FROM p),
s AS (SELECT kind, chosen_id, rejected_id, CAST(k AS BIGINT) AS n_common, c[1:k] AS h, c[k + 1:] AS x, r[k + 1:] AS y FROM n)
SELECT kind, chosen_id, rejected_id, n_common, {_sql_render("h")} AS prompt, {_sql_render("x")} AS chosen, {_sql_mask("x")} AS chosen_mask, {_sql_render("y")} AS rejected, {_sql_mask("y")} AS rejected_mask FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pseudonyms": op1_pseudonyms, "op2_language": op2_language, "op3_preferences": op3_preferences, "op4_urls": op4_urls, "op5_vectors": op5_vectors, "op6_decontamination": op6_decontamination, "op7_secrets": op7_secrets, "op8_neardup": op8_neardup, "op9_packing": op9_packing, "op10_licenses": op10_licenses, "op11_quality": op11_quality, "op12_repair": op12_repair, "op13_merkle": op13_merkle}


def oracle_sql() -> dict[str, str]:
    return {"op3_preferences": OP3_SQL, "op5_vectors": oracle.OP5_SQL, "op6_decontamination": oracle.OP6_SQL, "op8_neardup": oracle.OP8_SQL, "op10_licenses": oracle.op10_sql(), "op12_repair": oracle.op12_sql(), "op13_merkle": oracle.op13_sql()}
