"""Training-corpus pipeline over the table `documents`: five stages, each written and read again.

Language identification drops documents without a language, the similarity join keeps one document of each
group, decontamination drops documents that hold benchmark items, personal values become pseudonyms, and what
is left is tokenised and packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, langid, neardup, packing, pii
from ledgerlark.llm.queries import DEMO_KEY
from ledgerlark.llm.shared import drop_written, table, written


#: A text of so many letters whose best cosine stays below the floor is in none of the learnt languages.
LETTERS, FLOOR = 100, 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language: texts without any letter go, and texts of 100 letters or more whose cosine
    with every profile is below 0.1; shorter ones have too few n-grams to be refused for that.

    Prototypes are learnt from the labelled rows of `docs`. Without any label only texts without letters go.
    """
    prototypes = langid.train(docs.select("text", "lang"))
    if not prototypes:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    told = langid.predict(docs, prototypes, names=("lang_pred__", "score__"))
    foreign = f"score__ < {FLOOR}d and regexp_count(cast(text as string), '\\\\p{{L}}') >= {LETTERS}"
    return told.where(f"lang_pred__ != 'und' and not ({foreign})").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; repeated rows stay once.

    Documents without words link with nothing and stay. Rows with a null doc_id stay unless they are linked
    to a row with one; those of equal text stay once.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    keep = groups.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("kept__"), F.col("text_hash").alias("hash__")).agg(F.count("*").alias("rows__"))
    keep = written(keep, "kept")
    kept = docs.join(keep, F.expr("doc_id <=> kept__ and xxhash64(cast(text as string)) = hash__"), "left_semi").select(*docs.columns)
    # Whole texts are shuffled for repeated rows only where there are any.
    return kept if keep.where("rows__ > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers and dates replaced; n_chars, where it is there, counts the new text."""
    done = pii.pseudonymise(docs, DEMO_KEY, found="pii__")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("pii__") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pseudonyms), ("packing", packed)]

#: Similarity joins over hashed signatures, learnt prototypes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written_path"):  # nothing reads what the stage before wrote any more
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
