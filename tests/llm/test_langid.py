import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import langid
from ledgerlark.llm.queries import op2_language

EN = "the weather in the north was cold and they stayed at home with their children during the long winter".split()
DE = "das wetter im norden war kalt und sie blieben mit ihren kindern den langen winter über zu hause".split()


def documents():
    rng, rows = np.random.default_rng(1), []
    for i in range(160):
        lang, words = (("en", EN), ("de", DE))[i % 2]
        rows.append((i, " ".join(rng.choice(words, 20)), lang, "s"))
    return rows + [(1000, None, "en", None), (1001, "", None, None), (1002, "1234 !!", "de", None), (0, rows[0][1], "en", "s"), (1003, "the children " * 40_000, None, None)]


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 160]
    assert held and sum(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in held) / len(held) > 0.95
    assert [told[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and told[1003].lang_pred == "en"


def test_bundle_is_sum_of_bound_letters():
    text, n, dims = "abcab", 3, 64
    v = {c: langid.letter_vector(ord(c), dims, 7).astype(float) for c in "abc "}
    want = np.zeros(dims)
    padded = f" {text} "
    counts = {}
    for i in range(len(padded) - n + 1):
        counts[padded[i : i + n]] = counts.get(padded[i : i + n], 0) + 1
    for gram, times in counts.items():
        want += np.sqrt(times) * np.roll(v[gram[2]], 0) * np.roll(v[gram[1]], 1) * np.roll(v[gram[0]], 2)
    assert np.allclose(langid.bundles([text], n, dims, 7)[0], want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.train(none) == {} and langid.predict(none, {}).collect() == []


def test_any_number_of_labels(spark):
    rng = np.random.default_rng(3)
    words = lambda k: " ".join("".join(chr(97 + c) for c in np.random.default_rng([k, j]).integers(0, 26, 6)) for j in range(12))
    rows = [(f"{words(k)} {words(k + 5000)}", f"l{k:04}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("guess__", F.lit(1))
    prototypes = langid.train(docs, most_per_lang=1)
    assert len(prototypes) == 1500
    some = docs.where(F.col("lang").isin([f"l{k:04}" for k in rng.choice(1500, 60, replace=False)]))
    told = langid.predict(some, prototypes).collect()
    assert all(r.guess__ == 1 and r.lang_pred == r.lang for r in told) and len(told) == 60


def test_frequent_labels_are_sampled(spark):
    docs = spark.createDataFrame([(f"some words number {k} of it", "en") for k in range(3000)] + [("ein satz", "de")], "text string, lang string")
    whole, part = (langid.train(docs, most_per_lang=n)["en"] for n in (5000, 300))
    assert 0.03 < np.linalg.norm(part) / np.linalg.norm(whole) < 0.3
