import random

import corpus_pipeline
from tests.llm.test_neardup import brute as brute_groups

rng = random.Random(8)
EN = "the weather in the north was cold and they stayed at home with their children during the long winter".split()
DE = "das wetter im norden war kalt und sie blieben mit ihren kindern den langen winter zu hause".split()


def prose(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "en"]) for _ in range(n))


def test_stages_follow_brute_force(spark, tmp_path):
    item = prose(EN, 30)
    texts = [prose((EN, DE)[i % 2], 40 + i) for i in range(24)]
    texts += [texts[3], texts[4] + " end", None, "", "12 34 !!", prose(EN, 20) + " " + item + " " + prose(EN, 10), "write to ann.5@mail1.example.com or 4539578763621486 " + prose(EN, 30)]
    rows = [(i, t, ("en", "de")[i % 2] if i < 24 else None, "s", len(t or ""), "kept") for i, t in enumerate(texts)]
    rows += [(31, "зима была долгой и холодной а дети оставались дома " * 4, None, "s", 10, "kept")]
    rows += [rows[5], (None, prose(DE, 50), None, None, None, None), (None, texts[6], None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, pii string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        reread = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = [r.asDict() for r in reread.collect()]
        if name != "packing":
            assert out.columns == docs.columns
            docs = reread
    ids = lambda name: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in after[name])
    first = [i for i, r in enumerate(rows) if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 31]
    assert ids("language_id") == sorted(-1 if rows[i][0] is None else rows[i][0] for i in first)
    groups = brute_groups([(i if rows[i][0] is None else rows[i][0], rows[i][1]) for i in first])
    keep = {i for i, (_, c) in groups.items() if i == c}
    assert ids("near_duplicates") == sorted(-1 if rows[i][0] is None else i for i in keep) and 24 not in keep and 25 not in keep
    assert ids("decontamination") == [i for i in ids("near_duplicates") if i != 29]
    assert ids("pii") == ids("decontamination")
    [private] = [r for r in after["pii"] if r["doc_id"] == 30]
    assert "ann.5@" not in private["text"] and "4539578763621486" not in private["text"] and private["n_chars"] == len(private["text"]) and private["pii"] == "kept"
    assert sorted({r["doc_id"] for r in after["packing"]} - {None}) == [i for i in ids("pii") if i >= 0]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after["packing"])


def test_empty_tables_and_unlabelled_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, component string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(1, "words without a label", None, "s", 21, "h", "c"), (1, "words without a label", None, "s", 21, "h", "c"), (2, None, None, None, None, None, None), (3, "12 34", None, "s", 5, "h", "c")]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [1, 1] and out.columns == docs.columns
    once = corpus_pipeline.near_duplicates(spark, out, str(tmp_path))
    assert [r.doc_id for r in once.collect()] == [1] and once.columns == docs.columns
