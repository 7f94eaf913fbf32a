"""Licence scan with a positional index of rare words.

Every licence template is a row of words with positions. It is looked for by its own highest-IDF words,
whatever other licence words a file holds: an occurrence at file position p of such a word that stands at
template position t votes for the template at the alignment p - t. The score of an alignment is the IDF
weight of the template words that agree with it over the weight of all words that the template is looked for
by, so a notice that stands word by word scores 1. A template is reported when its best alignment reaches
`least` and all its mandatory key phrases stand in the file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, notice, key phrases that must stand in the file word by word.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2 of the license"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3 of the license"]),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license"]),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("lgpl-3.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu lesser general public license", "version 3 of the license"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ["accompanying documentation covered by this license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", ["spdx license identifier bsd 3 clause"]),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2 0"]),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"]),
]

# Words too common for the index.
STOP_WORDS = "a an and any are as by for in into is it of or that the this to use with you".split()


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z and characters above ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def phrase_places(words: str) -> str:
    """SQL for the array of (place, label) where a base phrase's words stand one after another."""
    cases = []
    for phrase, label in PHRASES.items():
        here = " and ".join(f"get({words}, i + {k}) = '{part}'" if k else f"w = '{part}'" for k, part in enumerate(phrase.split()))
        cases.append(f"when {here} then '{label}'")
    return f"filter(transform({words}, (w, i) -> named_struct('place', cast(i as bigint), 'label', case {' '.join(cases)} end)), x -> x.label is not null)"


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, rare: int = 12, least: float = 0.6) -> DataFrame:
    """The columns of `docs` (doc_id, text) and, for each row, its licence places and labels.

    Adds n_words, places (array of (place, label) of the base phrases), found (array of (label, score,
    place) of templates that hold, best alignment of each) and score (best of all templates, 0 without any).
    `rare` is how many of its highest-IDF words each template is looked for by; document frequencies come
    from all rows. Null and empty texts have no words, no places, no labels and score 0. Repeated rows get the
    same result each; a null doc_id is kept; ties of alignments go to the smallest place. An empty table
    gives no rows. Other columns of `docs` are not read and cannot clash.
    """
    index = [(t, k, w) for t, (_, notice, _) in enumerate(templates) for k, w in enumerate(notice.split()) if w not in STOP_WORDS]
    vocabulary = sorted({w for _, _, w in index})
    phrase_at = "|".join(GAP.join(p.split()) for p in PHRASES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"), lower_ascii(F.col("text")).rlike(phrase_at).alias("has_phrase"))
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    seen = F.expr(f"filter(transform(words, (w, i) -> named_struct('word', w, 'place', cast(i as bigint))), x -> x.word in ({listed}))")
    rows = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "has_phrase", "words", seen.alias("seen"))
    rows = rows.withColumn("joined", F.expr("if(size(seen) > 0, concat(' ', array_join(words, ' '), ' '), '')"))
    holds = ", ".join(" and ".join(f"contains(joined, ' {k} ')" for k in keys) for _, _, keys in templates)
    none = "cast(array() as array<struct<place:bigint,label:string>>)"
    table = written(
        rows.select(
            "doc_id", "text_hash", "n_words", "seen",
            F.expr(f"if(has_phrase, {phrase_places('words')}, {none})").alias("places"),
            F.expr(f"if(size(seen) > 0, array({holds}), array())").alias("holds"),
        ),
        "license-words",
    )

    n_docs = table.count()
    counted = table.select(F.explode(F.array_distinct("seen.word")).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counted.collect()}  # at most one row for each word of the templates
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}

    spark = docs.sparkSession
    # The same words make the postings and the totals, so all words of a verbatim notice can vote.
    own = {t: set(sorted({w for u, _, w in index if u == t}, key=lambda w: (-idf[w], w))[:rare]) for t in range(len(templates))}
    kept = [(w, t, k, idf[w]) for t, k, w in index if w in own[t]]
    postings = spark.createDataFrame(kept, "word string, template int, at long, weight double")
    # One row for each file that holds licence words; repeated rows are alike and count once.
    files = table.where(F.expr("exists(holds, x -> x)")).dropDuplicates(["doc_id", "text_hash"])
    votes = (
        files.select("doc_id", "text_hash", "holds", F.explode("seen").alias("hit"))
        .select("doc_id", "text_hash", "holds", F.col("hit.word").alias("word"), F.col("hit.place").alias("place"))
        .join(F.broadcast(postings), "word")  # as many rows as the templates have words
        .where(F.get("holds", F.col("template")))
    )
    aligned = votes.groupBy("doc_id", "text_hash", "template", (F.col("place") - F.col("at")).alias("place")).agg(F.sum("weight").alias("weight"))
    totals = {t: sum(weight for _, u, _, weight in kept if u == t) for t in range(len(templates))}
    sums = spark.createDataFrame([(t, name, totals[t]) for t, (name, _, _) in enumerate(templates)], "template int, label string, total double")
    scored = aligned.join(F.broadcast(sums), "template").withColumn("score", F.least(F.lit(1.0), F.col("weight") / F.col("total")))
    best = scored.groupBy("doc_id", "text_hash", "label").agg(F.max(F.struct("score", -F.col("place"))).alias("top"))
    named = F.struct("label", F.col("top.score").alias("score"), (-F.col("top.col2")).alias("place"))
    found = best.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.when(F.col("top.score") >= least, named))).alias("found"), F.max("top.score").alias("score")
    )  # at most one entry for each label of the templates
    base, got = table.alias("base"), found.alias("got")
    same = F.expr("base.doc_id <=> got.doc_id") & (F.col("base.text_hash") == F.col("got.text_hash"))
    nothing = F.array().cast("array<struct<label:string,score:double,place:bigint>>")
    return base.join(got, same, "left").select(
        "base.doc_id", "n_words", "places", F.coalesce("found", nothing).alias("found"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
