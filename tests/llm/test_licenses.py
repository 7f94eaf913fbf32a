import re

from ledgerlark.llm import licenses
from ledgerlark.llm.queries import op10_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    hits = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, places string")


def test_base_matches_brute_force_on_edge_texts(spark, tmp_path):
    texts = [
        None, "", "   ", "MIT License", "the MIT-License, then CC BY-NC 4.0 cc by", "cc bye", "xcc by", "É MIT\nLICENSE mit license mit license",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "word " * 50_000 + "mit license",
    ]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "MIT License", None, None), (None, "cc by", None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted([(i, *brute(t)) for i, t, _, _ in rows], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == want
    by = {r.doc_id: r for r in got}
    assert "gpl-3.0" in by[8].labels.split(",") and "gpl" in by[8].labels.split(",")
    assert "apache-2.0" in by[9].labels.split(",")
    assert "cc-by-nc" in by[4].labels.split(",") and "cc-by-nc" not in by[5].labels
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.labels for r in got if r.doc_id == 3} == {"mit"}


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).count() == 0


def test_template_without_base_phrase(spark):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    [row] = licenses.scan(docs(spark, [(1, "intro words " + text, None, None)])).collect()
    assert [f.label for f in row.found] == ["bsd"] and row.found[0].place == 2


def test_many_notices_in_one_text(spark):
    notices = {}
    for label, notice, _ in licenses.TEMPLATES:
        notices.setdefault(label, []).append(notice)
    apache, mit, bsd = notices["apache-2.0"][0], notices["mit"][0], notices["bsd"][0]
    every = " filler words here ".join(n for group in notices.values() for n in group)
    texts = [every, f"{apache} {mit} {bsd}", f"{mit} then {bsd} " * 20]
    rows = licenses.scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: {f.label: round(f.score, 9) for f in r.found} for r in rows}
    assert got[0] == dict.fromkeys(notices, 1.0)
    assert {k: v for k, v in got[1].items() if k in ("apache-2.0", "mit", "bsd")} == {"apache-2.0": 1.0, "mit": 1.0, "bsd": 1.0}
    assert got[2]["mit"] == got[2]["bsd"] == 1.0


def test_versions_and_identifiers_are_told_apart(spark):
    texts = {
        "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
    }
    rows = licenses.scan(docs(spark, [(k, t, None, None) for k, t in enumerate(texts.values())])).collect()
    for r, label in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        found = {f.label: f.score for f in r.found}
        assert label in found and found[label] > 0.99 and not {"agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1"} - {label} & set(found), (label, found)
