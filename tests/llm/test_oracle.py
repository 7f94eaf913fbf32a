"""Queries against their SQL on small tables with partial, shifted, repeated and tied cases."""

import random

import duckdb
import pytest

from ledgerlark.llm import licenses, queries
from tests.llm.test_neardup import corpus

rng = random.Random(21)


def license_texts():
    out = ["", "MIT License", "words only"]
    for label, notice, keys in licenses.TEMPLATES:
        words = notice.split()
        cut = rng.randint(1, len(words) - 2)
        out += [
            notice, " ".join(words[:-2]), " ".join(words[cut:] + words[:cut]), f"{notice} {notice}", " ".join([*words[:cut], "inserted", *words[cut:]]),
            " and ".join(keys), f"{keys[0]} {' '.join(rng.sample(words, len(words)))}", f"{' '.join(words[:cut])} filler {keys[0]} {' '.join(words[cut:])} cc by",
        ]
    return out + [f"{a} {b}" for a, b in zip(out[3:40:5], out[10:60:5])]


def vectors():
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], i % 3) for i in range(60)]
    near = [(100 + i, [x + rng.gauss(0, 0.05) for x in v], label) for i, (_, v, label) in enumerate(rows[:30])]
    return rows + near + [(200, None, 1), (201, [0.0] * 24, 1), (202, rows[0][1], None), (203, [2 * x for x in rows[1][1]], rows[1][2]), (204, [None] * 24, 1), (205, rows[5][1], rows[5][2])]


@pytest.mark.parametrize("name", ["op5_vectors", "op8_neardup", "op10_licenses"])
def test_query_equals_sql(spark, tmp_path, name):
    texts = license_texts() if name == "op10_licenses" else [t for _, t in corpus()]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>, label bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want.fetchall()))
