import hashlib
import zlib

import pytest

from ledgerlark.llm import merkle, queries

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def by_hand(rows):
    leaf = lambda r, text: digest(framed(r[0], r[3], r[2], r[4], text))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in names}
    trees = {s: levels([leaf(r, r[1]) for r in order[s]]) for s in names}
    above = levels([trees[s][-1][0] for s in names])
    root, out = above[-1][0], []
    for at, s in enumerate(names):
        for i, r in enumerate(order[s]):
            own = trees[s][0][i]
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now, beside = leaf(r, r[1].translate(LOW)) if tampered else own, ""
            for tree, k in ((trees[s], i), (above, at)):
                for nodes in tree[:-1]:
                    run, slot = nodes[k // 16 * 16 : k // 16 * 16 + 16], k % 16
                    beside += "".join(run[:slot] + run[slot + 1 :])
                    now, k = digest("".join(run[:slot]) + now + "".join(run[slot + 1 :])), k // 16
            out.append((r[0], own, trees[s][-1][0], root, digest(beside), now, now == root))
    return out


def got(spark, folder):
    return queries.op13_merkle(spark, str(folder)).select(*[c.split()[0] for c in merkle.FOLDED.split(", ")]).collect()


@pytest.mark.parametrize("sizes", [[1], [2, 16, 17], [0, 1, 255, 256, 257, 300], [5000, 3]])
def test_query_equals_trees_by_hand(spark, tmp_path, sizes):
    rows = [(1000 * s + 3 * k, f"Text {k} É" * (k % 4) or None, "en" if k % 3 else None, f"s{s}" if s else None, k if k % 5 else None) for s, n in enumerate(sizes) for k in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' as key", "1 as i").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, map(tuple, got(spark, tmp_path)))) == sorted(map(str, by_hand(rows)))


def test_null_ids_repeated_rows_long_texts_and_odd_sources(spark, tmp_path):
    rows = [(None, "A", "en", "a", 1), (None, "A", "en", "a", 1), (7, "B" * 300_000, "de", "a", 2), (7, "C", "de", "a", 2)] + [(k, "Same", None, "", 4) for k in range(40)]
    rows += [(k, "Ä", "x", name, None) for k, name in enumerate(["é", "z", "Z", "a\x00b", "日本"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, map(tuple, got(spark, tmp_path)))) == sorted(map(str, by_hand(rows)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(spark, tmp_path) == []


def test_a_parent_resumes_the_state_before_a_slot():
    kids = [f"{k:064x}".encode() for k in range(16)]
    parent = merkle.Parent(kids)
    for slot in range(16):
        assert parent.resumed(slot, kids[slot]) == parent.digest
        other = b"".join(kids[:slot] + [b"f" * 64] + kids[slot + 1 :])
        assert parent.resumed(slot, b"f" * 64).decode() == hashlib.sha256(other).hexdigest()
        assert parent.siblings(slot) == b"".join(kids[:slot] + kids[slot + 1 :])
