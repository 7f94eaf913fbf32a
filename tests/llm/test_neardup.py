import random
import re

import numpy as np
import pytest

from ledgerlark.llm import neardup
from ledgerlark.llm.components import components


def brute_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def closure(ids, links):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    links = []
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.append((i, j))
    return {i: (len(sets[i]), c) for i, c in closure(list(sets), links).items()}


def corpus():
    rng, rows = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    for g in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 20, 40, 90, 200, 700]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                spot = rng.randrange(len(copy))
                copy[spot : spot + rng.choice([0, 1])] = [word()] if rng.random() < 0.7 else []
            rows.append((" " * rng.choice([1, 2])).join(copy) if rng.random() < 0.9 else "\t".join(copy).upper())
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n\t"), (903, rows[0]), (904, "long words " * 30_000), (905, "a b c"), (906, "A b  c")]


def test_equals_comparison_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert len(set(c for _, c in want.values())) < len(want) - 20
    assert got == want


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n = int(rng.choice([4, 5, 6, 7, 9, 10, 11, 15, 16, 24, 40, 61, 100, 300]))
        a = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 8 + 1))
        b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), np.int64).astype(np.uint64))))
        if near(a, b) and (len(a) != len(b) or (a != b).any()):
            at = np.cumsum([0, len(a), len(b)])
            sig, row = neardup.signatures(np.concatenate((a, b)), at, 80)
            assert np.intersect1d(sig[row == 0], sig[row == 1]).size


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "other words stand alone here now"), (7, None), (7, None)], "doc_id bigint, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()], key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (None, 2, None), (7, 0, 7), (7, 0, 7)], key=str)
    assert neardup.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)] + [(60, 61), (None, 3)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)


def near(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("block", [16, 512])
def test_signatures_that_many_share_and_blocks(spark, block):
    """Over 64 sets with one signature in a lot, and more members than a block holds."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, line = [word() for _ in range(60)], [word() for _ in range(12)]
    rows = [(i, " ".join([*base[: 60 - i % 9], word()])) for i in range(150)]
    rows += [(200 + i, " ".join([*line, *(word() for _ in range(4))])) for i in range(90)]
    rows += [(300 + i, " ".join([*line, *(word() for _ in range(3))])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    assert neardup.read_texts(docs, 5, 80, slots=4).where("kind = 1").count() > 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, block=block, slots=4).collect()}
    assert got == brute(rows)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), np.int64).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, len(a))) :], rng.integers(0, 1 << 63, int(rng.integers(1, 300)), np.int64).astype(np.uint64))))
        at = np.cumsum([0, len(a), len(b)])
        drawn = neardup.sketches(np.concatenate((a, b)), at)
        width = np.array([min(map(len, drawn)) // 8] * 2)
        words, to = neardup.folded(np.frombuffer(b"".join(drawn), np.uint64), np.cumsum([0, *(len(x) // 8 for x in drawn)]), width)
        assert neardup.differences(words, to, width, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_sets_of_chunks_are_those_of_single_texts():
    texts = [t for _, t in corpus()] + ["", " ", None, "A\u00e9\u3000b c", "x", "x ", " x y", "a b c d", "a b c d e", "q" * 700_000]
    want = [len(brute_set(t)) for t in texts]
    import pyarrow as pa

    got, alone = [], [neardup.shingle_set(t) for t in texts]
    for lo, hi, raw, bounds in neardup.chunks(pa.array(texts).slice(0), most=3000):
        elements, at = neardup.shingle_sets(raw, bounds)
        for i in range(lo, hi):
            mine = elements[at[i - lo] : at[i - lo + 1]]
            assert (mine == alone[i]).all()
            got.append(len(mine))
    assert got == want
