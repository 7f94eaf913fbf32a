import math

import numpy as np

from ledgerlark.llm import vectors


def brute(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float), label) for i, v, label in rows if usable(v, label)]
    links, count = [], {i: 0 for i, _, _ in rows}
    for a, (i, v, la) in enumerate(good):
        for j, w, lb in good[a + 1 :]:
            if la == lb and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    from tests.llm.test_neardup import closure

    return {i: (count[i], c) for i, c in closure([i for i, _, _ in rows], links).items()}


def test_equals_comparison_of_all_pairs(spark):
    rng, rows = np.random.default_rng(2), []
    for g in range(12):
        centre = rng.standard_normal(16)
        for k in range([1, 2, 5, 30, 700][g % 5]):
            v = (centre + rng.standard_normal(16) * 0.08 * (g % 3)).astype(np.float32)
            rows.append((len(rows), [float(x) for x in v], g % 2))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, rows[0][1], None), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame([(i, v, label, 0) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    want = brute(rows)
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in got)
    assert found >= 0.99 * true and sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(want)
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004, 5005)] == [(0, i) for i in (5000, 5001, 5002, 5003, 5004, 5005)]
    assert got[5006] == (1, 5006) == (got[5007][0], got[5007][1])


def test_copies_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    frame = spark.createDataFrame([(3, v, 1), (3, v, 1), (None, v, 1), (9, [1.0, 2.0, 3.1], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()], key=str)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (9, 3, 3, False)], key=str)
    assert vectors.near_duplicates(frame.where("false")).collect() == []


def test_recall_of_pairs_near_the_threshold(spark):
    rng, rows = np.random.default_rng(4), []
    for _ in range(400):
        v, other = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 48)))
        other = other - (other @ v) * v
        cosine = rng.uniform(0.931, 0.97)
        w = cosine * v + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
        rows += [(len(rows), v.tolist(), 1), (len(rows) + 1, w.tolist(), 1)]
    rows += [(len(rows) + i, v.tolist(), i % 2) for i, v in enumerate(rng.standard_normal((1500, 48)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    linked = [got[2 * k + 1] == (1, 2 * k) for k in range(400)]
    assert sum(linked) >= 0.95 * 400
    assert all(got[i][0] == 0 for i in range(800, len(rows)))


def test_index_grows_slowly():
    shapes = [vectors.index_shape(n, 0.93, 2.0, 0.97) for n in (1000, 50_000, 10**9)]
    assert [p for _, p in shapes] == sorted(p for _, p in shapes) and shapes[1][0] < 60 and shapes[2][0] < 500
