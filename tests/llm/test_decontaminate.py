import random
import re
from collections import Counter

from ledgerlark.llm import decontaminate

rng = random.Random(4)
word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
ITEMS = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([15, 20, 20, 33, 57, 40])] + [(6, "tiny item"), (7, None), (8, "!!!"), (9, "one two " * 12)]


def texts():
    filler = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", "###", filler(300), ITEMS[3][1], filler(3000) + "\n" + ITEMS[4][1].upper().replace(" ", "*** ") + filler(20), filler(10) + " Tiny, ITEM " + filler(5)]
    for i in (0, 1, 3, 4, 5, 9):
        parts = ITEMS[i][1].split()
        out += [filler(20) + " " + " ".join(parts[cut : len(parts) - back]) + " " + filler(20) for cut, back in ((0, 0), (1, 1), (2, 0), (0, 3), (6, 6))]
        out += [" ".join(parts[:-1]), filler(4) + " " + " ".join([*parts[:10], word(), *parts[11:]]), " ".join(parts) + " " + filler(9) + " " + " ".join(parts)]
    return out


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(text, item):
    words, goal = re.findall(r"\w+", (text or "").lower()), re.findall(r"\w+", (item or "").lower())
    best = 0
    for s in range(max(1, len(words) - len(goal) + 1)):
        a, b = shingles(words[s : s + len(goal)]), shingles(goal)
        best = max(best, (a & b).total() / ((a | b).total() or 1) if a and b else 0)
    return best


def test_finds_what_comparing_all_windows_finds(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(4, rows[4][1], 0)], "doc_id bigint, text string, start int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, n_words int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, i): s for d, t in rows for i, x in ITEMS if (s := brute(t, x)) >= 0.8}
    assert len(want) > 20 and {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    shuffled = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, most_broadcast=0).collect()}
    assert shuffled == set(want)


def test_finds_reordered_parts(spark):
    filler = lambda n: " ".join(word() for _ in range(n))
    bench, texts_ = [], []
    for i in range(30):
        parts = [word() for _ in range(rng.randint(60, 120))]
        cut = rng.choice([len(parts) // 2, len(parts) // 3, 9])
        bench.append((i, " ".join(parts)))
        texts_ += [f"{filler(40)} {' '.join(parts[cut:] + parts[:cut])} {filler(40)}", " ".join(parts[cut:] + parts[:cut])]
    rows = list(enumerate(texts_)) + [(None, texts_[0])]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    want = {(d, i): round(s, 9) for d, t in rows for i, x in bench if (s := brute(t, x)) >= 0.8}
    assert len(want) > 40 and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a document")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, none).collect() == [] and decontaminate.clean(docs, none).count() == 1
    assert decontaminate.clean(docs.where("false"), none).collect() == []


def test_blocks_guarantee_radius():
    edges = decontaminate.block_edges(20)
    assert len(edges) == 21 and sum(n for _, n in edges) == 64
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 20):
            b ^= 1 << bit
        assert any((a >> lo) % (1 << n) == (b >> lo) % (1 << n) for lo, n in edges)
