import hashlib
import random
import re
import zlib

import duckdb

from ledgerlark.llm import queries, repair

EDITS = {"D": 4, "I": 3, "K": 0, "R": 3}


def cheapest(codes):
    """(cost, audit) by least (cost, audit) in each state of the grammar: nothing yet, after s, u expected, a expected."""
    put = lambda states, to, way: states.__setitem__(to, min(states.get(to, way), way))
    now = {"": (0, "")}
    for k in range(len(codes) + 1):
        for _ in range(2):  # at most two turns are inserted at one place
            for state, (cost, audit) in list(now.items()):
                put(now, {"": "a", "s": "a", "u": "a", "a": "u"}[state], (cost + 3, audit + "I"))
        if k == len(codes):
            break
        code, after = codes[k], {}
        for state, (cost, audit) in now.items():
            put(after, state, (cost + 4, audit + "D"))
            if code & 8:
                continue
            kind, more = code & 3, 3 if code & 4 else 0
            wanted = 1 if state == "a" else 0
            to = "u" if state == "a" else "a"
            put(after, to, (cost + more, audit + "K") if kind == wanted else (cost + more + 3, audit + "R"))
            if state == "" and kind == 2:
                put(after, "s", (cost + more, audit + "K"))
        now = after
    return min(now[s] for s in ("", "u") if s in now)


def test_alignment_equals_the_cheapest_way_through_the_grammar():
    rng = random.Random(5)
    for _ in range(4000):
        codes = bytes(rng.choice([0, 0, 0, 1, 1, 1, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randint(0, 9)))
        assert repair.aligned(codes) == cheapest(codes), list(codes)
    for size in (60, 300, 700):  # several blocks of the table
        codes = bytes((k & 1 if rng.random() < 0.8 else rng.randint(0, 3)) | rng.choice([0] * 8 + [4, 8]) for k in range(size))
        assert repair.aligned(codes) == cheapest(codes)


def by_hand(rows):
    """Rows of the query for conversations given as (conv_id, turn, role, text)."""
    convs, out = {}, {}
    for row in rows:
        convs.setdefault(row[0], []).append(row)
    show = lambda x: " " if x is None else str(x)
    for conv, held in convs.items():
        kept = []
        for _, turn, role, text in sorted(held, key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text, fate = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            if fate:
                text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
                kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, codes, seen = [0, 0, 0], [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append({"u": 0, "a": 1, "s": 2}.get(role[:1], 3) | {0: 8, 1: 8, 2: 4, None: 0}[fault])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = cheapest(codes)
        lines, at, wanted = [], 0, "user"
        for edit in audit:
            if edit == "I":
                lines.append(f"{wanted}:")
            else:
                _, role, text = kept[at]
                at += 1
                if edit == "D":
                    continue
                role = wanted if edit == "R" else role
                lines.append(f"{role}:{text}")
                if role[:1] == "s":
                    continue
            wanted = "assistant" if wanted == "user" else "user"
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_equals_a_repair_by_hand(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Hello there.", "What?", "no end", "", " \t", "tail. ", "x" * 200_000 + "!", "né ünï。", None]
    rows = [(conv, turn * (1 + conv % 2), rng.choice(["user", "assistant", "system", "tool", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2], rng.choice(texts))
            for conv in range(120) for turn in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "a."), (None, None, "user", "b."), (500, None, "system", "c."), (600, 3, "", "d")]
    rows += [(700, k, ("user", "assistant")[k % 2], "same." if k % 3 else f"t{k}.") for k in range(400)]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "1 as cost", "'x' as key").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    assert got == by_hand(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op12_repair"]).fetchall()} == got
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_lines_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, "user", "hi."), (1, 2, "user", "you?"), (2, 1, "assistant", "end")], "conv_id long, turn long, role string, text string").selectExpr("*", "0 as copy")
    turns = repair.keyed(rows)
    lines = repair.repaired(turns, repair.structure(turns)).collect()
    assert sorted((r["key"], r["position"], r["line"]) for r in lines) == [("1", 1, "user:hi."), ("1", 2, "assistant:you?")]
    assert repair.report(repair.keyed(rows.limit(0))).collect() == []
