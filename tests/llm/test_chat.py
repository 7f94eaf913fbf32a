from collections import defaultdict

import duckdb

from ledgerlark.llm.queries import OP3_SQL, op3_preferences

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "héllo 😀"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "héllo 😀"), (2, 2, "user", "less"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "bye"), (3, 1, "assistant", "bye"), (4, 0, "user", "hi"),
    (5, 1, "assistant", "yes"), (5, 0, "system", None), (6, 0, "system", None), (6, 1, None, ""), (7, 0, "user", "alone"),
    (8, 0, "user", "hi"), (8, 1, "assistant", "bye"), (20, 0, "user", "q"), (20, 1, "assistant", "one é"), (21, 0, "user", "other"), (21, 1, "assistant", "two"), (22, 0, "system", "s"), (22, 1, "assistant", "two"), (None, 0, "user", "hi"), (9, None, "user", "hi"), (10, 0, "user", "long " * 50_000), (11, 0, "user", "long " * 50_000), (11, 1, "assistant", "x"),
]


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None and t is not None:
            convs[c].add((t, r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    first, out = {}, {}
    for c in sorted(convs):
        a = first.setdefault(convs[c][0], c)
        if convs[c] != convs[a]:
            n = 0
            while n < min(len(convs[a]), len(convs[c])) and convs[a][n] == convs[c][n]:
                n += 1
            out[a, c] = (n, *(render(x) for x in (convs[a][:n], convs[a][n:], convs[c][n:])))
    return out


def render(turns):
    text, spans = "", []
    for r, x in turns:
        text += f"<|{r}|>\n"
        if r == "assistant":
            spans.append((len(text), len(text) + len(x) + 7))
        text += f"{x}<|end|>\n"
    return text, spans


def test_equals_sql(spark, tmp_path):
    spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, n int").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(OP3_SQL)
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in op3_preferences(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.fetchall()) and len(got) == 7


def test_equals_brute_force(spark, tmp_path):
    spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, n int").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = op3_preferences(spark, str(tmp_path)).collect()
    got = {(r.chosen_id, r.rejected_id): r for r in rows if r.kind == "opening"}
    replies = {(r.chosen_id, r.rejected_id): r for r in rows if r.kind == "reply"}
    assert set(replies) == {(20, 21)} and replies[20, 21].prompt == "<|user|>\nq<|end|>\n" and replies[20, 21].rejected == "<|assistant|>\ntwo<|end|>\n"
    want = brute(ROWS)
    assert set(got) == set(want) == {(1, 2), (1, 3), (1, 4), (1, 8), (5, 6), (10, 11)}
    for key, (n, (prompt, _), (chosen, cm), (rejected, rm)) in want.items():
        r = got[key]
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, prompt, chosen, rejected)
        assert r.chosen_mask == ",".join(f"{a}:{b}" for a, b in cm) and r.rejected_mask == ",".join(f"{a}:{b}" for a, b in rm)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op3_preferences(spark, str(tmp_path)).collect() == []
