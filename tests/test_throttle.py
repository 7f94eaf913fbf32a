import random
from datetime import datetime, timedelta

import pytest

from ledgerlark.operators import gates, throttle

START = datetime(2026, 1, 1)


def by_hand(rows, seconds, limit):
    """Events of (key, at, id), one after another."""
    out, now = set(), {}
    for key, at, id_ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        opened, n = now.get(key, (None, 0))
        opened, n = (at, 1) if opened is None or at - opened >= timedelta(seconds=seconds) else (opened, n + 1)
        now[key] = opened, n
        out.add((key, id_, opened, n, n <= limit))
    return out


@pytest.mark.parametrize("block", [7, 100_000])
def test_windows_equal_a_fold_of_each_key(spark, monkeypatch, block):
    monkeypatch.setattr(throttle, "BLOCK", block)
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", START + timedelta(seconds=rng.choice([rng.randint(0, 3000), 60 * rng.randint(0, 40)])), k) for k in range(400)]
    rows += [("same", START, k) for k in range(1000, 1040)]
    events = spark.createDataFrame([*rows, (None, START, 1), ("x", None, 2)], "key string, at timestamp, id long").repartition(3)
    got = throttle.anchored_windows(events, "key", "at", "id", 60, 4).collect()
    assert {(r.key, r.id, r.opened, r.position, r.accepted) for r in got} == by_hand(rows, 60, 4) and len(got) == len(rows)
    assert throttle.anchored_windows(events.limit(0), "key", "at", "id").collect() == []


def test_repeated_keys_of_several_rules(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", "x"), (2, "a", "x"), (2, "a", "x")], "i int, s string, n string")
    found = gates.repeated_by_rule(rows, {"one": ["i"], "both": ["i", "s"], "null": ["n"], "all": ["i", "s", "n"]})
    assert {r.rule: r.failures for r in found.collect()} == {"one": 3, "both": 2, "null": 3, "all": 2}
    assert {r.failures for r in gates.repeated_by_rule(rows.limit(0), {"one": ["i"]}).collect()} == {0}
