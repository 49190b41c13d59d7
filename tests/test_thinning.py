"""Greedy thinning by segments, blocks and pointer doubling against a loop; one key in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import thinning


def loop(rows):
    out, ends = [], {}
    for k, t, until, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in ends or t >= ends[k]:
            out.append((k, t, until))
            ends[k] = until
    return sorted(out, key=str)


@pytest.mark.parametrize("most, block, span", [(10**9, 4096, 10**9), (0, 4096, 10**9), (0, 3, 50), (0, 16, 7)])
def test_thinning_is_a_loop(spark, most, block, span):
    rng = random.Random(block)
    rows = []
    for k, n, top, last in (("dense", 250, 300, 40), ("sparse", 40, 4000, 30), (None, 60, 200, 90), ("mixed", 120, 900, 400)):
        for _ in range(n):
            t = rng.randrange(top)
            rows.append((k, t, t + rng.randint(1, last), len(rows)))
    frame = spark.createDataFrame(rows, "k string, t long, until long, n long").repartition(3)
    got = thinning.thin(frame, ["k"], "t", F.col("until"), most=most, block=block, span=span)
    assert sorted(((r["k"], r["t"], r["until"]) for r in got.collect()), key=str) == loop(rows)
    assert got.columns == frame.columns


@pytest.mark.parametrize("most", [10**9, 0])
def test_cooldown_of_two_keys(spark, most):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1, None]), rng.randrange(500)) for _ in range(150)]
    frame = spark.createDataFrame(rows, "a string, b int, t long")
    got = sorted(map(str, thinning.cooldown(frame, 60, ["a", "b"], most=most, block=5, span=100).collect()))
    want, last = [], {}
    for a, b, t in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2])):
        if (a, b) not in last or t - last[a, b] >= 60:
            want.append(f"Row(a={a!r}, b={b!r}, t={t!r})")
            last[a, b] = t
    assert got == sorted(want)


def test_nothing_to_thin(spark):
    empty = spark.createDataFrame([], "k string, t long")
    assert thinning.cooldown(empty, 5, ["k"]).collect() == [] and thinning.cooldown(empty, 5, ["k"], most=-1).collect() == []
