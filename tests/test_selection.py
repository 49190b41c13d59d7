"""Exact selection by counting against sorted lists: few parts, few rows a part, ties, nulls, extreme values, one key in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes, selection

RANKS = {"first": lambda n: 0, "p25": lambda n: int(0.25 * (n - 1) + 0.5), "low": lambda n: (n - 1) // 2, "high": lambda n: n // 2, "last": lambda n: n - 1}


def columns():
    n = F.col("n")
    return {"first": F.lit(0), "p25": F.floor(0.25 * (n - 1) + 0.5), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "last": n - 1}


@pytest.mark.parametrize("parts, few", [(32, 0), (100, 3), (1024, 50_000)])
def test_ranks_of_sorted_lists(spark, parts, few):
    rng = random.Random(parts)
    values = {
        "ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(200)], "one": [5.0], "same": [4.0] * 50, None: [rng.gauss(0, 1) for _ in range(101)], "skewed": [10.0 ** rng.uniform(-12, 12) for _ in range(150)],
        "extreme": [-1.7e308, 1.7e308, 0.0, 1e-300, -5.0], "unknown": [None, float("nan")], "mixed": [None, float("nan"), 3.0, -1.0],
    }
    frame = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k string, x double").repartition(4)
    got = {r["k"]: r for r in selection.at_ranks(frame, ["k"], "x", columns(), parts, few).collect()}
    for k, x in values.items():
        own = sorted(v for v in x if v is not None and v == v)
        if not own:
            assert k not in got
            continue
        assert got[k]["n"] == len(own) and [got[k][name] for name in RANKS] == [own[at(len(own))] for at in RANKS.values()]


def test_one_key_is_counted_in_many_tasks(spark):
    """A pass moves counts only: what is shuffled doesn't grow with the rows."""
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    found = selection.at_ranks(rows, ["k"], "x", {"low": F.floor((F.col("n") - 1) / 2)}, parts=64, few=1000).first()
    own = sorted((i * 7919 % 200_003) for i in range(200_000))
    assert found["low"] == own[99_999]


def test_summary_has_the_median(spark):
    rows = spark.createDataFrame([("p", "a", 0, v) for v in (0.1, -0.2, 0.3, 0.4)], "policy string, sym string, since long, net double")
    assert outcomes.summary(rows, ["policy"]).first()["median"] == pytest.approx(0.2)
