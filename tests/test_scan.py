"""Scans by blocks against plain loops, whatever the blocks; no task gets a whole key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, outcomes, scan, windows

SPANS = [1, 7, 4096, 10**9]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", t, rng.choice([None, rng.randint(-9, 9)])) for t in range(400)]
    out += [(k, rng.randint(-50, 50), rng.choice([None, rng.randint(-9, 9)])) for k in ("a", "b", None) for _ in range(30)]
    return [(k, t, i, x) for i, (k, t, x) in enumerate(out)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "sym string, t long, seq long, x long").repartition(5)


def loop(rows, pick, ahead=False):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]), reverse=ahead)
        for n, r in enumerate(mine):
            out[r[2]] = pick([y[3] for y in mine[: n + 1] if y[3] is not None])
    return out


KINDS = {"sum": lambda v: sum(v) if v else None, "count": len, "max": lambda v: max(v, default=None), "min": lambda v: min(v, default=None), "last": lambda v: v[-1] if v else None, "first": lambda v: v[0] if v else None}


@pytest.mark.parametrize("span", SPANS)
def test_running_is_a_loop(frame, rows, span):
    found = scan.running(frame, ["sym"], ["t", "seq"], {k: (k, F.col("x")) for k in KINDS}, span).collect()
    for k, pick in KINDS.items():
        want = loop(rows, pick)
        assert {r["seq"]: r[k] for r in found} == {i: (v or 0 if k == "count" else v) for i, v in want.items()}


@pytest.mark.parametrize("span", SPANS)
def test_ahead_is_a_loop_backwards(frame, rows, span):
    found = scan.running(frame, ["sym"], ["t", "seq"], {"x2": ("first", F.col("x")), "s": ("sum", F.col("x"))}, span, ahead=True).collect()
    assert {r["seq"]: r["x2"] for r in found} == loop(rows, lambda v: v[-1] if v else None, ahead=True)
    assert {r["seq"]: r["s"] for r in found} == loop(rows, KINDS["sum"], ahead=True)


@pytest.mark.parametrize("span", SPANS)
def test_deepest_fall_is_a_loop(frame, rows, span):
    found = scan.deepest_fall(frame, ["sym"], ["t", "seq"], F.coalesce("x", F.lit(0)).cast("double"), span).collect()
    want = {}
    for k in {r[0] for r in rows}:
        total = peak = fall = 0
        for _, _, _, x in sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2])):
            total += x or 0
            peak = max(peak, total)
            fall = max(fall, peak - total)
        want[k] = fall
    assert {r["sym"]: r["fall"] for r in found} == want


def test_blocks_are_tasks_of_their_own(spark):
    """One symbol: its rows meet in no partition, so a skewed key is many tasks."""
    one = spark.range(20_000).select(F.lit("hot").alias("sym"), F.col("id").alias("t"), F.lit(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scan.running(one, ["sym"], ["t"], {"s": ("sum", F.col("x"))}, span=500).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("p").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 9_000
        assert found.where("s <> t + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("span", SPANS)
def test_asof_both_ways_and_sums(spark, frame, rows, span):
    rng = random.Random(9)
    left = [(k, rng.randint(-60, 420), i) for k in ("hot", "a", "none") for i in range(40)]
    asked = spark.createDataFrame([(k, t, i) for n, (k, t, i) in enumerate(left)], "sym string, at long, n long")
    right = frame.where("x is not null").select("sym", F.col("t").alias("ts"), "seq", "x")
    back = asof.asof(asked, right, F.col("at"), {"x": "v"}, order=["ts", "seq"], max_age=5, span=span).collect()
    strict = asof.asof(asked, right, F.col("at"), {"x": "v"}, order=["ts", "seq"], strict=True, span=span).collect()
    ahead = asof.asof_forward(asked, right, F.col("at"), {"x": "v"}, order=["ts", "seq"], within=5, span=span).collect()
    sums = asof.range_sum(asked, right, F.col("at") - 20, F.col("at"), "x", "s", span=span).collect()
    known = {k: sorted((t, i, x) for s, t, i, x in rows if s == k and x is not None) for k in ("hot", "a", "none")}

    def last(k, keep):
        found = [r for r in known[k] if keep(r[0])]
        return found[-1][2] if found else None

    def first(k, keep):
        found = [r for r in known[k] if keep(r[0])]
        return found[0][2] if found else None

    key = lambda r: (str(r["sym"]), r["at"], r["n"])
    plain = sorted((str(k), t, n) for k, t, n in left)
    fresh = lambda k, t: last(k, lambda s: s <= t) if known[k] and max((s for s, _, _ in known[k] if s <= t), default=-1e9) >= t - 5 else None
    assert [r["v"] for r in sorted(back, key=key)] == [fresh(k, t) for k, t, _ in plain]
    assert [r["v"] for r in sorted(strict, key=key)] == [last(k, lambda s, t=t: s < t) for k, t, _ in plain]
    assert [r["v"] for r in sorted(ahead, key=key)] == [first(k, lambda s, t=t: t < s) if any(t < s <= t + 5 for s, _, _ in known[k]) else None for k, t, _ in plain]
    assert [(r["s"], r["s_n"]) for r in sorted(sums, key=key)] == [(sum(x for s, _, x in known[k] if t - 20 < s <= t), sum(t - 20 < s <= t for s, _, _ in known[k])) for k, t, _ in plain]


def test_users_of_the_scan(spark):
    rng = random.Random(5)
    series = [("s", 3600 * t, rng.uniform(9, 11), rng.uniform(8, 9), rng.uniform(9, 11), rng.uniform(1, 5)) for t in range(200)]
    frame = spark.createDataFrame(series, "sym string, t long, high double, low double, close double, q double")
    got = {r["t"]: r["vwap"] for r in windows.anchored_vwap(frame, F.col("t") == 3600 * 50).collect()}
    q = b = 0.0
    for _, t, high, low, close, volume in series:
        if t < 3600 * 50:
            assert got[t] is None
            continue
        q, b = q + volume, b + volume / ((high + low + close) / 3)
        assert math.isclose(got[t], q / b)
    since, want = None, {}
    for _, t, _, _, close, _ in series:
        since = (since if since is not None else t) if close > 10 else None
        want[t] = since
    assert {r["t"]: r["since"] for r in windows.presence_start(frame, F.col("close") > 10).collect()} == want
    trades = spark.createDataFrame([("k", 5000 * i, i, rng.uniform(-0.4, 0.4)) for i in range(60)] + [("k", 9, 99, -1.5)], "sym string, since long, id long, net double")
    equity = peak = 1.0
    fall = 0.0
    for r in sorted(trades.collect(), key=lambda r: (r["since"], r["id"])):
        equity *= max(0.01, 1 + r["net"])
        peak = max(peak, equity)
        fall = max(fall, 1 - equity / peak)
    for span in (1, 7000, 10**9):
        assert math.isclose(outcomes.equity_drawdown(trades, ["sym"], ["since", "id"], span=span).first()["drawdown"], fall)
    points = spark.createDataFrame([("s", 100_000, 1.0), ("s", 300_000, 2.0)], "sym string, t long, v double")
    grid = frame.select("sym", "t")
    assert {r["t"]: r["v"] for r in bars.forward_fill(grid, points).collect()} == {t: 2.0 if t >= 300_000 else 1.0 for t in want}
