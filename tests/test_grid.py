"""The three clocks: literal cases at each border of the rules, blocks, causality, missing feeds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators import grid as G
from tidemark.operators import windows as W

#: A row on which the rule just holds, and changes that each just close it.
FINE = {
    "early-pump": (
        dict(i=288, hi288=102.0, lo288=90.0, below=2.0, pos288=0.5, rise12=True, ret4=5.0, z288=1.5),
        [dict(i=287), dict(below=1.99), dict(below=12.01), dict(pos288=0.49), dict(rise12=False), dict(ret4=0.0), dict(ret4=5.01), dict(z288=1.49), dict(hi288=90.0), dict(z288=None), dict(hi288=None)],
    ),
    "ignition": (
        dict(i=12, ret3=6.0, ret12=60.0, q=300_000.0, blast=3.0),
        [dict(i=11), dict(ret3=5.99), dict(ret12=60.01), dict(q=299_999.0), dict(blast=2.99), dict(blast=None), dict(ret12=None)],
    ),
}
MIDDLE = {
    "spot-led-pump": (dict(i=59, ret4h=0.02, oi4h=1.49, spot_z=2.0, basis=0.05), [dict(i=58), dict(ret4h=0.0199), dict(oi4h=1.5), dict(oi4h=-1.5), dict(oi4h=None), dict(spot_z=1.99), dict(spot_z=None), dict(basis=0.051), dict(basis=None)]),
    "stealth-accumulation": (dict(i=59, ret4h=0.0099, oi4h=-1.99, spot_ratio=1.5, spot_buy=0.55), [dict(ret4h=0.01), dict(ret4h=-0.01), dict(oi4h=2.0), dict(spot_ratio=1.49), dict(spot_ratio=None), dict(spot_buy=0.549), dict(oi4h=None)]),
}
_BASE = dict(i=31, oi_max=100.0, oi=92.0, oi_then=91.5, base_low=100.0, base_high=105.9, funding=0.01, close=107.0, vol_z=1.5, ls_drop=5.0, rs24=2.0)
_NOT_BASE = [dict(i=30), dict(oi=92.1), dict(oi_then=91.6), dict(base_high=106.01), dict(funding=0.0101), dict(funding=-0.0101), dict(oi=None), dict(funding=None), dict(oi_max=None)]
_SURGE = dict(i=25, close=101.0, hi24=100.0, vol_z=1.5, oi4h=3.0, ret4h=0.06, flush=8.0, oi24h=8.0)
_TOP = dict(i=32, ret24h=0.15, pos24=0.8, vol_z=1.5, high=100.0, close=99.0, open=99.0, twin_high=100.0, hi24=99.0, wick=0.5, oi4h=-1.5, prev_z=2.5, prev_pos=0.85, prev_low=99.5, funding=0.015, f8h=0.014, ret4h=0.01)
_NOT_TOP = [dict(i=31), dict(ret24h=0.149), dict(pos24=0.79), dict(vol_z=1.49)]
HOURLY = {
    "early-setup": (_BASE, _NOT_BASE),
    "flush-breakout": (_BASE, [*_NOT_BASE, dict(close=105.9), dict(vol_z=1.49)]),
    "early-accum": (_BASE, [*_NOT_BASE, dict(ls_drop=4.99), dict(rs24=1.99), dict(ls_drop=None), dict(rs24=None)]),
    "rebuild-1": (_SURGE, [dict(i=24), dict(close=100.0), dict(vol_z=1.49), dict(oi4h=2.99), dict(oi4h=None), dict(flush=7.99), dict(flush=None)]),
    "rebuild-2": (_SURGE, [dict(ret4h=-0.0001), dict(ret4h=0.0601), dict(oi4h=2.99)]),
    "virgin-2": (_SURGE | dict(flush=7.99), [dict(flush=8.0), dict(flush=None), dict(oi24h=7.99), dict(oi4h=2.99)]),
    "top-1": (_TOP, [*_NOT_TOP, dict(twin_high=98.9), dict(twin_high=101.1), dict(close=99.1), dict(open=98.9)]),
    "top-2": (_TOP, [*_NOT_TOP, dict(hi24=100.0), dict(wick=0.49), dict(oi4h=-1.49), dict(oi4h=None)]),
    "top-3": (_TOP, [*_NOT_TOP, dict(prev_z=2.49), dict(prev_pos=0.849), dict(prev_low=99.0)]),
    "top-4": (_TOP, [*_NOT_TOP, dict(funding=0.0149), dict(f8h=0.015), dict(f8h=None), dict(ret4h=0.0101)]),
    "organic-spot": (dict(ret4h=0.02, spot_buy4=0.551, basis=0.0, spot24=10.0, perp24=10.0), [dict(ret4h=0.0199), dict(spot_buy4=0.55), dict(basis=0.01), dict(spot24=9.9), dict(spot24=None)]),
    "leverage-froth": (dict(funding=0.01, basis=0.1, spot24=4.9, perp24=10.0), [dict(funding=0.0099), dict(basis=0.09), dict(spot24=5.0), dict(basis=None)]),
}


@pytest.mark.parametrize("rules, cases", [(G.fine_rules, FINE), (G.middle_rules, MIDDLE), (G.hourly_rules, HOURLY)], ids=["fine", "middle", "hourly"])
def test_rules_at_their_borders(spark, rules, cases):
    rules = rules()
    assert set(rules) == set(cases)
    names = sorted({c for row, _ in cases.values() for c in row})
    every = sorted({"i", "close", "high", "open", "q", "funding", "oi", "hi288", "lo288", *names} | {"below", "pos288", "rise12", "ret4", "z288", "ret3", "ret12", "blast", "ret4h", "oi4h", "spot_z", "basis", "spot_ratio", "spot_buy"} | {c for row, _ in HOURLY.values() for c in row})
    schema = ", ".join(["sym string", "t long", *(f"{c} {'boolean' if c == 'rise12' else 'int' if c == 'i' else 'double'}" for c in every)])
    rows, want, at = [], set(), 0
    for rule, (row, closing) in cases.items():
        for n, change in enumerate([{}, *closing]):
            rows.append((rule, at, *[(row | change).get(c) for c in every]))
            if n == 0:
                want.add((rule, at))
            at += 1
    found = G.fired(spark.createDataFrame(rows, schema), rules).where("sym = detector")
    assert {(r["sym"], r["t"]) for r in found.collect()} == want


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(2)
    rows, px = [], {"a": 100.0, "b": 5.0}
    for k in px:
        for n in range(1500):
            if rng.random() < 0.1:
                continue
            o = px[k]
            c = o * (1 + rng.gauss(0, 0.01))
            rows.append((k, 300 * n, o, max(o, c) * 1.002, min(o, c) * 0.998, c, rng.uniform(1, 9), rng.choice([None, 1.0])))
            px[k] = c
    return spark.createDataFrame(rows, "sym string, t long, open double, high double, low double, close double, q double, tq double").repartition(3)


@pytest.fixture(scope="module")
def feeds(bars):
    oi = bars.select("sym", (F.col("t") + 17).alias("ts"), (F.col("close") * 10).alias("value"))
    funding = bars.where("t % 28800 = 0").select("sym", F.col("t").alias("ts"), (F.col("q") / 1000).alias("value"))
    return G.Feeds(oi, funding, oi, bars.select("sym", "t", (F.col("close") * 0.999).alias("close"), F.col("q"), (F.col("q") / 2).alias("tq")))


def table(df):
    return {(r["sym"], r["t"]): {c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in df.collect()}


def near(a, b):
    return a.keys() == b.keys() and all(a[k].keys() == b[k].keys() and all(x == b[k][c] or (isinstance(x, float) and isinstance(b[k][c], float) and abs(x - b[k][c]) <= 1e-6 * max(1, abs(x))) for c, x in a[k].items()) for k in a)


def test_small_blocks_change_nothing_and_the_future_neither(bars, feeds):
    rows = G.with_feeds(bars, feeds)
    middle, hour = G.coarser(rows, G.MIDDLE), G.coarser(rows, G.HOUR)
    for compute, own in ((lambda b, r: G.fine(r, b), rows), (lambda b, r: G.middle(r, b), middle), (lambda b, r: G.hourly(r, "b", b), hour)):
        whole = table(compute(W.BLOCK, own))
        assert near(table(compute(400, own)), whole)
        cut = own.where("t < 300000")
        assert near(table(compute(W.BLOCK, cut)), {k: v for k, v in whole.items() if k[1] < 300000})


def test_no_feed_no_signal(bars):
    rows = G.with_feeds(bars, G.Feeds())
    assert rows.where("oi IS NOT NULL OR funding IS NOT NULL OR ls IS NOT NULL OR spot_q IS NOT NULL").count() == 0
    hour = G.hourly(G.coarser(rows, G.HOUR), "b")
    read = {"early-setup", "flush-breakout", "early-accum", "rebuild-1", "rebuild-2", "virgin-2", "top-2", "top-4", "organic-spot", "leverage-froth"}
    assert not {r["detector"] for r in G.fired(hour, G.hourly_rules(G.WIDE)).collect()} & read
    assert G.fired(G.middle(G.coarser(rows, G.MIDDLE)), G.middle_rules(G.WIDE)).count() == 0


def test_feeds_reach_a_bar_by_its_close_and_grow_old(spark):
    bars = spark.createDataFrame([("a", t, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for t in (0, 300, 600, 9000)], "sym string, t long, open double, high double, low double, close double, q double, tq double")
    oi = spark.createDataFrame([("a", 300, 5.0), ("a", 301, 6.0), ("a", 900, 7.0), ("a", 901, 9.0)], "sym string, ts long, value double")
    got = {r["t"]: r["oi"] for r in G.with_feeds(bars, G.Feeds(oi=oi, ages=(7200, 1, 1))).collect()}
    assert got == {0: 5.0, 300: 6.0, 600: 7.0, 9000: None}


def test_a_coarse_bar_is_seen_once_it_closed(spark):
    fine = spark.createDataFrame([("a", t) for t in (3000, 3300, 3600, 6600, 6900)], "sym string, t long")
    hour = spark.createDataFrame([("a", 0, 1.0), ("a", 3600, 2.0)], "sym string, t long, close double")
    got = {r["t"]: r["h_close"] for r in G.seen(fine, hour, G.HOUR, ["close"], "h_").collect()}
    assert got == {3000: None, 3300: 1.0, 3600: 1.0, 6600: 1.0, 6900: 2.0}


@pytest.mark.parametrize("n, skip", [(1, 0), (3, 1), (7, 0), (16, 2), (50, 4)])
def test_slide_is_a_frame(spark, n, skip):
    rng = random.Random(n)
    values = {s: [rng.choice([None, rng.uniform(-5, 5)]) for _ in range(rng.choice([1, n, 60]))] for s in "abc"}
    frame = spark.createDataFrame([(s, i, i, v) for s, x in values.items() for i, v in enumerate(x)], "sym string, t long, __i long, x double")
    kinds = ("max", "min", "sum", "count", "z")
    got = {(r["sym"], r["t"]): [r[k] for k in kinds] for r in W.slide(frame, n, {k: (k, F.col("x")) for k in kinds}, skip).collect()}
    for s, x in values.items():
        for i, v in enumerate(x):
            own = [y for y in x[max(0, i - skip - n + 1) : max(0, i - skip + 1)] if y is not None]
            mean = sum(own) / len(own) if own else None
            sd = (sum((y - mean) ** 2 for y in own) / len(own)) ** 0.5 if own else None
            high, low, total, count, z = got[s, i]
            assert (high, low) == (max(own, default=None), min(own, default=None)) and (count or 0) == len(own)
            assert (total is None) == (not own) and abs((total or 0) - sum(own)) < 1e-9
            if own and v is not None:
                assert abs(z - ((v - mean) / sd if sd > 1e-12 else 0)) < 1e-6


@pytest.mark.parametrize("n", [1, 5, 20])
def test_slide_fall_is_a_frame(spark, n):
    rng = random.Random(n)
    x = [rng.uniform(1, 9) for _ in range(70)]
    frame = spark.createDataFrame([("a", i, i, v) for i, v in enumerate(x)], "sym string, t long, __i long, x double")
    got = {r["t"]: r["fall"] for r in W.slide_fall(frame, n, "x", "fall").collect()}
    for i in range(70):
        own, peak, fall = x[max(0, i - n + 1) : i + 1], 0.0, 0.0
        for v in own:
            peak = max(peak, v)
            fall = min(fall, v / peak - 1)
        assert abs(got[i] - fall) < 1e-12


@pytest.mark.parametrize("block", [1, 5, 64, 4096])
def test_averages_in_blocks_are_the_recurrence(spark, block):
    rng = random.Random(block)
    x = [rng.uniform(1, 9) for _ in range(300)]
    frame = spark.createDataFrame([("a", 60 * i, v) for i, v in enumerate(x)] + [("short", 0, 1.0)], "sym string, t long, close double").repartition(3)
    got = {(r["sym"], r["t"]): r for r in folds.emas(frame, {"quick": 2, "slow": 50}, block=block).collect()}
    for name, n in (("quick", 2), ("slow", 50)):
        y, k = None, 2 / (n + 1)
        for i, v in enumerate(x):
            y = None if i < n - 1 else sum(x[:n]) / n if i == n - 1 else v * k + y * (1 - k)
            assert y is None and got["a", 60 * i][name] is None or abs(got["a", 60 * i][name] - y) < 1e-9
        assert got["short", 0][name] is None


def test_a_rise_from_a_price_of_zero_is_infinite(spark):
    """As in the queries' SQL: a ramp from 0 is a ramp, a rise from 0 to 0 is no number."""
    closes = [10.0] * 13 + [0.0] * 3 + [10.0, 10.0, 10.0, 0.0]
    schema = "sym string, t long, open double, high double, low double, close double, q double, tq double"
    bars = spark.createDataFrame([("a", i * 300, c, max(c, 1.0), c, c, 30.0 if i == 16 else 1.0, 0.5) for i, c in enumerate(closes)], schema)
    rows = G.fine(G.with_feeds(bars, G.Feeds()))
    got = {r["t"] // 300: r for r in rows.collect()}
    assert got[16]["ret3"] == float("inf") and got[17]["ret4"] == float("inf") and got[19]["ret4"] != got[19]["ret4"]
    assert [(r["t"] // 300, r["detector"]) for r in G.fired(rows, G.fine_rules(G.WIDE)).collect()] == [(16, "ignition")]
