"""Regime scores, risk flags, remediation filters and squeezes: literal cases worked by hand, one at each border."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import deep
from tidemark.operators import detectors as D

NAMES = ["pos", "change1h", "ret4h", "oi4h", "funding", "vol_z", "buy_share"]
#: inputs in the order of NAMES -> (pump, accumulate, distribute), worked by hand
SCORES = [
    ((0.5, 2.0, 0.05, 5.0, 0.01, 2.0, 0.75), (1.2 + 0.9 + 0.8 + 0.5 + 0.6 - 0.8, 0.6 * (0.2 / 0.35) + 0.8 * 1.2 + 0.7 * -1 + 0.4 * -1 + 0.3, 0.0)),
    ((0.95, -1.2, -0.02, -2.5, 0.05, 2.0, 0.3), (1.2 * -0.6 + 0.9 * -0.4 + 0.8 - 0.25 - 0.6 - 0.8, 0.6 * -0.4 + 0.8 * (-2.5 / 3) + 0.7 * -0.5 + 0.4 * -1, 0.9 + 1.0 + 0.8 + 0.5 + 0.5 + 0.3)),
    ((0.2, 0.0, 0.0, 3.0, 0.0199, 0.0, 0.55), (0.3 - 0.8, 0.6 * 1.2 + 0.8 + 0.7 + 0.4 + 0.3, 0.0)),
    ((0.5, 100.0, 9.0, 99.0, 0.045, -9.0, 1.0), (1.2 * 1.5 + 0.9 * 1.5 - 0.4 + 0.75 + 0.6 * 1.5 - 0.8, 0.6 * (0.2 / 0.35) + 0.96 - 0.7 - 0.4, 0.0)),
]


def test_regime_scores(spark):
    rows = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(SCORES)], ", ".join(["n int", *(f"{c} double" for c in NAMES)]))
    scores = S.regime_scores(*[F.col(c) for c in NAMES])
    found = rows.select("n", *[c.alias(n) for c, n in zip(scores, ("p", "a", "d"))], S.regime(*scores).alias("r")).orderBy("n").collect()
    for r, (_, (p, a, d)) in zip(found, SCORES):
        assert (r["p"], r["a"], r["d"]) == pytest.approx((p, a, d), abs=1e-9)
    assert [r["r"] for r in found] == ["P", "D", "A", "P"]


@pytest.mark.parametrize(
    "change, flags",
    [
        ({}, []), ({"funding": 0.05}, []), ({"funding": 0.0501}, ["funding-overheated"]), ({"oi4h": 20.0}, []), ({"oi4h": 20.1}, ["oi-too-fast"]), ({"oi4h": None}, []), ({"ret4h": 0.12}, []), ({"ret4h": 0.121}, ["far-above-entry"]),
        ({"pos": 0.73, "vol_z": 1.01, "change1h": -0.1}, ["stall-at-high"]), ({"pos": 0.72, "vol_z": 1.01, "change1h": -0.1}, []), ({"pos": 0.73, "vol_z": 1.0, "change1h": -0.1}, []), ({"pos": 0.73, "vol_z": 1.01, "change1h": 0.0}, []),
        ({"buy_share": 0.42}, []), ({"buy_share": 0.419, "funding": 0.06}, ["funding-overheated", "buyers-gone"]),
    ],
)
def test_risk_flags(spark, change, flags):
    row = dict(zip(NAMES, (0.5, 1.0, 0.01, 1.0, 0.0, 0.0, 0.5))) | change
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in NAMES))
    assert rows.select(S.risk_flags(F.lit("P"), *[F.col(c) for c in NAMES]).alias("x")).first()["x"] == flags


_IN = ["ret1h", "ret4h", "ret24h", "bench24h", "pos", "oi4h", "rate", "taker1h", "volume_ratio", "strength"]
_LONG = dict(ret1h=0.01, ret4h=0.06, ret24h=0.01, bench24h=0.0, pos=0.65, oi4h=0.1, rate=0.0001, taker1h=0.52, volume_ratio=1.2, strength=55.0)
_SHORT = dict(ret1h=-0.01, ret4h=-0.01, ret24h=-0.5, bench24h=0.0, pos=0.65, oi4h=0.1, rate=0.0, taker1h=0.48, volume_ratio=1.2, strength=85.0)
FILTERS = {
    "trend-aligned": (_LONG, [dict(ret4h=0.0), dict(ret24h=0.0), dict(bench24h=-0.001), dict(bench24h=None)], _SHORT, [dict(ret4h=0.0), dict(bench24h=0.001), dict(ret24h=None)]),
    "flow-confirmed": (_LONG | dict(oi4h=0.15, rate=0.0003), [dict(ret1h=0.0), dict(oi4h=0.151), dict(oi4h=-0.001), dict(rate=0.00031), dict(taker1h=0.519), dict(rate=None)], _SHORT, [dict(ret1h=0.0), dict(oi4h=0.151), dict(rate=-0.0001), dict(taker1h=0.481)]),
    "uncrowded-trend": (_LONG, [dict(ret4h=0.061), dict(ret4h=0.0), dict(bench24h=-0.001), dict(oi4h=0.101), dict(rate=0.00011)], _SHORT, [dict(ret4h=0.0), dict(bench24h=0.001), dict(oi4h=-0.001), dict(rate=-0.0001)]),
    "reversal-confirmed": (_LONG | dict(ret24h=-0.01), [dict(ret24h=0.0), dict(ret1h=0.0), dict(pos=0.651), dict(oi4h=-0.001)], _SHORT | dict(ret24h=0.01), [dict(ret24h=0.0), dict(ret1h=0.0), dict(pos=0.649), dict(oi4h=None)]),
    "participation-quality": (_LONG, [dict(volume_ratio=1.19), dict(strength=54.9), dict(strength=85.1), dict(ret1h=0.0), dict(taker1h=0.519), dict(strength=float("nan"))], _SHORT, [dict(volume_ratio=1.19), dict(strength=85.1), dict(taker1h=0.481), dict(strength=None)]),
}


def test_remediation_filters(spark):
    rows, want = [], {}
    for name, (long, no_long, short, no_short) in FILTERS.items():
        for side, base, closing in (("long", long, no_long), ("short", short, no_short)):
            for n, change in enumerate([{}, *closing]):
                want[len(rows)] = (name, n == 0)
                rows.append((len(rows), side, *[(base | change)[c] for c in _IN]))
    frame = spark.createDataFrame(rows, ", ".join(["n int", "side string", *(f"{c} double" for c in _IN)]))
    found = frame.select("n", *[c.alias(name) for name, c in D.remediation(F.col("side")).items()]).collect()
    assert {r["n"]: r[want[r["n"]][0]] for r in found} == {n: passes for n, (_, passes) in want.items()}


def test_squeezes_by_a_loop(spark):
    import random

    rng, rows, px = random.Random(1), [], 100.0
    for t in range(160):
        move = rng.gauss(0, 0.05 if t < 70 or t > 130 else 0.0015)
        o, px = px, px * (1 + move)
        rows.append(("a", t, o, max(o, px) + 0.4, min(o, px) - 0.4, px, rng.uniform(1, 9)))
    frame = spark.createDataFrame(rows, "sym string, t long, open double, high double, low double, close double, q double")
    got = {r["t"]: r for r in deep.squeeze_definitions(frame).collect()}
    width, band = {}, {}
    for i in range(19, 160):
        own = [r[5] for r in rows[i - 19 : i + 1]]
        mean = sum(own) / 20
        width[i] = round(4 * (sum((x - mean) ** 2 for x in own) / 20) ** 0.5 / mean, 9)
        ranges = [max(r[3] - r[4], abs(r[3] - p), abs(r[4] - p)) for r, p in ((rows[j], rows[j - 1][5] if j else rows[j][2]) for j in range(i - 19, i + 1))]
        band[i] = sum(ranges) / 20 / mean
    for i in range(160):
        far, near, nine = ([width[j] for j in range(i - n + 1, i + 1) if j in width] for n in (48, 8, 9))
        w = width.get(i)
        assert got[i]["d1"] == (w is not None and len(far) >= 24 and sum(x <= w for x in far) / len(far) <= 0.1)
        assert got[i]["d2"] == (w is not None and w <= 0.35 * max(nine))
        assert got[i]["d3"] == (w is not None and w <= 3 * band[i])
        assert got[i]["d4"] == (w is not None and len(near) >= 8 and sum(x <= w for x in near) / len(near) <= 0.15)
    assert all(any(r[d] for r in got.values()) for d in ("d1", "d2", "d3", "d4"))


_SHADOW = dict(trades=100, coins=40, days=20, months=1, net_mean=0.0001, matched_lift=1.3, least_sensitivity=1.1501, positive_folds=0, bootstrap_lower=None, stress_mean=None, max_drawdown=0.5, top_sym_share=1.0, top_day_share=1.0)
_PAPER = dict(trades=200, coins=60, days=60, months=3, net_mean=0.0001, matched_lift=None, least_sensitivity=None, positive_folds=3, bootstrap_lower=0.0001, stress_mean=0.0001, max_drawdown=0.1, top_sym_share=0.1, top_day_share=0.2)


@pytest.mark.parametrize(
    "stage, base, closing",
    [
        ("shadow", _SHADOW, {"trades": 99, "coins": 39, "days": 19, "expectancy": ("net_mean", 0.0), "matched-lift": ("matched_lift", 1.29), "sensitivity": ("least_sensitivity", 1.15)}),
        ("paper", _PAPER, {"trades": 199, "coins": 59, "days": 59, "months": 2, "expectancy": ("net_mean", 0.0), "walk-forward": ("positive_folds", 2), "bootstrap": ("bootstrap_lower", 0.0), "stress": ("stress_mean", None), "drawdown": ("max_drawdown", 0.101), "one-coin": ("top_sym_share", 0.101), "one-day": ("top_day_share", 0.201)}),
    ],
)
def test_promotion_rules_at_their_borders(spark, stage, base, closing):
    from tidemark.operators import research

    cases = [({}, [])] + [({name: x} if not isinstance(x, tuple) else {x[0]: x[1]}, [name]) for name, x in closing.items()]
    rows = [(n, *[(base | change)[k] for k in base]) for n, (change, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "n int, " + ", ".join(f"{k} {'long' if k in ('trades', 'coins', 'days', 'months', 'positive_folds') else 'double'}" for k in base))
    found = research.promotion(frame, research.stage_rules(stage)).orderBy("n").collect()
    assert [r["reasons"] for r in found] == [reasons for _, reasons in cases] and [r["passed"] for r in found] == [not reasons for _, reasons in cases]
