"""Paper arms and replays against literal cases and plain loops."""

from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.operators import arms as A
from tidemark.operators import replay as R
from tidemark.plans import books as book_plans

SETTINGS = A.Settings(fee=0.0)


def arm(name, **k):
    return A.Arm(A.LADDERS.get(name, A.LADDERS["A"]), A.Settings(fee=0.0, **k), name == "confirmed")


def actions(rows):
    return [(r[0], r[1]) for r in rows]


def test_arm_a_sells_in_parts_at_the_targets():
    a = arm("A")
    assert actions(a.sweep(0, {"X": 100.0}, ["X"])) == [("X", "open")]
    assert a.open["X"]["size"] == pytest.approx(10_000 * 0.01 / 3)
    assert [(r[1], r[2], r[3]) for t, px in ((1, 104.5), (2, 109.0), (3, 120.0)) for r in a.sweep(t, {"X": px}, [])] == [("tp1", 104.0, 0.5), ("tp2", 108.0, 0.3), ("tp3", pytest.approx(115.0), pytest.approx(0.2))]
    assert not a.open and a.equity == pytest.approx(10_000 + 100 / 3 * (0.5 * 4 + 0.3 * 8 + 0.2 * 15))


def test_arm_b_stops_at_the_entry_and_keeps_a_rest():
    b = arm("B")
    b.sweep(0, {"X": 100.0}, ["X"])
    assert actions(b.sweep(1, {"X": 111.0}, [])) == [("X", "tp1")]
    (row,) = b.sweep(2, {"X": 99.0}, [])
    assert row[1:5] == ("stop", 100.0, pytest.approx(0.7), pytest.approx(0.0))
    b.sweep(3, {"X": 100.0}, ["X"])
    b.sweep(4, {"X": 160.0}, [])
    assert b.open["X"]["left"] == pytest.approx(0.65)
    assert b.sweep(3 + 2 * 48 * 3600, {"X": 112.0}, [])[0][1] == "tp1"
    assert actions(b.sweep(4 + 2 * 48 * 3600, {"X": 105.0}, [])) == [("X", "timeout")]


def test_arm_c_is_all_out_at_nine_percent_and_closes_before_it_opens():
    c = arm("C", most_open=1)
    c.sweep(0, {"X": 100.0}, ["X"])
    assert [(r[0], r[1]) for r in c.sweep(1, {"X": 110.0, "Y": 5.0}, ["Y"])] == [("X", "tp3"), ("Y", "open")]
    assert c.sweep(2, {"Y": float("nan"), "X": 1.0}, ["X"]) == []


def test_confirmed_waits_for_a_later_sweep():
    k = arm("confirmed", most_open=1)
    assert actions(k.sweep(0, {"X": 100.0, "Y": 1.0, "Z": 1.0}, ["X", "Y", "Z"])) == [("X", "queued"), ("Y", "queued"), ("Z", "queued")]
    assert actions(k.sweep(900, {"X": 101.0, "Y": 1.0}, [])) == [("X", "filled"), ("X", "open"), ("Y", "capacity")]
    assert actions(k.sweep(45 * 60 + 1, {"Z": 1.0}, [])) == [("Z", "expired")]
    k.sweep(5000, {"Z": 1.0}, ["Z"])
    assert actions(k.sweep(5900, {"Z": 1.0}, ["Z"], enabled=False)) == [("Z", "expired")] and "X" in k.open


def test_arms_against_a_loop(spark, sf):
    settings = A.Settings(fill_within=86400)
    rows = sorted(map(tuple, book_plans.arm_sweeps(spark, sf).collect()), key=lambda r: r[:3])
    want = []
    for name in ("A", "B", "C", "confirmed"):
        for book, of_book in groupby(rows, key=lambda r: r[0]):
            own = A.Arm(A.LADDERS.get(name, A.LADDERS["A"]), settings, name == "confirmed")
            for t, sweep in groupby(of_book, key=lambda r: r[1]):
                last = {r[3]: r for r in sweep}
                found = own.sweep(t, {s: r[4] for s, r in last.items()}, [s for s, r in last.items() if r[5]], all(r[6] for r in last.values()))
                want += [(book, name, t, i, *x) for i, x in enumerate(found)]
    got = A.arms(book_plans.arm_sweeps(spark, sf).repartition(7), settings)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[5] for r in want} >= {"open", "stop", "tp1", "queued", "filled", "expired"}
    lines = A.blotter_lines(got)
    assert lines.count() == sum(r[5] not in ("queued", "filled", "expired", "capacity") for r in want) and lines.where("opened IS NULL OR opened > at").isEmpty()


def test_cells_are_a_quarter_off():
    cells = {c.name: c for c in R.robustness_cells(R.Cell())}
    assert len(cells) == 22 and cells["q4-low"].q4 == 2.25 and cells["band-high"].band == 0.625 and cells["expiry-36h"].expiry == 36 * 3600
    assert cells["age-max-high"].age == (4, 95) and cells["age-min-low"].age == (3, 80) and cells["fall-max-high"].fall[1] == 0.25 and cells["momentum-low"].rise4 == pytest.approx(0.045)


CAND = "id string, cell string, sym string, since long, px double, level double, atr double, trough_low double, q1 double, q4 double, least_q4 double, band double, expiry long, charge double, confirm string"
BAR = "sym string, t long, high double, low double, close double, next_t long, next_open double, q1 double, q4 double"


def watch(spark, bars, confirm="band", expiry=24 * 3600):
    e = spark.createDataFrame([("e", "c", "A", 0, 99.0, 100.0, 2.0, 90.0, 1.0, 5.0, 3.0, 0.5, expiry, 0.003, confirm)], CAND)
    b = spark.createDataFrame([("A", (i + 1) * 3600, h, low, c, (i + 2) * 3600, 7.0, q1, q4) for i, (h, low, c, q1, q4) in enumerate(bars)], BAR)
    return {r["arm"]: (r["terminal"], r["fill_px"]) for r in R.variant_watches(e, b, 3600, 36 * 3600).collect()}


@pytest.mark.parametrize(
    ("bars", "confirm", "quantity", "price"),
    [
        ([(101.0, 99.0, 100.5, 1.0, 4.0)], "band", ("confirmed", 7.0), ("confirmed", 7.0)),
        ([(101.0, 99.0, 100.5, 1.0, 2.0)], "band", ("oi-rejected", None), ("confirmed", 7.0)),
        ([(101.0, 99.0, 100.5, None, None), (101.0, 99.0, 100.5, 1.0, 4.0)], "band", ("confirmed", 7.0), ("confirmed", 7.0)),
        ([(104.0, 99.0, 100.5, 1.0, 4.0)], "band", ("missed", None), ("missed", None)),
        ([(105.0, 99.0, 104.5, 1.0, 4.0)], "breakout-only", ("confirmed", 7.0), ("confirmed", 7.0)),
        ([(104.0, 99.0, 100.5, 1.0, 4.0)], "breakout-only", ("expired", None), ("expired", None)),
        ([(104.0, 80.0, 89.0, 1.0, 4.0)], "breakout-or-band", ("invalidated", None), ("invalidated", None)),
    ],
)
def test_variant_watch(spark, bars, confirm, quantity, price):
    assert watch(spark, bars, confirm) == {"quantity": quantity, "price": price}


def test_variant_watch_expires_first(spark):
    assert watch(spark, [(104.0, 80.0, 89.0, 1.0, 4.0)], expiry=7200) == {"quantity": ("expired", None), "price": ("expired", None)}


def test_references_against_marks(spark):
    marks = spark.createDataFrame([("A", t, px) for t, px in ((900, 100.0), (1800, 104.0), (2700, 109.0), (3600, 96.0), (5400, 120.0))], "sym string, t long, px double")
    signals = spark.createDataFrame([("s", "A", 1000), ("early", "A", 0), ("none", "B", 0)], "id string, sym string, ts long")
    at = {r["id"]: r["anchor_t"] for r in R.anchored(signals, marks).collect()}
    assert at == {"s": 900, "early": 900, "none": None}
    anchored = R.anchored(signals, marks).where("id = 's'")
    r = R.marked_returns(anchored, marks, (1,)).first()
    assert (r["last"], r["peak"], r["covered"]) == (pytest.approx(-4.0), pytest.approx(9.0), True)
    r = R.mark_ladder(anchored, marks, (0.04, 0.08, 0.15), -0.03).first()
    assert (r["hits"], r["stop_h"], r["end"]) == (2, pytest.approx(2600 / 3600), pytest.approx(-4.0))
    assert R.lead_over_proxy(signals.where("id = 's'"), marks.where("px > 110")).first()["lead_h"] == pytest.approx(4400 / 3600)


def test_verdict_names_what_fails(spark):
    rows = spark.createDataFrame([("base", 5, 1, 9, 0.1, -0.1, 0.1, 0.1, 2.0, False), ("x", 9, 1, 9, 0.1, 0.1, 0.1, 0.1, 2.0, True)], "cell string, confirms long, coins long, days long, net_event double, net_coin double, lead_event double, lead_coin double, lift double, passed boolean")
    r = R.verdict(rows, confirms=5, coins=2, days=9).first()
    assert not r["passed"] and r["reasons"] == "coins; net-coin; robustness: base"


def test_cooldown_is_of_each_cohort(spark):
    rows = spark.createDataFrame([("A", t, 1.0, t > 0) for t in (0, 10, 86400, 90000)], "sym string, t long, close double, f boolean")
    out = {(r["cohort"], r["since"]) for r in R.cohorts(rows, {"all": "true", "late": "f"}, 86400).collect()}
    assert out == {("all", 0), ("all", 86400), ("late", 10), ("late", 90000)}
    assert R.cohorts(rows, {"all": "true"}).agg(F.count("*")).first()[0] == 4
