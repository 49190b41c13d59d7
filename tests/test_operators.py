"""Operators against literal cases and plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, bars, books, detectors, evidence, folds, outcomes, research, windows, thinning
from tidemark.plans import books as book_plans
from tidemark.plans.windows import with_interest
from tidemark.sources import logs
from tidemark.sources.tables import event_bars, ticks
from tidemark.streaming.watches import DeepWatch, EntryWatch, decision

BAR = "sym string, t long, open double, high double, low double, close double, q double, tq double"


def flat(spark, closes, highs=None, lows=None, sym="A", step=3600):
    rows = [(sym, i * step, c, (highs or closes)[i], (lows or closes)[i], c, 1.0, 0.5) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def event(spark, px=100.0):
    return spark.createDataFrame([("e", "A", -3600, px)], "id string, sym string, since long, px double")


def test_time_exit(spark):
    b = flat(spark, [100.0] * 23 + [100.5])
    r = outcomes.time_exit(event(spark), b.withColumn("t", F.col("t")), 3600, 24 * 3600).first()
    assert r["terminal"] == "time-exit" and r["gross"] == pytest.approx(0.005) and r["net"] == pytest.approx(0.002)
    assert outcomes.time_exit(event(spark), b.where("t <> 7200"), 3600, 24 * 3600).first()["terminal"] == "insufficient-data"


def test_stop_comes_first_within_a_bar(spark):
    b = flat(spark, [100.0] * 24, [110.0] + [100.0] * 23, [96.0] + [100.0] * 23)
    r = outcomes.ladder(event(spark), b, 3600, 24 * 3600).first()
    assert r["terminal"] == "stop" and r["gross"] == pytest.approx(-0.03)
    assert outcomes.first_touch(event(spark), b, 24 * 3600).first()["t1"] is None


def test_ladder_in_order(spark):
    b = flat(spark, [100.0] * 24, [100.0, 104.0, 108.0, 115.0] + [100.0] * 20)
    r = outcomes.ladder(event(spark), b, 3600, 24 * 3600).first()
    assert r["terminal"] == "ladder-complete" and r["gross"] == pytest.approx(0.074)


def test_clock_rollup_rejects_conflicts_and_gaps(spark):
    b = flat(spark, [1.0, 2.0, 3.0] * 3, step=300)
    out = {r["t"]: r["close"] for r in bars.rollup_clock(b.union(b.where("t = 0")), 900, 3).collect()}
    assert out == {0: 3.0, 900: 3.0, 1800: 3.0}
    conflict = b.where("t = 300").withColumn("close", F.lit(9.0)).withColumn("high", F.lit(9.0))
    assert {r["t"] for r in bars.rollup_clock(b.union(conflict).where("t <> 1200"), 900, 3).collect()} == {1800}
    assert {r["t"] for r in bars.rollup_clock(b, 900, 3, now=1800).collect()} == {0, 900}


def test_forward_fill(spark):
    grid = spark.createDataFrame([("A", t) for t in (0, 10, 20)] + [("B", 0)], "sym string, t long")
    points = spark.createDataFrame([("A", 5, 1.0), ("A", 20, 2.0)], "sym string, t long, v double")
    assert sorted(map(tuple, bars.forward_fill(grid, points).collect())) == [("A", 0, 1.0), ("A", 10, 1.0), ("A", 20, 2.0), ("B", 0, 0.0)]


def plain_ema(x, period):
    out, k, y = [], 2 / (period + 1), None
    for i, v in enumerate(x):
        if i == period - 1:
            y = sum(x[:period]) / period
        elif i >= period:
            y = v * k + y * (1 - k)
        out.append(y)
    return out


@pytest.mark.parametrize("block", [7, 20, 4096])
def test_ema_over_blocks(spark, block):
    x = np.random.default_rng(0).uniform(1, 100, 90).tolist()
    out = folds.ema(flat(spark, x).union(flat(spark, [1.0] * 5, sym="B")), 20, block=block).orderBy("sym", "t").collect()
    assert [r["ema"] for r in out if r["sym"] == "B"] == [None] * 5
    for got, want in zip([r["ema"] for r in out if r["sym"] == "A"], plain_ema(x, 20), strict=True):
        assert got == pytest.approx(want) if want is not None else got is None


def test_cooldown(spark):
    rows = [("a", t) for t in (0, 5, 10, 14, 21, 21, 40)] + [("b", 3)]
    out = thinning.cooldown(spark.createDataFrame(rows, "sym string, t long"), 10, ["sym"])
    assert sorted(map(tuple, out.collect())) == [("a", 0), ("a", 10), ("a", 21), ("a", 40), ("b", 3)]


def test_asof_never_reads_the_future(spark):
    left = spark.createDataFrame([("A", 10), ("A", 20), ("B", 10)], "sym string, t long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 19, 2.0), ("A", 21, 3.0)], "sym string, ts long, v double")
    at = lambda **k: sorted(tuple(r) for r in asof.asof(left, right, F.col("t"), {"v": "v"}, **k).collect())
    assert at() == [("A", 10, 1.0), ("A", 20, 2.0), ("B", 10, None)]
    assert at(strict=True)[0] == ("A", 10, None) and at(max_age=0)[1] == ("A", 20, None)
    late = right.union(spark.createDataFrame([("A", 30, 9.0)], right.schema))
    assert sorted(map(tuple, asof.asof(left, late, F.col("t"), {"v": "v"}).collect())) == at()


def test_features_are_causal_and_order_free(spark, sf):
    b = event_bars(spark, sf)
    cut = 1705276800
    b = with_interest(b)
    whole = windows.strength(windows.atr(b)).where(F.col("t") < cut).select("sym", "t", F.round("atr", 9), F.round("strength", 9))
    part = windows.strength(windows.atr(b.where(F.col("t") < cut).orderBy(F.rand(3)))).select(*whole.columns[:2], F.round("atr", 9), F.round("strength", 9))
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


def test_rising_edge_by_global_slot(spark):
    rows = [("A", 0, True), ("B", 0, False), ("B", 1, True), ("A", 2, True), ("B", 2, True), ("A", 3, True)]
    out = outcomes.rising_edges(spark.createDataFrame(rows, "sym string, t long, f boolean"), F.col("f"))
    assert sorted((r["sym"], r["t"]) for r in out.collect()) == [("A", 0), ("A", 2), ("B", 1)]


def test_matched_lift_without_control_hits(spark):
    row = "id long, success boolean, seq long"
    p, c = spark.createDataFrame([(1, True, 0), (2, False, 0), (3, True, 0)], row), spark.createDataFrame([(1, True, 0), (1, False, 1), (2, False, 0)], row)
    r = research.matched_lift(p, c).first()
    assert r["eligible"] == 2 and r["lift"] == float("inf")


def test_bootstrap_against_a_loop(spark):
    rows = [("k", d, v) for d in range(8) for v in (d / 10, 0.5)]
    df = spark.createDataFrame(rows, "key string, day long, value double")
    a, b = (research.block_bootstrap(df.repartition(n), ["key"], ["day"], rounds=100).first() for n in (1, 5))
    rng, means, sums = research.Mulberry(7), [], [d / 10 + 0.5 for d in range(8)]
    for _ in range(100):
        pick = [int(rng.next() * 8) for _ in range(8)]
        means.append(sum(sums[i] for i in pick) / 16)
    assert a["lower"] == b["lower"] == pytest.approx(sorted(means)[5]) and a["blocks"] == b["blocks"] == 8
    assert research.block_bootstrap(df.where("day < 3"), ["key"], ["day"]).first()["lower"] is None


def test_rounds_share_draws_and_chunks(spark, monkeypatch):
    """Block sums in several chunks, shares that cut sections, and a stream so short that rounds read the same draws."""
    rows = [("k", d, d * 37 % 11 / 10) for d in range(40)] + [("l", d, d / 7) for d in range(23)]
    df = spark.createDataFrame(rows, "key string, day long, value double")
    monkeypatch.setattr(research, "CHUNK", 9)
    monkeypatch.setattr(research, "DRAWS", 7)
    monkeypatch.setattr(research, "PERIOD", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        pieces = research._pieces(df.groupBy("key", "day").agg(F.sum("value").alias("s"), F.count("*").alias("n")), ["key"], ["day"])
        assert pieces.agg(F.max("__n")).first()[0] <= 4 and pieces.where("key = 'k'").agg(F.sum("__n"), F.max("__len")).first() == (40, 40)
        got = {r["key"]: r["lower"] for r in research.block_bootstrap(df, ["key"], ["day"], rounds=50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    draws = research.mulberry(7, 0, 64)
    for key in "kl":
        own = [v for k, _, v in rows if k == key]
        means = sorted(sum(own[int(draws[(i * len(own) + j) % 64] * len(own))] for j in range(len(own))) / len(own) for i in range(50))
        assert got[key] == pytest.approx(means[2])


def test_draws_at_once_are_the_stream(spark):
    rng = research.Mulberry(11)
    stream = [rng.next() for _ in range(300)]
    assert research.mulberry(11, 0, 300).tolist() == stream and research.mulberry(11, 120, 50).tolist() == stream[120:170]


def test_paired_bounds_against_a_loop(spark):
    rows = [("k", f"s{i % 6}", 86400 * (i % 4) + 7 * i, (i * 37 % 11) / 10) for i in range(60)] + [("few", "s0", 0, 1.0)]
    out = {r["key"]: r for r in research.paired_bounds(spark.createDataFrame(rows, "key string, sym string, since long, value double"), ["key"], rounds=120).collect()}
    days, coins = {}, {}
    for key, sym, since, value in rows[:60]:
        days.setdefault((sym, since // 86400), []).append(value)
        coins.setdefault(sym, []).append(value)
    days, coins = [days[k] for k in sorted(days)], [sum(coins[k]) / len(coins[k]) for k in sorted(coins)]
    rng, event, coin = research.Mulberry(7), [], []
    for _ in range(120):
        picked = [v for _ in days for v in days[int(rng.next() * len(days))]]
        event.append(sum(picked) / len(picked))
        coin.append(sum(coins[int(rng.next() * len(coins))] for _ in coins) / len(coins))
    got = out["k"]
    assert (got["event_blocks"], got["coin_blocks"]) == (len(days), 6)
    assert got["event_lower"] == pytest.approx(sorted(event)[6]) and got["coin_lower"] == pytest.approx(sorted(coin)[6])
    assert out["few"]["event_lower"] is None and out["few"]["coin_blocks"] == 1


def test_weighted_cost_and_active_days_against_loops(spark):
    from tidemark.operators import deep

    rng = np.random.default_rng(4)
    charges = [("A" if i % 3 else "B", int(t), float(i % 7)) for i, t in enumerate(rng.integers(0, 500, 80))]
    positions = [(i, "AB"[i % 2], int(t), int(t) + 90, [(int(t) + int(c), p) for c, p in zip(rng.integers(-5, 120, 2), (0.5, 0.25), strict=True)]) for i, t in enumerate(rng.integers(0, 450, 40))]
    p = spark.createDataFrame(positions, "id long, sym string, entry long, exit long, cuts array<struct<ts:long,part:double>>")
    got = {r["id"]: r["cost"] for r in deep.weighted_cost(p, spark.createDataFrame(charges, "sym string, ts long, rate double")).collect()}
    want = {i: sum(r * (1 - sum(part for at, part in cuts if at < t)) for s, t, r in charges if s == sym and a <= t <= b) for i, sym, a, b, cuts in positions}
    assert got == {i: pytest.approx(v) for i, v in want.items()}
    spans = [(i, int(a), int(a) + int(n)) for i, (a, n) in enumerate(zip(rng.integers(0, 60, 25), rng.integers(0, 9, 25), strict=True))]
    days = {r["day"]: r["members"] for r in evidence.active_days(spark.createDataFrame(spans, "member long, first long, last long")).collect()}
    assert days == {d: n for d in range(80) if (n := sum(a <= d <= b for _, a, b in spans))}


def test_features_by_blocks_are_the_same(spark, sf):
    """Blocks of 150 bars, with the rows before them, give what one block of all bars gives; row numbers hold over stretches."""
    from tidemark.operators import features

    b = event_bars(spark, sf)
    numbers = windows.indexed(b, span=5 * 86400).select("sym", "t", "__i")
    want = b.withColumn("__i", windows.index()).select("sym", "t", F.col("__i").cast("long"))
    assert sorted(map(tuple, numbers.collect())) == sorted(map(tuple, want.collect()))
    plain = lambda df: sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())
    one, many = (plain(features.feature_rows(b, tolerance=0.3, block=n)) for n in (100_000, 150))
    assert one == many and len(one) == b.count()


def test_bottoms_against_a_loop(spark):
    rng = np.random.default_rng(2)
    low = np.round(100 + np.cumsum(rng.normal(0, 2, 160)), 1)
    high, close = low + np.round(rng.uniform(0, 3, 160), 1), low + np.round(rng.uniform(0, 1, 160), 1)
    close[60:] = high[60:] + 4 * (rng.random(100) < 0.3)
    rows = [("A", 3600 * i, *map(float, (low[i], high[i], low[i], close[i], 1, 0.5))) for i in range(160)]
    got = [(r["w_neck"], r["w_spring"]) for r in windows.bottoms(spark.createDataFrame(rows, BAR), 0.02).orderBy("t").collect()]
    want = []
    for i in range(160):
        least = lambda j: 1 <= j < i and low[j] <= low[j - 1] and low[j] <= low[j + 1]  # noqa: B023, E731
        neck = spring = False
        if i >= 29:
            for j in range(i - 6, i):
                for k in range(j - 12, j - 1):
                    neck |= bool(least(j) and least(k) and abs(low[j] / low[k] - 1) <= 0.02 and close[i] > high[k + 1 : j].max())
            spring = any(least(k) and low[i - 1] < low[k] and close[i - 1] > low[k] for k in range(i - 13, i - 2))
        want.append((neck, bool(spring)))
    assert got == want and {x for x, _ in want} == {x for _, x in want} == {True, False}


def test_plan_and_scores(spark):
    rows = [("P", 10.0, 9.0, 12.0), ("A", 10.0, 9.0, 12.0), ("D", 10.0, 9.0, 12.0), ("P", 10.0, None, 12.0), ("A", 10.0, 9.0, None), ("D", 10.0, 9.0, -1.0)]
    df = spark.createDataFrame(rows, "k string, close double, ema double, base double")
    out = df.select(*S.plan(F.col("k"), F.col("close"), F.col("ema"), F.col("base"))).collect()
    assert [(r["kind"], round(r["entry"], 6)) for r in out] == [("pullback", 9.0), ("breakout", 12.012), ("reclaim", 12.0), ("pullback", 10.0), ("breakout", 10.0), ("reclaim", 10.0)]
    assert [round(out[0][c], 6) for c in ("tp1", "tp2", "tp3", "sl", "runner_pct")] == [9.36, 9.72, 10.35, 8.73, 5]
    one = lambda *x: [F.lit(v).cast("double") for v in x]
    rank = lambda *x: df.select(S.rank_score(*one(*x), (0.06, 0.2), 0.7, (4, 80), 0.06)).first()[0]
    assert rank(-3, 0.2, 0, 4, 0.06) == 100.0 and rank(1, 0.13, 0.35, 42, 0.03) == 50.0 and rank(9, 0, 0.9, 99, -1) == 0.0
    score = lambda *x: df.select(S.operational_score(*one(*x))).first()[0]
    assert score(100, 10, 3, 0.75) == 100.0 and score(40, None, None, 0.5) == 20.0 and score(0, 6.5, 1.5, 0.65) == 25.0


def test_isolation_and_promotion(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, None)], "id long, seq long, ok boolean")
    out = {(r["id"], r["seq"]): r["reason"] for r in research.isolate(rows, [("bad", ~F.col("ok"))]).collect()}
    assert out == {(1, 0): "kept", (1, 1): "duplicate", (2, 0): "bad", (3, 0): "bad"}
    r = research.promotion(rows, [("ok", F.col("ok")), ("id", F.col("id") < 3)]).where("id = 3").first()
    assert r["reasons"] == ["ok", "id"] and not r["passed"]


def test_order_statistics(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    r = outcomes.order_statistics(df, ["k"], "v").first()
    assert (r["median"], r["p25"], r["q90"], r["upper_middle"], r["lower_middle"]) == (2.5, 2.0, 4.0, 3.0, 2.0)


def test_unknown_values_close_gates(spark):
    row = {c: None for c in ("f8h", "f24h", "oi4h", "ret4h", "ret24h", "change1h", "pullback24", "oi_drop", "oi_rebound", "range24", "close_hi24", "oi", "oi_max", "oi_then")}
    known = {"i": 40, "upper_red": True, "lower_strong": True, "funding": 0.02, "buy_share": 0.9, "pos": 0.7, "vol_z": 3.0, "new_high": True, "upper_wick": 0.9, "lower_wick": 0.9, "pctile": 0.5, "cross": 0, "close": 1.0, "hi24": 2.0, "open": 1.0, "green24": 0.9, "ema20": 2.0, "ema50": 2.0, "was_below": True, "range_last": 1.0, "range_avg": 0.1}
    cast = {k: F.lit(v).cast("double") if v is None or isinstance(v, float) else F.lit(v) for k, v in (row | known).items()}
    df = spark.range(1).select(F.lit("A").alias("sym"), F.lit(0).alias("t"), *[v.alias(k) for k, v in cast.items()])
    assert detectors.insights(df).count() == 0


def test_paper_book_against_a_loop(spark, sf):
    rules = books.Rules(fill_within=86400)
    want, held = [], {}
    for r in sorted(book_plans.book_ticks(spark, sf).collect(), key=lambda r: (r["t"], r["seq"])):
        book = held.setdefault(r["book"], books.Book(rules))
        want += [(r["book"], *x) for x in book.tick(r["t"], r["sym"], r["px"], r["edge"])]
    got = [tuple(r)[:7] for r in books.ledger(book_plans.book_ticks(spark, sf), rules).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


def test_book_rules():
    b = books.Book(books.Rules())
    assert b.tick(0, "A", 100.0, True) == []
    assert [x[2] for x in b.tick(60, "A", 100.0, False)] == ["open"]
    assert [x[2] for x in b.tick(120, "A", 109.0, False)] == ["tp2"] and [x[2] for x in b.tick(180, "A", 96.0, False)] == ["stop"] and not b.open
    b.tick(200, "A", 100.0, True)
    assert b.tick(200 + 46 * 60, "A", 100.0, False) == []


@pytest.mark.parametrize("name", ["stream_watches", "stream_deep_watches"])
def test_watches_stream_equals_a_loop(spark, sf, name):
    """The stream against a plain loop with rules of its own, over all ticks of all symbols."""
    from tidemark.plans import streams

    entry = name == "stream_watches"
    rows = (streams.watch_inputs if entry else streams.deep_inputs)(ticks(spark, sf)).collect()
    want, state, width = [], {}, 6 * 3600
    passed = max(r["ts"] for r in rows) // width * width  # what the watermark lets through

    def expire(sym, until):
        w = state[sym]
        if w["s"] == "watching" and w["t"] + 86400 <= until:
            w["s"] = "expired"
            want.append((sym, w["t"] + 86400, "expired", None))

    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        if r["ts"] > passed:
            continue
        w, t, px, out = state.setdefault(r["sym"], {"s": "none"}), r["ts"], r["px"], []
        expire(r["sym"], t)
        if entry:
            if r["kind"] == "push":
                if px > 0:
                    out = ["superseded"] * (w["s"] in ("watching", "ready", "sending")) + ["armed"]
                    w.clear()
                    w.update(s="watching", t=t, px=px, low=0.9 * px - 0.3 * px, mid=0.9 * px, top=0.9 * px + 0.3 * px, retry=-1, last=t)
            elif r["kind"] == "bar":
                if w["s"] == "watching" and px > 0 and t > w["last"]:
                    end = "invalid" if px < w["mid"] - 0.6 * w["px"] else "missed" if px * 1.02 >= w["px"] * 1.15 else None
                    w["last"] = t
                    if end is None and t >= w["t"] + 1800 and px * 0.98 <= w["top"] and px * 1.02 >= w["low"] and w["mid"] <= px <= w["top"]:
                        end = "ready"
                    if end:
                        w["s"], out = end, [end]
            elif r["kind"] == "sending":
                if w["s"] == "ready" and t >= w["retry"]:
                    w["s"] = "sending"
            elif r["kind"] == "failed":
                if w["s"] == "sending":
                    w["s"], w["retry"], out = "ready", t + 900, ["delivery-failed"]
            elif w["s"] in ("ready", "sending"):
                w["s"], out = "delivered", ["delivered"]
        else:
            known = r["age"] is not None and r["change1h"] is not None
            fresh = known and 0 <= r["age"] <= 600
            good = fresh and r["change1h"] > 0 and r["change4h"] >= 3
            if r["kind"] == "setup":
                if w["s"] != "watching" and good and px > 0:
                    w.update(s="watching", t=t, px=px, last=t)
                    out = ["armed"]
            elif w["s"] == "watching" and px > 0 and t > w["last"]:
                end = "invalid" if px < 0.3 * w["px"] else "missed" if px * 1.02 >= w["px"] + 1.6 * w["px"] else None
                w["last"] = t
                if end is None and w["px"] <= px <= w["px"] + 0.4 * w["px"]:
                    end = "confirmed" if good else "oi-rejected" if fresh else None
                    out = [] if end else ["oi-wait"]
                if end:
                    w["s"], out = end, [end]
        want += [(r["sym"], t, e, px) for e in out]
    for sym in state:
        expire(sym, passed)
    key = lambda x: (x[0], x[1], x[2], x[3] or 0)
    got = sorted(map(tuple, getattr(streams, name)(spark, sf).collect()), key=key)
    assert got == sorted(want, key=key)
    assert {x[2] for x in got} >= ({"armed", "superseded", "missed", "ready", "delivered"} if entry else {"armed", "missed", "confirmed", "oi-rejected", "oi-wait"})


def test_a_silent_watch_expires_and_a_restart_goes_on(spark, tmp_path):
    """One symbol arms a watch and falls silent; another keeps the watermark going. The stream is stopped in between and late input comes."""
    from tidemark.streaming import timed, watches

    source, schema = str(tmp_path / "in"), "sym string, ts long, seq long, kind string, px double, high double, low double, support double, atr double, source long, retry long"
    push = lambda sym, t, n: (sym, t, n, "push", 10.0, None, None, 9.0, 1.0, n, None)
    bar = lambda sym, t, n, px=10.0: (sym, t, n, "bar", px, px, px, None, None, None, None)

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        out = []
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        with timed.state_store(spark):
            q = watches.entry_watches(stream, 60).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start()
            q.awaitTermination()
        return sorted(out, key=str)

    more([push("quiet", 1000, 0), bar("busy", 2000, 1)])
    assert go() == [("quiet", 1000, "armed", 10.0)]
    more([bar("busy", 1000 + 86400, 2)])
    assert go() == []  # the stretch of the end is still open
    more([bar("busy", 1000 + 86400 + 120, 3), push("busy", 500, 4)])  # the second is late
    assert go() == [("quiet", 1000 + 86400, "expired", None)]
    more([bar("quiet", 1000 + 90000, 5), bar("busy", 1000 + 99999, 6)])
    assert go() == []


def test_notifications_equal_a_loop(spark, sf):
    from tidemark.plans.streams import stream_notifications
    from tidemark.streaming.processors import Notifier

    want, held = [], {}
    for r in sorted(ticks(spark, sf).collect(), key=lambda r: (r["ts"], r["seq"])):
        e = held.setdefault(r["sym"], Notifier()).observe(r["ts"], r["px"] > 40, r["user"] % 4 != 0, 4 * 3600)
        want += [(r["sym"], r["ts"], e)] if e else []
    got = sorted(map(tuple, stream_notifications(spark, sf).collect()))
    assert got == sorted(want) and {e for _, _, e in got} == {"sent", "failed", "suppressed"}


def test_notifier_retries_while_on():
    from tidemark.streaming.processors import Notifier

    n = Notifier()
    assert [n.observe(0, True, False, 100), n.observe(10, True, True, 100), n.observe(20, True, True, 100)] == ["failed", "sent", None]
    assert n.observe(30, False, True, 100) is None and n.observe(40, True, True, 100) == "suppressed" and n.observe(50, True, True, 100) is None


def test_archive_metrics_and_strategies(spark, tmp_path):
    (tmp_path / "m.csv").write_text("create_time,symbol,q,u,a,b,c,d\n2026-01-01 00:05:00,BTC,10,20,1,1,1,1\n2026-01-01 00:05:00,BTC,11,21,1,1,1,1\n2026-01-01 00:10:00,BTC,0,5,1,1,1,1\n")
    (tmp_path / "f.csv").write_text("calc_time,h,rate\n1700000000000,8,0.0001\n1700000000000,8,0.0002\n")
    assert [(r["t"] % 3600, r["qty"]) for r in logs.metrics(spark, str(tmp_path / "m.csv")).collect()] == [(300, 11.0)]
    assert [tuple(r) for r in logs.funding(spark, str(tmp_path / "f.csv")).collect()] == [(1700000000, 0.0002)]
    lines = [('{"type": "strategy_candidate", "v": 1, "id": "a", "strategy": "s", "sym": "A", "ts": 1}', 0), ('{"type": "strategy_outcome", "v": 1, "id": "a", "net": 0.5}', 1), ("strategy_ broken", 2)]
    c, o = logs.strategies(spark.createDataFrame(lines, "line string, no long"))
    assert c.count() == 1 and o.first()["net"] == 0.5 and c.join(o, "id", "left_anti").count() == 0


def test_entry_watch():
    row = {"source": 1, "support": 100.0, "atr": 10.0, "retry": 0}
    n = iter(range(10_000))
    def one(w, t, kind, px=100.0, high=None, low=None, **more):
        return w.observe(row | {"ts": t, "seq": next(n), "kind": kind, "px": px, "high": high or px, "low": low or px} | more)
    w = EntryWatch()
    assert one(w, 0, "push", 104.0, atr=100.0) == [] and one(w, 0, "push", 104.0, support=None) == [] and one(w, 0, "push", 104.0) == ["armed"] and one(w, 5, "push", 104.0) == []
    assert one(w, 900, "bar", 102.0) == [] and w.observe(row | {"ts": 900, "seq": 0, "kind": "bar", "px": 1.0, "high": 1.0, "low": 1.0}) == []
    assert one(w, 1800, "bar", 99.0) == [] and one(w, 2700, "bar", 102.0) == ["ready"] and one(w, 2800, "bar", 1.0) == []
    assert one(w, 2900, "sending") == [] and one(w, 3000, "failed", retry=3000) == [] and one(w, 3000, "failed", retry=3600) == ["delivery-failed"]
    assert one(w, 3100, "sending") == [] and w.status == "ready" and one(w, 3600, "sending") == [] and w.attempts == 2 and one(w, 3700, "delivered") == ["delivered"]
    ends = [("expired", 86400, 100.0, 100.0), ("invalid", 900, 89.9, 90.0), ("missed", 900, 118.0, 119.7)]
    for end, t, px, high in ends:
        w = EntryWatch()
        one(w, 0, "push", 104.0)
        assert one(w, t, "bar", px, high) == [end]
    w = EntryWatch()
    one(w, 0, "push", 104.0)
    assert one(w, 60, "push", 104.0, source=2) == ["superseded", "armed"] and one(w, 1000, "bar", 89.0, 130.0) == ["invalid"]


def test_deep_watch():
    nan = float("nan")
    assert [decision(*x) for x in ((None, 1, 3), (5, nan, 3), (-1, 1, 3), (601, 1, 3), (600, 1, 2.9), (0, 0, 9), (0, 0.1, 3))] == ["missing", "missing", "future", "stale", "rejected", "rejected", "pass"]
    n = iter(range(10_000))
    def one(w, t, kind, px, age=0.0, q1=1.0, q4=3.0, high=None):
        return w.observe({"ts": t, "seq": next(n), "kind": kind, "px": px, "high": high or px, "trough": 80.0, "level": 100.0, "atr": 10.0, "age": age, "change1h": q1, "change4h": q4})
    w = DeepWatch()
    assert one(w, 0, "setup", 95.0, q4=2.0) == [] and one(w, 0, "setup", 95.0) == ["armed"] and one(w, 5, "setup", 95.0) == []
    assert one(w, 900, "bar", 99.0) == [] and one(w, 1800, "bar", 104.0, age=None) == ["oi-wait"] and one(w, 2700, "bar", 105.0) == ["confirmed"]
    for end, t, px, more in (("expired", 86400, 101.0, {}), ("invalid", 900, 79.0, {}), ("missed", 900, 101.0, {"high": 120.0}), ("oi-rejected", 900, 101.0, {"q1": -1.0})):
        w = DeepWatch()
        one(w, 0, "setup", 95.0)
        assert one(w, t, "bar", px, **more) == [end]


def test_portfolio_limits(spark, sf):
    p = books.Portfolio(books.Policy())
    assert p.enter(10, "a", None, None) == ("no-bar", 0.0) and p.enter(10, "a", 1800, 5.0) == ("no-bar", 0.0) and p.enter(10, "a", 900, 5.0, eligible=False) == ("not-eligible", 0.0)
    outcome, size = p.enter(10, "a", 900, 5.0)
    assert outcome == "opened" and size == pytest.approx(10_000 * 0.005 / 0.03) and p.enter(20, "a", 900, 5.0)[0] == "held"
    assert [p.enter(30, s, 900, 5.0)[0] for s in "bcde"] == ["opened"] * 3 + ["full"]
    assert p.settle(40, "z", 1.0) == ("ignored", 0.0) and p.settle(40, "a", -0.15) == ("settled", pytest.approx(-250)) and p.blocked
    assert p.enter(50, "e", 900, 5.0)[0] == "day-loss" and p.enter(86400, "e", 86400, 5.0)[0] == "open-risk"
    p.settle(86500, "b", -0.3), p.settle(86600, "c", -0.2)
    assert p.locked and p.enter(3 * 86400, "f", 3 * 86400, 1.0)[0] == "drawdown-lock"
    tight = books.Portfolio(books.Policy(most_open=9))
    assert [tight.enter(0, s, 0, 1.0)[0] for s in "abcde"] == ["opened"] * 4 + ["open-risk"]
    rows, held, want = book_plans.portfolio_inputs(spark, sf).collect(), {}, []
    for r in sorted(rows, key=lambda r: (r["t"], r["seq"])):
        own = held.setdefault(r["book"], books.Portfolio(books.Policy()))
        done = own.enter(r["t"], r["sym"], r["bar_t"], r["px"]) if r["kind"] == "enter" else own.settle(r["t"], r["sym"], r["net"])
        want.append((r["book"], r["t"], r["sym"], *done, own.equity))
    key = lambda x: (x[0], x[1], x[2], x[3], round(x[4], 6), round(x[5], 6))
    got = [key(tuple(r)) for r in books.portfolios(book_plans.portfolio_inputs(spark, sf)).collect()]
    assert sorted(got) == sorted(map(key, want)) and {"opened", "held", "no-bar", "settled"} <= {x[3] for x in got}


def test_scalars(spark):
    df = spark.createDataFrame([(900_000, "1000PEPEUSDT"), (900_001, "BTCUSDT_240628"), (1, " ethusdt ")], "ms long, s string")
    out = df.select(S.next_slot_open(F.col("ms")).alias("n"), S.base_symbol(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in out] == [(900_000, "PEPE"), (1_800_000, None), (900_000, "ETH")]
    x = spark.range(1).select(S.round_half_up(F.lit(-2.5)).alias("r"), S.clamp(F.lit(None).cast("double"), 0, 1).alias("c"), S.seconds_of(F.lit(1.7e15)).alias("u"), S.compact(F.lit(1234.0)).alias("m"), S.signed_percent(F.lit(1.5)).alias("p")).first()
    assert tuple(x) == (-2.0, None, 1_700_000_000, "1.23K", "+1.50%")
    assert S.fnv1a("") == 0x811C9DC5 and S.fnv1a("a") == 0xE40C292C


def test_logs(spark, tmp_path):
    good = lambda slot, source, coin: json.dumps({"v": 7, "ts": slot * 900_000, "slot": slot, "source": source, "coins": coin})
    lines = [good(1, "okx", [["A", 1.5]]), good(1, "okx", [["A", 2.5], ["B"]]), good(2, "binance", [["A", None, 3]]), '{"type": "liq", "slot": 9, "coins": []}', "{broken", ""]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(lines))
    rows = logs.scan_rows(logs.read_lines(spark, str(path))).cache()
    assert sorted((r["slot"], r["sym"], r["price"]) for r in rows.collect() if r["price"]) == [(1, "A", 2.5)] and rows.count() == 3
    assert logs.newest_source(rows).select("source").distinct().collect()[0][0] == "binance"
    again = logs.scan_rows(logs.scan_lines(rows).withColumn("no", F.lit(1)))
    assert again.count() == 3 and again.where("sym = 'A' and slot = 1").first()["price"] == 2.5
    sent = ['{"type": "notify", "v": 1, "id": "x", "sym": "a", "px": 1, "ts": 5}', '{"type": "notify", "v": 2, "messageId": "x", "symbol": "a", "price": 2, "ts": 6}', '{"type": "notify", "v": 3, "sym": "a", "px": 1, "ts": 5}']
    out = logs.notifications(spark.createDataFrame([(x, i) for i, x in enumerate(sent)], "line string, no long")).collect()
    assert len(out) == 1 and out[0]["px"] == 2.0 and out[0]["sym"] == "A"
    with pytest.raises(ValueError):
        logs.serve(rows.withColumn("day", F.lit(1)), 1, 200)


def test_klines_and_checksums(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1700000000000,1,2,1,2,9,8,100,5,5,40,0\nbad,line\n1700003600000000,1,2,1,3,9,8,100,5,5,40,0\n")
    (tmp_path / "b.csv").write_text("1700000000000,1,2,1,1.5,9,8,100,5,5,40,0\n")
    out = {r["t"]: r["close"] for r in logs.klines(spark, str(tmp_path / "*.csv")).collect()}
    assert out == {1700000000: 1.5, 1700003600: 3.0}
    import hashlib

    catalog = spark.createDataFrame([("a.csv", hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()), ("b.csv", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in logs.verified(spark, str(tmp_path / "*.csv"), catalog).collect()} == {"a.csv": True, "b.csv": False}


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_fingerprint_is_order_free(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],), ([],)], "ids array<string>").select(evidence.fingerprint(F.col("ids")).alias("h"))
    assert [r["h"] for r in df.collect()] == [S.fnv1a("a|b"), S.fnv1a("a|b"), S.fnv1a("")]


def test_busy_until(spark):
    rng = np.random.default_rng(5)
    rows = [(s, int(t), int(t + rng.integers(0, 9))) for s in "AB" for t in np.sort(rng.integers(0, 200, 80))]
    want, end = [], {}
    for s, t, u in sorted(rows):
        if t >= end.get(s, -1):
            want.append((s, t, u))
            end[s] = u
    got = thinning.thin(spark.createDataFrame(rows, "sym string, since long, until long"), ["sym"], "since", F.col("until")).collect()
    assert sorted(map(tuple, got)) == want


def test_anchor_needs_whole_hours(spark):
    b = flat(spark, [100.0 + i for i in range(30)])
    whole = {r["t"] // 3600: r["support"] for r in evidence.anchors(b).collect()}
    assert whole[23] is None and whole[24] == 123.0 and whole[29] == 128.0
    gap = {r["t"] // 3600: r["support"] for r in evidence.anchors(b.where("t <> 36000")).collect()}
    assert all(x is None for x in gap.values())


def test_unknown_values_close_recorded_states(spark):
    columns = ("ret4h", "basis_pct", "spot_vol24h", "vol24h", "buy_share4h", "funding", "spot_taker_share4h", "strength")
    rows = [(3.0, -0.1, 10.0, 5.0, 0.6, 0.0, 0.6, 10.0), (3.0, None, 10.0, 5.0, 0.6, 0.02, 0.6, 10.0), (3.0, -0.1, 10.0, 5.0, 0.6, 0.0, None, 80.0)]
    found = evidence.labelled(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in columns)), evidence.STATES, "state")
    assert sorted((r["i"], r["state"]) for r in found.collect()) == [(0, "organic-spot-lift"), (0, "spot-led-v1"), (2, "organic-spot-lift"), (2, "strength-70")]


def test_reuse_and_seed_merge(spark):
    rows = spark.createDataFrame([("missing", None, "a"), ("invalid", "a", "a"), ("complete", "a", "a"), ("complete", "a", "b"), ("complete", None, "a")], "s string, k string, f string")
    assert [r["r"] for r in rows.select(evidence.reuse(F.col("s"), F.col("k"), F.col("f")).alias("r")).collect()] == [True, False, True, False, False]
    log, seed = (spark.createDataFrame(x, "sym string, ts long, v int") for x in ([("A", 1, 1)], [("A", 1, 9), ("B", 1, 2)]))
    assert sorted(map(tuple, evidence.seed_merge(log, seed, ["sym", "ts"]).collect())) == [("A", 1, 1), ("B", 1, 2)]


def test_switched_insights_and_flush_precedence():
    shown = {r[0] for r in detectors.insight_rules()}
    assert not shown & detectors.SWITCHED and {r[0] for r in detectors.insight_rules(detectors.SWITCHED)} >= detectors.SWITCHED
    assert "NOT coalesce" in next(r[3] for r in detectors.insight_rules() if r[0] == "breakout-confirmed")


def test_two_decimals_go_by_the_binary_value(spark):
    values = [0.125, 0.375, 2.675, 1.005, 0.285, -0.125, -2.675, 0.0, 0.001, 1005.0, 1015.0, 8.345, 999.995, 1e5 + 0.005, 560.21, 7e11 + 0.25]
    rng = np.random.default_rng(5)
    values += [float(v) for v in rng.integers(0, 900_000, 400) / 1000] + [float(v) for v in rng.normal(0, 300, 200)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.two_decimals(F.col("x")).alias("y"), S.compact(F.col("x")).alias("z")).collect()
    assert [r["y"] for r in got] == ["%.2f" % r["x"] for r in got]
    assert {r["x"]: r["z"] for r in got}[1005.0] == "1.00K" and {r["x"]: r["z"] for r in got}[1015.0] == "%.2fK" % 1.015


def test_evidence_does_not_turn_on_the_order_of_rows(spark, tmp_path):
    """Rows whose discounts less taxes are 0.01 on average, in many orders: all get one answer, and 0.01 is not above 0.01."""
    from tidemark.plans.evidence import evidence_items

    rng, rows = np.random.default_rng(3), []
    pairs = [(i % 11 / 100, (i % 11 - 1) % 9 / 100) for i in range(600)]
    pairs += [(0.05, 0.04 - 0.0)] * 20
    gap = round(sum(round(100 * d) - round(100 * t) for d, t in pairs)) - len(pairs)
    pairs += [(0.0, 0.0)] * gap if gap > 0 else [(0.02, 0.0)] * -gap
    for key in range(60):
        rows += [(key, pairs[i][0], pairs[i][1], "A") for i in rng.permutation(len(pairs))]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["capability"], r["recommendation"]) for r in evidence_items(spark, str(tmp_path)).collect()} == {("context", "demote")}


def test_machines_in_order_carry_their_states_over_batches(spark, sf, tmp_path):
    """Seven files are two batches or more; a symbol that is missing in one of them keeps its state, and Arrow batches cut symbols."""
    from tidemark.plans.streams import stream_cooldown, stream_notifications
    from tidemark.streaming.processors import Notifier

    for k in range(7):
        part = spark.read.parquet(f"{sf}/events.parquet").where(f"event_id BETWEEN {k * 140} AND {k * 140 + 139} AND NOT ({k} > 3 AND event_type = 'click' AND {k} < 6)")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, stream_notifications(spark, str(tmp_path)).collect()))
        thinned = sorted(map(tuple, stream_cooldown(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held, kept, last = [], {}, [], {}
    for r in sorted(ticks(spark, str(tmp_path)).collect(), key=lambda r: (r["ts"], r["seq"])):
        e = held.setdefault(r["sym"], Notifier()).observe(r["ts"], r["px"] > 40, r["user"] % 4 != 0, 4 * 3600)
        want += [(r["sym"], r["ts"], e)] if e else []
        if r["px"] > 80 and r["ts"] - last.get(r["sym"], -(10**9)) >= 6 * 3600:
            last[r["sym"]] = r["ts"]
            kept.append((r["sym"], r["ts"]))
    assert got == sorted(want) and thinned == sorted(kept)
