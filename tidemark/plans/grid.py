"""Queries on the three clocks. Feeds of the test series are made of all ticks; their SQL is written apart from the operators' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators.bars import from_ticks
from ..registry import query
from ..shared import kept
from ..sources.tables import ticks
from .bars import rounded
from .windows import ema_sql


def feeds(spark: SparkSession, sf_dir: str) -> G.Feeds:
    """Stand-ins: ticks' prices as open interest, the share of even users as funding and their ratio to odd ones, users' numbers as spot volume."""
    rows = ticks(spark, sf_dir)
    even, odd = F.count_if(F.col("user") % 2 == 0), F.count_if(F.col("user") % 2 == 1)
    oi = rows.groupBy("sym", "ts").agg((F.max("px") + 100).alias("value"))
    funding = rows.groupBy("sym", (F.floor(F.col("ts") / 28800) * 28800 + 28800).alias("ts")).agg(((even / F.count("*") - 0.5) / 10).alias("value"))
    ratio = rows.groupBy("sym", (F.floor(F.col("ts") / 3600) * 3600 + 3600).alias("ts")).agg(((even + 1) / (odd + 1)).alias("value"))
    spot = rows.groupBy("sym", (F.col("ts") - F.col("ts") % 300).alias("t")).agg(F.min_by("px", F.struct("ts", "seq")).alias("close"), F.sum("user").cast("double").alias("q"), F.sum(F.when(F.col("px") > 10, F.col("user")).otherwise(0)).cast("double").alias("tq"))
    return G.Feeds(oi, funding, ratio, spot)


def fine_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(G.with_feeds(from_ticks(ticks(spark, sf_dir).withColumn("q", F.col("px")).withColumn("taker", F.col("user") % 2 == 0), G.FINE), feeds(spark, sf_dir)))


_FINE = """WITH RECURSIVE ev AS (SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, value AS px, user_id AS u FROM events),
oi_feed AS (SELECT sym, ts, max(px) + 100 AS v FROM ev GROUP BY 1, 2),
fund_feed AS (SELECT sym, ts - ts % 28800 + 28800 AS ts, (count(*) FILTER (u % 2 = 0) / count(*) - 0.5) / 10 AS v FROM ev GROUP BY 1, 2),
ls_feed AS (SELECT sym, ts - ts % 3600 + 3600 AS ts, (count(*) FILTER (u % 2 = 0) + 1) / (count(*) FILTER (u % 2 = 1) + 1) AS v FROM ev GROUP BY 1, 2),
spot AS (SELECT sym, ts - ts % 300 AS t, first(px ORDER BY ts, seq) AS spot_close, CAST(sum(u) AS DOUBLE) AS spot_q, CAST(sum(CASE WHEN px > 10 THEN u ELSE 0 END) AS DOUBLE) AS spot_tq FROM ev GROUP BY 1, 2),
b5 AS (SELECT sym, ts - ts % 300 AS t, first(px ORDER BY ts, seq) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, seq) AS close, sum(px) AS q, sum(CASE WHEN u % 2 = 0 THEN px ELSE 0 END) AS tq FROM ev GROUP BY 1, 2),
g5 AS (SELECT b5.*, CASE WHEN b5.t + 300 - o.ts <= 7200 THEN o.v END AS oi, CASE WHEN b5.t + 300 - f.ts <= 32400 THEN f.v END AS funding, CASE WHEN b5.t + 300 - l.ts <= 7200 THEN l.v END AS ls, spot_close, spot_q, spot_tq
 FROM b5 ASOF LEFT JOIN oi_feed o ON b5.sym = o.sym AND b5.t + 300 >= o.ts ASOF LEFT JOIN fund_feed f ON b5.sym = f.sym AND b5.t + 300 >= f.ts ASOF LEFT JOIN ls_feed l ON b5.sym = l.sym AND b5.t + 300 >= l.ts LEFT JOIN spot s ON s.sym = b5.sym AND s.t = b5.t)"""


def _coarse_sql(name: str, width: int) -> str:
    return f"""{name} AS (SELECT sym, t - t % {width} AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(q) AS q, CASE WHEN count(tq) = count(*) THEN sum(tq) END AS tq,
 last(oi ORDER BY t) FILTER (oi IS NOT NULL) AS oi, last(funding ORDER BY t) FILTER (funding IS NOT NULL) AS funding, last(ls ORDER BY t) FILTER (ls IS NOT NULL) AS ls, last(spot_close ORDER BY t) FILTER (spot_close IS NOT NULL) AS spot_close, sum(spot_q) AS spot_q, sum(spot_tq) AS spot_tq FROM g5 GROUP BY 1, t - t % {width})"""


def _rows(a: int, b: int) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{n} PRECEDING"
    return f"(PARTITION BY sym ORDER BY t ROWS BETWEEN {side(a)} AND {side(b)})"


_FINE_CONTEXT = f"""{_FINE}, c5 AS (SELECT *, row_number() OVER o - 1 AS i, max(high) OVER p AS hi, min(low) OVER p AS lo, avg(q) OVER p AS m, stddev_pop(q) OVER p AS sd, lag(close, 12) OVER o AS c12, lag(close, 4) OVER o AS c4, lag(close, 3) OVER o AS c3,
 list_sort(list(q) OVER e) AS eight FROM g5 WINDOW o AS (PARTITION BY sym ORDER BY t), p AS {_rows(288, 1)}, e AS {_rows(9, 2)})"""


@query(f"""{_FINE_CONTEXT} SELECT sym, t, 'early-pump' AS detector, 'long' AS side FROM c5 WHERE i >= 288 AND hi > lo AND (hi / close - 1) * 100 >= 2 AND (hi / close - 1) * 100 <= 95 AND (close - lo) / (hi - lo) >= 0.5 AND close > c12
 AND close > c4 AND (close / c4 - 1) * 100 <= 1000 AND CASE WHEN sd > 0 THEN (q - m) / sd ELSE 0 END >= 0.5
UNION ALL SELECT sym, t, 'ignition', 'long' FROM c5 WHERE i >= 12 AND close / c3 >= 1.06 AND (close / c12 - 1) * 100 <= 5000 AND q >= 20 AND q / eight[5] >= 1.2""")
def grid_fine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early pumps and ignitions on 5-minute bars, over thresholds that a series of noise can meet."""
    return G.fired(G.fine(fine_bars(spark, sf_dir)), G.fine_rules(G.WIDE))


_MIDDLE = f"""{_FINE}, {_coarse_sql("b", 900)}, {ema_sql(20, name="ema20")}, {ema_sql(50, name="ema50")},
m0 AS (SELECT b.*, e_20.ema20, e_50.ema50, row_number() OVER (PARTITION BY b.sym ORDER BY b.t) - 1 AS i FROM b LEFT JOIN e_20 USING (sym, t) LEFT JOIN e_50 USING (sym, t)),
m1 AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN round(4 * stddev_pop(close) OVER w20 / nullif(abs(avg(close) OVER w20), 0), 9) END AS width, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) END AS uw, CASE WHEN high > low THEN (least(open, close) - low) / (high - low) END AS lw,
 CASE WHEN close >= open THEN q ELSE 0 END AS up, CASE WHEN lag(ema20 - ema50) OVER o <= 0 AND ema20 - ema50 > 0 THEN 1 WHEN lag(ema20 - ema50) OVER o >= 0 AND ema20 - ema50 < 0 THEN -1 END AS cx FROM m0 WINDOW o AS (PARTITION BY sym ORDER BY t), w20 AS {_rows(19, 0)}),
m2 AS (SELECT *, list({{'w': uw, 'at': -t, 'mark': close <= open}}) OVER w4 AS us, list({{'w': lw, 'at': -t, 'mark': close > low + 0.5 * (high - low)}}) OVER w4 AS lws, list(width) OVER w173 AS ws, list(close) OVER w97 AS cs,
 (close / lag(close, 4) OVER o - 1) * 100 AS change1h, close / lag(close, 16) OVER o - 1 AS ret4h, close / coalesce(lag(close, 96) OVER o, first(close) OVER o) - 1 AS ret24h,
 CASE WHEN i >= 32 THEN lag(funding, 32) OVER o ELSE first(funding) OVER o END AS f8h, CASE WHEN i >= 96 THEN lag(funding, 96) OVER o ELSE first(funding) OVER o END AS f24h, (oi / lag(oi, 16) OVER o - 1) * 100 AS oi4h,
 CASE WHEN count(*) OVER p96 > 0 THEN CASE WHEN stddev_pop(q) OVER p96 > 0 THEN (q - avg(q) OVER p96) / stddev_pop(q) OVER p96 ELSE 0 END END AS vol_z,
 coalesce((close - min(low) OVER w97) / nullif(max(high) OVER w97 - min(low) OVER w97, 0), 0.5) AS pos, coalesce(sum(up) OVER w16 / nullif(sum(q) OVER w16, 0), 0.5) AS buy_share, CASE WHEN count(tq) OVER w16 = count(*) OVER w16 THEN sum(tq) OVER w16 / nullif(sum(q) OVER w16, 0) END AS taker_share,
 coalesce(sum(up) OVER w97 / nullif(sum(q) OVER w97, 0), 0.5) AS green_share, avg(high - low) OVER w97 AS range_avg, high - low AS range_last, close >= coalesce(max(high) OVER p95, max(high) OVER w97) * 0.999 AS new_high, max(close) OVER w4 >= coalesce(max(high) OVER p97, max(high) OVER w97) * 0.997 AS broke_high,
 close > ema20 AS above20, close > ema50 AS above50, close / ema20 - 1 AS dev20, coalesce(max(CAST(close < ema20 AS INTEGER)) OVER p7 = 1, false) AS was_below, coalesce(last_value(cx IGNORE NULLS) OVER w8, 0) AS crossed,
 (close / spot_close - 1) * 100 AS basis, CASE WHEN count(spot_q) OVER p96 >= 95 AND spot_q IS NOT NULL THEN CASE WHEN stddev_pop(spot_q) OVER p96 > 0 THEN (spot_q - avg(spot_q) OVER p96) / stddev_pop(spot_q) OVER p96 ELSE 0 END END AS spot_z,
 CASE WHEN count(spot_q) OVER w32 = 32 AND count(spot_q) OVER p160 = 160 THEN avg(spot_q) OVER w32 / nullif(avg(spot_q) OVER p160, 0) END AS spot_ratio, sum(spot_tq) OVER w96 / nullif(sum(spot_q) OVER w96, 0) AS spot_buy
 FROM m1 WINDOW o AS (PARTITION BY sym ORDER BY t), w4 AS {_rows(3, 0)}, w8 AS {_rows(7, 0)}, w16 AS {_rows(15, 0)}, w32 AS {_rows(31, 0)}, w96 AS {_rows(95, 0)}, w97 AS {_rows(96, 0)}, w173 AS {_rows(172, 0)}, p7 AS {_rows(7, 1)}, p95 AS {_rows(96, 2)}, p96 AS {_rows(96, 1)}, p97 AS {_rows(100, 4)}, p160 AS {_rows(191, 32)}),
mid AS (SELECT *, CASE WHEN width IS NOT NULL THEN len(list_filter(ws, lambda x: x <= width)) / len(list_filter(ws, lambda x: x IS NOT NULL)) END AS bb_pctile,
 list_min(list_transform(cs, lambda x, k: x / list_max(cs[1:k]) - 1)) AS pullback, coalesce(list_max(list_filter(us, lambda x: x.w > 0))['w'], 0) AS upper_wick, coalesce(list_max(list_filter(us, lambda x: x.w > 0))['mark'], false) AS upper_red, coalesce(list_max(list_filter(lws, lambda x: x.w > 0))['w'], 0) AS lower_wick, coalesce(list_max(list_filter(lws, lambda x: x.w > 0))['mark'], false) AS lower_strong FROM m2)"""

_SHOWN = {
    "change1h": 4, "ret4h": 6, "ret24h": 6, "f8h": 6, "f24h": 6, "oi4h": 4, "vol_z": 4, "pos": 6, "buy_share": 6, "taker_share": 6, "green_share": 6, "range_avg": 5, "dev20": 6, "bb_pctile": 6, "upper_wick": 6, "lower_wick": 6,
    "pullback": 6, "basis": 4, "spot_z": 4, "spot_ratio": 5, "spot_buy": 6,
}
_MARKS = ["new_high", "broke_high", "above20", "above50", "was_below", "upper_red", "lower_strong"]


def middle_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.middle(G.coarser(fine_bars(spark, sf_dir), G.MIDDLE))


@query(f"{_MIDDLE} SELECT sym, t, crossed AS \"cross\", " + ", ".join([f"round({c}, {n}) AS {c}" for c, n in _SHOWN.items()] + _MARKS) + " FROM mid WHERE i >= 59")
def grid_context_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of 15-minute bars with open interest, funding and spot from their own feeds."""
    return rounded(middle_bars(spark, sf_dir).where("i >= 59").select("sym", "t", "cross", *_SHOWN, *_MARKS), _SHOWN)


@query(f"{_MIDDLE} SELECT sym, t, round(ret4h * 100, 4) AS ret4h, round(pos, 6) AS pos, round(buy_share, 6) AS buy_share_4h, round(taker_share, 6) AS taker_share_4h, round(coalesce(f8h, 0), 6) AS f8h, round(coalesce(bb_pctile, 0.5), 6) AS bb_pctile FROM mid WHERE i >= 16")
def feature_vector_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded of a bar: an unknown funding reads as 0, a band without history as the middle."""
    rows = middle_bars(spark, sf_dir).where("i >= 16")
    rows = rows.select("sym", "t", (F.col("ret4h") * 100).alias("ret4h"), "pos", F.col("buy_share").alias("buy_share_4h"), F.col("taker_share").alias("taker_share_4h"), F.coalesce("f8h", F.lit(0.0)).alias("f8h"), F.coalesce("bb_pctile", F.lit(0.5)).alias("bb_pctile"))
    return rounded(rows, {"ret4h": 4, "pos": 6, "buy_share_4h": 6, "taker_share_4h": 6, "f8h": 6, "bb_pctile": 6})


_HOURLY = f"""{_coarse_sql("b60", 3600)}, h0 AS (SELECT *, row_number() OVER o - 1 AS i, close / lag(close, 4) OVER o - 1 AS ret4, close / lag(close, 24) OVER o - 1 AS ret24, max(oi) OVER w48 AS oi_max, lag(oi, 6) OVER o AS oi_then,
 (oi / lag(oi, 4) OVER o - 1) * 100 AS oi4, (oi / lag(oi, 24) OVER o - 1) * 100 AS oi24, max(close) OVER p24 AS base_hi, min(close) OVER p24 AS base_lo, max(high) OVER p24 AS hi24, CASE WHEN count(q) OVER p24 >= 8 AND stddev_pop(q) OVER p24 > 0 THEN (q - avg(q) OVER p24) / stddev_pop(q) OVER p24 ELSE 0 END AS z,
 (1 - ls / lag(ls, 24) OVER o) * 100 AS ls_drop, coalesce((close - min(low) OVER w24) / nullif(max(high) OVER w24 - min(low) OVER w24, 0), 0.5) AS pos, max(high) OVER p22 AS twin, (high - greatest(open, close)) / nullif(high - low, 0) AS wick, lag(low) OVER o AS low1, lag(close) OVER o AS close1, coalesce((lag(close) OVER o - min(low) OVER p24) / nullif(max(high) OVER p24 - min(low) OVER p24, 0), 0.5) AS pos1,
 lag(funding, 8) OVER o AS f8, (close / spot_close - 1) * 100 AS basis, CASE WHEN count(spot_q) OVER w49 = 49 THEN sum(spot_q) OVER w24 END AS spot24, sum(q) OVER w24 AS perp24, CASE WHEN count(spot_q) OVER w49 = 49 THEN sum(spot_tq) OVER w4 / nullif(sum(spot_q) OVER w4, 0) END AS sbuy4, list(oi) OVER w49 AS ois
 FROM b60 WINDOW o AS (PARTITION BY sym ORDER BY t), w4 AS {_rows(3, 0)}, w24 AS {_rows(23, 0)}, w48 AS {_rows(47, 0)}, w49 AS {_rows(48, 0)}, p22 AS {_rows(24, 3)}, p24 AS {_rows(24, 1)}),
h1 AS (SELECT *, lag(z) OVER (PARTITION BY sym ORDER BY t) AS z1, (1 - list_min(ois[list_position(ois, list_max(ois)):]) / nullif(list_max(ois), 0)) * 100 AS flush FROM h0),
h2 AS (SELECT h1.*, (h1.ret24 - k.ret24) * 100 AS rs FROM h1 LEFT JOIN (SELECT t, ret24 FROM h1 WHERE sym = 'click') k ON k.t = h1.t),
h3 AS (SELECT *, coalesce(i >= 31 AND oi_max > 0 AND oi <= oi_max * 0.96 AND oi > oi_then * 1.005 AND base_lo > 0 AND (base_hi / base_lo - 1) * 100 <= 100000 AND abs(funding) <= 0.05, false) AS base, coalesce(i >= 25 AND close > hi24 AND z >= 0.5, false) AS surge,
 coalesce(i >= 32 AND ret24 * 100 >= 15 AND pos >= 0.8 AND z >= 0.5, false) AS top FROM h2)"""
_HOUR_RULES = {
    "early-setup": ("long", "base"), "flush-breakout": ("long", "base AND close > base_hi AND z >= 0.5"), "early-accum": ("long", "base AND ls_drop >= 1 AND rs >= -1000000"),
    "rebuild-1": ("long", "surge AND oi4 >= 3 AND flush >= 4"), "rebuild-2": ("long", "surge AND oi4 >= 3 AND ret4 >= 0 AND ret4 * 100 <= 6"), "virgin-2": ("long", "surge AND oi4 >= 3 AND flush < 4 AND oi24 >= 8"),
    "top-1": ("short", "top AND twin > 0 AND high >= 0.99 * twin AND high <= 1.01 * twin AND close <= 0.99 * high AND close <= open"), "top-2": ("short", "top AND high > hi24 AND wick >= 0.5 AND oi4 <= -1.5"),
    "top-3": ("short", "top AND z1 >= 2.5 AND pos1 >= 0.85 AND close < low1"), "top-4": ("short", "top AND funding >= 0.015 AND funding > f8 AND ret4 <= 0.01"),
    "organic-spot": ("long", "ret4 >= -1 AND sbuy4 > 0.2 AND basis <= 0 AND spot24 >= perp24"), "leverage-froth": ("short", "funding >= 0.01 AND basis >= 0.1 AND spot24 < perp24 / 2"),
}


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hourly(G.coarser(fine_bars(spark, sf_dir), G.HOUR), "click")


@query(f"{_FINE}, {_HOURLY} " + " UNION ALL ".join(f"SELECT sym, t, '{name}' AS detector, '{side}' AS side FROM h3 WHERE {rule}" for name, (side, rule) in _HOUR_RULES.items()))
def grid_hourly_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flush bases, rebuilds, tops and spot against perpetual volume on hourly bars with real feeds."""
    return G.fired(hourly_bars(spark, sf_dir), G.hourly_rules(G.WIDE))

#: Insights with their rules over the names of the SQL above.
_READS = [
    ("flush-breakout", "bull", 10, "base AND close60 > base_hi AND z >= 0.5"),
    ("early-accum", "info", 8, "base AND ls_drop >= 1 AND rs >= -1000000"),
    ("funding-cooling", "bull", 7, "f8h >= 0.008 AND funding BETWEEN 0 AND 0.003 AND funding < 0.6 * f8h AND ret4h > -0.01 AND change1h > -1"),
    ("funding-flip-negative", "bull", 8, "f8h > 0 AND funding < -0.001 AND ret4h > -0.005"),
    ("funding-overheat", "warn", 9, "funding >= 0.015 AND funding > f8h AND f8h > f24h AND oi4h > 3"),
    ("disbelief-rally", "bull", 8, "funding <= -0.005 AND f8h <= -0.002 AND ret4h >= 0.02 AND ret24h > 0"),
    ("long-trap", "bear", 7, "funding >= 0.006 AND oi4h > -1 AND ret4h <= -0.02 AND change1h < -0.5"),
    ("extreme-negative-funding", "bull", 6, "funding <= -0.02 AND f24h > funding AND ret24h < 0.03"),
    ("double-confirmation", "bull", 9, "calm AND oi4h >= 2 AND ret4h >= 0.015"),
    ("oi-up-price-up", "bull", 6, "oi4h >= 2 AND ret4h >= 0.015 AND buy_share > 0.52 AND NOT calm"),
    ("oi-up-price-down", "bear", 7, "oi4h >= 2 AND ret4h <= -0.015"),
    ("oi-down-price-up", "info", 4, "oi4h <= -2 AND ret4h >= 0.015"),
    ("oi-down-price-down", "bear", 5, "oi4h <= -2 AND ret4h <= -0.015"),
    ("oi-coil", "info", 6, "oi4h >= 3 AND oi4h < 8 AND abs(change1h) < 0.5 AND abs(ret4h) < 0.008 AND pos > 0.3 AND pos < 0.7"),
    ("oi-spike", "warn", 7, "oi4h >= 8 AND abs(ret4h) < 0.025"),
    ("oi-divergence-high", "warn", 8, "new_high AND oi4h <= -1.5"),
    ("spot-led-breakout", "bull", 5, "ret4h >= 0.02 AND abs(oi4h) < 1.5 AND buy_share > 0.55 AND vol_z > 1"),
    ("spot-led-pump", "bull", 8, "ret4h >= 0.02 AND abs(oi4h) < 1.5 AND spot_z >= 2 AND basis <= 0.05"),
    ("stealth-spot-accum", "info", 6, "abs(ret4h) < 0.01 AND spot_ratio >= 1.5 AND spot_buy >= 0.55 AND abs(oi4h) < 2"),
    ("volume-ignition", "bull", 8, "vol_z >= 2 AND pos < 0.4 AND change1h >= 1.5 AND ret4h > 0"),
    ("volume-climax", "warn", 9, "vol_z >= 2.5 AND pos > 0.85 AND ret4h > 0.03 AND range_last >= 1.5 * range_avg"),
    ("absorption-stall", "warn", 7, "pos > 0.75 AND vol_z >= 1.5 AND abs(change1h) < 0.5 AND ret4h < 0.01 AND upper_wick > 0.3"),
    ("rebuild-breakout", "bull", 8, "surge AND oi4 >= 3 AND flush >= 4"),
    ("virgin-breakout", "bull", 8, "surge AND oi4 >= 3 AND flush < 4 AND oi24 >= 8"),
    ("volatility-squeeze", "info", 6, "bb_pctile <= 0.1 AND vol_z <= -0.3 AND abs(change1h) < 0.8"),
    ("ema-golden-cross", "bull", 7, "crossed = 1"),
    ("ema-death-cross", "bear", 7, "crossed = -1"),
    ("breakout-confirmed", "bull", 9, "broke_high AND vol_z >= 1.8 AND buy_share > 0.55 AND NOT coalesce(base AND close60 > base_hi AND z >= 0.5, false)"),
    ("breakout-thin", "warn", 6, "broke_high AND vol_z < 0.8"),
    ("upthrust-rejection", "bear", 8, "pos > 0.85 AND upper_wick >= 0.55 AND vol_z >= 1.5 AND ret4h < 0.015 AND upper_red"),
    ("capitulation-wick", "bull", 8, "pos < 0.15 AND lower_wick >= 0.55 AND vol_z >= 2 AND lower_strong"),
    ("buy-pressure-divergence", "info", 6, "buy_share > 0.6 AND ret4h BETWEEN -0.01 AND 0.005 AND pos < 0.85"),
    ("trend-health", "bull", 7, "ret24h > 0.03 AND green_share >= 0.55 AND pullback > -0.08 AND above20 AND above50"),
    ("failed-breakdown-reclaim", "bull", 7, "pos < 0.3 AND was_below AND above20 AND change1h > 1 AND vol_z >= 1.2"),
    ("parabolic-overextension", "warn", 8, "ret4h > 0.08 AND pos > 0.9 AND bb_pctile > 0.9 AND dev20 > 0.05 AND vol_z < 1"),
]


@query(f"""{_MIDDLE}, {_HOURLY}, hr AS (SELECT sym AS hsym, t AS ht, close AS close60, base, base_hi, z, ls_drop, rs, surge, oi4, oi24, flush FROM h3),
r0 AS (SELECT mid.*, hr.*, coalesce(funding > 0 AND funding <= 0.008 AND funding >= f8h AND pos > 0.6, false) AS calm FROM mid LEFT JOIN hr ON hsym = sym AND ht = (t + 900) - (t + 900) % 3600 - 3600 WHERE i >= 59),
r1 AS (""" + " UNION ALL ".join(f"SELECT sym, t, {n} AS n, '{name}' AS id, '{tone}' AS tone, {k} AS priority FROM r0 WHERE {rule}" for n, (name, tone, k, rule) in enumerate(_READS)) + """),
r2 AS (SELECT *, row_number() OVER (PARTITION BY sym, t ORDER BY priority DESC, n) AS rank FROM r1) SELECT sym, t, CAST(rank AS INTEGER) AS rank, id, tone, priority FROM r2 WHERE rank <= 6""")
def grid_insights_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of 15-minute bars, all switches on, with the triggers of the last closed hour."""
    rows = fine_bars(spark, sf_dir)
    return G.insights(G.middle(G.coarser(rows, G.MIDDLE)), G.hourly(G.coarser(rows, G.HOUR), "click"), switches=G.SWITCHED, p=G.WIDE)


@query(f"""{_FINE_CONTEXT}, {_coarse_sql("b15", 900)}, {_coarse_sql("b60", 3600)}, k15 AS (SELECT *, (close / lag(close, 4) OVER (PARTITION BY sym ORDER BY t) - 1) * 100 AS change1h FROM b15)
SELECT c5.sym, c5.t, round((c5.close / c4 - 1) * 100, 4) AS ret4, round(k15.change1h, 4) AS m_change1h, round(k15.funding, 6) AS m_funding, round(b60.close, 6) AS h_close, round(b60.oi, 6) AS h_oi
FROM c5 LEFT JOIN k15 ON k15.sym = c5.sym AND k15.t + 900 <= c5.t + 300 AND k15.t + 1800 > c5.t + 300 LEFT JOIN b60 ON b60.sym = c5.sym AND b60.t + 3600 <= c5.t + 300 AND b60.t + 7200 > c5.t + 300""")
def grid_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 5-minute bar beside the last 15-minute and hourly bars that had closed by its close."""
    rows = fine_bars(spark, sf_dir)
    middle, hour = G.middle(G.coarser(rows, G.MIDDLE)), G.coarser(rows, G.HOUR)
    found = G.seen(G.fine(rows).select("sym", "t", "ret4"), middle, G.MIDDLE, ["change1h", "funding"], "m_")
    return rounded(G.seen(found, hour, G.HOUR, ["close", "oi"], "h_"), {"ret4": 4, "m_change1h": 4, "m_funding": 6, "h_close": 6, "h_oi": 6})
