"""The wide feature row that detectors and insights read: one per (sym, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from . import windows as X


def relative(rows: DataFrame, benchmark: str) -> DataFrame:
    """Adds rs24: percent by which a symbol's return of 24 bars beats the benchmark's at the same time; null where that is unknown."""
    here = Window.partitionBy("t")
    base = F.max(F.when(F.col("sym") == benchmark, F.col("ret24h"))).over(here)
    return rows.withColumn("rs24", (F.col("ret24h") - base) * 100)


def feature_rows(bars: DataFrame, width: int = 3600, tolerance: float = 0.01, block: int = X.BLOCK) -> DataFrame:
    """Features of every bar; tolerance is that of double bottoms. A bar's middle stands for spot, its ticks for spot volume. Open interest stands for the taker volume of the last 24 bars and funding for its share around one half.

    Everything is causal; nulls mean unknown and close every gate that reads them. All frames are computed on one partitioning, by symbol
    and block of bars, so a symbol of any length is many tasks.
    """
    rows = folds.emas(X.indexed(bars), {"ema20": 20, "ema50": 50})
    return X.in_blocks(rows, lambda part: _frames(part, width, tolerance), block).drop("__i")


def _frames(rows: DataFrame, width: int, tolerance: float) -> DataFrame:
    """What looks back over rows; at most X.LEAD of them in all."""
    rows = X.squeeze(rows).withColumnsRenamed({"tight": "squeezed", "breakout": "squeeze_up"})
    rows = X.pullback(rows, 24).withColumnRenamed("pullback", "pullback24")
    rows = X.latest_cross(X.wicks(X.atr(X.width_percentile(rows))), "ema20", "ema50").drop("width")
    rows = rows.withColumns({"i": F.col("__i"), "oi": F.sum("tq").over(X.upto(24)), "funding": (F.try_divide("tq", "q") - 0.5) / 10})
    lag = lambda c, k: F.lag(c, k).over(X.by_time())
    ret = lambda k: F.try_divide(F.col("close"), lag("close", k)) - 1
    day = X.upto(24)
    rows = X.flush_shape(rows, "oi", 48).withColumnsRenamed({"drop_pct": "oi_drop", "rebound_pct": "oi_rebound"}).drop("peak", "trough")
    rows = X.bottoms(rows, tolerance)
    rows = rows.withColumns({
        "change1h": ret(1) * 100, "ret3": ret(3), "ret4h": ret(4), "ret12": ret(12), "ret24h": ret(24),
        "f8h": lag("funding", 8), "f24h": lag("funding", 24), "oi4h": (F.try_divide("oi", lag("oi", 4)) - 1) * 100, "oi24h": (F.try_divide("oi", lag("oi", 24)) - 1) * 100,
        "pos": X.range_position(24), "buy_share": X.up_share(4), "taker4": X.taker_share(4), "vol_z": X.zscore(24), "hi24": X.prior_high(24), "close_hi24": X.prior_high(24, "close"),
        "range24": F.try_divide(F.max("close").over(X.before(24)) - F.min("close").over(X.before(24)), F.min("close").over(X.before(24))) * 100,
        "range_last": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "range_avg": F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).over(day),
        "new_high": F.col("high") >= F.max("high").over(day), "green24": F.avg((F.col("close") > F.col("open")).cast("double")).over(day),
        "was_below": F.coalesce(F.max((F.col("close") < F.col("ema20")).cast("int")).over(X.before(6)) == 1, F.lit(False)), "lo8": F.min("low").over(X.before(8)),
        "oi1h": (F.try_divide("oi", lag("oi", 1)) - 1) * 100, "prev_ema20": lag("ema20", 1), "dense100": F.coalesce(F.col("t") - lag("t", 99) == 99 * width, F.lit(False)),
        "below48": F.sum((F.col("close") < F.col("ema50")).cast("int")).over(X.before(48)) == 48,
        "oi_max": F.max("oi").over(X.upto(48)), "oi_then": lag("oi", 6), "twin_high": F.max("high").over(X.before(22, 3)), "wick": F.try_divide(F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low")), "prev_pos": X.day_position_before(24),
        "spot24": F.sum("n").over(day) * 20.0, "perp24": F.sum("q").over(day), "volume_ratio": F.try_divide("q", F.avg("q").over(X.before(24))),
        "prev_high": lag("high", 1), "prev_low": lag("low", 1), "prev_close": lag("close", 1),
        "pos24": F.coalesce(F.try_divide(F.col("close") - F.min("low").over(day), F.max("high").over(day) - F.min("low").over(day)), F.lit(0.5)),
        "below24": F.sum((F.col("close") < F.col("ema20")).cast("int")).over(X.before(24)) == 24,
        "sweep": F.coalesce((F.col("high") > F.col("low")) & (F.col("low") < F.min("low").over(X.before(24))) & (F.least("open", "close") - F.col("low") >= 0.6 * (F.col("high") - F.col("low"))) & (F.col("close") >= F.col("low") + 0.5 * (F.col("high") - F.col("low"))), F.lit(False)),
        "ls": F.try_divide(X.taker_share(4), 1 - X.taker_share(4)), "spot_basis": (F.try_divide(F.col("close") * 2, F.col("high") + F.col("low")) - 1) * 100, "spot_z": F.when(F.count("n").over(X.before(24)) >= 8, X.zscore(24, 8, "n")),
        "spot_ratio": F.try_divide(F.avg("n").over(X.before(8)), F.when(F.col("i") >= 48, F.avg("n").over(X.before(40, 9)))), "spot_buy": F.try_divide(F.sum("tq").over(X.before(24)), F.sum("q").over(X.before(24))),
    })
    return rows.withColumns({
        "ls_drop": (1 - F.try_divide("ls", lag("ls", 24))) * 100, "swept": F.coalesce(lag("sweep", 1), F.lit(False)), "vol_z2": F.greatest("vol_z", lag("vol_z", 1)), "prev_z": lag("vol_z", 1),
        "coiled": F.coalesce(F.max(F.col("squeezed").cast("int")).over(X.before(7)) == 1, F.lit(False)),
    }).drop("sweep", "ls")


_O = "o AS (PARTITION BY sym ORDER BY t)"
#: The same in DuckDB, after b: common table expressions that end in feat.
def sql(ema_sql, tolerance: float = 0.01, benchmark: str = "click") -> str:
    return f"""{ema_sql(20, name='ema20')}, {ema_sql(50, name='ema50')},
f1 AS (SELECT b.*, e_20.ema20, e_50.ema50 FROM b LEFT JOIN e_20 USING (sym, t) LEFT JOIN e_50 USING (sym, t)),
f2 AS (SELECT *, row_number() OVER o - 1 AS i, sign(ema20 - ema50) AS sg, CASE WHEN lag(close) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr,
 CASE WHEN count(*) OVER w20 = 20 THEN round(4 * stddev_pop(close) OVER w20 / nullif(abs(avg(close) OVER w20), 0), 9) END AS width, CASE WHEN count(*) OVER w20 = 20 THEN 4 * stddev_pop(close) OVER w20 / nullif(abs(avg(close) OVER w20), 0) END AS bw, abs(avg(close) OVER w20) AS mid, sum(tq) OVER w24 AS oi, (tq / nullif(q, 0) - 0.5) / 10 AS funding,
 coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) AS uw, coalesce((least(open, close) - low) / nullif(high - low, 0), 0) AS lw FROM f1 WINDOW {_O}, w20 AS (PARTITION BY sym ORDER BY t ROWS 19 PRECEDING), w24 AS (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING)),
f3 AS (SELECT *, CASE WHEN sg <> lag(sg) OVER o AND sg <> 0 THEN sg END AS cx, list(width) OVER w48 AS ws, list(oi) OVER w49 AS ois, list(close) OVER w24 AS cls, coalesce(bw <= 3 * CASE WHEN count(tr) OVER w20 = 20 THEN avg(tr) OVER w20 END / nullif(mid, 0), false) AS squeezed FROM f2 WINDOW {_O}, w20 AS (PARTITION BY sym ORDER BY t ROWS 19 PRECEDING), w24 AS (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING), w48 AS (PARTITION BY sym ORDER BY t ROWS 47 PRECEDING), w49 AS (PARTITION BY sym ORDER BY t ROWS 48 PRECEDING)),
f4 AS (SELECT *, list_min(ois[list_position(ois, list_max(ois)):]) AS oi_trough, list_max(ois) AS oi_peak, list(squeezed) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS fl, list(high) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hi6 FROM f3),
f5 AS (SELECT *, CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr, CASE WHEN width IS NOT NULL THEN len(list_filter(ws, lambda x: x <= width)) / len(list_filter(ws, lambda x: x IS NOT NULL)) END AS pctile,
 CAST(coalesce(last_value(cx IGNORE NULLS) OVER w8, 0) AS INTEGER) AS "cross", max(uw) OVER w4 AS upper_wick, max(lw) OVER w4 AS lower_wick,
 (1 - oi_trough / nullif(oi_peak, 0)) * 100 AS oi_drop, (oi / nullif(oi_trough, 0) - 1) * 100 AS oi_rebound,
 (close / nullif(lag(close) OVER o, 0) - 1) * 100 AS change1h, close / nullif(lag(close, 3) OVER o, 0) - 1 AS ret3, close / nullif(lag(close, 4) OVER o, 0) - 1 AS ret4h, close / nullif(lag(close, 12) OVER o, 0) - 1 AS ret12, close / nullif(lag(close, 24) OVER o, 0) - 1 AS ret24h,
 lag(funding, 8) OVER o AS f8h, lag(funding, 24) OVER o AS f24h, (oi / nullif(lag(oi, 4) OVER o, 0) - 1) * 100 AS oi4h, (oi / nullif(lag(oi, 24) OVER o, 0) - 1) * 100 AS oi24h,
 CASE WHEN max(high) OVER w25 > min(low) OVER w25 THEN (close - min(low) OVER w25) / (max(high) OVER w25 - min(low) OVER w25) ELSE 0.5 END AS pos,
 coalesce(sum(CASE WHEN close >= open THEN q ELSE 0 END) OVER w4 / nullif(sum(q) OVER w4, 0), 0.5) AS buy_share, sum(tq) OVER w4 / nullif(sum(q) OVER w4, 0) AS taker4,
 CASE WHEN count(q) OVER p24 >= 8 AND stddev_pop(q) OVER p24 > 0 THEN (q - avg(q) OVER p24) / stddev_pop(q) OVER p24 ELSE 0 END AS vol_z, max(high) OVER p24 AS hi24, max(close) OVER p24 AS close_hi24,
 (max(close) OVER p24 - min(close) OVER p24) / nullif(min(close) OVER p24, 0) * 100 AS range24, (high - low) / nullif(close, 0) AS range_last, avg((high - low) / nullif(close, 0)) OVER w24 AS range_avg,
 high >= max(high) OVER w24 AS new_high, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER w24 AS green24, coalesce(max(CAST(close < ema20 AS INTEGER)) OVER p6 = 1, false) AS was_below, min(low) OVER p8 AS lo8,
 (oi / nullif(lag(oi) OVER o, 0) - 1) * 100 AS oi1h, lag(ema20) OVER o AS prev_ema20, coalesce(t - lag(t, 99) OVER o = 356400, false) AS dense100, sum(CAST(close < ema50 AS INTEGER)) OVER p48 = 48 AS below48,
 coalesce(list_contains(fl, true) AND close > list_max(hi6[list_position(fl, true):]), false) AS squeeze_up, -greatest(0, list_max(list_transform(cls, lambda x, i: 1 - x / nullif(list_max(cls[1:i]), 0)))) AS pullback24,
 max(oi) OVER w48 AS oi_max, lag(oi, 6) OVER o AS oi_then, max(high) OVER p22 AS twin_high, (high - greatest(open, close)) / nullif(high - low, 0) AS wick, coalesce((lag(close) OVER o - min(low) OVER p24) / nullif(max(high) OVER p24 - min(low) OVER p24, 0), 0.5) AS prev_pos,
 sum(n) OVER w24 * 20.0 AS spot24, sum(q) OVER w24 AS perp24, q / nullif(avg(q) OVER p24, 0) AS volume_ratio, list({{'w': uw, 'at': -t, 'mark': close <= open}}) OVER w4 AS uppers, list({{'w': lw, 'at': -t, 'mark': close > low + 0.5 * (high - low)}}) OVER w4 AS lowers,
 lag(high) OVER o AS prev_high, lag(low) OVER o AS prev_low, lag(close) OVER o AS prev_close,
 coalesce((close - min(low) OVER w24) / nullif(max(high) OVER w24 - min(low) OVER w24, 0), 0.5) AS pos24, sum(CAST(close < ema20 AS INTEGER)) OVER p24 = 24 AS below24,
 coalesce(high > low AND low < min(low) OVER p24 AND least(open, close) - low >= 0.6 * (high - low) AND close >= low + 0.5 * (high - low), false) AS sweep,
 (close * 2 / nullif(high + low, 0) - 1) * 100 AS spot_basis, CASE WHEN count(n) OVER p24 >= 8 THEN CASE WHEN stddev_pop(n) OVER p24 > 0 THEN (n - avg(n) OVER p24) / stddev_pop(n) OVER p24 ELSE 0 END END AS spot_z,
 avg(n) OVER p8 / nullif(CASE WHEN i >= 48 THEN avg(n) OVER p40 END, 0) AS spot_ratio, sum(tq) OVER p24 / nullif(sum(q) OVER p24, 0) AS spot_buy,
 list(low) OVER w20 AS lo20, list(high) OVER w20 AS hi20
 FROM f4 WINDOW {_O}, w48 AS (PARTITION BY sym ORDER BY t ROWS 47 PRECEDING), p22 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 3 PRECEDING), w4 AS (PARTITION BY sym ORDER BY t ROWS 3 PRECEDING), w8 AS (PARTITION BY sym ORDER BY t ROWS 7 PRECEDING), w14 AS (PARTITION BY sym ORDER BY t ROWS 13 PRECEDING), w24 AS (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING), w25 AS (PARTITION BY sym ORDER BY t ROWS 24 PRECEDING),
 p24 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), p6 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), p8 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), p48 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING),
 p40 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 48 PRECEDING AND 9 PRECEDING), w20 AS (PARTITION BY sym ORDER BY t ROWS 19 PRECEDING)),
f6 AS (SELECT *, (1 - taker4 / nullif(1 - taker4, 0) / nullif(lag(taker4 / nullif(1 - taker4, 0), 24) OVER o, 0)) * 100 AS ls_drop, coalesce(lag(sweep) OVER o, false) AS swept, greatest(vol_z, lag(vol_z) OVER o) AS vol_z2, lag(vol_z) OVER o AS prev_z, upper_wick > 0 AND list_max(uppers)['mark'] AS upper_red, lower_wick > 0 AND list_max(lowers)['mark'] AS lower_strong,
 coalesce(max(CAST(squeezed AS INTEGER)) OVER p7 = 1, false) AS coiled,
 i >= 29 AND coalesce(list_bool_or(list_transform(range(14, 20), lambda j: list_bool_or(list_transform(range(2, 13), lambda a: coalesce(lo20[j] <= lo20[j - 1] AND lo20[j] <= lo20[j + 1] AND lo20[j - a] <= lo20[j - a - 1] AND lo20[j - a] <= lo20[j - a + 1]
  AND abs(lo20[j] / nullif(lo20[j - a], 0) - 1) <= {tolerance} AND list_max(hi20[j - a + 1:j - 1]) > 0 AND close > list_max(hi20[j - a + 1:j - 1]), false))))), false) AS w_neck,
 i >= 29 AND coalesce(list_bool_or(list_transform(range(7, 18), lambda k: coalesce(lo20[k] <= lo20[k - 1] AND lo20[k] <= lo20[k + 1] AND lo20[19] < lo20[k] AND prev_close > lo20[k], false))), false) AS w_spring
 FROM f5 WINDOW {_O}, p7 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
feat AS (SELECT x.*, (x.ret24h - k.ret24h) * 100 AS rs24 FROM f6 x LEFT JOIN (SELECT t, ret24h FROM f6 WHERE sym = '{benchmark}') k ON k.t = x.t)"""
