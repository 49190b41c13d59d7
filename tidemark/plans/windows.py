"""Queries on indicator windows and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, thinning, windows as X
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, TRADE_BARS_SQL, event_bars, trade_bars
from .bars import rounded

_W = "PARTITION BY sym ORDER BY t"
Z24 = f"CASE WHEN count(q) OVER p24 >= 8 AND stddev_pop(q) OVER p24 > 0 THEN (q - avg(q) OVER p24) / stddev_pop(q) OVER p24 ELSE 0 END"
P24 = f"p24 AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@query(f"{EVENT_BARS_SQL} SELECT sym, t, round({Z24}, 6) AS z FROM b WINDOW {P24}")
def vol_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select("sym", "t", F.round(X.zscore(24), 6).alias("z"))


_BOLL = f"SELECT sym, t, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS mid, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w + 2 * stddev_pop(close) OVER w, 6) END AS upper, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w - 2 * stddev_pop(close) OVER w, 6) END AS lower FROM b WINDOW w AS ({_W} ROWS 19 PRECEDING)"


@query(f"{TRADE_BARS_SQL} {_BOLL}")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir).select("sym", "t", *[F.round(c, 6).alias(n) for n, c in X.bollinger().items()])


@query(f"""{EVENT_BARS_SQL}, w AS (SELECT sym, t, CASE WHEN count(*) OVER w = 20 THEN round(4 * stddev_pop(close) OVER w / nullif(abs(avg(close) OVER w), 0), 9) END AS width FROM b WINDOW w AS ({_W} ROWS 19 PRECEDING)),
f AS (SELECT *, list(width) OVER ({_W} ROWS 47 PRECEDING) AS ws FROM w)
SELECT sym, t, CASE WHEN width IS NOT NULL THEN round(len(list_filter(ws, lambda x: x <= width)) / len(list_filter(ws, lambda x: x IS NOT NULL)), 6) END AS pctile FROM f""")
def bb_pctile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.width_percentile(event_bars(spark, sf_dir)).select("sym", "t", "pctile"), {"pctile": 6})


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym, t, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM b WINDOW w AS ({_W}))
SELECT sym, t, CASE WHEN count(tr) OVER w = 14 THEN round(avg(tr) OVER w, 6) END AS atr FROM r WINDOW w AS ({_W} ROWS 13 PRECEDING)""")
def atr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.atr(event_bars(spark, sf_dir)).select("sym", "t", "atr"), {"atr": 6})


@query(f"""{TRADE_BARS_SQL}, v AS (SELECT *, q / nullif((high + low + close) / 3, 0) AS base FROM b)
SELECT sym, t, CASE WHEN sum(base) OVER w > 0 THEN round(sum(q) OVER w / sum(base) OVER w, 6) END AS vwap FROM v WINDOW w AS ({_W} ROWS 23 PRECEDING)""")
def vwap_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.rolling_vwap(trade_bars(spark, sf_dir)).select("sym", "t", "vwap"), {"vwap": 6})


@query(f"""{EVENT_BARS_SQL}, v AS (SELECT *, q / nullif((high + low + close) / 3, 0) AS base FROM b WHERE t >= 1704672000)
SELECT sym, t, CASE WHEN sum(base) OVER w > 0 THEN round(sum(q) OVER w / sum(base) OVER w, 6) END AS vwap FROM v WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""")
def vwap_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.anchored_vwap(event_bars(spark, sf_dir), F.col("t") >= 1704672000).where("t >= 1704672000").select("sym", "t", "vwap"), {"vwap": 6})


@query(f"""{EVENT_BARS_SQL} SELECT sym, t, round(CASE WHEN max(high) OVER w > min(low) OVER w THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) ELSE 0.5 END, 6) AS pos,
round(close / nullif(coalesce(lag(close, 4) OVER o, first_value(close) OVER o), 0) - 1, 6) AS r4, round(coalesce(sum(CASE WHEN close >= open THEN q ELSE 0 END) OVER s / nullif(sum(q) OVER s, 0), 0.5), 6) AS up_share,
round(sum(tq) OVER s / nullif(sum(q) OVER s, 0), 6) AS taker_share FROM b WINDOW o AS ({_W}), w AS ({_W} ROWS 96 PRECEDING), s AS ({_W} ROWS 3 PRECEDING)""")
def range_and_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select(
        "sym", "t", F.round(X.range_position(), 6).alias("pos"), F.round(X.change(4), 6).alias("r4"), F.round(X.up_share(4), 6).alias("up_share"), F.round(X.taker_share(4), 6).alias("taker_share")
    )


_STRENGTH = f"""b2 AS (SELECT *, sum(tq) OVER ({_W} ROWS 23 PRECEDING) AS oi, (tq / nullif(q, 0) - 0.5) / 10 AS funding FROM b),
x AS (SELECT sym, t, q, close, funding, row_number() OVER o - 1 AS i, close / nullif(coalesce(lag(close, 4) OVER o, first_value(close) OVER o), 0) - 1 AS r4,
 CASE WHEN coalesce(lag(oi, 4) OVER o, first_value(oi) OVER o) > 0 THEN coalesce(oi / coalesce(lag(oi, 4) OVER o, first_value(oi) OVER o) - 1, 0) ELSE 0 END AS o4,
 CASE WHEN stddev_pop(q) OVER p8 > 0 THEN (q - avg(q) OVER p8) / stddev_pop(q) OVER p8 ELSE 0 END AS vz,
 CASE WHEN max(high) OVER w > min(low) OVER w THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) ELSE 0.5 END AS pos,
 coalesce(sum(CASE WHEN close >= open THEN q ELSE 0 END) OVER s / nullif(sum(q) OVER s, 0), 0.5) AS buy
 FROM b2 WINDOW o AS ({_W}), p8 AS ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), w AS ({_W} ROWS 8 PRECEDING), s AS ({_W} ROWS 4 PRECEDING)),
y AS (SELECT sym, t, q, close, CASE WHEN i >= 1 THEN least(98.0, greatest(3.0, 50 + 24 * (o4 / 0.05) / (1 + abs(o4 / 0.05)) + 16 * (r4 / 0.06) / (1 + abs(r4 / 0.06)) + 14 * least(1, greatest(-1, (buy - 0.5) * 2)) + 20 * (0.5 - pos) + 8 * (vz / 2) / (1 + abs(vz / 2)) - 14 * least(1, greatest(0, (coalesce(funding, 0) - 0.03) / 0.05)))) END AS s FROM x),
st AS (SELECT sym, t, q, close, coalesce(s, first_value(s IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 50.0) AS strength FROM y)"""


def with_interest(bars: DataFrame) -> DataFrame:
    """The taker volume of 24 bars stands for open interest, a bar's taker share around one half for funding."""
    return bars.withColumns({"oi": F.sum("tq").over(X.upto(24)), "funding": (F.try_divide("tq", "q") - 0.5) / 10})


@query(f"{EVENT_BARS_SQL}, {_STRENGTH} SELECT sym, t, round(strength, 5) AS strength FROM st")
def strength_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.strength(with_interest(event_bars(spark, sf_dir))).select("sym", "t", "strength"), {"strength": 5})


@query(f"{TRADE_BARS_SQL}, {_STRENGTH}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(strength, 6) DESC, round(q, 4) DESC, sym) AS rank FROM st) SELECT sym, t, round(strength, 5) AS strength, rank FROM r WHERE rank <= 10")
def strength_rank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.ranked(X.strength(with_interest(trade_bars(spark, sf_dir))), 10, [F.round("strength", 6).desc(), F.round("q", 4).desc(), F.col("sym")])
    return rounded(rows.select("sym", "t", "strength", F.col("rank").cast("long").alias("rank")), {"strength": 5})


@query(f"""{EVENT_BARS_SQL}, f AS (SELECT sym, t, close, list(close) OVER ({_W} ROWS 48 PRECEDING) AS f FROM b), k AS (SELECT *, list_max(f) AS peak, list_position(f, list_max(f)) AS k FROM f),
m AS (SELECT *, list_min(f[k:]) AS trough FROM k)
SELECT sym, t, round(peak, 6) AS peak, round(trough, 6) AS trough, round((1 - trough / nullif(peak, 0)) * 100, 5) AS drop_pct, round((close / nullif(trough, 0) - 1) * 100, 4) AS rebound_pct FROM m""")
def flush_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.flush_shape(event_bars(spark, sf_dir)).select("sym", "t", "peak", "trough", "drop_pct", "rebound_pct")
    return rounded(rows, {"peak": 6, "trough": 6, "drop_pct": 5, "rebound_pct": 4})


@query(f"""{EVENT_BARS_SQL}, f AS (SELECT sym, t, list(close) OVER ({_W} ROWS 95 PRECEDING) AS f FROM b)
SELECT sym, t, round(greatest(0, list_max(list_transform(f, lambda x, i: 1 - x / nullif(list_max(f[1:i]), 0)))), 6) AS drawdown FROM f""")
def causal_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.causal_drawdown(event_bars(spark, sf_dir)).select("sym", "t", "drawdown"), {"drawdown": 6})


@query(f"""{EVENT_BARS_SQL}, f AS (SELECT sym, t, close, list_reverse(list(high) OVER ({_W} ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)) AS f FROM b)
SELECT sym, t, CAST(coalesce(nullif(list_position(list_transform(f, lambda h: h >= close), true), 0), 240) AS BIGINT) AS age FROM f""")
def fresh_high_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.high_age(event_bars(spark, sf_dir)).select("sym", "t", "age")


@query(f"""{EVENT_BARS_SQL}, s AS (SELECT sym, t, coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) AS uw, coalesce((least(open, close) - low) / nullif(high - low, 0), 0) AS lw FROM b),
f AS (SELECT *, max(uw) OVER w AS upper_wick, max(lw) OVER w AS lower_wick, list(uw) OVER w AS us, list(lw) OVER w AS ls, list(t) OVER w AS ts FROM s WINDOW w AS ({_W} ROWS 3 PRECEDING))
SELECT sym, t, round(upper_wick, 6) AS upper_wick, ts[list_position(us, upper_wick)] AS upper_t, round(lower_wick, 6) AS lower_wick, ts[list_position(ls, lower_wick)] AS lower_t FROM f""")
def wick_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.wicks(event_bars(spark, sf_dir)).select("sym", "t", "upper_wick", "upper_t", "lower_wick", "lower_t")
    return rounded(rows, {"upper_wick": 6, "lower_wick": 6})


def ema_sql(period: int, source: str = "b", name: str = "ema") -> str:
    """Common table expressions that end in e_<period> (sym, t, i, ema)."""
    k = f"(2.0 / {period + 1})"
    return f"""i_{period} AS (SELECT sym, t, close, row_number() OVER ({_W}) - 1 AS i FROM {source}),
s_{period} AS (SELECT sym, avg(close) AS seed FROM i_{period} WHERE i < {period} GROUP BY 1 HAVING count(*) = {period}),
e_{period} AS (SELECT x.sym, x.t, x.i, seed AS {name} FROM i_{period} x JOIN s_{period} USING (sym) WHERE x.i = {period - 1}
 UNION ALL SELECT x.sym, x.t, x.i, x.close * {k} + e.{name} * (1 - {k}) FROM e_{period} e JOIN i_{period} x ON x.sym = e.sym AND x.i = e.i + 1)"""


@query(f"{EVENT_BARS_SQL}, {ema_sql(20)} SELECT b.sym, b.t, round(ema, 6) AS ema FROM b LEFT JOIN e_20 USING (sym, t)")
def ema20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.ema(event_bars(spark, sf_dir), 20).select("sym", "t", "ema"), {"ema": 6})


@query(f"""{EVENT_BARS_SQL}, {ema_sql(20, name='f')}, {ema_sql(50, name='s')}, d AS (SELECT b.sym, b.t, sign(f - s) AS sg FROM b LEFT JOIN e_20 USING (sym, t) LEFT JOIN e_50 USING (sym, t)),
x AS (SELECT *, lag(sg) OVER ({_W}) AS pv FROM d), y AS (SELECT sym, t, CASE WHEN sg <> pv AND sg <> 0 THEN sg END AS c FROM x)
SELECT sym, t, CAST(coalesce(last_value(c IGNORE NULLS) OVER ({_W} ROWS 7 PRECEDING), 0) AS INTEGER) AS "cross" FROM y""")
def ema_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.emas(event_bars(spark, sf_dir), {"f": 20, "s": 50})
    return X.latest_cross(rows, "f", "s").select("sym", "t", "cross")


@query(f"""{EVENT_BARS_SQL}, {ema_sql(50)}, d AS (SELECT b.sym, b.t, CAST(b.close < ema AS INTEGER) AS f FROM b LEFT JOIN e_50 USING (sym, t))
SELECT sym, t, coalesce(count(f) OVER w = 6 AND min(f) OVER w = 1, false) AS run FROM d WINDOW w AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def below_ema_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.ema(event_bars(spark, sf_dir), 50)
    return X.below_run(rows, F.col("close") < F.col("ema"), 6).select("sym", "t", F.coalesce("run", F.lit(False)).alias("run"))


@query(f"""{EVENT_BARS_SQL}, d AS (SELECT sym, t, close > open AS f FROM b), e AS (SELECT *, CAST(f AND NOT coalesce(lag(f) OVER ({_W}), false) AS INTEGER) AS e FROM d),
r AS (SELECT *, sum(e) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM e), m AS (SELECT sym, run, min(t) AS since FROM r WHERE f GROUP BY 1, 2)
SELECT r.sym, r.t, CASE WHEN f THEN since END AS since FROM r LEFT JOIN m USING (sym, run)""")
def presence_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.presence_start(event_bars(spark, sf_dir), F.col("close") > F.col("open")).select("sym", "t", "since")


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM b WINDOW w AS ({_W})),
x AS (SELECT sym, t, high, close, coalesce(CASE WHEN count(*) OVER w = 20 THEN 4 * stddev_pop(close) OVER w / nullif(abs(avg(close) OVER w), 0) END <= 3 * CASE WHEN count(tr) OVER w = 20 THEN avg(tr) OVER w END / nullif(abs(avg(close) OVER w), 0), false) AS tight FROM r WINDOW w AS ({_W} ROWS 19 PRECEDING)),
f AS (SELECT *, list(tight) OVER w AS fl, list(high) OVER w AS hi FROM x WINDOW w AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT sym, t, tight, coalesce(list_contains(fl, true) AND close > list_max(hi[list_position(fl, true):]), false) AS breakout FROM f""")
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.squeeze(event_bars(spark, sf_dir)).select("sym", "t", "tight", F.coalesce("breakout", F.lit(False)).alias("breakout"))


@query(f"""{EVENT_BARS_SQL}, n AS (SELECT sym, t, low, high, close, row_number() OVER ({_W}) AS i, lag(low) OVER ({_W}) AS lp, lead(low) OVER ({_W}) AS ln FROM b),
m AS (SELECT * FROM n WHERE low < lp AND low <= ln),
p AS (SELECT DISTINCT c.sym, c.t FROM n c JOIN m j ON j.sym = c.sym AND j.i BETWEEN c.i - 5 AND c.i - 1 JOIN m k ON k.sym = c.sym AND j.i - k.i BETWEEN 2 AND 12 AND k.i >= c.i - 18
  AND abs(j.low - k.low) <= 0.3 * abs(k.low) WHERE c.i >= 20 AND c.close > (SELECT max(high) FROM n h WHERE h.sym = c.sym AND h.i BETWEEN k.i AND j.i))
SELECT sym, t FROM p""")
def double_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.double_bottom(event_bars(spark, sf_dir), tolerance=0.3).where("bottom").select("sym", "t")


@query(f"""{EVENT_BARS_SQL}, h AS (SELECT sym, t, row_number() OVER ({_W}) AS i FROM b WHERE close > open),
k AS (SELECT sym, t, i FROM h WHERE i = 1 UNION ALL SELECT sym, t, i FROM (SELECT h.sym, h.t, h.i, row_number() OVER (PARTITION BY h.sym, k.t ORDER BY h.t) AS rn FROM k JOIN h ON h.sym = k.sym AND h.t >= k.t + 86400) WHERE rn = 1)
SELECT sym, t FROM k""")
def cooldown_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinning.cooldown(event_bars(spark, sf_dir).where("close > open").select("sym", "t"), 86400, ["sym"])


@query(f"""{EVENT_BARS_SQL}, f AS (SELECT sym, t, list(close) OVER ({_W} ROWS 23 PRECEDING) AS f FROM b)
SELECT sym, t, round(-greatest(0, list_max(list_transform(f, lambda x, i: 1 - x / nullif(list_max(f[1:i]), 0)))), 6) AS pullback FROM f""")
def max_pullback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.pullback(event_bars(spark, sf_dir), 24).select("sym", "t", "pullback"), {"pullback": 6})
