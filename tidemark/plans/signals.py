"""Queries on features, detectors and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detectors as D
from ..operators import features as X
from ..operators import windows as W
from ..operators.deep import store_state
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, TRADE_BARS_SQL, event_bars, table, ticks, trade_bars
from .bars import rounded
from .windows import _STRENGTH, ema_sql, with_interest

#: Double bottoms of the test series are this far apart.
TOLERANCE = 0.3
FEATURES_SQL = f"{EVENT_BARS_SQL}, {X.sql(ema_sql, TOLERANCE)}"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relative(X.feature_rows(event_bars(spark, sf_dir), tolerance=TOLERANCE), "click")


@query(f"""{TRADE_BARS_SQL}, z AS (SELECT sym, t, close, row_number() OVER o - 1 AS i, max(high) OVER p AS hi, CASE WHEN count(q) OVER p >= 8 AND stddev_pop(q) OVER p > 0 THEN (q - avg(q) OVER p) / stddev_pop(q) OVER p ELSE 0 END AS z
FROM b WINDOW o AS (PARTITION BY sym ORDER BY t), p AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT sym, t, round(close, 8) AS close, round(hi, 8) AS hi24, round(z, 5) AS z FROM z WHERE i >= 25 AND close > hi AND z >= 1.5""")
def breakout_envelope_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trade_bars(spark, sf_dir).select("sym", "t", "close", W.index().alias("i"), W.prior_high().alias("hi24"), W.zscore(24).alias("z")).where("i >= 25 AND close > hi24 AND z >= 1.5")
    return rounded(rows.drop("i"), {"close": 8, "hi24": 8, "z": 5})


@query(f"""{EVENT_BARS_SQL}, z AS (SELECT sym, t, close, row_number() OVER o - 1 AS i, max(high) OVER p AS hi, CASE WHEN count(q) OVER p >= 8 AND stddev_pop(q) OVER p > 0 THEN (q - avg(q) OVER p) / stddev_pop(q) OVER p ELSE 0 END AS z
FROM b WINDOW o AS (PARTITION BY sym ORDER BY t), p AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT sym, t, round(close, 6) AS close, round(hi, 6) AS hi24, round(z, 5) AS z FROM z WHERE i >= 25 AND close > hi AND z >= 1.5""")
def breakout_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every completed bar: which series closed above the high of the 24 bars before on volume?"""
    rows = event_bars(spark, sf_dir).select("sym", "t", "close", W.index().alias("i"), W.prior_high().alias("hi24"), W.zscore(24).alias("z")).where("i >= 25 AND close > hi24 AND z >= 1.5")
    return rounded(rows.drop("i"), {"close": 6, "hi24": 6, "z": 5})


_F = ["pullback24", "oi1h", "change1h", "ret4h", "ret24h", "funding", "f8h", "oi4h", "oi_drop", "oi_rebound", "pos", "buy_share", "taker4", "vol_z", "range24", "range_avg", "green24", "upper_wick", "lower_wick", "pctile"]


@query(f"{FEATURES_SQL} SELECT sym, t, {', '.join(f'round({c}, 7) AS {c}' for c in _F)}, new_high, was_below, squeezed, squeeze_up, dense100, \"cross\" FROM feat")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir).select("sym", "t", *_F, "new_high", "was_below", "squeezed", "squeeze_up", "dense100", "cross"), dict.fromkeys(_F, 7))


#: The numbers of both sets of thresholds, for the SQL below, which states every rule by itself.
_PRODUCTION = dict(z=1.5, spring=1.25, climax=2.5, flushed=0.92, deep=8, base=6, calm=0.01, up4=6, reclaim=0.7, board=0.7, mild=3.2, flat=0.01, quiet=1.5, sz=2, sbasis=0.05, sratio=1.5)
_SCALED = dict(z=1.0, spring=0.5, climax=1.5, flushed=0.80, deep=20, base=100000, calm=0.05, up4=500, reclaim=0.9, board=0.95, mild=500, flat=0.5, quiet=20, sz=1.0, sbasis=60, sratio=1.1)


def _detector_sql(k: dict, name: str = "fd") -> str:
    """Common table expression of (sym, t, detector, side)."""
    blocks = f"""{name}_0 AS (SELECT *, coalesce(i >= 25 AND close > hi24 AND vol_z >= {k["z"]}, false) AS broke, oi_drop >= {k["deep"]} AS flushed, coalesce(i >= 31 AND oi_max > 0 AND oi / oi_max <= {k["flushed"]} AND oi / oi_then > 1.005 AND range24 <= {k["base"]} AND funding BETWEEN -{k["calm"]} AND {k["calm"]}, false) AS based,
 coalesce(i >= 32 AND ret24h >= 0.15 AND pos24 >= 0.8 AND vol_z >= {k["z"]}, false) AS topping, coalesce(i >= 100 AND close > ema20 AND prev_close <= prev_ema20 AND ret4h <= {k["up4"] / 100} AND pos <= {k["reclaim"]}, false) AS reclaims,
 coalesce(i >= 52 AND swept AND close > prev_high AND vol_z2 >= {k["z"]}, false) AS swept_up, coalesce(i >= 52 AND ret4h <= {k["up4"] / 100} AND pos24 <= {k["board"]} AND vol_z >= {k["z"]}, false) AS boards, coalesce(close > ema20 AND prev_close <= prev_ema20, false) AS crossed_up FROM feat)"""
    rules = {
        "breakout-envelope": "broke", "flush-context": "based", "flush-breakout": f"based AND close > close_hi24 AND vol_z >= {k['z']}", "early-setup": "based", "early-accum": "based AND ls_drop >= 5 AND rs24 >= 2",
        "rebuild-1": "broke AND oi4h >= 3 AND flushed", "rebuild-2": f"broke AND oi4h >= 3 AND ret4h BETWEEN 0 AND {k['up4'] / 100}", "rebuild-3": "broke AND oi4h >= 3 AND flushed AND funding <= 0.02",
        "virgin-1": "broke AND oi4h >= 3 AND NOT flushed", "virgin-2": "broke AND oi24h >= 8 AND NOT flushed", "virgin-3": "broke AND oi24h >= 8 AND NOT flushed AND funding <= 0.02",
        "top-1-reject": "topping AND high BETWEEN 0.99 * twin_high AND 1.01 * twin_high AND close <= 0.99 * high AND open >= close", "top-2-wick": "topping AND high > hi24 AND wick >= 0.5 AND oi4h <= -1.5",
        "top-3-climax": f"topping AND prev_z >= {k['climax']} AND prev_pos >= 0.85 AND close < prev_low", "top-4-stall": "topping AND funding >= 0.015 AND f8h < funding AND ret4h <= 0.01",
        "w-bottom-1": f"ret24h >= 0.1 AND w_neck AND vol_z >= {k['z']}", "w-bottom-2": f"ret24h >= 0.1 AND w_spring AND vol_z >= {k['spring']} AND close > open", "w-bottom-3": f"ret24h >= 0.1 AND w_neck AND vol_z >= {k['z']} AND oi4h >= 0",
        "ema-reclaim": "reclaims", "boarding-1": f"reclaims AND was_below AND vol_z >= {k['z']}", "boarding-2": f"reclaims AND dense100 AND below48 AND vol_z >= {k['z']}", "boarding-2-oi": f"reclaims AND dense100 AND below48 AND vol_z >= {k['z']} AND oi1h > 0 AND oi4h >= 3",
        "boarding-oi": "reclaims AND was_below AND oi4h >= 3", "squeeze-setup": "squeezed", "squeeze-breakout": "squeeze_up", "flush-wick-1": "swept_up", "flush-wick-2": "swept_up AND ema20 > ema50", "flush-wick-3": "swept_up AND coiled",
        "ignition-1h": f"i >= 25 AND change1h >= 5 AND vol_z >= {k['z']}", "boarding-deep": "boards AND ret24h <= -0.08 AND pos24 <= 0.45 AND change1h >= 2", "boarding-long": "boards AND i >= 98 AND crossed_up AND below48", "boarding-scan": "boards AND crossed_up AND below24",
        "boarding-mild": f"boards AND change1h > 0.2 AND change1h <= {k['mild']} AND oi4h > 0.8 AND oi4h < 14 AND taker4 > 0.55 AND funding <= 0.02",
        "spot-pump": f"i >= 4 AND ret4h >= 0.02 AND abs(oi4h) < {k['quiet']} AND spot_z >= {k['sz']} AND spot_basis <= {k['sbasis']}", "spot-accum": f"i >= 48 AND abs(ret4h) < {k['flat']} AND spot_ratio >= {k['sratio']} AND spot_buy >= 0.55 AND abs(oi4h) < {2 * k['quiet']}",
        "organic-spot": "ret4h >= 0.02 AND taker4 > 0.55 AND spot_basis <= 0 AND perp24 <= spot24", "leverage-froth": "funding >= 0.01 AND spot_basis >= 0.1 AND 2 * spot24 < perp24",
    }
    short = ("top-1-reject", "top-2-wick", "top-3-climax", "top-4-stall", "leverage-froth")
    return f"{blocks}, {name} AS (" + " UNION ALL ".join(f"SELECT sym, t, '{d}' AS detector, '{'short' if d in short else 'long'}' AS side FROM {name}_0 WHERE {rule}" for d, rule in rules.items()) + ")"


@query(f"{FEATURES_SQL}, {_detector_sql(_SCALED)} SELECT * FROM fd")
def detectors_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(features(spark, sf_dir), D.SCALED)


@query(f"{FEATURES_SQL}, {_detector_sql(_PRODUCTION)} SELECT detector, side, count(*) AS n, count(DISTINCT sym) AS syms FROM fd GROUP BY 1, 2")
def detectors_production_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(features(spark, sf_dir)).groupBy("detector", "side").agg(F.count("*").alias("n"), F.count_distinct("sym").alias("syms"))


@query(f"{FEATURES_SQL}, {_detector_sql(_SCALED)} SELECT a.detector AS a, z.detector AS b, count(*) AS n FROM fd a JOIN fd z ON a.sym = z.sym AND a.t = z.t AND a.detector < z.detector GROUP BY 1, 2")
def detector_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two detectors fire on one bar: pairs within a bar's short list, never across bars."""
    fired = D.detect(features(spark, sf_dir), D.SCALED).groupBy("sym", "t").agg(F.array_sort(F.collect_set("detector")).alias("d"))
    pairs = fired.select(F.explode("d").alias("a"), "d").select("a", F.explode("d").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _insight_sql(rules: list[tuple[str, str, int, str]]) -> str:
    fired = " UNION ALL ".join("SELECT sym, t, {} AS i, '{}' AS id, '{}' AS tone, {} AS priority FROM feat WHERE {}".format(i, n, tone, p, text.replace("`", '"')) for i, (n, tone, p, text) in enumerate(rules))
    return f"{FEATURES_SQL}, f AS ({fired}), r AS (SELECT *, row_number() OVER (PARTITION BY sym, t ORDER BY priority DESC, i) AS rank FROM f) SELECT sym, t, CAST(rank AS INTEGER) AS rank, id, tone, priority FROM r WHERE rank <= 6"


@query(_insight_sql(D.insight_rules()))
def insights_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.insights(features(spark, sf_dir))


@query(_insight_sql(D.insight_rules(D.SWITCHED, D.SCALED)))
def insights_switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All switches on, over detectors scaled to the test series."""
    return D.insights(features(spark, sf_dir), switches=D.SWITCHED, params=D.SCALED)


_INSIGHTS = _insight_sql(D.insight_rules()).replace("SELECT sym, t, CAST(rank AS INTEGER) AS rank", ", r6 AS (SELECT sym, t, CAST(rank AS INTEGER) AS rank") + ")"
_MARKS = """w1 AS (SELECT sym, t, max(CASE WHEN cx IS NOT NULL THEN t END) OVER (PARTITION BY sym ORDER BY t ROWS 7 PRECEDING) AS cross_t, list({'v': uw, 'nt': -t}) OVER w4 AS us, list({'v': lw, 'nt': -t}) OVER w4 AS ls FROM f3 WINDOW w4 AS (PARTITION BY sym ORDER BY t ROWS 3 PRECEDING)),
w2 AS (SELECT sym, t, cross_t, -list_max(us).nt AS upper_t, -list_max(ls).nt AS lower_t FROM w1)"""


@query(f"{_INSIGHTS}, {_MARKS} SELECT r6.*, coalesce(CASE id " + " ".join(f"WHEN '{name}' THEN {c}" for name, c in D.ANCHORS.items()) + " END, t) AS anchor_t FROM r6 JOIN w2 USING (sym, t)")
def insight_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights with the bar that each marks: a cross, the longest wick, or the last bar."""
    return D.anchored_insights(features(spark, sf_dir))


_NOW = 1706400000


@query(f"""{FEATURES_SQL}, one AS (SELECT * FROM feat WHERE sym = 'view' AND t + 3600 <= {_NOW} ORDER BY t DESC LIMIT 1),
st AS (SELECT count(*) FILTER (ts <= {_NOW} - 169200) > 0 AND max(ts) >= {_NOW} - 1200 AS ready FROM ev WHERE sym = 'view' AND ts > {_NOW} - 176400 AND ts <= {_NOW})
SELECT 'cold' AS mode, sym, t, round(ret24h, 4) AS ret24h, round(vol_z, 4) AS vol_z, round(oi4h, 4) AS oi4h FROM one UNION ALL SELECT 'warm', sym, CASE WHEN ready THEN t END, CASE WHEN ready THEN round(ret24h, 4) END, CASE WHEN ready THEN round(vol_z, 4) END, CASE WHEN ready THEN round(oi4h, 4) END FROM one, st""")
def single_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last closed bar of one symbol on demand; warm, its values are null unless the store is ready. Only that symbol's ticks are shuffled."""
    bars = event_bars(spark, sf_dir).where("sym = 'view'")
    last = X.feature_rows(bars, tolerance=TOLERANCE).where(F.col("t") + 3600 <= _NOW).groupBy("sym").agg(F.max_by(F.struct("t", "ret24h", "vol_z", "oi4h"), "t").alias("r")).select("sym", "r.*")
    state = store_state(ticks(spark, sf_dir).where("sym = 'view'"), _NOW).select("sym", (F.col("warm") & F.col("fresh")).alias("ready"))
    names = ["t", "ret24h", "vol_z", "oi4h"]
    warm = last.join(state, "sym", "left").select(F.lit("warm").alias("mode"), "sym", *[F.when(F.col("ready"), F.col(c)).alias(c) for c in names])
    return rounded(last.select(F.lit("cold").alias("mode"), "sym", *names).unionByName(warm), dict.fromkeys(names[1:], 4))


#: Side by side what a long and a short must show; the first part, what must be known for either.
_FILTERS = {
    "trend-aligned": ("r4, r24, k24", "r4 > 0 AND r24 > 0 AND k24 >= 0", "r4 < 0 AND k24 <= 0"),
    "flow-confirmed": ("r1, o4, rate, tb", "r1 > 0 AND o4 BETWEEN 0 AND 0.15 AND rate <= 0.0003 AND tb >= 0.52", "r1 < 0 AND o4 BETWEEN 0 AND 0.15 AND rate >= 0 AND tb <= 0.48"),
    "uncrowded-trend": ("r4, k24, o4, rate", "r4 > 0 AND r4 <= 0.06 AND k24 >= 0 AND o4 BETWEEN 0 AND 0.1 AND rate <= 0.0001", "r4 < 0 AND k24 <= 0 AND o4 BETWEEN 0 AND 0.1 AND rate >= 0"),
    "reversal-confirmed": ("r1, r24, pos, o4", "r24 < 0 AND r1 > 0 AND pos <= 0.65 AND o4 >= 0", "r24 > 0 AND r1 < 0 AND pos >= 0.65 AND o4 >= 0"),
    "participation-quality": ("r1, tb, vr, strength", "vr >= 1.2 AND strength >= 55 AND strength <= 85 AND r1 > 0 AND tb >= 0.52", "vr >= 1.2 AND strength >= 55 AND strength <= 85 AND r1 < 0 AND tb <= 0.48"),
}


@query(f"""{FEATURES_SQL}, {_detector_sql(_SCALED)}, {_STRENGTH}, inp AS (SELECT x.sym, x.t, x.ret4h AS r4, x.ret24h AS r24, k.ret24h AS k24, x.pos, x.volume_ratio AS vr, x.change1h / 100 AS r1, x.oi4h / 100 AS o4, x.funding / 100 AS rate, x.tq / nullif(x.q, 0) AS tb, st.strength
FROM feat x LEFT JOIN feat k ON k.sym = 'click' AND k.t = x.t LEFT JOIN st ON st.sym = x.sym AND st.t = x.t)
""" + " UNION ALL ".join(f"SELECT '{n}' AS filter, side, count(*) AS n FROM fd JOIN inp USING (sym, t) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in read.split(", ")) + f" AND CASE side WHEN 'long' THEN {a} ELSE {b} END GROUP BY side" for n, (read, a, b) in _FILTERS.items()))
def remediation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    inputs = D.remediation_inputs(rows, W.strength(with_interest(event_bars(spark, sf_dir))).select("sym", "t", "strength"), "click")
    fired = D.detect(rows, D.SCALED).join(inputs, ["sym", "t"])
    passed = [F.when(c, F.lit(n)) for n, c in D.remediation(F.col("side")).items()]
    return fired.select("side", F.explode(F.array_compact(F.array(*passed))).alias("filter")).groupBy("filter", "side").agg(F.count("*").alias("n"))


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym, t, close / nullif(lag(close, 168) OVER (PARTITION BY sym ORDER BY t), 0) - 1 AS r FROM b)
SELECT t, round(floor(r * 10000 + 0.5) / 100, 4) AS ret7d, CASE WHEN r * 100 >= 5 THEN 'up' WHEN r * 100 <= -5 THEN 'down' ELSE 'flat' END AS regime FROM r WHERE sym = 'click' AND r IS NOT NULL""")
def benchmark_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_bars(spark, sf_dir).withColumn("r", F.try_divide(F.col("close"), F.lag("close", 168).over(W.by_time())) - 1).where("sym = 'click' AND r IS NOT NULL")
    pct = F.col("r") * 100
    return r.select("t", F.round(S.round_half_up(pct, 2), 4).alias("ret7d"), F.when(pct >= 5, "up").when(pct <= -5, "down").otherwise("flat").alias("regime"))


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


_SCORES_SQL = f"""rg AS (SELECT sym, t, close, ema20, close_hi24, pos, change1h, ret4h, oi4h, funding, vol_z, buy_share,
 1.2 * {_clip("change1h / 2", -1, 1.5)} + 0.9 * {_clip("ret4h * 20", -1, 1.5)} + 0.8 * {_clip("vol_z / 2", -0.5, 1.5)} + 0.5 * {_clip("oi4h / 5", -1, 1.5)} + 0.6 * {_clip("(buy_share - 0.55) * 5", -1, 1.5)} - 0.8 AS pump,
 0.9 * {_clip("(pos - 0.65) / 0.3", 0, 1)} + {_clip("change1h / -1.2", 0, 1.5)} + 0.8 * {_clip("oi4h / -2.5", 0, 1.5)} + CASE WHEN funding > 0.045 THEN 0.5 ELSE 0 END + 0.5 * {_clip("vol_z / 2", 0, 1)} * {_clip("change1h * -2", 0, 1)} + 0.3 * {_clip("(0.45 - buy_share) / 0.15", 0, 1)} AS dist,
 0.6 * {_clip("(0.7 - pos) / 0.35", -0.4, 1.2)} + 0.8 * {_clip("oi4h / 3", -1, 1.2)} + 0.7 * {_clip("(0.8 - abs(change1h)) / 0.8", -1, 1)} + 0.4 * {_clip("1 - abs(vol_z)", -1, 1)} + CASE WHEN funding < 0.02 THEN 0.3 ELSE 0 END AS acc
 FROM feat WHERE ret4h IS NOT NULL AND oi4h IS NOT NULL), rk AS (SELECT *, CASE WHEN pump >= dist AND pump >= acc THEN 'P' WHEN acc >= dist THEN 'A' ELSE 'D' END AS regime FROM rg)"""
_READ = ["pos", "change1h", "ret4h", "oi4h", "funding", "vol_z", "buy_share"]


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).where("ret4h IS NOT NULL AND oi4h IS NOT NULL")
    return rows.withColumn("regime", S.regime(*S.regime_scores(*[F.col(c) for c in _READ])))


@query(f"""{FEATURES_SQL}, {_SCORES_SQL} SELECT sym, t, regime, concat_ws(',', CASE WHEN funding > 0.05 THEN 'funding-overheated' END, CASE WHEN oi4h > 20 THEN 'oi-too-fast' END, CASE WHEN regime = 'P' AND ret4h > 0.12 THEN 'far-above-entry' END,
 CASE WHEN pos > 0.72 AND vol_z > 1 AND change1h < 0 THEN 'stall-at-high' END, CASE WHEN buy_share < 0.42 THEN 'buyers-gone' END) AS risks FROM rk""")
def regime_and_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regimes(spark, sf_dir)
    return rows.select("sym", "t", "regime", F.array_join(S.risk_flags(F.col("regime"), *[F.col(c) for c in _READ]), ",").alias("risks"))


@query("""SELECT event_id AS id, CAST(floor(epoch_ms(ts) / 900000) AS BIGINT) AS slot, CAST(ceil(epoch_ms(ts) / 900000.0) * 900000 AS BIGINT) AS next_open, CAST(floor((epoch_ms(ts) / 1000 + 28800) / 86400) AS BIGINT) AS day8,
upper(trim(event_type)) AS sym, CASE WHEN abs(value) >= 1e3 THEN printf('%.2fK', value / 1e3) ELSE printf('%.2f', value) END AS money FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("id"), S.slot(ms).alias("slot"), S.next_slot_open(ms).alias("next_open"), S.day_key(ms / 1000, 8).alias("day8"),
        F.upper(F.trim("event_type")).alias("sym"), S.compact(F.col("value")).alias("money"),
    )


_FLAGS = {"funds_first": "pos < 0.5 AND oi4h > 1.2", "mild_rise": "change1h > 0.2 AND change1h < 3.2", "oi_healthy": "oi4h > 0.8 AND oi4h < 14", "buy_healthy": "buy_share > 0.55"}


@query(f"{FEATURES_SQL} SELECT sym, t, " + ", ".join(f"coalesce({text}, false) AS {name}" for name, text in _FLAGS.items()) + " FROM feat")
def signal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four flags shown beside a symbol; what is unknown is not healthy."""
    return features(spark, sf_dir).select("sym", "t", *[F.coalesce(F.expr(text), F.lit(False)).alias(name) for name, text in _FLAGS.items()])


@query(f"{FEATURES_SQL} SELECT sym, t, round(oi_drop, 4) AS oi_drop, round(ls_drop, 4) AS ls_drop, round(rs24, 4) AS rs24, coalesce(ls_drop >= 5 AND rs24 >= 2, false) AS confirmed FROM feat WHERE i >= 31 AND oi_max > 0 AND oi <= 0.8 * oi_max AND oi > 1.005 * oi_then AND range24 <= 100000 AND abs(funding) <= 0.05")
def early_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early setups with what confirms them: long positions leave, and the symbol beats the benchmark."""
    rows = features(spark, sf_dir).where(D.predicates(D.SCALED)["early-setup"][1])
    confirmed = F.coalesce((F.col("ls_drop") >= D.SCALED.ls_drop) & (F.col("rs24") >= D.SCALED.rs), F.lit(False))
    return rounded(rows.select("sym", "t", "oi_drop", "ls_drop", "rs24", confirmed.alias("confirmed")), {"oi_drop": 4, "ls_drop": 4, "rs24": 4})


def _audit(p: D.Params) -> list[tuple[str, str, str, str, str]]:
    known, base = D.predicates(p), D.controls(p)
    rows = [(key, known[name][0], control, known[name][1], base[control]) for key, name, control in D.AUDIT]
    return rows + [(key, "long", control, text, base[control]) for key, text, control in D.AUDIT_STRENGTH]


_RANKED_SQL = f"{_STRENGTH}, sr AS (SELECT sym, t, strength, row_number() OVER (PARTITION BY t ORDER BY round(strength, 6) DESC, sym) AS place FROM st), so AS (SELECT *, lag(strength) OVER (PARTITION BY sym ORDER BY t) AS prev_strength, lag(place) OVER (PARTITION BY sym ORDER BY t) AS prev_place FROM sr)"


#: Keys of the audit with their detector and control in SQL; controls are fired detectors or conditions on bars.
_KEYS_SQL = {
    "flush-breakout": ("flush-breakout", "breakout"), "early-setup": ("early-setup", "early-setup-envelope"), "squeeze-d3": ("squeeze-breakout", "breakout"), "boarding-b2": ("boarding-scan", "ema-reclaim"),
    "rebuild-r1": ("rebuild-1", "breakout"), "rebuild-r2": ("rebuild-2", "breakout"), "rebuild-r3": ("rebuild-3", "breakout"), "virgin-v1": ("virgin-1", "breakout"), "virgin-v2": ("virgin-2", "breakout"), "virgin-v3": ("virgin-3", "breakout"),
    "top-t1": ("top-1-reject", "top-envelope"), "top-t2": ("top-2-wick", "top-envelope"), "top-t3": ("top-3-climax", "top-envelope"), "top-t4": ("top-4-stall", "top-envelope"),
    "wbottom-w1": ("w-bottom-1", "w-envelope"), "wbottom-w2": ("w-bottom-2", "w-envelope"), "wbottom-w3": ("w-bottom-3", "w-envelope"), "spot-pump": ("spot-pump", "spot-momentum"), "spot-accum": ("spot-accum", "spot-flat"),
    "organic-spot": ("organic-spot", "spot-momentum"), "leverage-froth": ("leverage-froth", "spot-momentum"), "true-spot-led": ("organic-spot", "spot-momentum"), "umm-ema-control": ("ema-reclaim", "all"), "umm-b2": ("boarding-2", "ema-reclaim"), "umm-b2-oi": ("boarding-2-oi", "ema-reclaim"),
}
_CONTROLS_SQL = """cn AS (SELECT count(*) AS "all", count(*) FILTER (broke) AS breakout, count(*) FILTER (flushed) AS "early-setup-envelope", count(*) FILTER (reclaims) AS "ema-reclaim", count(*) FILTER (topping) AS "top-envelope", count(*) FILTER (ret24h >= 0.1 AND vol_z >= 0.5) AS "w-envelope",
 count(*) FILTER (i >= 4 AND ret4h >= 0.02) AS "spot-momentum", count(*) FILTER (i >= 48 AND abs(ret4h) < 0.5) AS "spot-flat" FROM fd_0)"""
_SHORT_KEYS = ("top-t1", "top-t2", "top-t3", "top-t4", "leverage-froth")


@query(f"{FEATURES_SQL}, {_RANKED_SQL}, {_detector_sql(_SCALED)}, {_CONTROLS_SQL} "
       + " UNION ALL ".join(f"SELECT '{key}' AS key, '{'short' if key in _SHORT_KEYS else 'long'}' AS side, '{control}' AS control, (SELECT count(*) FROM fd WHERE detector = '{name}') AS events, (SELECT \"{control}\" FROM cn) AS controls" for key, (name, control) in _KEYS_SQL.items())
       + """ UNION ALL SELECT 'strength70', 'long', 'all', (SELECT count(*) FROM so WHERE strength >= 70 AND prev_strength < 70), (SELECT "all" FROM cn) UNION ALL SELECT 'top10', 'long', 'all', (SELECT count(*) FROM so WHERE place <= 10 AND (prev_place > 10 OR prev_place IS NULL)), (SELECT "all" FROM cn)""")
def detector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audited detector with its side and control: how many bars fire, and how many the control has, in one pass."""
    bars = W.strength(with_interest(event_bars(spark, sf_dir))).select("sym", "t", "strength")
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.round("strength", 6).desc(), "sym"))
    bars = bars.withColumn("place", place).withColumns({f"prev_{c}": F.lag(c).over(W.by_time()) for c in ("strength", "place")})
    audit = _audit(D.SCALED)
    count = lambda text: F.count_if(F.coalesce(F.expr(text), F.lit(False)))
    rows = features(spark, sf_dir).join(bars, ["sym", "t"])
    sums = rows.agg(*[count(text).alias(f"e{i}") for i, (*_, text, _) in enumerate(audit)], *[count(base).alias(f"c{i}") for i, (*_, base) in enumerate(audit)])
    each = [F.struct(F.lit(key).alias("key"), F.lit(side).alias("side"), F.lit(control).alias("control"), F.col(f"e{i}").alias("events"), F.col(f"c{i}").alias("controls")) for i, (key, side, control, _, _) in enumerate(audit)]
    return sums.select(F.inline(F.array(*each)))


@query(f"""{FEATURES_SQL} SELECT sym, t, round(0.5 * 100 * pos + 25 * coalesce(least(1, greatest(0, (oi4h - 3) / 7)), 0) + 10 * coalesce(least(1, greatest(0, oi1h / 3)), 0) + 15 * coalesce(least(1, greatest(0, (buy_share - 0.55) / 0.2)), 0), 3) AS score FROM feat WHERE oi4h IS NOT NULL AND oi1h IS NOT NULL""")
def operational_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational score of every bar with known quantities, its place in the range as the rank score."""
    rows = features(spark, sf_dir).where("oi4h IS NOT NULL AND oi1h IS NOT NULL")
    return rows.select("sym", "t", S.operational_score(100 * F.col("pos"), F.col("oi4h"), F.col("oi1h"), F.col("buy_share")).alias("score"))


@query(f"""{FEATURES_SQL}, {_SCORES_SQL},
k AS (SELECT *, CASE regime WHEN 'P' THEN 'pullback' WHEN 'A' THEN 'breakout' ELSE 'reclaim' END AS kind, CASE regime WHEN 'P' THEN ema20 WHEN 'A' THEN close_hi24 * 1.001 ELSE close_hi24 END AS raw FROM rk),
p AS (SELECT *, CASE WHEN raw > 0 THEN raw ELSE close END AS entry FROM k) SELECT sym, t, kind, round(entry, 8) AS entry, round(entry * 1.04, 8) AS tp1, round(entry * 1.08, 8) AS tp2, round(entry * 1.15, 8) AS tp3, round(entry * 0.97, 8) AS sl, CAST(5 AS INTEGER) AS runner_pct FROM p""")
def exit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry by regime, anchored to closed bars, with its three targets, stop and runner."""
    return rounded(_regimes(spark, sf_dir).select("sym", "t", *S.plan(F.col("regime"), F.col("close"), F.col("ema20"), F.col("close_hi24"))), dict.fromkeys(["entry", "tp1", "tp2", "tp3", "sl"], 8))
