"""Queries on deep-reclaim geometry, entries, selection and grids; set operations on candidates; liquidations and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import deep as D
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, epoch, event_bars, table, ticks
from .bars import rounded
from .windows import with_interest
from .outcomes import _EVENTS_SQL, events
from .windows import ema_sql

_DD = """dl AS (SELECT *, list_transform(cl, lambda x, i: coalesce(1 - x / nullif(list_max(cl[1:i]), 0), 0)) AS dds FROM dw),
dm AS (SELECT *, greatest(list_max(dds), 0) AS drawdown, CASE WHEN list_max(dds) > 0 THEN len(dds) - list_position(list_reverse(dds), list_max(dds)) ELSE 0 END AS tr FROM dl)"""


#: Measures of reclaims, after b: common table expressions that end in dm.
GEOMETRY_SQL = f"""{ema_sql(20, name='ema20')}, {ema_sql(50, name='ema50')}, d0 AS (SELECT b.*, e_20.ema20, e_50.ema50 FROM b LEFT JOIN e_20 USING (sym, t) LEFT JOIN e_50 USING (sym, t)),
d1 AS (SELECT *, CASE WHEN lag(close) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr0, row_number() OVER o - 1 AS i, lag(close) OVER o AS pc, lag(ema20) OVER o AS pe, close / nullif(coalesce(lag(close, 4) OVER o, first_value(close) OVER o), 0) - 1 AS r4 FROM d0 WINDOW o AS (PARTITION BY sym ORDER BY t)),
dw AS (SELECT *, CASE WHEN count(tr0) OVER w14 = 14 THEN avg(tr0) OVER w14 END AS atr, list(close) OVER w96 AS cl, list(high) OVER w96 AS hi, list(low) OVER w96 AS lo, CASE WHEN max(high) OVER w97 > min(low) OVER w97 THEN (close - min(low) OVER w97) / (max(high) OVER w97 - min(low) OVER w97) ELSE 0.5 END AS pos
 FROM d1 WINDOW w14 AS (PARTITION BY sym ORDER BY t ROWS 13 PRECEDING), w96 AS (PARTITION BY sym ORDER BY t ROWS 95 PRECEDING), w97 AS (PARTITION BY sym ORDER BY t ROWS 96 PRECEDING)), {_DD}"""


@query(f"""{EVENT_BARS_SQL}, {GEOMETRY_SQL},
g AS (SELECT sym, t, drawdown, len(cl) - 1 - tr AS trough_age, greatest(ema50, list_max(hi[tr + 2:])) AS level, CASE WHEN NOT coalesce(i >= 95, false) THEN 'history' WHEN NOT coalesce(drawdown BETWEEN 0.06 AND 2, false) THEN 'drawdown' WHEN NOT coalesce(len(cl) - 1 - tr BETWEEN 2 AND 80, false) THEN 'trough-age'
 WHEN NOT coalesce(pos <= 0.9, false) THEN 'position' WHEN NOT coalesce(r4 > 0 AND r4 <= 50, false) THEN 'return-4h' WHEN NOT coalesce(close > ema20 AND pc <= pe, false) THEN 'cross' WHEN NOT coalesce(ema20 > pe, false) THEN 'slope' WHEN NOT coalesce(close - ema20 <= 3 * atr, false) THEN 'extended' END AS reject, close, atr, pos, r4 FROM dm)
SELECT sym, t, round(drawdown, 6) AS drawdown, CAST(trough_age AS INTEGER) AS trough_age, round(level, 6) AS level, reject, CASE WHEN reject IS NULL THEN round(40 * least(1, greatest(0, 1 - greatest(0, (level - close) / nullif(atr, 0)) / 2)) + 20 * least(1, greatest(0, (drawdown - 0.06) / (2 - 0.06)))
 + 15 * least(1, greatest(0, 1 - pos / 0.9)) + 15 * least(1, greatest(0, (80 - trough_age) / 78.0)) + 10 * least(1, greatest(0, r4 / 50)), 3) END AS score FROM g""")
def deep_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled to the test series; production thresholds are the operator's defaults."""
    rows = D.geometry(event_bars(spark, sf_dir), fall=(0.06, 2), age=(2, 80), top_pos=0.9, rise4=50)
    return rounded(rows.select("sym", "t", "drawdown", "trough_age", "level", "reject", "score"), {"drawdown": 6, "level": 6})


@query("""SELECT event_id AS id, CASE WHEN user_id % 11 = 0 THEN 'missing' WHEN event_id % 1500 - 300 < 0 THEN 'future' WHEN event_id % 1500 - 300 > 600 THEN 'stale' WHEN value - 50 > 0 AND value / 10 >= 3 THEN 'pass' ELSE 'rejected' END AS decision FROM events""")
def quantity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("user_id") % 11 != 0, F.col("event_id") % 1500 - 300)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), D.quantity_decision(age, F.col("value") - 50, F.col("value") / 10).alias("decision"))


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, p AS (SELECT e.id, e.px, b.t, b.low, b.high, b.close, max(b.high) OVER (PARTITION BY e.id ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM e JOIN b ON b.sym = e.sym AND b.t > e.since AND b.t <= e.since + 43200),
m AS (SELECT id, t, close, 'immediate' AS method FROM p UNION ALL SELECT id, t, close, 'retest' FROM p WHERE low <= px AND close >= px UNION ALL SELECT id, t, close, 'fixed-pullback' FROM p WHERE low <= px * 0.98 UNION ALL SELECT id, t, close, 'breakout' FROM p WHERE close > peak)
SELECT id, method, min(t) AS entry_t, round(first(close ORDER BY t), 6) AS entry_px FROM m GROUP BY 1, 2""")
def entry_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    methods = {k: v for k, v in D.METHODS.items() if k != "atr-reclaim"}
    return rounded(D.entries(events(bars), bars, 12 * 3600, methods), {"entry_px": 6})


_WAIT, _DELAY = 24 * 3600, 1800
_FILL_ENDS = "".join(f" UNION ALL SELECT id, t, '{name}' AS method, CASE WHEN late THEN 'expired'" + (" WHEN close < support - atr THEN 'invalidated' WHEN high >= px * 1.15 THEN 'missed'" if name == "breakout-retest" else "") + f" WHEN due AND next_t <= since + {_WAIT} AND {text.replace('bar_', '')} THEN 'filled' END AS terminal, next_t AS fill_t, next_open AS fill_px FROM q" for name, text in D.fill_methods(0.5, 0.3, 0.5).items())
_FILLS_SQL = f"""{ema_sql(20, name='ema20')}, {ema_sql(50, name='ema50')}, bb AS (SELECT b.sym, b.t, open, high, low, close, lag(ema20) OVER o AS prev20, lag(ema50) OVER o AS prev50, lead(b.t) OVER o AS next_t, lead(open) OVER o AS next_open FROM b LEFT JOIN e_20 USING (sym, t) LEFT JOIN e_50 USING (sym, t) WINDOW o AS (PARTITION BY b.sym ORDER BY b.t)),
x AS (SELECT *, px * 0.8 AS support, px * 0.5 AS atr FROM e), p AS (SELECT x.id, x.since, x.px, x.support, x.atr, bb.t, bb.open, bb.high, bb.low, bb.close, prev20, prev50, next_t, next_open, greatest(x.px, max(bb.high) OVER (PARTITION BY x.id ORDER BY bb.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak,
 bb.t + 3600 >= since + {_WAIT} AS late, bb.t + 3600 >= since + {_DELAY} AS due FROM x JOIN bb ON bb.sym = x.sym AND bb.t > since AND bb.t <= since + {_WAIT}),
q AS (SELECT *, max(CASE WHEN due AND low <= peak - 0.5 * atr THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t) = 1 AS touched FROM p),
m AS (SELECT id, t, 'immediate' AS method, 'filled' AS terminal, t AS fill_t, open AS fill_px FROM q{_FILL_ENDS}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, method ORDER BY t) AS rn FROM m WHERE terminal IS NOT NULL) WHERE rn = 1),
fl AS (SELECT x.id, x.sym, x.since, mm.method, coalesce(f.terminal, 'expired') AS terminal, CASE WHEN f.terminal = 'filled' THEN f.fill_t END AS fill_t, CASE WHEN f.terminal = 'filled' THEN f.fill_px END AS fill_px FROM x CROSS JOIN (SELECT DISTINCT method FROM m) mm LEFT JOIN f ON f.id = x.id AND f.method = mm.method)"""


def _fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = event_bars(spark, sf_dir)
    e = events(bars).withColumns({"support": F.col("px") * 0.8, "atr": F.col("px") * 0.5})
    return e, bars, D.entry_fills(e, bars, 3600, _WAIT, _DELAY, 0.5, 0.3, 0.5)


@query(f"{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_FILLS_SQL} SELECT id, method, terminal, fill_t, round(fill_px, 6) AS fill_px FROM fl")
def entry_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven entry methods with their ends; bands in true ranges are scaled to the test series."""
    return rounded(_fills(spark, sf_dir)[2], {"fill_px": 6})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_FILLS_SQL}, o AS (SELECT fl.id, method, fill_px AS px, greatest(max(b.high), fill_px) / fill_px - 1 AS mfe, least(min(b.low), fill_px) / fill_px - 1 AS mae, min(CASE WHEN b.low <= fill_px * 0.95 THEN b.t END) AS stop, min(CASE WHEN b.high >= fill_px * 1.1 THEN b.t END) AS hit
 FROM fl JOIN b ON b.sym = fl.sym AND b.t >= fill_t AND b.t < since + 172800 WHERE fill_px > 0 GROUP BY fl.id, method, fill_px)
SELECT id, method, round(mfe, 6) AS mfe, round(mae, 6) AS mae, coalesce(hit < stop OR (hit IS NOT NULL AND stop IS NULL), false) AS up_first FROM o""")
def fill_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten percent up before five down, from each fill to two days after its event."""
    e, bars, fills = _fills(spark, sf_dir)
    return rounded(D.fill_outcomes(fills.join(e.select("id", "sym", "since"), "id"), bars, 172800), {"mfe": 6, "mae": 6})


_CELLS = {"base": "q > 20", "tight": "q > 50", "loose": "q > 5", "rising": "q > 20 AND close > open", "quiet": "n < 3"}


@query(EVENT_BARS_SQL + ", g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS cell, close FROM b WHERE {v}" for k, v in _CELLS.items()) + ") SELECT cell, count(*) AS n, round(avg(close), 6) AS mean, round(count(*) / (SELECT count(*) FROM b WHERE q > 20), 6) AS retention FROM g GROUP BY 1")
def robustness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.grid(event_bars(spark, sf_dir), _CELLS, "close"), {"mean": 6, "retention": 6})


@query("""WITH c AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, concat(event_type, event_id) AS sym, value AS score FROM events WHERE value > 60),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, sym) AS k FROM c), d AS (SELECT slot, row_number() OVER (PARTITION BY day ORDER BY slot) AS d FROM r WHERE k = 1)
SELECT sym, slot, day, CASE WHEN k > 1 THEN 'not-first' WHEN d <= 3 THEN 'selected' ELSE 'quota' END AS outcome FROM r LEFT JOIN d USING (slot)""")
def daily_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = epoch(F.col("ts"))
    rows = table(spark, sf_dir, "events").where("value > 60").select(F.floor(s / 900).cast("long").alias("slot"), F.floor(s / 86400).cast("long").alias("day"), F.concat("event_type", F.col("event_id").cast("string")).alias("sym"), F.col("value").alias("score"))
    return D.select_daily(rows, 3).select("sym", "slot", "day", "outcome")


@query("""WITH p AS (SELECT event_id AS id, event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS entry, CAST(floor(epoch(ts)) AS BIGINT) + 172800 AS exit  FROM events), c AS (SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value / 1000 AS rate FROM events)
SELECT id, round(coalesce(sum(rate * (1 - CASE WHEN entry + 43200 < ts THEN 0.5 ELSE 0 END - CASE WHEN entry + 86400 < ts THEN 0.3 ELSE 0 END)), 0), 6) AS cost FROM p LEFT JOIN c ON c.sym = p.sym AND c.ts BETWEEN p.entry AND p.exit GROUP BY id""")
def weighted_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position of two days, reduced twice, against every event as a charge."""
    rows = ticks(spark, sf_dir)
    cut = lambda h, part: F.struct((F.col("ts") + h * 3600).alias("ts"), F.lit(part).alias("part"))
    positions = rows.select(F.col("seq").alias("id"), "sym", F.col("ts").alias("entry"), (F.col("ts") + 172800).alias("exit"), F.array(cut(12, 0.5), cut(24, 0.3)).alias("cuts"))
    charges = rows.select("sym", "ts", (F.col("px") / 1000).alias("rate"))
    return rounded(D.weighted_cost(positions, charges), {"cost": 6})


@query(f"""{EVENT_BARS_SQL}, v AS (SELECT *, q / nullif((high + low + close) / 3, 0) AS base FROM b), x AS (SELECT sym, t, close, CASE WHEN sum(base) OVER w > 0 THEN sum(q) OVER w / sum(base) OVER w END AS vwap, list(low) OVER w AS ls, list(q) OVER w AS qs, list(coalesce(base, 0)) OVER w AS bs FROM v WINDOW w AS (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING)),
l AS (SELECT *, list_sum(qs[list_position(ls, list_min(ls)):]) / nullif(list_sum(bs[list_position(ls, list_min(ls)):]), 0) AS line FROM x)
SELECT sym, t, coalesce(round(close - vwap, 9) > 0 AND round(lag(close) OVER o - lag(vwap) OVER o, 9) <= 0, false) AS rolling, coalesce(round(close - line, 9) > 0 AND round(lag(close) OVER o - lag(line) OVER o, 9) <= 0, false) AS anchored FROM l WINDOW o AS (PARTITION BY sym ORDER BY t)""")
def vwap_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vwap_reclaim(event_bars(spark, sf_dir)).select("sym", "t", "rolling", "anchored")


_SQUEEZE = f"""{EVENT_BARS_SQL}, r AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER o, open)), abs(low - coalesce(lag(close) OVER o, open))) AS tr FROM b WINDOW o AS (PARTITION BY sym ORDER BY t)),
w AS (SELECT *, CASE WHEN count(*) OVER w = 20 AND avg(close) OVER w > 0 THEN round(4 * stddev_pop(close) OVER w / avg(close) OVER w, 9) END AS width, avg(tr) OVER w / nullif(avg(close) OVER w, 0) AS k, sum(tq) OVER d AS oi, (tq / nullif(q, 0) - 0.5) / 10 AS funding,
 CASE WHEN count(q) OVER p24 >= 8 AND stddev_pop(q) OVER p24 > 0 THEN (q - avg(q) OVER p24) / stddev_pop(q) OVER p24 ELSE 0 END AS z FROM r WINDOW w AS (PARTITION BY sym ORDER BY t ROWS 19 PRECEDING), d AS (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING), p24 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, list(width) FILTER (width IS NOT NULL) OVER a AS w48, list(width) FILTER (width IS NOT NULL) OVER z AS w8, max(width) OVER n AS m9, lag(oi, 4) OVER o AS oi_4, sum(tq) OVER f / nullif(sum(q) OVER f, 0) AS buys
 FROM w WINDOW o AS (PARTITION BY sym ORDER BY t), a AS (PARTITION BY sym ORDER BY t ROWS 47 PRECEDING), z AS (PARTITION BY sym ORDER BY t ROWS 7 PRECEDING), n AS (PARTITION BY sym ORDER BY t ROWS 8 PRECEDING), f AS (PARTITION BY sym ORDER BY t ROWS 3 PRECEDING)),
sq AS (SELECT *, coalesce(width IS NOT NULL AND len(w48) >= 24 AND len(list_filter(w48, lambda x: x <= width)) <= 0.1 * len(w48), false) AS d1, coalesce(m9 > 0 AND width / m9 <= 0.35, false) AS d2, coalesce(k > 0 AND width <= 3 * k, false) AS d3,
 coalesce(width IS NOT NULL AND len(w8) >= 8 AND len(list_filter(w8, lambda x: x <= width)) <= 0.15 * len(w8), false) AS d4, coalesce(funding <= 0, false) AS cheap, coalesce(oi_4 > 0 AND oi / oi_4 >= 1 AND buys >= 0.5, false) AS held FROM l)"""


@query(f"{_SQUEEZE} SELECT sym, t, d1, d2, d3, d4 FROM sq")
def squeeze_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.squeeze_definitions(event_bars(spark, sf_dir)).select("sym", "t", "d1", "d2", "d3", "d4")


_MODES = ("none", "funding", "oi", "both", "either")


@query(f"""{_SQUEEZE}, m AS (SELECT *, unnest(['none', 'funding', 'oi', 'both', 'either']) AS mode FROM sq), c AS (SELECT sym, t, mode, high, close, z, d3 AND CASE mode WHEN 'none' THEN true WHEN 'funding' THEN cheap WHEN 'oi' THEN held WHEN 'both' THEN cheap AND held ELSE cheap OR held END AS setup FROM m),
e AS (SELECT *, min(CASE WHEN setup THEN t END) OVER p AS since, list({{'t': t, 'h': high}}) OVER p AS path FROM c WINDOW p AS (PARTITION BY sym, mode ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT mode, count(*) FILTER (setup) AS setups, count(*) FILTER (since IS NOT NULL AND z >= 1.5 AND close > list_max(list_transform(list_filter(path, lambda x: x.t >= since), lambda x: x.h))) AS releases FROM e GROUP BY 1""")
def squeeze_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squeezes inside the Keltner band and what came of them, by what confirms them."""
    rows = D.squeeze_definitions(with_interest(event_bars(spark, sf_dir)))
    rows = rows.withColumns({f"s_{m}": D.squeeze_confirmed(F.col("d3"), m) for m in _MODES})
    for m in _MODES:
        rows = D.squeeze_released(rows, f"s_{m}", f"r_{m}")
    sums = rows.agg(*[F.count_if(f"{k}_{m}").alias(f"{k}_{m}") for m in _MODES for k in "sr"])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"s_{m}").alias("setups"), F.col(f"r_{m}").alias("releases")) for m in _MODES])))


@query("""WITH p AS (SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE epoch(ts) > 1706400000 - 176400 AND floor(epoch(ts)) <= 1706400000 AND floor(epoch(ts)) > 1706400000 - 176400)
SELECT sym, count(*) AS points, min(ts) <= 1706400000 - 169200 AS warm, min(ts) <= 1706400000 - 16200 AS recent, max(ts) >= 1706400000 - 1200 AS fresh FROM p GROUP BY 1""")
def store_warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.store_state(ticks(spark, sf_dir), 1706400000)


@query("""WITH s AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click' AND value > 60), f AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'view' AND value > 60)
SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM s UNION SELECT id FROM f) UNION ALL SELECT 'difference', count(*) FROM (SELECT id FROM s EXCEPT SELECT id FROM f) UNION ALL SELECT 'intersection', count(*) FROM (SELECT id FROM s INTERSECT SELECT id FROM f)""")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 60")
    s, f = (e.where(F.col("event_type") == x).select(F.col("user_id").alias("id")) for x in ("click", "view"))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(s.union(f).distinct(), "union").union(count(s.subtract(f), "difference")).union(count(s.intersect(f), "intersection"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS base, o_custkey AS member, sum(o_totalprice) AS vol FROM orders GROUP BY 1, 2, 3)
SELECT month, base, first(member ORDER BY round(vol, 4) DESC, member) AS member, round(max(vol), 4) AS vol FROM m GROUP BY 1, 2""")
def monthly_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month and base the member of most volume; ties to the smaller id."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("base"), F.col("o_custkey").alias("member")).agg(F.sum("o_totalprice").alias("vol"))
    return rounded(m.groupBy("month", "base").agg(F.max_by("member", F.struct(F.round("vol", 4), -F.col("member"))).alias("member"), F.max("vol").alias("vol")), {"vol": 4})


@query("""SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts, round(value * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS usd, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM events WHERE epoch(ts) >= 1705276801""")
def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidations after a time; size by a contract value from the nested JSON."""
    size = F.get_json_object("props", "$.k").cast("double")
    side = F.when(F.col("user_id") % 2 == 0, "long").otherwise("short")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sym"), epoch(F.col("ts")).alias("ts"), F.round(F.col("value") * (1 + size), 4).alias("usd"), side.alias("side"))
    return rows.where("ts > 1705276800")


@query("""WITH s AS (SELECT o_orderpriority AS key, count(*) AS n, avg(o_totalprice) / 250000 AS lift, avg(o_totalprice) - 249000 AS net FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT key, n, round(lift, 6) AS lift, round(net, 4) AS net, CASE WHEN n < 1000 THEN 'insufficient' WHEN lift >= 1.0 AND net > 0 THEN 'pass' ELSE 'fail' END AS verdict FROM s""")
def holdout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 250000).alias("lift"), (F.avg("o_totalprice") - 249000).alias("net"))
    return rounded(D.holdout(s, 1000, 1.0), {"lift": 6, "net": 4})


@query("""WITH n AS (SELECT n_name AS sym, n_nationkey AS seq, list_position(['PERU', 'CHINA', 'NATION_3'], n_name) AS r FROM nation) SELECT sym, CAST(row_number() OVER (ORDER BY coalesce(nullif(r, 0), 1073741824), seq) AS INTEGER) AS place FROM n""")
def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("sym"), F.col("n_nationkey").alias("seq"))
    return D.prioritised(rows, ["PERU", "CHINA", "NATION_3"]).select("sym", "place")


@query(f"""{EVENT_BARS_SQL}, x AS (SELECT sym, t, close, max(t) OVER (PARTITION BY sym) AS newest FROM b) SELECT sym, count(*) AS bars, round(avg(close), 6) AS mean_close FROM x WHERE t + 3600 <= newest GROUP BY 1""")
def closed_bars_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forming bar of each symbol is left out."""
    rows = event_bars(spark, sf_dir).withColumn("newest", F.max("t").over(Window.partitionBy("sym"))).where("t + 3600 <= newest")
    return rounded(rows.groupBy("sym").agg(F.count("*").alias("bars"), F.avg("close").alias("mean_close")), {"mean_close": 6})
