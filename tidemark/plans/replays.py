"""Queries that replay rules over the test series: cohorts under both policies, variants of the deep-reclaim watch, references against marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deep as D
from ..operators import detectors as T
from ..operators import replay as R
from ..operators import windows as X
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, event_bars, ticks
from .asof import feed
from .bars import rounded
from .deep import GEOMETRY_SQL
from .signals import FEATURES_SQL, features

HOUR, DAY = 3600, 86400
_KNOWN = {name: text for name, (_, text) in T.predicates(T.SCALED).items()}
#: The control, boarding, boarding with quantity, and the same with the quantity of a day before.
UMM = {
    "control": _KNOWN["ema-reclaim"], "boarding": _KNOWN["boarding-1"],
    "boarding-quantity": f"{_KNOWN['boarding-1']} AND oi1h > 0 AND oi4h >= 3", "placebo": f"{_KNOWN['boarding-1']} AND oi1h_day > 0 AND oi4h_day >= 3",
}
SPOT = {"organic": _KNOWN["organic-spot"], "spot-led": "ret4h >= 0.02 AND taker4 > 0.55 AND spot_basis <= 0", "momentum": "i >= 96 AND ret4h >= 0.02"}
_SHIFTED = "fs AS (SELECT *, lag(oi1h, 24) OVER o AS oi1h_day, lag(oi4h, 24) OVER o AS oi4h_day FROM feat WINDOW o AS (PARTITION BY sym ORDER BY t))"


def _cohort_sql(rules: dict[str, str], rows: str) -> str:
    return " UNION ALL ".join(f"SELECT sym, t AS since, close AS px, '{name}' AS cohort FROM {rows} WHERE {text}" for name, text in rules.items())


_COOLED = """ch AS (SELECT *, row_number() OVER (PARTITION BY cohort, sym ORDER BY since) AS k FROM c0),
ck AS (SELECT cohort, sym, since, px, k FROM ch WHERE k = 1 UNION ALL SELECT cohort, sym, since, px, k FROM (SELECT h.*, row_number() OVER (PARTITION BY h.cohort, h.sym, p.since ORDER BY h.since) AS rn FROM ck p JOIN ch h ON h.cohort = p.cohort AND h.sym = p.sym AND h.since >= p.since + 86400) WHERE rn = 1),
c1 AS (SELECT cohort, sym, since, px FROM ck)"""


def _executed_sql(events: str, time: int = 12, ladder: int = 24) -> str:
    """Common table expressions that end in xs: each event of `events` (cohort, sym, since, px) under both policies."""
    parts = []
    for policy, h in (("time", time), ("ladder", ladder)):
        cuts = "" if policy == "time" else " - CASE WHEN one AND t1 < ts THEN 0.5 ELSE 0.0 END - CASE WHEN two AND t2 < ts THEN 0.3 ELSE 0.0 END"
        gross = "ended" if policy == "time" else "CASE WHEN one THEN 0.5 ELSE 0.0 END * 0.04 + CASE WHEN two THEN 0.3 ELSE 0.0 END * 0.08 + (1 - CASE WHEN one THEN 0.5 ELSE 0.0 END - CASE WHEN two THEN 0.3 ELSE 0.0 END) * CASE WHEN three THEN 0.15 ELSE ended END"
        out = "coalesce(stop_t, end_t, since)" if policy == "time" else "CASE WHEN three THEN t3 ELSE coalesce(stop_t, end_t, since) END"
        parts.append(f"""{policy}_s AS (SELECT e.*, min(CASE WHEN b.low <= px * 0.97 THEN b.t END) AS stop_t, last(b.close ORDER BY b.t) AS end_px, max(b.t) AS end_t, count(b.t) AS n FROM {events} e LEFT JOIN b ON b.sym = e.sym AND b.t > since AND b.t <= since + {h * 3600} GROUP BY ALL),
{policy}_t AS (SELECT s.*, min(CASE WHEN b.t IS DISTINCT FROM stop_t AND b.high >= px * 1.04 THEN b.t END) AS t1, min(CASE WHEN b.t IS DISTINCT FROM stop_t AND b.high >= px * 1.08 THEN b.t END) AS t2, min(CASE WHEN b.t IS DISTINCT FROM stop_t AND b.high >= px * 1.15 THEN b.t END) AS t3
 FROM {policy}_s s LEFT JOIN b ON b.sym = s.sym AND b.t > since AND b.t <= since + {h * 3600} GROUP BY ALL),
{policy}_u AS (SELECT *, coalesce(t1 < coalesce(stop_t, 1 << 62), false) AS one, coalesce(t2 < coalesce(stop_t, 1 << 62), false) AS two, coalesce(t3 < coalesce(stop_t, 1 << 62), false) AS three, CASE WHEN stop_t IS NOT NULL THEN -0.03 ELSE end_px / nullif(px, 0) - 1 END AS ended FROM {policy}_t),
{policy}_x AS (SELECT cohort, sym, since, px, '{policy}' AS policy, n = {h} AS whole, one AS up_first, sym IN (SELECT sym FROM charge) AS funding_known,
 CASE WHEN n = {h} THEN CAST({gross} AS DOUBLE) - 0.003 - coalesce((SELECT sum(rate * (1{cuts})) FROM charge c WHERE c.sym = u.sym AND c.ts >= since AND c.ts <= {out}), 0) END AS net FROM {policy}_u u)""")
    return ", ".join(parts) + ", xs AS (SELECT * FROM time_x UNION ALL SELECT * FROM ladder_x)"


_CHARGE = "charge AS (SELECT sym, ts, px / 100000000 AS rate FROM ev WHERE sym <> 'scroll')"
_SUMMED = "count(*) AS events, count(net) AS trades, count(DISTINCT CASE WHEN net IS NOT NULL THEN sym END) AS coins, count(DISTINCT CASE WHEN net IS NOT NULL THEN since // 86400 END) AS days, round(avg(net), 6) AS net_mean, round(avg(net) - 0.003, 6) AS net_stressed, round(avg(CASE WHEN net IS NOT NULL THEN CAST(up_first AS DOUBLE) END), 6) AS up_rate, round(avg(CAST(whole AS DOUBLE)), 6) AS coverage"
_ROUND = dict.fromkeys(("net_mean", "net_stressed", "up_rate", "coverage"), 6)


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding of all symbols but one, whose charges stay unknown."""
    return ticks(spark, sf_dir).where("sym <> 'scroll'").select("sym", "ts", (F.col("px") / 100_000_000).alias("rate"))


def _replayed(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    return R.executed(events, event_bars(spark, sf_dir), _charges(spark, sf_dir), HOUR, 12 * HOUR, 24 * HOUR)


@query(f"{FEATURES_SQL}, {_SHIFTED}, c0 AS ({_cohort_sql(UMM, 'fs')}), {_CHARGE}, {_executed_sql('c0')} SELECT cohort, policy, strftime(make_timestamp(since * 1000000), '%Y-%m') AS month, {_SUMMED} FROM xs WHERE funding_known GROUP BY 1, 2, 3")
def umm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cohorts under both policies by month; symbols without known charges are left out; holds are scaled to 12 and 24 hours."""
    lag = lambda c: F.lag(c, 24).over(X.by_time())
    rows = features(spark, sf_dir).withColumns({"oi1h_day": lag("oi1h"), "oi4h_day": lag("oi4h")})
    out = _replayed(spark, sf_dir, R.cohorts(rows, UMM)).withColumn("month", F.date_format(F.timestamp_seconds("since"), "yyyy-MM"))
    return rounded(R.replay_summary(out, ["cohort", "policy", "month"]), _ROUND)


@query(f"{FEATURES_SQL}, c0 AS ({_cohort_sql(SPOT, 'feat')}), {_COOLED}, {_CHARGE}, {_executed_sql('c1')} SELECT cohort, policy, {_SUMMED} FROM xs WHERE funding_known GROUP BY 1, 2")
def spot_led_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cohorts, each with its own cooldown of a day by symbol, under both policies."""
    events = R.cohorts(features(spark, sf_dir), SPOT, DAY)
    return rounded(R.replay_summary(_replayed(spark, sf_dir, events), ["cohort", "policy"]), _ROUND)


BASE = R.Cell(fall=(0.75, 0.99), age=(4, 80), top_pos=0.8, rise4=4.0, q4=0.5, band=0.5)
CELLS, EXPERIMENTS = R.robustness_cells(BASE), R.experiment_cells(BASE)
LONGEST, AFTER = 36 * HOUR, 48 * HOUR
_VALUES = ", ".join(f"('{c.name}', {c.fall[0]!r}, {c.fall[1]!r}, {c.age[0]}, {c.age[1]}, {c.top_pos!r}, {c.rise4!r}, {c.q4!r}, {c.band!r}, {c.expiry}, {c.cost!r}, '{c.confirm}')" for c in CELLS + EXPERIMENTS)
_WATCHED = f"""{GEOMETRY_SQL}, qa AS (SELECT *, sum(tq) OVER (PARTITION BY sym ORDER BY t ROWS 23 PRECEDING) AS oi FROM b),
qb AS (SELECT sym, t, high, low, close, lead(t) OVER o AS next_t, lead(open) OVER o AS next_open, (oi / nullif(lag(oi, 1) OVER o, 0) - 1) * 100 AS q1, (oi / nullif(lag(oi, 4) OVER o, 0) - 1) * 100 AS q4 FROM qa WINDOW o AS (PARTITION BY sym ORDER BY t)),
cells(cell, f0, f1, a0, a1, most_pos, most_rise, q4m, band, expiry, charge, confirm) AS (SELECT c0, CAST(c1 AS DOUBLE), CAST(c2 AS DOUBLE), c3, c4, CAST(c5 AS DOUBLE), CAST(c6 AS DOUBLE), CAST(c7 AS DOUBLE), CAST(c8 AS DOUBLE), c9, CAST(c10 AS DOUBLE), c11 FROM (VALUES {_VALUES}) v(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11)),
cand AS (SELECT concat(m.sym, ':', m.t) AS id, cell, m.sym, m.t AS since, m.close AS px, greatest(ema50, list_max(hi[tr + 2:])) AS level, atr, lo[tr + 1] AS trough_low, q1, q4, q4m, band, expiry, charge, confirm FROM dm m JOIN qb USING (sym, t), cells
 WHERE i >= 95 AND drawdown BETWEEN f0 AND f1 AND len(cl) - 1 - tr BETWEEN a0 AND a1 AND pos <= most_pos AND r4 > 0 AND r4 <= most_rise AND m.close > ema20 AND pc <= pe AND ema20 > pe AND m.close - ema20 <= 3 * atr),
armed AS (SELECT c.*, arm FROM cand c, (VALUES ('quantity'), ('price')) a(arm) WHERE arm = 'price' OR (q1 > 0 AND q4 >= q4m)),
pw AS (SELECT a.id, a.cell, a.arm, x.t, x.next_t, x.next_open, x.t + 3600 >= since + expiry AS late, x.close < trough_low AS below, confirm = 'band' AND x.high >= level + 2 * atr AS gone,
 CASE confirm WHEN 'band' THEN x.close BETWEEN level AND level + band * atr WHEN 'breakout-only' THEN x.close >= level + 2 * atr ELSE x.close BETWEEN level AND level + band * atr OR x.close >= level + 2 * atr END AND (arm = 'price' OR (x.q1 IS NOT NULL AND x.q4 IS NOT NULL)) AS ready,
 arm = 'price' OR (x.q1 > 0 AND x.q4 >= q4m) AS passes FROM armed a JOIN qb x ON x.sym = a.sym AND x.t > since AND x.t <= since + {LONGEST}),
pe1 AS (SELECT *, CASE WHEN late THEN 'expired' WHEN below THEN 'invalidated' WHEN gone THEN 'missed' WHEN ready THEN CASE WHEN NOT passes THEN 'oi-rejected' WHEN next_t IS NULL THEN 'no-next-open' ELSE 'confirmed' END END AS terminal FROM pw),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, cell, arm ORDER BY t) AS rn FROM pe1 WHERE terminal IS NOT NULL) WHERE rn = 1),
wt AS (SELECT a.id, a.cell, a.arm, a.sym, a.since, a.charge, coalesce(f.terminal, 'expired') AS terminal, CASE WHEN f.terminal = 'confirmed' THEN f.next_t END AS fill_t, CASE WHEN f.terminal = 'confirmed' THEN f.next_open END AS fill_px FROM armed a LEFT JOIN pf f USING (id, cell, arm)),
wn AS (SELECT w.id, w.cell, w.arm, w.sym, w.since, w.terminal, w.fill_t, w.charge, w.fill_px, last(b.close ORDER BY b.t) AS end_px, min(CASE WHEN b.low <= fill_px * 0.95 THEN b.t END) AS s, min(CASE WHEN b.high >= fill_px * 1.1 THEN b.t END) AS h FROM wt w LEFT JOIN b ON w.fill_px > 0 AND b.sym = w.sym AND b.t >= w.fill_t AND b.t < w.since + {AFTER} GROUP BY ALL),
nets AS MATERIALIZED (SELECT *, coalesce(end_px / nullif(fill_px, 0) - 1 - charge, 0) AS net, coalesce(h < s OR (h IS NOT NULL AND s IS NULL), false) AS up_first FROM wn)"""
_CELL_SQL = """j AS MATERIALIZED (SELECT q.*, c.net AS cn, c.up_first AS cup FROM nets q JOIN nets c ON c.id = q.id AND c.cell = q.cell AND c.arm = 'price' WHERE q.arm = 'quantity'),
jc AS (SELECT cell, sym, avg(net) AS m, avg(net - cn) AS d FROM j GROUP BY 1, 2), jm AS (SELECT cell, avg(m) AS net_coin, avg(d) AS lead_coin FROM jc GROUP BY 1),
je AS MATERIALIZED (SELECT cell, count(*) AS alerts, count(*) FILTER (terminal = 'confirmed') AS confirms, count(DISTINCT CASE WHEN terminal = 'confirmed' THEN sym END) AS coins, count(DISTINCT CASE WHEN terminal = 'confirmed' THEN since // 86400 END) AS days, avg(net) AS net_event, avg(net - cn) AS lead_event, count(*) FILTER (up_first) AS hits, count(*) FILTER (cup) AS control_hits FROM j GROUP BY 1),
js AS (SELECT *, CASE WHEN control_hits > 0 THEN hits / control_hits WHEN hits > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS lift, confirms / (SELECT greatest(confirms, 1) FROM je WHERE cell = 'base') AS retention FROM je JOIN jm USING (cell)),
jp AS MATERIALIZED (SELECT *, net_event > 0 AND net_coin > 0 AND lead_event > 0 AND lead_coin > 0 AND lift > 1 AND retention >= 0.75 AS passed FROM js)"""


def nets(spark: SparkSession, sf_dir: str, cells: list[R.Cell]) -> DataFrame:
    """Cells' candidates with how their watches ended and what came of them; thresholds are scaled to the test series."""
    bars = event_bars(spark, sf_dir).withColumn("oi", F.sum("tq").over(X.upto(24)))
    moved = lambda k: (F.try_divide("oi", F.lag("oi", k).over(X.by_time())) - 1) * 100
    ahead = lambda c: F.lead(c).over(X.by_time())
    bars = bars.withColumns({"q1": moved(1), "q4": moved(4), "next_t": ahead("t"), "next_open": ahead("open")})
    found = R.variant_candidates(D.measures(bars), cells)
    watched = R.variant_watches(found, bars.select("sym", "t", "high", "low", "close", "next_t", "next_open", "q1", "q4"), HOUR, LONGEST)
    return R.variant_nets(watched, bars, AFTER)


_CELL_ROUND = dict.fromkeys(("net_event", "net_coin", "lead_event", "lead_coin", "lift", "retention"), 6)
_NAMED = ", ".join(f"'{c.name}'" for c in CELLS)
_OTHERS = ", ".join(f"'{c.name}'" for c in EXPERIMENTS)


@query(f"{EVENT_BARS_SQL}, {_WATCHED} SELECT cell, arm, terminal, count(*) AS n, round(avg(net), 6) AS net FROM nets WHERE cell IN ({_NAMED}, {_OTHERS}) GROUP BY 1, 2, 3")
def variant_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the watches of 22 cells and three experiments end, with the quantity gate and without."""
    return rounded(nets(spark, sf_dir, CELLS + EXPERIMENTS).groupBy("cell", "arm", "terminal").agg(F.count("*").alias("n"), F.avg("net").alias("net")), {"net": 6})


@query(f"{EVENT_BARS_SQL}, {_WATCHED}, {_CELL_SQL} SELECT cell, alerts, confirms, coins, days, hits, control_hits, passed, {', '.join(f'round({c}, 6) AS {c}' for c in _CELL_ROUND)} FROM jp WHERE cell IN ({_NAMED})")
def robustness_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and its 21 variants, each with candidates of its own, against the price arm on the same alerts."""
    return rounded(R.variant_summary(nets(spark, sf_dir, CELLS)), _CELL_ROUND)


_REASONS = [("confirms", "confirms >= 100"), ("coins", "coins >= 20"), ("days", "days >= 20"), ("net-event", "net_event > 0"), ("net-coin", "net_coin > 0"), ("lead-event", "lead_event > 0"), ("lead-coin", "lead_coin > 0"), ("lift", "lift >= 1.25")]


@query(f"{EVENT_BARS_SQL}, {_WATCHED}, {_CELL_SQL}, fl AS (SELECT string_agg(cell, ',' ORDER BY cell) FILTER (NOT coalesce(passed, false)) AS f FROM jp WHERE cell IN ({_NAMED})), r AS (SELECT jp.*, concat_ws('; ', " + ", ".join(f"CASE WHEN NOT coalesce({text}, false) THEN '{name}' END" for name, text in _REASONS) + ", 'robustness: ' || f) AS reasons FROM jp, fl WHERE cell = 'base') SELECT reasons = '' AS passed, reasons, confirms, coins, days FROM r")
def deep_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The battery's verdict, with its reasons in order."""
    return R.verdict(R.variant_summary(nets(spark, sf_dir, CELLS)))


@query(f"{EVENT_BARS_SQL}, {_WATCHED}, ms AS (SELECT id FROM nets WHERE cell = 'base' AND arm = 'quantity' AND terminal = 'missed') SELECT cell, count(*) AS evaluated, count(*) FILTER (terminal = 'confirmed') AS captured, round(avg(net) FILTER (terminal = 'confirmed'), 6) AS net, count(*) FILTER (terminal = 'confirmed' AND up_first) AS hits, round(avg((fill_t - since) / 3600) FILTER (terminal = 'confirmed'), 6) AS delay_h FROM nets JOIN ms USING (id) WHERE arm = 'quantity' AND cell IN ({_OTHERS}) GROUP BY 1")
def missed_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breakout confirmations make of the alerts that the base misses."""
    rows = R.missed_cohort(nets(spark, sf_dir, [BASE, *EXPERIMENTS]), "base", [c.name for c in EXPERIMENTS])
    return rounded(rows, {"net": 6, "delay_h": 6})


_SIGNALS = """mk AS (SELECT sym, ts - ts % 900 AS t, last(px ORDER BY ts, seq) AS px FROM ev GROUP BY 1, 2), sg AS (SELECT seq AS id, sym, ts FROM ev WHERE px > 95),
an AS (SELECT sg.*, CASE WHEN ts - bt <= 1500 THEN bt WHEN ft - ts <= 1500 THEN ft END AS anc FROM (SELECT sg.*, (SELECT max(t) FROM mk WHERE mk.sym = sg.sym AND mk.t <= sg.ts) AS bt, (SELECT min(t) FROM mk WHERE mk.sym = sg.sym AND mk.t > sg.ts) AS ft FROM sg) sg),
aq AS (SELECT an.id, an.sym, an.ts, an.anc, mk.px AS ap FROM an JOIN mk ON mk.sym = an.sym AND mk.t = an.anc WHERE mk.px > 0)"""


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = feed(spark, sf_dir)
    marks = rows.groupBy("sym", (F.col("ts") - F.col("ts") % 900).alias("t")).agg(F.max_by("px", F.struct("ts", "seq")).alias("px"))
    return R.anchored(rows.where("px > 95").select(F.col("seq").alias("id"), "sym", "ts"), marks), marks


@query(f"{EVENT_BARS_SQL}, {_SIGNALS}, w AS (SELECT id, h, ts, ap, mk.t, mk.px FROM aq, (VALUES (1), (4), (12), (24), (48)) v(h), mk WHERE mk.sym = aq.sym AND mk.t > anc AND mk.t <= ts + h * 3600) SELECT id, CAST(h AS INTEGER) AS h, round((last(px ORDER BY t) / ap - 1) * 100, 4) AS last, round((max(px) / ap - 1) * 100, 4) AS peak, ts + h * 3600 - max(t) <= 2400 AS covered FROM w GROUP BY id, h, ts, ap")
def reference_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns of reference signals from the mark they stand at."""
    return rounded(R.marked_returns(*_signals(spark, sf_dir)), {"last": 4, "peak": 4})


@query(f"""{EVENT_BARS_SQL}, {_SIGNALS}, w AS (SELECT id, ts, anc, ap, mk.t, mk.px, min(CASE WHEN mk.px <= ap * 0.7 THEN mk.t END) OVER (PARTITION BY id) AS st FROM aq, mk WHERE mk.sym = aq.sym AND mk.t > anc AND mk.t <= ts + 172800),
l AS (SELECT id, ts, anc, ap, st, max(CASE WHEN st IS NULL OR t < st THEN px END) AS top, last(px ORDER BY t) AS l, max(t) AS e FROM w WHERE st IS NULL OR t <= st GROUP BY 1, 2, 3, 4, 5)
SELECT id, CAST(coalesce(CAST(top >= ap * 0.8 AS INTEGER), 0) + coalesce(CAST(top >= ap * 0.9 AS INTEGER), 0) + coalesce(CAST(top >= ap * 1.02 AS INTEGER), 0) AS BIGINT) AS hits, round((st - ts) / 3600, 4) AS stop_h, round((l / ap - 1) * 100, 4) AS "end", round((e - anc) / 3600, 4) AS covered_h FROM l""")
def reference_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder walked over marks; targets and stop are scaled to the test series."""
    rows = R.mark_ladder(*_signals(spark, sf_dir), targets=(-0.2, -0.1, 0.02), stop=-0.3)
    return rounded(rows, {"stop_h": 4, "end": 4, "covered_h": 4})


@query(f"{EVENT_BARS_SQL}, {_SIGNALS} SELECT id, round((min(mk.t) - ts) / 3600, 4) AS lead_h FROM sg JOIN mk ON mk.sym = sg.sym AND mk.px > 60 AND mk.t >= ts - 86400 AND mk.t <= ts + 86400 GROUP BY id, ts")
def reference_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by which a proxy on the same series fires before or after a reference."""
    signals, marks = _signals(spark, sf_dir)
    return rounded(R.lead_over_proxy(signals, marks.where("px > 60")), {"lead_h": 4})
