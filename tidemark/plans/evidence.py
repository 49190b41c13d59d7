"""Queries on recorded evidence: states, setups, anchors, entry reports, simulations, coverage and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof as J
from ..operators import deep as D
from ..operators import evidence as E
from ..operators import outcomes as O
from ..operators import windows as X
from ..operators.thinning import thin
from ..registry import query
from ..sources import logs as L
from ..sources.tables import EVENT_BARS_SQL, epoch, event_bars, table, ticks
from .bars import rounded
from .outcomes import _EVENTS_SQL, _TOUCH, DAY, HOUR, events

_STATES_SQL = " UNION ALL ".join(f"SELECT slot, sym, '{k}' AS state FROM r WHERE {v}" for k, v in E.STATES.items())


@query(f"""WITH r AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, concat(event_type, event_id) AS sym, round(value / 10 - 2, 4) AS ret4h, round((user_id % 7 - 3) / 10, 4) AS basis_pct, CASE WHEN user_id % 5 > 0 THEN event_id % 100 * 10 END AS spot_vol24h,
user_id % 100 * 10 AS vol24h, round(event_id % 10 / 10, 4) AS buy_share4h, round(event_id % 3 / 100, 4) AS funding, CASE WHEN event_id % 4 > 0 THEN round(user_id % 10 / 10, 4) END AS spot_taker_share4h, round(value, 4) AS strength FROM events) {_STATES_SQL}""")
def recorded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are written as scan lines and read again before the states are told."""
    e, user, no = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    known = {
        "sym": F.concat("event_type", no.cast("string")), "strength": F.col("value"), "ret4h": F.col("value") / 10 - 2, "basis_pct": (user % 7 - 3) / 10, "spot_vol24h": F.when(user % 5 > 0, no % 100 * 10), "vol24h": user % 100 * 10,
        "buy_share4h": no % 10 / 10, "funding": no % 3 / 100, "spot_taker_share4h": F.when(no % 4 > 0, user % 10 / 10),
    }
    s = epoch(F.col("ts"))
    rows = e.select(F.floor(s / 900).cast("long").alias("slot"), F.lit("okx").alias("source"), (s * 1000).alias("ts"), no.alias("place"), *[known[c].alias(c) if c in known else F.lit(None).cast("string" if c == "regime" else "double").alias(c) for c in L.SCAN_COLUMNS])
    lines = L.scan_lines(rows).withColumn("no", F.col("slot"))
    return E.labelled(L.scan_rows(lines), E.STATES, "state").select("slot", "sym", "state")


_SETUP = E.Setup(flush=20, base_range=100_000, neutral=0.05, vol_z=0.5)


@query(f"""{EVENT_BARS_SQL}, k AS (SELECT t, close AS bench FROM b WHERE sym = 'click'), j AS (SELECT b.*, k.bench, sum(tq) OVER (PARTITION BY sym ORDER BY b.t ROWS 23 PRECEDING) AS oi, (tq / nullif(q, 0) - 0.5) / 10 AS funding, tq / nullif(q, 0) AS ls FROM b LEFT JOIN k ON k.t = b.t),
r AS (SELECT *, max(oi) OVER w49 AS oi_max, lag(oi, 6) OVER o AS oi_lag, max(close) OVER p24 AS close_max, (max(close) OVER p24 / nullif(min(close) OVER p24, 0) - 1) * 100 AS base_range, CASE WHEN count(q) OVER p24 >= 8 AND stddev_pop(q) OVER p24 > 0 THEN (q - avg(q) OVER p24) / stddev_pop(q) OVER p24 ELSE 0 END AS vol_z,
 sum(tq) OVER p24 / nullif(sum(q) OVER p24, 0) AS taker, lag(ls, 24) OVER o AS ls_lag, close / nullif(lag(close, 24) OVER o, 0) - 1 AS own_ret, bench / nullif(lag(bench, 24) OVER o, 0) - 1 AS bench_ret
 FROM j WINDOW o AS (PARTITION BY sym ORDER BY t), w49 AS (PARTITION BY sym ORDER BY t ROWS 48 PRECEDING), p24 AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) """ + " UNION ALL ".join(f"SELECT sym, t, '{k}' AS variant FROM r WHERE {v}" for k, v in E.setup_variants(_SETUP).items()))
def setup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setup and breakouts with one optional filter each; thresholds are scaled to the test series."""
    bars = event_bars(spark, sf_dir)
    bench = bars.where("sym = 'click'").select("t", F.col("close").alias("bench"))
    share = F.try_divide("tq", "q")
    rows = bars.join(bench, "t", "left").withColumns({"oi": F.sum("tq").over(X.upto(24)), "funding": (share - 0.5) / 10, "ls": share})
    return E.labelled(E.setup_rows(rows), E.setup_variants(_SETUP), "variant").select("sym", "t", "variant")


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, r AS (SELECT *, CASE WHEN lag(close) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr, t - lag(t, 24) OVER o = 86400 AS whole FROM b WINDOW o AS (PARTITION BY sym ORDER BY t)),
a AS (SELECT sym, t, CASE WHEN whole THEN max(high) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS support, CASE WHEN whole THEN avg(tr) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS atr FROM r)
SELECT id, round(support, 6) AS support, round(atr, 6) AS atr FROM e JOIN a ON a.sym = e.sym AND a.t = e.since""")
def anchor_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    a = E.anchors(bars).select("sym", F.col("t").alias("since"), "support", F.col("anchor_atr").alias("atr"))
    return rounded(events(bars).join(a, ["sym", "since"]).select("id", "support", "atr"), {"support": 6, "atr": 6})


_HORIZONS = (4, 12, 24)


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, p AS (SELECT e.id, h, count(*) AS n, last(b.close ORDER BY b.t) AS cl FROM e CROSS JOIN (VALUES (4), (12), (24)) x(h) JOIN b ON b.sym = e.sym AND b.t > e.since AND b.t <= e.since + h * 3600 GROUP BY 1, 2),
s AS (SELECT e.sym AS cls, m.mode, x.h AS horizon, CASE WHEN coalesce(n, 0) = x.h THEN 'complete' WHEN since + x.h * 3600 > (SELECT max(t) FROM b) THEN 'pending' ELSE 'missing' END AS status, CASE WHEN m.mode = 'long' THEN cl / nullif(px, 0) - 1 ELSE 1 - cl / nullif(px, 0) END AS ret
 FROM e CROSS JOIN (VALUES (4), (12), (24)) x(h) CROSS JOIN (VALUES ('long'), ('short')) m(mode) LEFT JOIN p ON p.id = e.id AND p.h = x.h)
SELECT cls, mode, CAST(horizon AS INTEGER) AS horizon, count(CASE WHEN status = 'complete' THEN 1 END) AS complete, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'missing' THEN 1 END) AS missing, round(avg(CASE WHEN status = 'complete' THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END), 5) AS rate FROM s GROUP BY 1, 2, 3""")
def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class by mode by horizon: the path is read once for the longest horizon, shorter ones are conditions on it."""
    bars = event_bars(spark, sf_dir)
    rows = events(bars)
    within = lambda h: F.col("bar_t") <= F.col("since") + h * HOUR
    met = O.path(rows, bars, max(_HORIZONS) * HOUR).groupBy("id").agg(*[a for h in _HORIZONS for a in (F.count_if(within(h)).alias(f"n{h}"), F.max_by("bar_close", F.when(within(h), F.col("bar_t"))).alias(f"c{h}"))])
    rows = rows.join(met, "id", "left").crossJoin(F.broadcast(bars.agg(F.max("t").alias("last"))))  # one row
    cells = [F.struct(F.lit(m).alias("mode"), F.lit(h).alias("horizon"), F.coalesce(f"n{h}", F.lit(0)).alias("n"), (sign * (F.try_divide(f"c{h}", "px") - 1)).alias("ret")) for h in _HORIZONS for m, sign in (("long", 1), ("short", -1))]
    long = rows.select(F.col("sym").alias("cls"), "since", "last", F.explode(F.array(*cells)).alias("x")).select("cls", "since", "last", "x.*")
    status = F.when(F.col("n") == F.col("horizon"), "complete").when(F.col("since") + F.col("horizon") * HOUR > F.col("last"), "pending").otherwise("missing")
    out = long.withColumn("status", status).groupBy("cls", "mode", "horizon").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "pending", "missing")], F.avg(F.when(F.col("status") == "complete", F.coalesce(F.col("ret") > 0, F.lit(False)).cast("double"))).alias("rate"))
    return rounded(out, {"rate": 5})


_ENTRIES_SQL = """p AS (SELECT e.id, e.px, b.t, b.low, b.high, b.close, max(b.high) OVER (PARTITION BY e.id ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM e JOIN b ON b.sym = e.sym AND b.t > e.since AND b.t <= e.since + 43200),
m AS (SELECT id, t, close, 'immediate' AS method FROM p UNION ALL SELECT id, t, close, 'retest' FROM p WHERE low <= px AND close >= px UNION ALL SELECT id, t, close, 'fixed-pullback' FROM p WHERE low <= px * 0.98 UNION ALL SELECT id, t, close, 'breakout' FROM p WHERE close > peak),
en AS (SELECT id, method, min(t) AS entry_t, first(close ORDER BY t) AS entry_px FROM m GROUP BY 1, 2), fin AS (SELECT id, last(close ORDER BY t) AS end_px FROM p GROUP BY 1)"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = event_bars(spark, sf_dir)
    e = events(bars)
    methods = {k: v for k, v in D.METHODS.items() if k != "atr-reclaim"}
    end = O.path(e, bars, 12 * HOUR).groupBy("id").agg(F.max_by("bar_close", "bar_t").alias("end_px"))
    return e, D.entries(e, bars, 12 * HOUR, methods), end


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_ENTRIES_SQL}, o AS (SELECT id, method, end_px / nullif(entry_px, 0) - 1 AS ret FROM en JOIN fin USING (id)),
j AS (SELECT o.method, o.ret, i.ret AS base FROM o JOIN o i ON i.id = o.id AND i.method = 'immediate'), n AS (SELECT count(*) AS all_n FROM e)
SELECT method, count(*) AS n, round(count(*) / any_value(all_n), 5) AS fill_rate, round(avg(ret), 5) AS mean, round(avg(base), 5) AS matched, round(avg(ret) - avg(base), 5) AS delta,
round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) / nullif(avg(CASE WHEN base > 0 THEN 1.0 ELSE 0.0 END), 0), 5) AS lift FROM j CROSS JOIN n GROUP BY 1""")
def entry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry method against the immediate entries of the same events."""
    e, entries, end = _entries(spark, sf_dir)
    rows = entries.join(end, "id").select("id", "method", (F.try_divide("end_px", "entry_px") - 1).alias("ret"))
    rows = rows.join(rows.where("method = 'immediate'").select("id", F.col("ret").alias("base")), "id")
    rate = lambda c: F.avg(F.coalesce(F.col(c) > 0, F.lit(False)).cast("double"))
    out = rows.groupBy("method").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg("base").alias("matched"), F.try_divide(rate("ret"), rate("base")).alias("lift"))
    out = out.crossJoin(F.broadcast(e.agg(F.count("*").alias("all_n"))))  # one row
    out = out.select("method", "n", (F.col("n") / F.col("all_n")).alias("fill_rate"), "mean", "matched", (F.col("mean") - F.col("matched")).alias("delta"), "lift")
    return rounded(out, dict.fromkeys(("fill_rate", "mean", "matched", "delta", "lift"), 5))


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_ENTRIES_SQL}, s AS (SELECT e.sym AS lane, en.method, x.mode, CASE WHEN x.mode = 'signal' THEN e.px ELSE en.entry_px END / nullif(e.px, 0) - 1 AS slip FROM en JOIN e USING (id) CROSS JOIN (VALUES ('signal'), ('confirmed')) x(mode))
SELECT lane, method, mode, count(*) AS n, round(avg(slip), 5) AS mean, round(median(slip), 5) AS median FROM s GROUP BY 1, 2, 3""")
def entry_policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage of the confirmed entry against the signal's own price, by lane and method."""
    e, entries, _ = _entries(spark, sf_dir)
    mode = lambda name, px: F.struct(F.lit(name).alias("mode"), (F.try_divide(F.col(px), F.col("px")) - 1).alias("slip"))
    rows = entries.join(e.select("id", F.col("sym").alias("lane"), "px"), "id").select("lane", "method", F.explode(F.array(mode("signal", "px"), mode("confirmed", "entry_px"))).alias("x")).select("lane", "method", "x.*")
    return rounded(rows.groupBy("lane", "method", "mode").agg(F.count("*").alias("n"), F.avg("slip").alias("mean"), F.percentile("slip", F.lit(0.5)).alias("median")), {"mean": 5, "median": 5})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=43200)}, tr AS (SELECT e.sym, e.since, CASE WHEN t1 < coalesce(stop_t, 4611686018427387904) THEN t1 WHEN stop_t IS NOT NULL THEN stop_t ELSE end_t END AS until,
 CASE WHEN t1 < coalesce(stop_t, 4611686018427387904) THEN 0.04 WHEN stop_t IS NOT NULL THEN -0.03 ELSE end_px / nullif(px, 0) - 1 END AS gross FROM e JOIN ft USING (id) WHERE n = 12),
nx AS (SELECT *, (SELECT min(o.since) FROM tr o WHERE o.sym = tr.sym AND o.since > tr.since AND o.since >= tr.until) AS next FROM tr),
tk AS (SELECT n.* FROM nx n JOIN (SELECT sym, min(since) AS since FROM nx GROUP BY 1) f ON f.sym = n.sym AND f.since = n.since UNION ALL SELECT n.* FROM tk JOIN nx n ON n.sym = tk.sym AND n.since = tk.next)
SELECT CAST(floor(since / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(CASE WHEN gross > 0.003 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, round(sum(greatest(-1.0, 20 * (CAST(gross AS DOUBLE) - 0.003))), 5) AS roi FROM tk GROUP BY 1""")
def daily_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All out at the first target, the stop or the end; a symbol is busy until its trade ends; return on margin at 20 times, at worst all of it."""
    bars = event_bars(spark, sf_dir)
    e = events(bars)
    won = F.coalesce(F.col("t1") < F.coalesce("stop_t", F.lit(1 << 62)), F.lit(False))
    pick = lambda win, lose, end: F.when(won, win).when(F.col("stop_t").isNotNull(), lose).otherwise(end)
    rows = e.join(O.first_touch(e, bars, 12 * HOUR, (0.04,)), "id").where("n = 12")
    rows = rows.select("sym", "since", pick(F.col("t1"), F.col("stop_t"), F.col("end_t")).alias("until"), pick(F.lit(0.04), F.lit(-0.03), F.try_divide("end_px", "px") - 1).alias("gross"))
    taken = thin(rows, ["sym"], "since", F.col("until")).withColumn("net", F.col("gross") - 0.003)
    out = taken.groupBy(F.floor(F.col("since") / DAY).cast("long").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.sum(F.greatest(F.lit(-1.0), 20 * F.col("net"))).alias("roi"))
    return rounded(out, {"win_rate": 5, "roi": 5})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, ed AS (SELECT id, sym, since, CAST(floor(since / 86400) AS BIGINT) AS day FROM e WHERE since - 3600 IN (SELECT t FROM b) AND sym NOT IN ('error', 'signup')),
op AS (SELECT ed.*, b.close AS px FROM ed JOIN b ON b.sym = ed.sym AND b.t = ed.since + 3600 WHERE b.close > 0 AND ed.since + 3600 < (day + 1) * 86400),
wk AS (SELECT op.id, s.side, b.t, CASE s.side WHEN 'long' THEN 1 ELSE -1 END * (b.close / op.px - 1) AS gain FROM op JOIN b ON b.sym = op.sym AND b.t > op.since + 3600 AND b.t < (day + 1) * 86400 AND b.close > 0 CROSS JOIN (VALUES ('long'), ('short')) s(side)),
fo AS (SELECT id, side, min(CASE WHEN gain <= -0.05 + 1e-9 THEN t END) AS stop, min(CASE WHEN gain >= 0.05 - 1e-9 THEN t END) AS one, min(CASE WHEN gain >= 0.1 - 1e-9 THEN t END) AS two, last(gain ORDER BY t) AS fin FROM wk GROUP BY 1, 2),
pa AS (SELECT *, CASE WHEN one < coalesce(stop, 4611686018427387904) THEN 0.5 ELSE 0 END AS p1, coalesce(two < coalesce(stop, 4611686018427387904), false) AS g2, CASE WHEN stop IS NOT NULL THEN -0.05 ELSE fin END AS rest FROM fo),
ro AS (SELECT id, side, 'ladder' AS mode, 20 * (0.05 * p1 + 0.1 * CASE WHEN g2 THEN (1 - p1) * 0.5 ELSE 0 END + (1 - p1 - CASE WHEN g2 THEN (1 - p1) * 0.5 ELSE 0 END) * rest) AS roi, coalesce(stop, 4611686018427387904) AS until FROM pa
 UNION ALL SELECT id, side, 'allout', 20 * CASE WHEN g2 THEN 0.1 ELSE rest END, 4611686018427387904 FROM pa),
la AS (SELECT concat(ed.day, ed.sym, l.side, l.mode) AS lane, ed.day, ed.since, l.side, l.mode, ro.roi, coalesce(ro.until + 1, ed.since) AS until FROM ed CROSS JOIN (SELECT * FROM (VALUES ('long'), ('short')) a(side) CROSS JOIN (VALUES ('ladder'), ('allout')) m(mode)) l LEFT JOIN ro ON ro.id = ed.id AND ro.side = l.side AND ro.mode = l.mode),
nx AS (SELECT *, (SELECT min(o.since) FROM la o WHERE o.lane = la.lane AND o.since > la.since AND o.since >= la.until) AS next FROM la),
tk AS (SELECT n.* FROM nx n JOIN (SELECT lane, min(since) AS since FROM nx GROUP BY 1) f ON f.lane = n.lane AND f.since = n.since UNION ALL SELECT n.* FROM tk JOIN nx n ON n.lane = tk.lane AND n.since = tk.next)
SELECT day, side, mode, count(roi) AS n, count(*) - count(roi) AS skipped, round(avg(CASE WHEN roi > 0 THEN 1.0 WHEN roi IS NOT NULL THEN 0.0 END), 5) AS win_rate, round(coalesce(sum(roi), 0), 4) AS roi FROM tk GROUP BY 1, 2, 3""")
def daily_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides, ladder and all out, each day: confirmed entries of guarded edges, without the excluded symbols."""
    bars = event_bars(spark, sf_dir)
    slots = bars.select((F.col("t") + HOUR).alias("since")).distinct()
    edges = events(bars).where(~F.col("sym").isin("error", "signup")).join(slots, "since", "left_semi")
    trades = E.day_trades(edges, bars, HOUR)
    won = F.when(F.col("roi").isNotNull(), (F.col("roi") > 0).cast("double"))
    out = trades.groupBy("day", "side", "mode").agg(F.count("roi").alias("n"), (F.count("*") - F.count("roi")).alias("skipped"), F.avg(won).alias("win_rate"), F.coalesce(F.sum("roi"), F.lit(0.0)).alias("roi"))
    return rounded(out, {"win_rate": 5, "roi": 4})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL} SELECT id, sym, since FROM e WHERE since - 3600 IN (SELECT t FROM b) AND sym NOT IN ('error', 'signup')""")
def edges_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose slot before was recorded at all, without the excluded symbols."""
    bars = event_bars(spark, sf_dir)
    slots = bars.select((F.col("t") + HOUR).alias("since")).distinct()
    return events(bars).where(~F.col("sym").isin("error", "signup")).join(slots, "since", "left_semi").select("id", "sym", "since")


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL} SELECT id, round((SELECT last(px ORDER BY ts, seq) FROM ev WHERE ev.sym = e.sym AND ev.ts <= e.since), 6) AS now, round((SELECT last(px ORDER BY ts, seq) FROM ev WHERE ev.sym = e.sym AND ev.ts <= e.since - 86400), 6) AS placebo FROM e""")
def placebo_day_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of read of an event and the same read a day earlier."""
    feed = ticks(spark, sf_dir).select("sym", "ts", "seq", F.col("px").alias("v"))
    rows = J.asof(events(event_bars(spark, sf_dir)), feed, F.col("since"), {"v": "now"}, order=["ts", "seq"])
    rows = J.asof(rows, feed, F.col("since") - DAY, {"v": "placebo"}, order=["ts", "seq"])
    return rounded(rows.select("id", "now", "placebo"), {"now": 6, "placebo": 6})


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY t DESC) AS k FROM b), l AS (SELECT * FROM r WHERE k <= 25)
SELECT sym, CASE WHEN count(*) = 25 THEN round(last(close ORDER BY t) / nullif(first(close ORDER BY t), 0) - 1, 6) END AS ret24h, CASE WHEN count(*) = 25 THEN round((1 - last(tq / nullif(q, 0) ORDER BY t) / nullif(first(tq / nullif(q, 0) ORDER BY t), 0)) * 100, 4) END AS ls_drop,
CASE WHEN count(*) = 25 THEN round(sum(CASE WHEN k <= 24 THEN tq END) / nullif(sum(CASE WHEN k <= 24 THEN q END), 0), 6) END AS taker24h FROM l GROUP BY 1""")
def scalar_lookbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over the last 25 rows of a symbol, null where there are fewer."""
    bars = event_bars(spark, sf_dir).withColumn("share", F.try_divide("tq", "q"))
    w = X.by_time()
    back = lambda c: F.lag(c, 24).over(w)
    whole = lambda x: F.when(F.count("*").over(X.upto(25)) == 25, x)
    values = {"ret24h": F.try_divide(F.col("close"), back("close")) - 1, "ls_drop": (1 - F.try_divide(F.col("share"), back("share"))) * 100, "taker24h": F.try_divide(F.sum("tq").over(X.upto(24)), F.sum("q").over(X.upto(24)))}
    rows = bars.select("sym", "t", *[whole(v).alias(k) for k, v in values.items()])
    last = rows.groupBy("sym").agg(F.max_by(F.struct(*values), "t").alias("x")).select("sym", "x.*")
    return rounded(last, {"ret24h": 6, "ls_drop": 4, "taker24h": 6})


@query(f"""{EVENT_BARS_SQL}, s AS (SELECT sym, t, close AS spot FROM b WHERE n > 1), r AS (SELECT b.sym, b.t, count(*) OVER w AS rows, b.t - min(b.t) OVER w AS span, count(spot) OVER w AS spots, avg(spot) OVER w AS mean FROM b LEFT JOIN s USING (sym, t) WINDOW w AS (PARTITION BY b.sym ORDER BY b.t ROWS 11 PRECEDING))
SELECT sym, t, span = 39600 AS dense, CASE WHEN spots = 12 THEN round(mean, 6) END AS spot FROM r WHERE rows = 12""")
def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve bars; the second feed is attached only if all twelve of its bars are there."""
    bars = event_bars(spark, sf_dir)
    rows = bars.join(bars.where("n > 1").select("sym", "t", F.col("close").alias("spot")), ["sym", "t"], "left")
    w = X.upto(12)
    rows = rows.select("sym", "t", F.count("*").over(w).alias("rows"), (F.col("t") - F.min("t").over(w)).alias("span"), F.count("spot").over(w).alias("spots"), F.avg("spot").over(w).alias("mean"))
    return rows.where("rows = 12").select("sym", "t", (F.col("span") == 11 * HOUR).alias("dense"), F.when(F.col("spots") == 12, F.round("mean", 6)).alias("spot"))


@query("""WITH l AS (SELECT event_type AS src, user_id AS sym, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_id AS id, value AS px FROM events), a AS (SELECT src, sym, h, max(id) AS id FROM l WHERE px > 20 GROUP BY 1, 2, 3), s AS (SELECT src, sym, h, min(id) AS id FROM l GROUP BY 1, 2, 3)
SELECT src, sym, h, id FROM a UNION ALL SELECT src, sym, h, id FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = s.src AND a.sym = s.sym AND a.h = s.h)""")
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["src", "sym", "h"]
    rows = ticks(spark, sf_dir).select(F.col("sym").alias("src"), F.col("user").alias("sym"), F.floor(F.col("ts") / HOUR).cast("long").alias("h"), F.col("seq").alias("id"), "px")
    log, seed = rows.where("px > 20").groupBy(*key).agg(F.max("id").alias("id")), rows.groupBy(*key).agg(F.min("id").alias("id"))
    return E.seed_merge(log, seed, key)


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'missing' WHEN o_orderstatus = 'P' THEN 'invalid' ELSE 'complete' END AS status, o_custkey % 3 = 0 AS same, o_custkey % 11 = 0 AS unknown FROM orders)
SELECT id, CASE WHEN status = 'missing' THEN true WHEN status = 'invalid' THEN false ELSE same AND NOT unknown END AS reused FROM a""")
def coverage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, customer = table(spark, sf_dir, "orders"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "missing").when(F.col("o_orderstatus") == "P", "invalid").otherwise("complete")
    return o.select(F.col("o_orderkey").alias("id"), E.reuse(status, F.when(customer % 11 != 0, F.lit(0)), customer % 3).alias("reused"))


@query("""WITH m AS (SELECT o_custkey AS member, CAST(floor(min(epoch(o_orderdate)) / 86400) AS BIGINT) AS first, CAST(floor(max(epoch(o_orderdate)) / 86400) AS BIGINT) AS last FROM orders GROUP BY 1),
d AS (SELECT member, unnest(range(first, last + 1)) AS day FROM m) SELECT day, count(*) AS members FROM d GROUP BY 1""")
def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members active each day, from their first order to their last."""
    day = F.floor(epoch(F.col("o_orderdate")) / DAY).cast("long")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return E.active_days(m)


@query("""SELECT n_regionkey AS base, string_agg(n_name, ',' ORDER BY n_name) AS symbols FROM nation GROUP BY 1""")
def symbols_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols are a registry: a base has few."""
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("base")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("symbols"))


@query("""WITH g AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, string_agg(concat(event_type, event_id), '|' ORDER BY concat(event_type, event_id)) AS s FROM events GROUP BY 1)
SELECT slot, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fingerprint FROM g""")
def selection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).groupBy(F.floor(F.col("ts") / 900).cast("long").alias("slot"))
    return rows.agg(F.collect_list(F.concat("sym", F.col("seq").cast("string"))).alias("ids")).select("slot", E.fingerprint(F.col("ids")).alias("fingerprint"))


@query("""WITH s AS (SELECT l_suppkey AS key, count(*) AS n, avg(l_discount) - avg(l_tax) AS net, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) / 0.3333 AS lift FROM lineitem GROUP BY 1)
SELECT key, CASE WHEN n < 10 THEN 'untested' WHEN lift >= 1 AND net > 0.01 THEN 'entry' WHEN lift >= 1 THEN 'context' ELSE 'none' END AS capability, CASE WHEN n < 10 THEN 'collect' WHEN lift >= 1 AND net > 0.01 THEN 'validate' WHEN lift >= 1 THEN 'demote' ELSE 'retire' END AS recommendation FROM s""")
def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rounded: a net of 0.01 is none above it, in whatever order its rows were summed
    net = F.round(F.avg("l_discount") - F.avg("l_tax"), 12)
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("n"), net.alias("net"), (F.avg((F.col("l_returnflag") == "A").cast("double")) / 0.3333).alias("lift"))
    few, good, some = F.col("n") < 10, (F.col("lift") >= 1) & (F.col("net") > 0.01), F.col("lift") >= 1
    pick = lambda a, b, c, d: F.when(few, a).when(good, b).when(some, c).otherwise(d)
    return s.select("key", pick("untested", "entry", "context", "none").alias("capability"), pick("collect", "validate", "demote", "retire").alias("recommendation"))


@query("""SELECT event_type AS sym, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, count(*) AS n, count(DISTINCT user_id) AS sources, CAST(floor(min(epoch(ts))) AS BIGINT) AS first_ts, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_ts, count(CASE WHEN value > 50 THEN 1 END) AS eligible, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2""")
def reference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("side", F.when(F.col("user") % 2 == 0, "long").otherwise("short"))
    return rounded(rows.groupBy("sym", "side").agg(F.count("*").alias("n"), F.count_distinct("user").alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("px") > 50).alias("eligible"), F.avg("px").alias("mean")), {"mean": 5})
