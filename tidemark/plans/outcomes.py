"""Queries on edges, forward outcomes, policies and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..operators import windows as X
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, event_bars
from .bars import rounded

HOUR, DAY = 3600, 86400

_PREV = "sl AS (SELECT t, lag(t) OVER (ORDER BY t) AS prev FROM (SELECT DISTINCT t FROM b))"
#: Edges of "closed up twice the last close" as events.
_EVENTS_SQL = f"""k AS (SELECT sym, t, close, close > 2 * lag(close) OVER (PARTITION BY sym ORDER BY t) AS f FROM b), {_PREV},
ev1 AS (SELECT k.sym, k.t, k.close FROM k JOIN sl USING (t) WHERE f AND NOT EXISTS (SELECT 1 FROM k p WHERE p.sym = k.sym AND p.t = sl.prev AND p.f)),
e AS (SELECT concat(sym, ':', t) AS id, sym, t AS since, close AS px FROM ev1)"""


def events(bars: DataFrame) -> DataFrame:
    on = bars.withColumn("flag", F.col("close") > 2 * F.lag("close").over(X.by_time()))
    edges = O.rising_edges(on, F.col("flag"))
    return edges.select(F.concat("sym", F.lit(":"), F.col("t").cast("string")).alias("id"), "sym", F.col("t").alias("since"), F.col("close").alias("px"))


@query(f"{EVENT_BARS_SQL}, {_EVENTS_SQL} SELECT id, sym, since, round(px, 6) AS px FROM e")
def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(event_bars(spark, sf_dir)), {"px": 6})


_FWD = "w AS (PARTITION BY sym ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 14400 FOLLOWING)"
_FORWARD_SQL = f"fw AS (SELECT sym, t, close, max(high) OVER w / nullif(close, 0) - 1 AS mfe, min(low) OVER w / nullif(close, 0) - 1 AS mae, last_value(close) OVER w / nullif(close, 0) - 1 AS ret, count(*) OVER w AS seen FROM b WINDOW {_FWD})"


@query(f"{EVENT_BARS_SQL}, {_FORWARD_SQL} SELECT sym, t, round(mfe, 8) AS mfe, round(mae, 8) AS mae, round(ret, 8) AS ret, seen FROM fw")
def forward_mfe_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.forward(event_bars(spark, sf_dir), 4 * HOUR).select("sym", "t", "mfe", "mae", "ret", "seen")
    return rounded(rows, {"mfe": 8, "mae": 8, "ret": 8})


@query(f"""{EVENT_BARS_SQL}, {_FORWARD_SQL}, {_EVENTS_SQL}, s AS (SELECT 'baseline' AS state, mfe, ret FROM fw WHERE seen > 0 UNION ALL SELECT 'edge', mfe, ret FROM fw JOIN e ON e.sym = fw.sym AND e.since = fw.t WHERE seen > 0)
SELECT state, count(*) AS n, round(avg(CASE WHEN mfe >= 0.5 THEN 1.0 ELSE 0.0 END), 5) AS hit_rate, round(avg(mfe), 4) AS mean_mfe, round(median(mfe), 4) AS median_mfe, round(avg(ret), 4) AS mean_ret FROM s GROUP BY state""")
def state_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline over every bar against the edges, in one aggregation."""
    bars = event_bars(spark, sf_dir)
    fw = O.forward(bars, 4 * HOUR).where("seen > 0").select("sym", "t", "mfe", "ret")
    edges = events(bars).select("sym", F.col("since").alias("t"), F.lit("edge").alias("state"))
    rows = fw.select(F.lit("baseline").alias("state"), "mfe", "ret").unionByName(fw.join(edges, ["sym", "t"]).select("state", "mfe", "ret"))
    return rows.groupBy("state").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("mfe") >= 0.5).cast("double")), 5).alias("hit_rate"), F.round(F.avg("mfe"), 4).alias("mean_mfe"), F.round(F.percentile("mfe", F.lit(0.5)), 4).alias("median_mfe"), F.round(F.avg("ret"), 4).alias("mean_ret")
    )


_PATH = "p AS (SELECT e.id, e.px, b.t, b.high, b.low, b.close FROM e JOIN b ON b.sym = e.sym AND b.t > e.since AND b.t <= e.since + {h})"


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_PATH.format(h=86400)}, g AS (SELECT id, count(*) AS n, max(high) AS top, last(close ORDER BY t) AS cl, min(CASE WHEN high >= px * 1.5 THEN t END) AS hit_t FROM p GROUP BY id),
s AS (SELECT e.*, coalesce(n, 0) AS n, top, cl, hit_t, CASE WHEN coalesce(n, 0) = 24 THEN 'complete' WHEN since + 86400 > (SELECT max(t) FROM b) THEN 'pending' ELSE 'data-missing' END AS status FROM e LEFT JOIN g USING (id))
SELECT id, sym, since, round(px, 6) AS px, status, n, round(top / nullif(px, 0) - 1, 8) AS mfe, CASE WHEN status = 'complete' THEN round(cl / nullif(px, 0) - 1, 8) END AS ret, hit_t FROM s""")
def strict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return rounded(O.strict(events(bars), bars, HOUR, DAY, 0.5), {"px": 6, "mfe": 8, "ret": 8})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_PATH.format(h=86400)}, g AS (SELECT id, min(CASE WHEN high >= px * 1.125 THEN t END) AS q, min(CASE WHEN high >= px * 1.5 THEN t END) AS h FROM p GROUP BY id)
SELECT id, (q - since) / 3600 AS lead_h FROM g JOIN e USING (id) WHERE h IS NOT NULL""")
def lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours to a quarter of the target, of events that reach the target."""
    bars = event_bars(spark, sf_dir)
    met = O.path(events(bars), bars, DAY).groupBy("id", "since").agg(*[F.min(F.when(F.col("bar_high") >= F.col("px") * x, F.col("bar_t"))).alias(n) for n, x in (("q", 1.125), ("h", 1.5))])
    return met.where("h IS NOT NULL").select("id", ((F.col("q") - F.col("since")) / 3600).alias("lead_h"))


_TOUCH = _PATH.format(h="{h}") + """, st AS (SELECT id, min(CASE WHEN low <= px * 0.97 THEN t END) AS stop_t FROM p GROUP BY id),
ft AS (SELECT p.id, any_value(stop_t) AS stop_t, min(CASE WHEN (stop_t IS NULL OR t <> stop_t) AND high >= px * 1.04 THEN t END) AS t1, min(CASE WHEN (stop_t IS NULL OR t <> stop_t) AND high >= px * 1.08 THEN t END) AS t2,
 min(CASE WHEN (stop_t IS NULL OR t <> stop_t) AND high >= px * 1.15 THEN t END) AS t3, last(close ORDER BY t) AS end_px, max(t) AS end_t, count(*) AS n FROM p JOIN st USING (id) GROUP BY p.id)"""


@query(f"{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=86400)} SELECT id, stop_t, t1, t2, t3, round(end_px, 6) AS end_px, end_t, n FROM ft")
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return rounded(O.first_touch(events(bars), bars, DAY), {"end_px": 6})


_TIME = f"""tm AS (SELECT e.*, CASE WHEN coalesce(n, 0) <> 12 THEN 'insufficient-data' WHEN stop_t IS NOT NULL THEN 'stop' ELSE 'time-exit' END AS terminal,
 CASE WHEN n = 12 THEN CASE WHEN stop_t IS NOT NULL THEN -0.03 ELSE end_px / nullif(px, 0) - 1 END END AS gross FROM e LEFT JOIN ft USING (id))"""


@query(f"{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=43200)}, {_TIME} SELECT id, sym, since, round(px, 6) AS px, terminal, round(gross, 5) AS gross, round(gross - 0.003, 5) AS net FROM tm")
def policy_time12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return rounded(O.time_exit(events(bars), bars, HOUR, 12 * HOUR), {"px": 6, "gross": 5, "net": 5})


_LADDER = """ld AS (SELECT e.*, n, stop_t, end_px, coalesce(t1 < coalesce(stop_t, 4611686018427387904), false) AS o1, coalesce(t2 < coalesce(stop_t, 4611686018427387904), false) AS o2, coalesce(t3 < coalesce(stop_t, 4611686018427387904), false) AS o3 FROM e LEFT JOIN ft USING (id)),
lg AS (SELECT *, CASE WHEN n = 12 THEN (CASE WHEN o1 THEN 0.5 ELSE 0.0 END) * 0.04 + (CASE WHEN o2 THEN 0.3 ELSE 0.0 END) * 0.08 + (1 - (CASE WHEN o1 THEN 0.5 ELSE 0.0 END) - (CASE WHEN o2 THEN 0.3 ELSE 0.0 END)) * (CASE WHEN o3 THEN 0.15 WHEN stop_t IS NOT NULL THEN -0.03 ELSE end_px / nullif(px, 0) - 1 END) END AS gross,
 CASE WHEN coalesce(n, 0) <> 12 THEN 'insufficient-data' WHEN o3 THEN 'ladder-complete' WHEN stop_t IS NOT NULL THEN 'stop' ELSE 'time-exit' END AS terminal FROM ld)"""


@query(f"{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=43200)}, {_LADDER} SELECT id, sym, since, round(px, 6) AS px, terminal, round(CAST(gross AS DOUBLE), 5) AS gross, round(CAST(gross AS DOUBLE) - 0.003, 5) AS net FROM lg")
def policy_ladder12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return rounded(O.ladder(events(bars), bars, HOUR, 12 * HOUR), {"px": 6, "gross": 5, "net": 5})


_NET = f"nt AS (SELECT sym, since, id, CAST(CASE WHEN gross IS NOT NULL THEN gross - 0.003 END AS DOUBLE) AS net FROM lg WHERE gross IS NOT NULL)"


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return O.ladder(events(bars), bars, HOUR, 12 * HOUR).where("net IS NOT NULL")


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=43200)}, {_LADDER}, {_NET}, q AS (SELECT sym, since, id, exp(sum(ln(greatest(0.01, 1 + net))) OVER w) AS e FROM nt WINDOW w AS (PARTITION BY sym ORDER BY since, id ROWS UNBOUNDED PRECEDING)),
kk AS (SELECT *, greatest(1.0, max(e) OVER (PARTITION BY sym ORDER BY since, id ROWS UNBOUNDED PRECEDING)) AS p FROM q) SELECT sym, round(max(1 - e / p), 5) AS drawdown FROM kk GROUP BY sym""")
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.equity_drawdown(_trades(spark, sf_dir), ["sym"], ["since", "id"]), {"drawdown": 5})


@query(f"""{EVENT_BARS_SQL}, {_EVENTS_SQL}, {_TOUCH.format(h=43200)}, {_LADDER}, {_NET}, x AS (SELECT 'ladder' AS policy, *, CAST(floor(since / 86400) AS BIGINT) AS day FROM nt),
cs AS (SELECT sym, sum(net) AS s FROM x GROUP BY 1), cd AS (SELECT day, sum(net) AS s FROM x GROUP BY 1)
SELECT policy, count(net) AS trades, count(DISTINCT sym) AS coins, count(DISTINCT day) AS days, round(avg(net), 5) AS mean, round(median(net), 5) AS median, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate,
 round(sum(CASE WHEN net > 0 THEN net END) / nullif(-sum(CASE WHEN net < 0 THEN net END), 0), 4) AS profit_factor, round(coalesce((SELECT max(s) / sum(s) FROM cs WHERE s > 0), 1.0), 5) AS top_sym_share, round(coalesce((SELECT max(s) / sum(s) FROM cd WHERE s > 0), 1.0), 5) AS top_day_share FROM x GROUP BY policy""")
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.summary(_trades(spark, sf_dir).withColumn("policy", F.lit("ladder")), ["policy"])
    return rounded(rows, {"mean": 5, "median": 5, "win_rate": 5, "profit_factor": 4, "top_sym_share": 5, "top_day_share": 5})


@query(f"""{EVENT_BARS_SQL}, x AS (SELECT sym, list_sort(list(close)) AS x, count(*) AS n FROM b GROUP BY 1)
SELECT sym, n, round((x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2, 6) AS median, round(x[CAST(floor(0.25 * (n - 1) + 0.5) AS INTEGER) + 1], 6) AS p25, round(x[least(CAST(floor(0.9 * n) AS INTEGER), n - 1) + 1], 6) AS q90, round(x[n // 2 + 1], 6) AS upper_middle, round(x[(n - 1) // 2 + 1], 6) AS lower_middle FROM x""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.order_statistics(event_bars(spark, sf_dir), ["sym"], "close"), dict.fromkeys(("median", "p25", "q90", "upper_middle", "lower_middle"), 6))
