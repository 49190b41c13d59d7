"""Queries on as-of, range, anti and splice joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import windows as X
from ..registry import query
from ..shared import kept
from ..sources.tables import EVENT_BARS_SQL, event_bars, table, ticks
from .bars import rounded

FEED_SQL = "o AS (SELECT sym, ts, seq, px FROM ev)"
ORDER = ["ts", "seq"]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks as a second feed (sym, ts, seq, px)."""
    return ticks(spark, sf_dir).select("sym", "ts", "seq", "px")


def _asof_sql(at: str, age: int, strict: bool = False) -> str:
    return f"(SELECT last(px ORDER BY ts, seq) FROM o WHERE o.sym = x.sym AND o.ts {'<' if strict else '<='} {at} AND o.ts >= {at} - {age})"


@query(f"{EVENT_BARS_SQL}, {FEED_SQL} SELECT x.sym, x.t, round({_asof_sql('x.t + 3600', 7200)}, 6) AS v FROM b x")
def asof_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.asof(event_bars(spark, sf_dir).select("sym", "t"), feed(spark, sf_dir), F.col("t") + 3600, {"px": "v"}, order=ORDER, max_age=7200)
    return rounded(rows, {"v": 6})


_CUR = "c AS (SELECT x.sym, x.t, (SELECT max(ts) FROM o WHERE o.sym = x.sym AND o.ts <= x.t AND o.ts >= x.t - 7200) AS ct, " + _asof_sql("x.t", 7200) + " AS cv FROM b x)"


@query(f"{EVENT_BARS_SQL}, {FEED_SQL}, {_CUR} SELECT x.sym, x.t, round((cv / nullif({_asof_sql('x.ct - 3600', 14400)}, 0) - 1) * 100, 4) AS change_1h, round((cv / nullif({_asof_sql('x.ct - 14400', 14400)}, 0) - 1) * 100, 4) AS change_4h FROM c x WHERE ct IS NOT NULL")
def oi_change_on_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References stand at the matched row's own time less 1 h and 4 h."""
    o = feed(spark, sf_dir)
    rows = A.asof(event_bars(spark, sf_dir).select("sym", "t"), o, F.col("t"), {"px": "cv", "ts": "ct"}, order=ORDER, max_age=7200).where("ct is not null")
    for name, h in (("r1", 3600), ("r4", 14400)):
        rows = kept(A.asof(rows, o, F.col("ct") - h, {"px": name}, order=ORDER, max_age=14400))
    pct = lambda r: F.round((F.try_divide("cv", r) - 1) * 100, 4)
    return rows.select("sym", "t", pct("r1").alias("change_1h"), pct("r4").alias("change_4h"))


@query(f"{EVENT_BARS_SQL}, {FEED_SQL}, c AS (SELECT x.sym, x.t, {_asof_sql('x.t', 7200)} AS cv FROM b x) SELECT x.sym, x.t, round((cv / nullif({_asof_sql('x.t - 3600', 7200)}, 0) - 1) * 100, 4) AS change_1h, round((cv / nullif({_asof_sql('x.t - 14400', 7200)}, 0) - 1) * 100, 4) AS change_4h FROM c x")
def oi_change_on_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References stand at the bar's close less 1 h and 4 h: another anchor than oi_change_on_current."""
    o, rows = feed(spark, sf_dir), event_bars(spark, sf_dir).select("sym", "t")
    for name, h in (("cv", 0), ("r1", 3600), ("r4", 14400)):
        rows = kept(A.asof(rows, o, F.col("t") - h, {"px": name}, order=ORDER, max_age=7200))
    pct = lambda r: F.round((F.try_divide("cv", r) - 1) * 100, 4)
    return rows.select("sym", "t", pct("r1").alias("change_1h"), pct("r4").alias("change_4h"))


@query(f"{EVENT_BARS_SQL}, {FEED_SQL} SELECT x.sym, x.t, round(coalesce({_asof_sql('x.t', 1800)}, (SELECT first(px ORDER BY ts, seq) FROM o WHERE o.sym = x.sym AND o.ts > x.t AND o.ts <= x.t + 1500)), 6) AS v FROM b x")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.nearest(event_bars(spark, sf_dir).select("sym", "t"), feed(spark, sf_dir), F.col("t"), "px", "v", order=ORDER, max_age=1800, within=1500)
    return rounded(rows, {"v": 6})


@query(f"{EVENT_BARS_SQL}, {FEED_SQL} SELECT x.sym, x.t, round(coalesce((SELECT sum(px) FROM o WHERE o.sym = x.sym AND o.ts > x.t AND o.ts <= x.t + 28800), 0), 4) AS cost, (SELECT count(*) FROM o WHERE o.sym = x.sym AND o.ts > x.t AND o.ts <= x.t + 28800) AS cost_n FROM b x")
def funding_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.range_sum(event_bars(spark, sf_dir).select("sym", "t"), feed(spark, sf_dir), F.col("t"), F.col("t") + 28800, "px", "cost")
    return rounded(rows, {"cost": 4})


_SPOT = "s AS (SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS t, first(value ORDER BY ts, event_id) AS spot FROM events GROUP BY 1, 2)"


@query(f"""{EVENT_BARS_SQL}, {_SPOT}, j AS (SELECT b.sym, b.t, close, spot FROM b LEFT JOIN s ON s.sym = b.sym AND s.t = b.t)
SELECT sym, t, CASE WHEN count(spot) OVER w = 4 AND t - min(t) OVER w = 10800 THEN round(avg((close / nullif(spot, 0) - 1) * 100) OVER w, 4) END AS basis_pct FROM j WINDOW w AS (PARTITION BY sym ORDER BY t ROWS 3 PRECEDING)""")
def basis_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perpetual against spot on equal times; only whole, contiguous windows count."""
    spot = ticks(spark, sf_dir).groupBy("sym", (F.col("ts") - F.col("ts") % 3600).alias("t")).agg(F.min_by("px", F.struct("ts", "seq")).alias("spot"))
    rows = event_bars(spark, sf_dir).join(spot, ["sym", "t"], "left")
    w = X.upto(4)
    whole = (F.count("spot").over(w) == 4) & (F.col("t") - F.min("t").over(w) == 10800)
    return rows.select("sym", "t", F.when(whole, F.round(F.avg((F.try_divide("close", "spot") - 1) * 100).over(w), 4)).alias("basis_pct"))


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym, t, close / nullif(lag(close, 4) OVER (PARTITION BY sym ORDER BY t), 0) - 1 AS r4 FROM b)
SELECT r.sym, r.t, round((r.r4 - m.r4) * 100, 4) AS rs_pct FROM r JOIN r m ON m.sym = 'click' AND m.t = r.t WHERE r.sym <> 'click' AND r.r4 IS NOT NULL AND m.r4 IS NOT NULL""")
def benchmark_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return against that of one benchmark series at equal times."""
    r = event_bars(spark, sf_dir).select("sym", "t", (F.try_divide(F.col("close"), F.lag("close", 4).over(X.by_time())) - 1).alias("r4")).where("r4 is not null")
    m = r.where("sym = 'click'").select("t", F.col("r4").alias("m4"))
    return r.where("sym <> 'click'").join(m, "t").select("sym", "t", F.round((F.col("r4") - F.col("m4")) * 100, 4).alias("rs_pct"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def active_without_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).join(done, "id", "left_anti")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
SELECT 'armed_not_listed' AS audit, count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'listed_not_armed', count(*) FROM r WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'both', count(*) FROM r WHERE id IN (SELECT id FROM a)""")
def linkage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    armed = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    listed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("audit"), "n")
    return count(armed.join(listed, "id", "left_anti"), "armed_not_listed").union(count(listed.join(armed, "id", "left_anti"), "listed_not_armed")).union(count(listed.join(armed, "id", "left_semi"), "both"))


@query(f"""{EVENT_BARS_SQL}, k AS (SELECT sym, t, close, lag(close) OVER (PARTITION BY sym ORDER BY t) AS pc FROM b), e AS (SELECT sym, t, 'edge' AS kind FROM k WHERE close > 3 * pc),
n AS (SELECT DISTINCT sym, ts - ts % 3600 AS t, 'notify' AS kind FROM ev WHERE px > 90)
SELECT * FROM n UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sym = e.sym AND n.t = e.t)""")
def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications, and detector edges where no notification stands in the same slot."""
    bars = event_bars(spark, sf_dir)
    edges = bars.withColumn("pc", F.lag("close").over(X.by_time())).where("close > 3 * pc").select("sym", "t", F.lit("edge").alias("kind"))
    sent = ticks(spark, sf_dir).where("px > 90").select("sym", (F.col("ts") - F.col("ts") % 3600).alias("t"), F.lit("notify").alias("kind")).distinct()
    return sent.unionByName(edges.join(sent, ["sym", "t"], "left_anti"))


@query(f"""{EVENT_BARS_SQL}, base AS (SELECT sym, t, close FROM b WHERE t >= 1705276800), f AS (SELECT sym, min(t) AS f FROM base GROUP BY 1)
SELECT sym, t, round(close, 6) AS close FROM base UNION ALL SELECT b.sym, b.t, round(b.close * 0.9, 6) FROM b LEFT JOIN f USING (sym) WHERE f IS NULL OR b.t < f""")
def splice_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir).select("sym", "t", "close")
    return rounded(A.splice(bars.withColumn("close", F.col("close") * 0.9), bars.where("t >= 1705276800")), {"close": 6})


@query(f"""{EVENT_BARS_SQL}, st AS (SELECT sym, t, close AS v FROM b WHERE t >= 1705276800), h AS (SELECT sym, t, close * 0.9 AS v FROM b),
f AS (SELECT sym, min(t) AS t, first(v ORDER BY t) AS v FROM st GROUP BY 1), k AS (SELECT f.sym, f.t, f.v / nullif((SELECT last(h.v ORDER BY h.t) FROM h WHERE h.sym = f.sym AND h.t <= f.t AND h.t >= f.t - 2700), 0) AS k FROM f)
SELECT sym, t, round(v, 6) AS v FROM st UNION ALL SELECT h.sym, h.t, round(h.v * k.k, 6) FROM h JOIN k USING (sym) WHERE k.k BETWEEN 0.8 AND 1.25 AND h.t < k.t""")
def scale_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir).select("sym", "t", F.col("close").alias("v"))
    return rounded(A.scale_splice(bars.where("t >= 1705276800"), bars.withColumn("v", F.col("v") * 0.9), 2700), {"v": 6})


@query(f"""{EVENT_BARS_SQL}, u AS (SELECT sym, ts - ts % 900 AS t, CASE WHEN u % 2 = 0 THEN px END AS usd, CASE WHEN u % 3 = 0 THEN px * 10 END AS qty, seq FROM ev),
m AS (SELECT sym, t, last(usd ORDER BY seq) FILTER (usd IS NOT NULL) AS usd, last(qty ORDER BY seq) FILTER (qty IS NOT NULL) AS qty FROM u GROUP BY 1, 2), x AS (SELECT sym, max(t) AS x FROM m GROUP BY 1)
SELECT sym, t, round(usd, 6) AS usd, round(qty, 5) AS qty FROM m JOIN x USING (sym) WHERE t > x - 176400""")
def log_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit the last write wins; rows of the last 49 hours of a symbol stay."""
    rows = ticks(spark, sf_dir).select("sym", (F.col("ts") - F.col("ts") % 900).alias("t"), F.when(F.col("user") % 2 == 0, F.col("px")).alias("usd"), F.when(F.col("user") % 3 == 0, F.col("px") * 10).alias("qty"), "seq")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    merged = rows.groupBy("sym", "t").agg(known("usd"), known("qty"))
    newest = F.max("t").over(Window.partitionBy("sym"))
    return rounded(merged.withColumn("x", newest).where("t > x - 176400").drop("x"), {"usd": 6, "qty": 5})
