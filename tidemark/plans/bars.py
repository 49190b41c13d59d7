"""Queries on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, TRADE_BARS_SQL, event_bars, ticks, trade_bars

HOUR = 3600
_R = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(q, 4) AS q"


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in columns.items()})


_OHLCQ = {"open": 6, "high": 6, "low": 6, "close": 6, "q": 4}


@query(f"{EVENT_BARS_SQL} SELECT sym, t, {_R}, round(tq, 4) AS tq, n FROM b")
def ohlc_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_bars(spark, sf_dir), _OHLCQ | {"tq": 4})


@query(f"{TRADE_BARS_SQL} SELECT sym, t, {_R.replace(', 6)', ', 8)')}, round(tq, 4) AS tq, n FROM b")
def ohlc_trades_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trade_bars(spark, sf_dir), {"open": 8, "high": 8, "low": 8, "close": 8, "q": 4, "tq": 4})


@query(f"""{EVENT_BARS_SQL}, g AS (SELECT *, (row_number() OVER (PARTITION BY sym ORDER BY t) - 1) // 3 AS g FROM b),
r AS (SELECT sym, min(t) AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(q) AS q, sum(tq) AS tq, count(*) AS n FROM g GROUP BY sym, g)
SELECT sym, t, {_R}, round(tq, 4) AS tq, n, close >= open AS up FROM r""")
def bars_rollup_x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.rollup_positions(event_bars(spark, sf_dir), 3), _OHLCQ | {"tq": 4})


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym, t - t % 14400 AS g, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(q) AS q FROM b
GROUP BY 1, 2 HAVING count(*) = 4) SELECT sym, g AS t, {_R} FROM r WHERE g + 14400 <= 1706400000""")
def bars_clock_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.rollup_clock(event_bars(spark, sf_dir), 4 * HOUR, 4, now=1706400000), _OHLCQ)


@query(f"""{EVENT_BARS_SQL}, p AS (SELECT sym, ts - ts % 60 AS t, last(px ORDER BY ts, seq) AS v FROM ev GROUP BY 1, 2),
f AS (SELECT sym, first(v ORDER BY t) AS v0 FROM p GROUP BY 1)
SELECT b.sym, b.t, round(coalesce((SELECT last(v ORDER BY p.t) FROM p WHERE p.sym = b.sym AND p.t <= b.t), f.v0, 0), 6) AS v FROM b LEFT JOIN f USING (sym)""")
def resample_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ticks(spark, sf_dir).groupBy("sym", (F.col("ts") - F.col("ts") % 60).alias("t")).agg(F.max_by("px", F.struct("ts", "seq")).alias("v"))
    return rounded(B.forward_fill(event_bars(spark, sf_dir), points), {"v": 6})


@query(f"""{EVENT_BARS_SQL}, p AS (SELECT sym, CAST(floor(ts / 3600.0 + 0.5) AS BIGINT) * 3600 AS t, last(px ORDER BY ts, seq) AS v FROM ev GROUP BY 1, 2)
SELECT b.sym, b.t, round(last_value(v IGNORE NULLS) OVER (PARTITION BY b.sym ORDER BY b.t ROWS UNBOUNDED PRECEDING), 6) AS v FROM b LEFT JOIN p ON p.sym = b.sym AND p.t = b.t""")
def metrics_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ticks(spark, sf_dir).withColumnRenamed("px", "v")
    return rounded(B.attach_nearest(event_bars(spark, sf_dir), points, HOUR).select("sym", "t", "v"), {"v": 6})


@query(f"""{EVENT_BARS_SQL}, l AS (SELECT sym, t, CASE WHEN close = 0 THEN 0 ELSE round(close * pow(10, 4 - floor(log10(abs(close))))) / pow(10, 4 - floor(log10(abs(close)))) END AS x,
  row_number() OVER (PARTITION BY sym ORDER BY t DESC) AS rd FROM b), k AS (SELECT *, count(*) OVER (PARTITION BY sym) - rd AS i FROM l WHERE rd <= 289),
s AS (SELECT *, lag(x) OVER (PARTITION BY sym ORDER BY i) AS px FROM k WHERE i % 6 = 0 OR rd = 1)
SELECT sym, count(*) AS n, round(sum(x), 4) AS total, round(first(x ORDER BY i), 4) AS first_x, round(last(x ORDER BY i), 4) AS last_x FROM s WHERE i % 6 = 0 OR x <> px OR px IS NULL GROUP BY sym""")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = B.sparkline(event_bars(spark, sf_dir))
    total = F.aggregate("points", F.lit(0.0), lambda a, x: a + x)
    return line.select("sym", F.size("points").cast("long").alias("n"), F.round(total, 4).alias("total"), F.round(F.element_at("points", 1), 4).alias("first_x"), F.round(F.element_at("points", -1), 4).alias("last_x"))


@query(f"""{EVENT_BARS_SQL}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY sym ORDER BY t) AS dt FROM b)
SELECT sym, count(*) AS rows, min(t) AS first_t, max(t) AS last_t, CAST(sum(CASE WHEN dt > 3600 THEN greatest(1, floor(dt / 3600.0 + 0.5) - 1) ELSE 0 END) AS BIGINT) AS gaps, round(sum(q), 3) AS q FROM d GROUP BY sym""")
def gap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.gap_profile(event_bars(spark, sf_dir), HOUR), {"q": 3})


@query(f"""{EVENT_BARS_SQL}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY sym ORDER BY t) AS dt FROM b),
v AS (SELECT sym, t, CASE WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'invalid' WHEN dt <> 3600 THEN 'gap' END AS reject FROM d)
SELECT sym, t, reject FROM v WHERE reject IS NOT NULL""")
def bar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.validated(event_bars(spark, sf_dir), HOUR).where("reject is not null").select("sym", "t", "reject")


@query(f"""{EVENT_BARS_SQL}, s AS (SELECT sym, t, CASE WHEN count(*) OVER w = 4 AND t - min(t) OVER w = 10800 THEN sum(tq) OVER w / nullif(sum(q) OVER w, 0) END AS share
FROM b WINDOW w AS (PARTITION BY sym ORDER BY t ROWS 3 PRECEDING)) SELECT sym, t, round(share, 6) AS share FROM s""")
def completed_taker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.completed_share(event_bars(spark, sf_dir), 4, HOUR).select("sym", "t", "share"), {"share": 6})


@query(f"""{EVENT_BARS_SQL}, u AS (SELECT sym, t, close, 1 AS src FROM b WHERE t < 1705968000 UNION ALL SELECT sym, t, close * 2, 2 FROM b WHERE t >= 1705622400),
m AS (SELECT sym, t, last(close ORDER BY src) AS close FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY t DESC) AS rd FROM m)
SELECT sym, t, round(close, 6) AS close FROM r WHERE rd <= 140""")
def hourly_store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    old = bars.where("t < 1705968000").select("sym", "t", "close", F.lit(1).alias("src"))
    new = bars.where("t >= 1705622400").select("sym", "t", (F.col("close") * 2).alias("close"), F.lit(2).alias("src"))
    merged = B.latest(old.unionByName(new), ["sym", "t"], F.col("src"))
    return rounded(B.keep_last(merged, 140).select("sym", "t", "close"), {"close": 6})


@query(f"""{TRADE_BARS_SQL}, l AS (SELECT sym, sum(q) AS vol, last(close ORDER BY t) AS px, last(close ORDER BY t) / first(open ORDER BY t) - 1 AS chg FROM b GROUP BY 1),
f AS (SELECT *, sym IN ('JAPAN', 'PERU') AS pin FROM l WHERE vol > 0 AND chg > -0.9)
SELECT sym, round(vol, 2) AS vol, round(px, 6) AS px, round(chg, 6) AS chg, pin, row_number() OVER (ORDER BY pin DESC, chg DESC, sym) AS place FROM f""")
def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = trade_bars(spark, sf_dir).groupBy("sym").agg(F.sum("q").alias("vol"), F.max_by("close", "t").alias("px"), (F.max_by("close", "t") / F.min_by("open", "t") - 1).alias("chg"))
    found = B.screen(last, (F.col("vol") > 0) & (F.col("chg") > -0.9), F.col("chg"), ["JAPAN", "PERU"])
    return rounded(found.select("sym", "vol", "px", "chg", "pin", F.col("place").cast("long").alias("place")), {"vol": 2, "px": 6, "chg": 6})


@query("""WITH x AS (SELECT c_custkey AS id, c_mktsegment AS base, c_acctbal AS vol FROM customer)
SELECT base, arg_max(id, vol) AS id, round(max(vol), 4) AS vol FROM x GROUP BY base""")
def most_liquid_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps the most liquid member of each base; ties go to the smaller id."""
    from ..sources.tables import table

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("base"), F.col("c_acctbal").alias("vol"))
    best = rows.groupBy("base").agg(F.max_by("id", F.struct("vol", -F.col("id"))).alias("id"), F.max("vol").alias("vol"))
    return rounded(best, {"vol": 4})


@query("""SELECT n_nationkey AS id, n_name AS name, starts_with(n_name, 'I') AS prefix FROM nation WHERE contains(n_name, 'I') ORDER BY prefix DESC, n_name LIMIT 30""")
def instrument_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search, prefix matches first, at most 30: the limit is the feature."""
    from ..sources.tables import table

    rows = table(spark, sf_dir, "nation").where(F.col("n_name").contains("I"))
    return rows.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_name").startswith("I").alias("prefix")).orderBy(F.desc("prefix"), "name").limit(30)
