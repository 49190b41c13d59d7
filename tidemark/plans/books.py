"""Queries on books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arms as A
from ..operators import books as B
from ..registry import query
from ..sources.tables import ticks
from .bars import rounded


def book_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten books by user, over the symbols of the events; every third user's tick is an edge."""
    rows = ticks(spark, sf_dir).where("px > 0")
    return rows.select(F.concat(F.lit("b"), (F.col("user") % 10).cast("string")).alias("book"), F.col("ts").alias("t"), "seq", "sym", "px", (F.col("seq") % 3 == 0).alias("edge"))


@query()
def paper_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy fold has no plain SQL; a test holds it against a loop over all ticks."""
    return rounded(B.ledger(book_ticks(spark, sf_dir), B.Rules(fill_within=86400)), {"px": 6, "pnl": 8, "equity": 8})


@query()
def paper_blotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.blotter(B.ledger(book_ticks(spark, sf_dir), B.Rules(fill_within=86400))), {"closed": 6, "pnl": 8})


def arm_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of a quarter of an hour, of ten books by user; entries are disabled on every seventh day."""
    rows = book_ticks(spark, sf_dir)
    return rows.select("book", (F.col("t") - F.col("t") % 900).alias("t"), "seq", "sym", (100 + F.col("px") / 5).alias("px"), "edge", (F.floor(F.col("t") / 86400) % 7 > 0).alias("enabled"))


@query()
def paper_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of the arms A, B, C and of the confirmed one; a greedy fold has no plain SQL, a test holds it against a loop."""
    return rounded(A.arms(arm_sweeps(spark, sf_dir), A.Settings(fill_within=86400)), {"px": 6, "part": 6, "pnl": 6, "equity": 6})


@query()
def arm_blotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an open and one a fill, of all arms, as a CSV export has them."""
    return rounded(A.blotter_lines(A.arms(arm_sweeps(spark, sf_dir), A.Settings(fill_within=86400))), {"entry": 6, "px": 6, "part": 6, "pnl": 6})


def portfolio_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten portfolios by user: even ticks ask to enter, with the next slot's open for most of them, odd ones settle their symbol."""
    rows = ticks(spark, sf_dir).where("px > 0")
    slot = F.ceil(F.col("ts") / 900) * 900
    return rows.select(
        F.concat(F.lit("b"), (F.col("user") % 10).cast("string")).alias("book"), F.col("ts").alias("t"), "seq", "sym", F.when(F.col("seq") % 2 == 0, "enter").otherwise("settle").alias("kind"),
        F.when(F.col("seq") % 7 > 0, slot).alias("bar_t"), "px", (F.least(F.col("px"), F.lit(150.0)) / 500 - 0.15).alias("net"),
    )


@query()
def portfolio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request and settlement with its outcome under the limits; a greedy fold has no plain SQL, a test holds it against a loop."""
    return rounded(B.portfolios(portfolio_inputs(spark, sf_dir)), {"amount": 6, "equity": 6})


@query("""SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(value - 50), 4) AS total, round(avg(value - 50), 6) AS mean FROM events GROUP BY 1, 2""")
def daily_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select(F.col("ts").alias("since"), F.when(F.col("user") % 2 == 0, "long").otherwise("short").alias("side"), (F.col("px") - 50).alias("net"))
    return rounded(B.daily_sides(rows), {"win_rate": 6, "total": 4, "mean": 6})


@query("""SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS t, last(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2""")
def equity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve with one point a bucket: the last value counts."""
    rows = ticks(spark, sf_dir).withColumn("t", F.col("ts") - F.col("ts") % 3600)
    return rows.groupBy("sym", "t").agg(F.max_by("px", F.struct("ts", "seq")).alias("v"))
