"""Readers: tables of a folder, and the series that stand for market feeds in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp without zone since 1970, whatever the session's zone."""
    return F.unix_seconds(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, ts seconds, seq, px, user): events as ticks, one symbol an event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sym"), epoch(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("px"), F.col("user_id").alias("user")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, ts, seq, px, q, taker): line items as trades, one symbol a nation, price by quantity; suppliers are a dimension."""
    line, supplier, nation = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    where = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("sym"))
    return line.join(where, line["l_suppkey"] == where["s_suppkey"]).select(
        "sym", epoch(F.col("l_shipdate")).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_extendedprice").alias("q"), (F.col("l_returnflag") == "A").alias("taker"),
    )


def event_bars(spark: SparkSession, sf_dir: str, width: int = 3600) -> DataFrame:
    from ..operators.bars import from_ticks

    rows = ticks(spark, sf_dir).withColumn("q", F.col("px")).withColumn("taker", F.col("user") % 2 == 0)
    return from_ticks(rows, width)


def trade_bars(spark: SparkSession, sf_dir: str, width: int = 86400) -> DataFrame:
    from ..operators.bars import from_ticks

    return from_ticks(trades(spark, sf_dir), width)


#: The same bars in DuckDB, as common table expressions b and tb to start a query with.
EVENT_BARS_SQL = """WITH RECURSIVE ev AS (
  SELECT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, value AS px, user_id AS u FROM events
), b AS (
  SELECT sym, ts - ts % 3600 AS t, first(px ORDER BY ts, seq) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, seq) AS close,
         sum(px) AS q, sum(CASE WHEN u % 2 = 0 THEN px ELSE 0 END) AS tq, count(*) AS n
  FROM ev GROUP BY 1, 2
)"""
TRADE_BARS_SQL = """WITH RECURSIVE tr AS (
  SELECT n_name AS sym, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS px,
         l_extendedprice AS q, l_returnflag = 'A' AS taker
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), b AS (
  SELECT sym, ts - ts % 86400 AS t, first(px ORDER BY ts, seq, px) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, seq, px) AS close,
         sum(q) AS q, sum(CASE WHEN taker THEN q ELSE 0 END) AS tq, count(*) AS n
  FROM tr GROUP BY 1, 2
)"""
