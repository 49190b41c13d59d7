"""Queries that run streams over what is there now and read their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, ticks
from ..streaming import processors as P
from ..streaming import watches as V
from ..streaming.timed import state_store
from .bars import rounded


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tick_stream(spark, f"{sf_dir}/events.parquet")


@query(f"{EVENT_BARS_SQL} SELECT sym, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(q, 4) AS q, n FROM b")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.drain(P.hourly_bars(_stream(spark, sf_dir)), "update", ["sym", "t"]), {"open": 6, "high": 6, "low": 6, "close": 6, "q": 4})


@query("""WITH RECURSIVE e AS (SELECT DISTINCT event_type AS sym, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE value > 80), s AS (SELECT sym, min(ts) AS ts FROM e GROUP BY 1),
k AS (SELECT sym, ts FROM s UNION ALL SELECT sym, ts FROM (SELECT e.sym, e.ts, row_number() OVER (PARTITION BY e.sym, k.ts ORDER BY e.ts) AS rn FROM k JOIN e ON e.sym = k.sym AND e.ts >= k.ts + 21600) WHERE rn = 1) SELECT sym, ts FROM k""")
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cooldown(_stream(spark, sf_dir).where("px > 80"), 6 * 3600)


def watch_inputs(rows: DataFrame) -> DataFrame:
    """Ticks as inputs of entry watches: pushes and deliveries by user, all others as bars around their price."""
    kind = F.when(F.col("user") % 13 == 0, "push").when(F.col("user") % 13 == 1, "sending").when(F.col("user") % 13 == 2, "failed").when(F.col("user") % 13 == 3, "delivered").otherwise("bar")
    return rows.select(
        "sym", "ts", "seq", kind.alias("kind"), "px", (F.col("px") * 1.02).alias("high"), (F.col("px") * 0.98).alias("low"), (F.col("px") * 0.9).alias("support"), (F.col("px") * 0.6).alias("atr"),
        F.col("seq").alias("source"), (F.col("ts") + 900).alias("retry"),
    )


def deep_inputs(rows: DataFrame) -> DataFrame:
    """Ticks as inputs of deep watches: every eleventh user's as setups; an observation is absent, stale or fresh by the tick's number."""
    known = F.col("seq") % 4 > 0
    return rows.select(
        "sym", "ts", "seq", F.when(F.col("user") % 11 == 0, "setup").otherwise("bar").alias("kind"), "px", (F.col("px") * 1.02).alias("high"), (F.col("px") * 0.3).alias("trough"), F.col("px").alias("level"), (F.col("px") * 0.8).alias("atr"),
        F.when(known, (F.col("seq") % 7 * 150 - 60).cast("double")).alias("age"), F.when(known, F.col("px") - 5).alias("change1h"), (F.col("seq") % 9).cast("double").alias("change4h"),
    )


@query()
def stream_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed state machine has no plain SQL; a test holds it against a loop over all ticks."""
    with state_store(spark):
        return P.drain(V.entry_watches(watch_inputs(_stream(spark, sf_dir)), 6 * 3600), "append")


@query()
def stream_deep_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_watches, over setups and bars with and without observations."""
    with state_store(spark):
        return P.drain(V.deep_watches(deep_inputs(_stream(spark, sf_dir)), 6 * 3600), "append")


@query("""WITH s AS (SELECT event_id AS id, event_id - 2 AS source, CAST(floor(epoch(ts)) AS BIGINT) AS since, value - 5 AS px, value * 0.9 AS support, value - 20 AS atr, CASE user_id % 5 WHEN 0 THEN 'watching' WHEN 1 THEN 'ready' WHEN 2 THEN 'sending' WHEN 3 THEN 'expired' END AS status,
CASE WHEN user_id % 7 = 0 THEN -1 ELSE CAST(floor(epoch(ts)) AS BIGINT) + user_id * 900 - 900 END AS last, CASE WHEN user_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 60 ELSE -1 END AS retry FROM events)
SELECT id, coalesce(source >= 0 AND px > 0 AND support > 0 AND atr > 0 AND atr < support AND status IN ('watching', 'ready', 'sending') AND since > 0 AND (last = -1 OR (last > since AND last < since + 86400)) AND (retry = -1 OR (retry > since AND status = 'ready')), false) AS valid FROM s""")
def watch_states_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored watches, each judged by itself before it is taken up again."""
    v, user, since = F.col("px"), F.col("user"), F.col("ts")
    status = F.when(user % 5 == 0, "watching").when(user % 5 == 1, "ready").when(user % 5 == 2, "sending").when(user % 5 == 3, "expired")
    last = F.when(user % 7 == 0, -1).otherwise(since + user * 900 - 900)
    retry = F.when(user % 3 == 0, since + 60).otherwise(-1)
    return ticks(spark, sf_dir).select(F.col("seq").alias("id"), V.valid(F.col("seq") - 2, since, v - 5, v * 0.9, v - 20, status, last, retry).alias("valid"))


@query("""WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) SELECT ts - ts % 900 AS slot, count(*) AS n FROM e GROUP BY 1 HAVING slot + 900 <= (SELECT max(ts) FROM e) - 3600""")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed slots: those whose end the watermark, an hour behind the newest tick, has passed."""
    return P.drain(P.slot_counts(_stream(spark, sf_dir)), "append")


@query()
def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with cooldown and retry; a test holds it against a loop over all ticks."""
    rows = _stream(spark, sf_dir).withColumn("on", F.col("px") > 40).withColumn("delivered", F.col("user") % 4 != 0)
    return P.notifications(rows, 4 * 3600)


@query("""SELECT DISTINCT concat(event_type, ':', CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS id, event_type AS sym FROM events""")
def stream_shadow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("id", F.concat("sym", F.lit(":"), F.floor(F.col("ts") / 3600).cast("string")))
    return P.drain(P.shadow_candidates(rows), "append").select("id", "sym")
