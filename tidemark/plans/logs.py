"""Queries on logs: the events table serves as a log, its rows written as lines and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import logs as L
from ..sources.tables import epoch, table
from .bars import rounded


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("s", epoch(F.col("ts"))).withColumn("slot", F.floor(F.col("s") / 900).cast("long"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scan lines (line, no): one line a slot and parity of users, with rows of three columns, and some lines that don't count."""
    e = _events(spark, sf_dir).withColumn("source", F.when(F.col("user_id") % 2 == 0, "okx").otherwise("binance"))
    row = F.struct("event_id", F.array(F.concat(F.upper("event_type"), F.col("event_id").cast("string")), F.round("value", 4).cast("string"), F.col("user_id").cast("string")).alias("c"))
    good = e.groupBy("slot", "source").agg(F.max("s").alias("ts"), F.max("event_id").alias("no"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("coins"))
    lines = good.select(F.to_json(F.struct(F.lit(1).alias("v"), (F.col("ts") * 1000).alias("ts"), "slot", "source", "coins")).alias("line"), "no")
    # an older line of the same slot, a typed line and a broken one
    old = good.where("slot % 5 = 0").select(F.to_json(F.struct(F.lit(1).alias("v"), (F.col("ts") * 1000).alias("ts"), "slot", "source", F.array(F.array(F.lit("OLD"))).alias("coins"))).alias("line"), (F.col("no") - 1000000).alias("no"))
    typed = good.where("slot % 7 = 0").select(F.to_json(F.struct(F.lit("liq").alias("type"), "slot", "source", "coins")).alias("line"), (F.col("no") + 1000000).alias("no"))
    broken = good.where("slot % 9 = 0").select(F.lit('{"slot": 1, "coins": [[').alias("line"), (F.col("no") + 2000000).alias("no"))
    return lines.union(old).union(typed).union(broken)


@query("""SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, CASE WHEN user_id % 2 = 0 THEN 'okx' ELSE 'binance' END AS source, concat(upper(event_type), event_id) AS sym, round(value, 4) AS price, CAST(user_id AS DOUBLE) AS oi_usd, CAST(NULL AS DOUBLE) AS funding FROM events""")
def jsonl_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_rows(scan_log(spark, sf_dir)).select("slot", "source", "sym", "price", "oi_usd", "funding")


@query("""SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, count(*) AS n FROM events WHERE user_id % 2 = (SELECT user_id % 2 FROM events ORDER BY floor(epoch(ts) / 900) DESC, CASE WHEN user_id % 2 = 0 THEN 'okx' ELSE 'binance' END LIMIT 1) GROUP BY 1""")
def newest_venue_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest_source(L.scan_rows(scan_log(spark, sf_dir)).select("slot", "source", "sym")).groupBy("slot").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT concat('m', event_id % 500) AS id, upper(event_type) AS sym, round(value, 6) AS px, CAST(user_id % 3 AS INTEGER) AS v, event_id AS no FROM events WHERE value > 0 AND user_id % 4 <> 0)
SELECT id, first(sym ORDER BY v DESC, no) AS sym, first(px ORDER BY v DESC, no) AS px, first(v ORDER BY v DESC, no) AS v FROM n GROUP BY id""")
def notify_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    body = F.struct(F.lit("notify").alias("type"), (F.col("user_id") % 3).alias("v"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("m"), (F.col("event_id") % 500).cast("string"))).alias("messageId"), F.col("event_type").alias("symbol"), F.round("value", 6).alias("price"), F.col("s").alias("ts"))
    return rounded(L.notifications(e.select(F.to_json(body).alias("line"), F.col("event_id").alias("no"))).select("id", "sym", "px", "v"), {"px": 6})


@query("""SELECT user_id AS watch, last(value ORDER BY event_id) FILTER (event_type = 'view') AS px, last(event_type ORDER BY event_id) AS status, count(*) AS events FROM events GROUP BY 1""")
def watch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("watch"), F.when(F.col("event_type") == "view", F.col("value")).alias("px"), F.col("event_type").alias("status"), F.col("event_id").alias("no"))
    return L.merged_watches(e, ["px", "status"])


@query("""WITH m AS (SELECT user_id AS watch, last(value ORDER BY event_id) FILTER (event_type = 'view') AS px, last(event_type ORDER BY event_id) AS status, count(*) AS events FROM events GROUP BY 1),
a AS (SELECT c_custkey AS watch, CASE WHEN c_nationkey < 12 THEN round(c_acctbal, 2) END AS px, c_mktsegment AS status FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(m.watch, a.watch) AS watch, coalesce(a.px, m.px) AS px, coalesce(a.status, m.status) AS status, coalesce(events, 0) AS events FROM m FULL JOIN a ON a.watch = m.watch""")
def watch_merge_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged as in watch_merge, then the states that are on now over them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("watch"), F.when(F.col("event_type") == "view", F.col("value")).alias("px"), F.col("event_type").alias("status"), F.col("event_id").alias("no"))
    now = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("watch"), F.when(F.col("c_nationkey") < 12, F.round("c_acctbal", 2)).alias("px"), F.col("c_mktsegment").alias("status"))
    return L.merged_watches(e, ["px", "status"], active=now)


@query("""SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot, count(DISTINCT CASE WHEN value > 30 OR user_id % 5 = 0 THEN event_type END) AS n, max(CASE WHEN event_type = 'click' AND (value > 30 OR user_id % 5 = 0) THEN 1 ELSE 0 END) AS click FROM events GROUP BY 1""")
def sparse_flag_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("slot", F.col("event_type").alias("sym")).agg(F.max(F.col("value") > 30).alias("big"), F.max(F.col("user_id") % 5 == 0).alias("fifth"))
    maps = L.flag_maps(rows, {"signals": ["big", "fifth"]})
    return maps.select("slot", F.size("signals").cast("long").alias("n"), F.map_contains_key("signals", "click").cast("int").alias("click"))


@query("""SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase' AND floor(epoch(ts) / 86400) BETWEEN 19724 AND 19740""")
def served_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.floor(F.col("s") / 86400).cast("long").alias("day"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return L.serve(rows, 19724, 19740, "events")


@query("""WITH p AS (SELECT event_id AS id, concat(event_type, user_id % 40) AS sym, CAST(user_id % 3 AS VARCHAR) AS cls, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value AS px FROM events WHERE floor(epoch(ts)) >= 1704672000),
w AS (SELECT max(event_id) AS watch, concat(event_type, user_id % 40) AS sym, CASE WHEN user_id % 3 < 2 THEN CAST(user_id % 3 AS VARCHAR) END AS cls, CASE WHEN user_id % 40 < 20 THEN max(event_id) END AS source, CAST(floor(max(epoch(ts))) AS BIGINT) + 30 AS push_ts, CASE user_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'waiting' ELSE 'invalid' END AS status FROM events GROUP BY event_type, user_id % 40, user_id % 3),
g AS (SELECT sym, count(*) AS n, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM p GROUP BY 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts DESC, id DESC) AS k FROM p) WHERE k = 1),
o AS (SELECT * FROM (SELECT w.watch, w.status, p.id, p.ts, p.px, p.sym, row_number() OVER (PARTITION BY p.sym ORDER BY w.watch) AS k FROM w JOIN p ON p.sym = w.sym AND p.id = w.source) WHERE k = 1),
y AS (SELECT * FROM (SELECT w.watch, w.status, l.sym, row_number() OVER (PARTITION BY l.sym ORDER BY w.watch) AS k FROM w JOIN l ON l.sym = w.sym AND w.source IS NULL AND (w.cls IS NULL OR w.cls = l.cls) AND abs(push_ts - l.ts) < 60) WHERE k = 1)
SELECT g.sym, g.n, g.classes, coalesce(o.id, l.id) AS id, coalesce(o.ts, l.ts) AS ts, coalesce(o.px, l.px) AS px, coalesce(o.watch, y.watch) AS watch, coalesce(o.status, y.status) AS status FROM g JOIN l USING (sym) LEFT JOIN o USING (sym) LEFT JOIN y USING (sym)""")
def push_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes by symbol with the watch that one of them armed, else one pushed at the time of the latest."""
    e = _events(spark, sf_dir)
    sym, cls = F.concat("event_type", (F.col("user_id") % 40).cast("string")), F.col("user_id") % 3
    pushes = e.where("s >= 1704672000").select(F.col("event_id").alias("id"), sym.alias("sym"), cls.cast("string").alias("cls"), F.col("s").alias("ts"), F.col("value").alias("px"))
    w = e.groupBy(sym.alias("sym"), cls.alias("c"), (F.col("user_id") % 40).alias("u")).agg(F.max("event_id").alias("watch"), (F.max("s") + 30).alias("push_ts"))
    status = F.when(F.col("c") == 0, "ready").when(F.col("c") == 1, "waiting").otherwise("invalid")
    w = w.select("watch", "sym", F.when(F.col("c") < 2, F.col("c").cast("string")).alias("cls"), F.when(F.col("u") < 20, F.col("watch")).alias("source"), "push_ts", status.alias("status"))
    return L.watched_pushes(pushes, w)


@query("""WITH p AS (SELECT event_type AS sym, count(*) AS n, max(event_id) AS last_id, string_agg(DISTINCT CAST(user_id % 3 AS VARCHAR), ',' ORDER BY CAST(user_id % 3 AS VARCHAR)) AS classes FROM events WHERE epoch(ts) >= 1706140800 GROUP BY 1),
px AS (SELECT event_type AS sym, last(value ORDER BY ts, event_id) AS now_px FROM events GROUP BY 1), l AS (SELECT p.*, e.value AS px FROM p JOIN events e ON e.event_id = p.last_id)
SELECT sym, n, classes, round(px, 6) AS px, round(now_px / nullif(px, 0) - 1, 6) AS ret, row_number() OVER (ORDER BY now_px / nullif(px, 0) - 1 DESC NULLS LAST, sym) AS place FROM l JOIN px USING (sym)""")
def push_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent notifications by symbol: latest, count, classes, return since, best first."""
    e = _events(spark, sf_dir)
    recent = e.where("s >= 1706140800").groupBy(F.col("event_type").alias("sym")).agg(F.count("*").alias("n"), F.max_by("value", "event_id").alias("px"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 3).cast("string"))), ",").alias("classes"))
    now = e.groupBy(F.col("event_type").alias("sym")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("now_px"))
    rows = recent.join(now, "sym").withColumn("ret", F.try_divide("now_px", "px") - 1)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ret").desc_nulls_last(), "sym")).cast("long"))
    return rounded(rows.select("sym", "n", "classes", "px", "ret", "place"), {"px": 6, "ret": 6})
