"""Event logs: tolerant line parsing, versioned positional rows, deduplication, time-range serving, and the lines' writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of a positional scan row by position; rows of older versions are shorter.
SCAN_COLUMNS = [
    "sym", "price", "oi_usd", "funding", "vol_z", "strength", "regime", "fb", "ea", "vol24h", "change24h", "ret4h", "pos", "buy_share4h", "f8h", "bb_pctile", "ls_drop_pct", "rs_pct",
    "oi_drop_pct", "spot_vol24h", "basis_pct", "oi4h", "change1h", "f24h", "early_pump", "oi_qty", "oi_qty1h", "oi_qty4h", "taker_share4h", "spot_taker_share4h",
]
_TEXT = {"sym", "regime"}
MAX_DAYS = {"recordings": 92, "events": 31}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, no): lines of text files; `no` orders lines within a file."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("no"))
    return rows.where("trim(line) <> ''")


def scan_rows(lines: DataFrame, source: str | None = None) -> DataFrame:
    """(slot, ts, source, place, columns ...) from JSON lines {v, ts, slot, source, coins: [[...]]}.

    Malformed lines and lines with a type are skipped; of one slot and source the last line counts; values a row is too short for are null.
    A cheap substring test stands before the parser. `lines` has (line, no).
    """
    schema = "v int, ts long, slot long, source string, type string, coins array<array<string>>"
    rows = lines.where(F.col("line").contains('"coins"')).select(F.from_json("line", schema).alias("j"), "no").select("j.*", "no")
    rows = rows.where("slot is not null and type is null and coins is not null")
    if source is not None:
        rows = rows.where(F.col("source") == source)
    last = rows.groupBy("slot", "source").agg(F.max_by(F.struct("ts", "coins"), "no").alias("r"))
    coins = last.select("slot", "r.ts", "source", F.posexplode("r.coins").alias("place", "c"))
    typed = [F.get("c", i).alias(n) if n in _TEXT else F.expr(f"try_cast(get(c, {i}) AS DOUBLE)").alias(n) for i, n in enumerate(SCAN_COLUMNS)]
    return coins.select("slot", "ts", "source", "place", *typed).where("sym is not null")


def newest_source(rows: DataFrame) -> DataFrame:
    """Rows of the source that recorded last: outcomes must not cross from one venue to another."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("last"), "source")
    last = rows.groupBy("source").agg(F.max("slot").alias("last")).withColumn("k", F.row_number().over(w)).where("k = 1").select("source")
    return rows.join(F.broadcast(last), "source", "left_semi")  # one row


def scan_lines(rows: DataFrame, version: int = 7) -> DataFrame:
    """(slot, line): the writer of scan_rows; prices to 8 digits, other numbers to 4."""
    value = lambda n: F.col(n) if n in _TEXT else F.round(F.col(n), 8 if n == "price" else 4).cast("string")
    row = F.struct("place", F.array(*[value(n) for n in SCAN_COLUMNS]).alias("c"))
    out = rows.groupBy("slot", "source").agg(F.max("ts").alias("ts"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("coins"))
    return out.select("slot", F.to_json(F.struct(F.lit(version).alias("v"), "ts", "slot", "source", "coins")).alias("line"))


def flag_maps(rows: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """(slot, one sparse map a name): symbol -> its flags as 0 or 1, only where any is set."""
    aggregates = []
    for name, columns in flags.items():
        any_set = F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in columns])
        entry = F.struct("sym", F.array(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c in columns]))
        aggregates.append(F.map_from_entries(F.array_sort(F.collect_list(F.when(any_set, entry)))).alias(name))
    return rows.groupBy("slot").agg(*aggregates)


def notifications(lines: DataFrame) -> DataFrame:
    """Delivered notifications (id, sym, cls, px, v, at) with proof of delivery; of one id the highest v counts, of equal v the first line."""
    schema = "type string, v int, id string, messageId string, sym string, symbol string, cls string, px double, price double, ts long, deliveredAt long, delivered boolean"
    rows = lines.where(F.col("line").contains("notify")).select(F.from_json("line", schema).alias("j"), "no").select("j.*", "no").where("type = 'notify'")
    rows = rows.select(F.coalesce("messageId", "id").alias("id"), F.upper(F.coalesce("sym", "symbol")).alias("sym"), "cls", F.coalesce("px", "price").alias("px"), "v", F.coalesce("deliveredAt", "ts").alias("sent"), "delivered", "no")
    rows = rows.where("id is not null and sym is not null and px > 0 and sent is not null and coalesce(delivered, true)")
    best = rows.groupBy("id").agg(F.max_by(F.struct("sym", "cls", "px", "v", "sent"), F.struct(F.coalesce("v", F.lit(0)), -F.col("no"))).alias("r"))
    return best.select("id", "r.*")


def merged_watches(events: DataFrame, columns: list[str], key: str = "watch", order: str = "no", active: DataFrame | None = None) -> DataFrame:
    """Delta merge: per watch the last known value of every column, in log order. `active` holds states that are on now: what they know
    counts after any event, and a watch that no event names is there too; they are not counted as events."""
    if active is not None:
        now = active.select(key, *columns, F.lit(True).alias("__now"))
        rank = F.struct(F.coalesce("__now", F.lit(False)).alias("now"), F.col(order).alias("no"))
        events = events.unionByName(now, allowMissingColumns=True).withColumn("__rank", rank)
        known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in columns]
        return events.groupBy(key).agg(*known, F.count_if(F.col("__now").isNull()).alias("events"))
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return events.groupBy(key).agg(*known, F.count("*").alias("events"))


def watched_pushes(pushes: DataFrame, watches: DataFrame, within: int = 60) -> DataFrame:
    """One row a symbol of pushes (id, sym, cls, ts, px): how many, their classes, the push it stands for, and its watch, or null.

    watches: watch, sym, source, cls, push_ts, status. A watch of one of the symbol's pushes comes first, the smallest of several, and its
    push is the row's; else the latest push takes the smallest watch without a source, of its class or none, pushed within `within` seconds.
    """
    push = F.struct("ts", "id", "px", "cls")
    rows = pushes.groupBy("sym").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"), F.max(push).alias("latest"))
    owned = watches.join(pushes.select("sym", F.col("id").alias("source"), push.alias("push")), ["sym", "source"]).groupBy("sym").agg(F.min(F.struct("watch", "status", "push")).alias("own"))
    w = watches.where("source is null").select("sym", F.col("cls").alias("wcls"), "push_ts", "watch", "status")
    near = rows.select("sym", "latest").join(w, "sym").where((F.col("wcls").isNull() | (F.col("wcls") == F.col("latest.cls"))) & (F.abs(F.col("push_ts") - F.col("latest.ts")) < within))
    near = near.groupBy("sym").agg(F.min(F.struct("watch", "status")).alias("by"))
    out = rows.join(owned, "sym", "left").join(near, "sym", "left")
    chosen = F.coalesce("own.push", "latest")
    return out.select("sym", "n", "classes", chosen["id"].alias("id"), chosen["ts"].alias("ts"), chosen["px"].alias("px"), F.coalesce("own.watch", "by.watch").alias("watch"), F.coalesce("own.status", "by.status").alias("status"))


def serve(rows: DataFrame, first_day: int, last_day: int, kind: str = "recordings", day: str = "day") -> DataFrame:
    """Rows of a range of days, by the partition column; ranges that are reversed or too long are refused."""
    if last_day < first_day or last_day - first_day + 1 > MAX_DAYS[kind]:
        raise ValueError(f"{kind}: at most {MAX_DAYS[kind]} days, in order")
    return rows.where(F.col(day).between(first_day, last_day))


def append(rows: DataFrame, path: str, day: Column) -> None:
    """Appends lines under their UTC day."""
    rows.withColumn("day", day).write.partitionBy("day").mode("append").text(path)


def klines(spark: SparkSession, path: str, mult: float = 1.0) -> DataFrame:
    """Archive bars from CSV: (t, open, high, low, close, q, tq) by columns 0-4, 7 and 10; microseconds and milliseconds; the last file counts per t."""
    rows = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(12))).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("no"))
    number = lambda i: F.expr(f"try_cast(c{i} AS DOUBLE)")
    from ..functions.scalars import seconds_of

    rows = rows.select(seconds_of(number(0)).alias("t"), *[(number(i) / mult).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"))], number(7).alias("q"), number(10).alias("tq"), "file", "no")
    rows = rows.where("t is not null and open > 0 and high > 0 and low > 0 and close > 0")
    last = rows.groupBy("t").agg(F.max_by(F.struct("open", "high", "low", "close", "q", "tq"), F.struct("file", "no")).alias("r"))
    return last.select("t", "r.*")


def _csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    return spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(width))).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("no"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Archive metrics from CSV: (sym, t, qty, usd, top_accounts, top_positions, ratio, taker_ratio); both sizes above 0; the last row counts."""
    number = lambda i: F.expr(f"try_cast(c{i} AS DOUBLE)")
    names = ["qty", "usd", "top_accounts", "top_positions", "ratio", "taker_ratio"]
    t = F.unix_seconds(F.expr("try_cast(c0 AS TIMESTAMP)"))
    rows = _csv(spark, path, 8).select(F.col("c1").alias("sym"), t.alias("t"), *[number(i).alias(n) for i, n in enumerate(names, 2)], "file", "no").where("t is not null and qty > 0 and usd > 0")
    return rows.groupBy("sym", "t").agg(F.max_by(F.struct(*names), F.struct("file", "no")).alias("r")).select("sym", "t", "r.*")


def funding(spark: SparkSession, path: str) -> DataFrame:
    """Archive funding from CSV: (t, rate) by columns 0 and 2; the last row of a time counts."""
    from ..functions.scalars import seconds_of

    rows = _csv(spark, path, 3).select(seconds_of(F.expr("try_cast(c0 AS DOUBLE)")).alias("t"), F.expr("try_cast(c2 AS DOUBLE)").alias("rate"), "file", "no").where("t is not null and rate is not null")
    return rows.groupBy("t").agg(F.max_by("rate", F.struct("file", "no")).alias("rate"))


def strategies(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (id, strategy, sym, ts) and outcomes (id, net) of a strategy log, told apart by `type`; unknown versions are skipped."""
    schema = "type string, v int, id string, strategy string, sym string, ts long, net double"
    rows = lines.where(F.col("line").contains("strategy_")).select(F.from_json("line", schema).alias("j")).select("j.*").where("v >= 1 and id is not null")
    return rows.where("type = 'strategy_candidate'").select("id", "strategy", "sym", "ts"), rows.where("type = 'strategy_outcome'").select("id", "net")


def verified(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(path, length, ok): files whose SHA-256 is the catalog's (name, sha256); unknown files are not ok."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("own"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(catalog, "name", "left").select("name", "length", F.coalesce(F.col("own") == F.col("sha256"), F.lit(False)).alias("ok"))
