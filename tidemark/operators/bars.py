"""Bars: building, position and clock resampling, forward fill, validation, profiles, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def by_time():
    return Window.partitionBy("sym").orderBy("t")


def from_ticks(ticks: DataFrame, width: int) -> DataFrame:
    """Bars (sym, t, open, high, low, close, q, tq, n) of `width` seconds from (sym, ts, seq, px, q, taker).

    One hash aggregation with partial sums; first and last are by (ts, seq, px), so input order doesn't matter.
    """
    at = F.struct("ts", "seq", "px")
    return ticks.groupBy("sym", (F.col("ts") - F.col("ts") % width).alias("t")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("q").alias("q"), F.sum(F.when(F.col("taker"), F.col("q")).otherwise(0.0)).alias("tq"), F.count("*").alias("n"),
    )


def _merged(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.groupBy(*keys).agg(
        F.min("t").alias("t"), F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"),
        F.sum("q").alias("q"), F.when(F.count("tq") == F.count("*"), F.sum("tq")).alias("tq"), F.count("*").alias("n"),
    )


def rollup_positions(bars: DataFrame, by: int) -> DataFrame:
    """Every `by` bars in order make one, the last may be short; taker volume only if all children have it; `up` by the new bar's colour."""
    groups = bars.withColumn("g", F.floor((F.row_number().over(by_time()) - 1) / by))
    return _merged(groups, ["sym", "g"]).drop("g").withColumn("up", F.col("close") >= F.col("open"))


def rollup_clock(bars: DataFrame, width: int, children: int, now: int | None = None, strict: bool = True) -> DataFrame:
    """Clock-aligned bars of exactly `children` distinct children; equal duplicates count once, conflicting ones reject the bar.

    Bars that close after `now` and bars with impossible prices are dropped.
    """
    rows = bars.dropDuplicates(["sym", "t", "open", "high", "low", "close", "q"]).withColumn("g", F.col("t") - F.col("t") % width)
    if strict:
        good = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
        rows = rows.withColumn("good", good)
    else:
        rows = rows.withColumn("good", F.lit(True))
    out = rows.groupBy("sym", "g").agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("q").alias("q"),
        F.count("*").alias("n"), F.count_distinct("t").alias("k"), F.bool_and("good").alias("good"),
    )
    out = out.where((F.col("n") == children) & (F.col("k") == children) & F.col("good"))
    if now is not None:
        out = out.where(F.col("g") + width <= now)
    return out.select("sym", F.col("g").alias("t"), "open", "high", "low", "close", "q")


def forward_fill(grid: DataFrame, points: DataFrame) -> DataFrame:
    """grid (sym, t), points (sym, t, v): last value at or before t; before the first point the first value; 0 without any point."""
    rows = grid.select("sym", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")).unionByName(points.select("sym", "t", "v", F.lit(0).alias("side")))
    first = points.groupBy("sym").agg(F.min_by("v", "t").alias("v0"))
    rows = scan.running(rows.withColumnRenamed("v", "x"), ["sym"], ["t", "side"], {"v": ("last", F.col("x"))}).where("side = 1")
    return rows.join(first, "sym", "left").select("sym", "t", F.coalesce("v", "v0", F.lit(0.0)).alias("v"))


def attach_nearest(bars: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points go to the bar of the nearest index (half up), the last one wins; then forward fill, null before the first."""
    at = points.withColumn("t", F.floor(F.col("ts") / width + 0.5).cast("long") * width).groupBy("sym", "t").agg(F.max_by("v", F.struct("ts", "seq")).alias("v"))
    rows = bars.join(at.withColumnRenamed("v", "__x"), ["sym", "t"], "left")
    return scan.running(rows, ["sym"], ["t"], {"v": ("last", F.col("__x"))}).drop("__x")


def sparkline(bars: DataFrame, last: int = 289, every: int = 6, digits: int = 5) -> DataFrame:
    """(sym, points): of the last bars every sixth close, plus the last close if it differs; rounded to significant digits."""
    newest = Window.partitionBy("sym").orderBy(F.desc("t"))
    rows = bars.withColumn("rd", F.row_number().over(newest)).where(F.col("rd") <= last)
    n = F.count("*").over(Window.partitionBy("sym"))
    rows = rows.withColumn("i", n - F.col("rd"))
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs("close"))))
    value = F.when(F.col("close") == 0, 0.0).otherwise(F.round(F.col("close") * scale) / scale)
    rows = rows.withColumn("x", value).where((F.col("i") % every == 0) | (F.col("rd") == 1))
    before = F.lag("x").over(Window.partitionBy("sym").orderBy("i"))
    rows = rows.withColumn("same", (F.col("i") % every != 0) & (F.col("x") == before)).where("not same")
    return rows.groupBy("sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("points"))


def gap_profile(bars: DataFrame, step: int) -> DataFrame:
    """(sym, rows, first_t, last_t, gaps, q): gaps counts missing steps."""
    dt = F.col("t") - F.lag("t").over(by_time())
    missing = F.when(dt > step, F.greatest(F.lit(1), F.floor(dt / step + 0.5) - 1)).otherwise(0)
    return bars.withColumn("missing", missing).groupBy("sym").agg(
        F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("missing").cast("long").alias("gaps"), F.sum("q").alias("q")
    )


def validated(bars: DataFrame, step: int) -> DataFrame:
    """Adds `reject`: invalid prices first, then a gap to the bar before, else null."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    valid = (o > 0) & (h > 0) & (low > 0) & (c > 0) & (low <= F.least(o, c)) & (h >= F.greatest(o, c))
    gap = F.col("t") - F.lag("t").over(by_time()) != step
    return bars.withColumn("reject", F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(gap, "gap"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write wins: of the rows of a key, the one of the greatest order."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*keys, "r.*")


def keep_last(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("rd", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("t")))).where(F.col("rd") <= n).drop("rd")


def completed_share(bars: DataFrame, n: int, step: int) -> DataFrame:
    """Taker share over the n bars up to each, null unless they are contiguous and all taker volumes are known."""
    w = by_time().rowsBetween(-(n - 1), 0)
    whole = (F.count("*").over(w) == n) & (F.count("tq").over(w) == n) & (F.col("t") - F.min("t").over(w) == (n - 1) * step)
    return bars.withColumn("share", F.when(whole, F.try_divide(F.sum("tq").over(w), F.sum("q").over(w))))


def screen(rows: DataFrame, where: Column, key: Column, pinned: list[str], descending: bool = True) -> DataFrame:
    """Rows that pass, pinned symbols first, then by key; ties by symbol. `place` is the position from 1."""
    order = [F.desc("pin"), key.desc_nulls_last() if descending else key.asc_nulls_last(), F.asc("sym")]
    rows = rows.where(where).withColumn("pin", F.col("sym").isin(pinned))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
