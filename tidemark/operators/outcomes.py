"""Events and what came of them: edges, forward outcomes, execution policies, summaries.

Forward paths of dense bars are ROWS or RANGE frames on the bars' own partitioning. Sparse events meet their horizon by hour buckets of
the horizon's length: an equi-join on two buckets, never a theta join over a symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan, selection


def by_time():
    return Window.partitionBy("sym").orderBy("t")


def rising_edges(rows: DataFrame, on: Column) -> DataFrame:
    """Rows that are on while the symbol was off, or absent, at the previous slot that was recorded for any symbol.

    Slots are few next to rows; their order is found once on the distinct slots.
    """
    slots = rows.select("t").distinct()
    slots = slots.withColumn("prev", F.lag("t").over(Window.partitionBy(F.lit(0)).orderBy("t")))
    state = rows.withColumn("on", F.coalesce(on, F.lit(False)))
    before = state.where("on").select("sym", F.col("t").alias("prev"), F.lit(True).alias("was"))
    return state.where("on").join(slots, "t").join(before, ["sym", "prev"], "left").where("was is null").select(*rows.columns)


def forward(bars: DataFrame, horizon: int) -> DataFrame:
    """Adds mfe, mae and ret of the bars within `horizon` seconds after each, and how many there were; missing bars are skipped."""
    w = by_time().rangeBetween(1, horizon)
    rel = lambda x: F.try_divide(x, F.col("close")) - 1
    return bars.withColumns({
        "mfe": rel(F.max("high").over(w)), "mae": rel(F.min("low").over(w)), "ret": rel(F.last("close").over(w)), "seen": F.count("*").over(w),
    })


def path(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Each event (id, sym, since, ...) with each bar of since < t <= since + horizon, as bar_<column>: joined by buckets of the horizon's length."""
    names = [c for c in bars.columns if c != "sym"]
    b = bars.select("sym", *[F.col(c).alias(f"bar_{c}") for c in names], F.floor(F.col("t") / horizon).alias("__g"))
    first = F.floor(F.col("since") / horizon)
    e = events.withColumn("__g", F.explode(F.array(first, first + 1)))
    return e.join(b, ["sym", "__g"]).where((F.col("bar_t") > F.col("since")) & (F.col("bar_t") <= F.col("since") + horizon)).drop("__g")


def strict(events: DataFrame, bars: DataFrame, width: int, horizon: int, target: float, last_t: int | None = None) -> DataFrame:
    """Status complete, pending or data-missing, partial mfe, first hit. The horizon must be covered bar by bar.

    pending: the horizon reaches past the last slot recorded for any symbol; data-missing: a bar is absent before that.
    """
    newest = bars.agg(F.max("t").alias("__last")) if last_t is None else bars.sparkSession.range(1).select(F.lit(last_t).alias("__last"))
    met = path(events, bars, horizon).groupBy("id").agg(
        F.count("*").alias("n"), F.max("bar_high").alias("top"), F.max_by("bar_close", "bar_t").alias("end"), F.min(F.when(F.col("bar_high") >= F.col("px") * (1 + target), F.col("bar_t"))).alias("hit_t")
    )
    rows = events.join(met, "id", "left").crossJoin(F.broadcast(newest))  # one row
    need = horizon // width
    status = F.when(F.coalesce("n", F.lit(0)) == need, "complete").when(F.col("since") + horizon > F.col("__last"), "pending").otherwise("data-missing")
    return rows.select(*events.columns, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), (F.try_divide("top", "px") - 1).alias("mfe"), F.when(status == "complete", F.try_divide("end", "px") - 1).alias("ret"), "hit_t")


def first_touch(events: DataFrame, bars: DataFrame, horizon: int, targets: tuple[float, ...] = (0.04, 0.08, 0.15), stop: float = -0.03) -> DataFrame:
    """First time of each level. Stop first: on the bar that first stops out, no target counts; later bars may still touch one."""
    p = path(events, bars, horizon)
    down = F.col("bar_low") <= F.col("px") * (1 + stop)
    p = p.withColumn("stop_t", F.min(F.when(down, F.col("bar_t"))).over(Window.partitionBy("id")))
    free = F.col("stop_t").isNull() | (F.col("bar_t") != F.col("stop_t"))
    hit = [F.min(F.when(free & (F.col("bar_high") >= F.col("px") * (1 + x)), F.col("bar_t"))).alias(f"t{i}") for i, x in enumerate(targets, 1)]
    return p.groupBy("id").agg(F.first("stop_t").alias("stop_t"), *hit, F.max_by("bar_close", "bar_t").alias("end_px"), F.max("bar_t").alias("end_t"), F.count("*").alias("n"))


def time_exit(events: DataFrame, bars: DataFrame, width: int, horizon: int, stop: float = -0.03, cost: float = 0.003) -> DataFrame:
    """Out at the stop, else at the close of the last bar; a horizon that isn't whole is insufficient-data."""
    touched = first_touch(events, bars, horizon, (), stop)
    rows = events.join(touched, "id", "left")
    whole = F.coalesce("n", F.lit(0)) == horizon // width
    gross = F.when(whole, F.when(F.col("stop_t").isNotNull(), F.lit(stop)).otherwise(F.try_divide("end_px", "px") - 1))
    state = F.when(~whole, "insufficient-data").when(F.col("stop_t").isNotNull(), "stop").otherwise("time-exit")
    return rows.select(*events.columns, state.alias("terminal"), gross.alias("gross"), (gross - cost).alias("net"))


def ladder(events: DataFrame, bars: DataFrame, width: int, horizon: int, targets: tuple[float, float, float] = (0.04, 0.08, 0.15), parts: tuple[float, float] = (0.5, 0.3), stop: float = -0.03, cost: float = 0.003) -> DataFrame:
    """Half out at the first target, three tenths at the second, the rest at the third, the stop or the end: closed form from first touches."""
    rows = events.join(first_touch(events, bars, horizon, targets, stop), "id", "left")
    whole = F.coalesce("n", F.lit(0)) == horizon // width
    before = lambda t: F.coalesce(F.col(t) < F.coalesce("stop_t", F.lit(1 << 62)), F.lit(False))
    one, two, three = (before(f"t{i}") for i in (1, 2, 3))
    share1, share2 = one.cast("double") * parts[0], two.cast("double") * parts[1]
    rest = 1 - share1 - share2
    tail = F.when(three, F.lit(targets[2])).when(F.col("stop_t").isNotNull(), F.lit(stop)).otherwise(F.try_divide("end_px", "px") - 1)
    gross = F.when(whole, share1 * targets[0] + share2 * targets[1] + rest * tail)
    state = F.when(~whole, "insufficient-data").when(three, "ladder-complete").when(F.col("stop_t").isNotNull(), "stop").otherwise("time-exit")
    return rows.select(*events.columns, state.alias("terminal"), gross.alias("gross"), (gross - cost).alias("net"))


def equity_drawdown(trades: DataFrame, keys: list[str], at: list[str], value: str = "net", floor: float = 0.01, span: int = scan.SPAN) -> DataFrame:
    """(keys, drawdown): largest fall of the compounded equity from its running peak, which starts at 1; a trade never takes it under floor.
    The fall is that of the sum of logarithms, found by blocks of the first of the ordering columns."""
    step = F.log(F.greatest(F.lit(floor), 1 + F.col(value)))
    return scan.deepest_fall(trades, keys, at, step, span).select(*keys, (1 - F.exp(-F.col("fall"))).alias("drawdown"))


def concentration(rows: DataFrame, keys: list[str], by: str, value: str = "net") -> DataFrame:
    """(keys, top_<by>_share): the largest positive group sum over the sum of the positive ones, 1 without any."""
    sums = rows.groupBy(*keys, by).agg(F.sum(value).alias("__s"))
    good = F.when(F.col("__s") > 0, F.col("__s"))
    return sums.groupBy(*keys).agg(F.coalesce(F.try_divide(F.max(good), F.sum(good)), F.lit(1.0)).alias(f"top_{by}_share"))


def summary(rows: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """Trades, coins, days, mean, median, win rate, profit factor (null without losses) and concentration."""
    r, v = rows.withColumn("day", F.floor(F.col("since") / 86400).cast("long")), F.col(value)
    out = r.groupBy(*keys).agg(
        F.count(v).alias("trades"), F.count_distinct("sym").alias("coins"), F.count_distinct("day").alias("days"), F.avg(v).alias("mean"),
        F.avg((v > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))).alias("profit_factor"),
    )
    n = F.col("n")
    middles = selection.at_ranks(r, keys, value, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)}).select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias("median"))
    return out.join(middles, keys).join(concentration(r, keys, "sym", value), keys).join(concentration(r, keys, "day", value), keys)


def order_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The five order statistics: mean of the middles, index round(f (n - 1)), floor(q n), upper and lower middle.

    Found by counting passes (see selection), so a key of any length is many tasks; nulls are left out.
    """
    n = F.col("n")
    places = {"lower_middle": F.floor((n - 1) / 2), "upper_middle": F.floor(n / 2), "p25": F.floor(0.25 * (n - 1) + 0.5), "q90": F.least(F.floor(0.9 * n), n - 1)}
    found = selection.at_ranks(rows, keys, value, places)
    return found.select(*keys, "n", ((F.col("lower_middle") + F.col("upper_middle")) / 2).alias("median"), "p25", "q90", "upper_middle", "lower_middle")
