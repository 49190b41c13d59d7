"""Indicator windows over bars (sym, t, open, high, low, close, q, tq): all share one partitioning and order, so Spark plans one exchange and sort.

Frames count rows, not time. Results are null, or the stated default, while a window is short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def by_time():
    return Window.partitionBy("sym").orderBy("t")


def before(n: int, skip: int = 1):
    """The n rows up to `skip` rows before the current one."""
    return by_time().rowsBetween(-(n + skip - 1), -skip)


def upto(n: int):
    """The n rows that end with the current one."""
    return by_time().rowsBetween(-(n - 1), 0)


def index() -> Column:
    return F.row_number().over(by_time()) - 1


#: Rows of a symbol that one task sorts, and the longest look back of a chain of frames within them.
BLOCK, LEAD = 4096, 128


def indexed(bars: DataFrame, span: int = 30 * 86400, name: str = "__i") -> DataFrame:
    """Adds the row number of each bar within its symbol, from 0: counts of stretches of time are summed up, and rows numbered within
    a stretch, so that no task sorts a symbol."""
    rows = bars.withColumn("__s", F.floor(F.col("t") / span))
    counts = rows.groupBy(F.col("sym").alias("__sym"), F.col("__s").alias("__stretch")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__sym").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__sym", "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    rows = rows.join(counts, F.col("sym").eqNullSafe(F.col("__sym")) & (F.col("__s") == F.col("__stretch")))
    own = F.row_number().over(Window.partitionBy("sym", "__s").orderBy("t")) - 1
    return rows.withColumn(name, F.col("__n") + own).drop("__s", "__sym", "__stretch", "__n")


def in_blocks(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """compute(rows) by blocks of rows (numbered as __i) of a symbol: each block gets the `lead` rows before it too, which are dropped after.

    For what looks back at most `lead` rows in all. `sym` is a pair of symbol and block while it computes.
    """
    here = F.floor(F.col("__i") / block)
    both = F.array_compact(F.array(here, F.when(F.col("__i") % block >= block - lead, here + 1)))
    parts = rows.withColumn("__b", F.explode(both)).withColumn("sym", F.struct("sym", "__b")).drop("__b")
    out = compute(parts).where(F.col("sym.__b") == here)
    return out.withColumn("sym", F.col("sym.sym"))


def slide(rows: DataFrame, n: int, values: dict[str, tuple[str, Column]], skip: int = 0) -> DataFrame:
    """Adds max, min, sum, count or z of a column over the n rows that end `skip` rows before each one, at a cost that doesn't grow with n.

    Rows (numbered as __i) are cut into stretches of n. Any n rows are the end of one stretch and the start of the next, so running values
    from the start and towards the end of stretches, which grow row by row, combine into each frame; no row carries an array. Near the
    start of a symbol, frames are shorter. z is the current row's deviation from the frame's mean in population deviations, 0 without any.
    """
    stretch = Window.partitionBy("sym", F.floor(F.col("__i") / n))
    up, down = stretch.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0), stretch.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    plain = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    moments = lambda c, w: F.struct(F.count(c).over(w).alias("n"), F.avg(c).over(w).alias("m"), F.var_pop(c).over(w).alias("v"))
    run = lambda kind, c, w: moments(c, w) if kind == "z" else plain[kind](c).over(w)
    rows = rows.withColumns({f"__x_{name}": c for name, (_, c) in values.items()})
    rows = rows.withColumns({f"__u_{name}": run(kind, F.col(f"__x_{name}"), up) for name, (kind, _) in values.items()})
    rows = rows.withColumns({f"__d_{name}": run(kind, F.col(f"__x_{name}"), down) for name, (kind, _) in values.items()})
    start = F.col("__i") - (n - 1 + skip)
    near = {name: F.lag(f"__u_{name}", skip).over(by_time()) if skip else F.col(f"__u_{name}") for name in values}
    far = {name: F.when((start > 0) & (start % n != 0), F.lag(f"__d_{name}", n - 1 + skip).over(by_time())) for name in values}
    rows = rows.withColumns({f"__n_{name}": c for name, c in near.items()}).withColumns({f"__f_{name}": c for name, c in far.items()})
    out = {}
    for name, (kind, _) in values.items():
        a, b = F.col(f"__f_{name}"), F.col(f"__n_{name}")
        if kind == "z":
            x, count = F.col(f"__x_{name}"), F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))
            weight = lambda s, field: F.coalesce(s["n"] * s[field], F.lit(0.0))
            mean = F.try_divide(weight(a, "m") + weight(b, "m"), count)
            spread = F.try_divide(weight(a, "v") + weight(b, "v"), count) + F.coalesce(a["n"] * b["n"] * F.pow(a["m"] - b["m"], 2) / (count * count), F.lit(0.0))
            out[name] = F.when(count > 0, F.when(spread > 0, (x - mean) / F.sqrt(spread)).otherwise(0.0))
        elif kind in ("sum", "count"):
            out[name] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        else:
            out[name] = (F.greatest if kind == "max" else F.least)(a, b)
    return rows.withColumns(out).drop(*[f"__{k}_{name}" for name in values for k in "xudnf"])


def slide_fall(rows: DataFrame, n: int, of: str, name: str) -> DataFrame:
    """Adds the deepest fall of `of` from a value before it within the last n rows, as a share (0 or less): as in slide, from the falls
    within both parts of a frame and that from the highest of the first part to the lowest of the second."""
    stretch = Window.partitionBy("sym", F.floor(F.col("__i") / n))
    up, down = stretch.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0), stretch.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(of)
    rows = rows.withColumns({"__hu": F.max(x).over(up), "__lu": F.min(x).over(up), "__hd": F.max(x).over(down), "__ld": F.min(x).over(down)})
    rows = rows.withColumns({"__fu": F.try_divide(x, F.col("__hu")) - 1, "__fd": F.try_divide(F.col("__ld"), x) - 1})
    rows = rows.withColumns({"__fu": F.min("__fu").over(up), "__fd": F.min("__fd").over(down)})
    start = F.col("__i") - (n - 1)
    apart = (start > 0) & (start % n != 0)
    rows = rows.withColumns({"__ff": F.when(apart, F.lag("__fd", n - 1).over(by_time())), "__fh": F.when(apart, F.lag("__hd", n - 1).over(by_time()))})
    return rows.withColumn(name, F.least("__fu", "__ff", F.try_divide("__lu", "__fh") - 1)).drop("__hu", "__lu", "__hd", "__ld", "__fu", "__fd", "__ff", "__fh")


def zscore(n: int, least: int = 8, of: str = "q") -> Column:
    """Against the n rows before, population deviation; 0 with fewer than `least` rows or no deviation."""
    w = before(n)
    sd = F.stddev_pop(of).over(w)
    return F.when((F.count(of).over(w) >= least) & (sd > 0), (F.col(of) - F.avg(of).over(w)) / sd).otherwise(0.0)


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    w = upto(n)
    full, mid, sd = F.count(F.col("close")).over(w) == n, F.avg(F.col("close")).over(w), F.stddev_pop(F.col("close")).over(w)
    return {"mid": F.when(full, mid), "upper": F.when(full, mid + k * sd), "lower": F.when(full, mid - k * sd)}


def bandwidth(n: int = 20, k: float = 2.0) -> Column:
    w = upto(n)
    return F.when(F.count(F.col("close")).over(w) == n, F.try_divide(2 * k * F.stddev_pop(F.col("close")).over(w), F.abs(F.avg(F.col("close")).over(w))))


def width_percentile(bars: DataFrame, n: int = 20, frame: int = 48) -> DataFrame:
    """Share of the widths in the frame, the current one included, that are no larger than the current."""
    wide = bars.withColumn("width", bandwidth(n))
    inside = F.collect_list("width").over(upto(frame))
    share = F.size(F.filter(inside, lambda x: x <= F.col("width"))) / F.size(inside)
    return wide.withColumn("pctile", F.when(F.col("width").isNotNull(), share))


def true_range() -> Column:
    prev = F.lag("close").over(by_time())
    return F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds atr: the mean of the last n true ranges, null before there are n."""
    rows = bars.withColumn("tr", true_range())
    return rows.withColumn("atr", F.when(F.count("tr").over(upto(n)) == n, F.avg("tr").over(upto(n)))).drop("tr")


def base_volume() -> Column:
    return F.try_divide(F.col("q"), (F.col("high") + F.col("low") + F.col("close")) / 3)


def rolling_vwap(bars: DataFrame, n: int = 24) -> DataFrame:
    rows = bars.withColumn("base", base_volume())
    return rows.withColumn("vwap", F.when(F.sum("base").over(upto(n)) > 0, F.sum("q").over(upto(n)) / F.sum("base").over(upto(n)))).drop("base")


def anchored_vwap(bars: DataFrame, anchor: Column) -> DataFrame:
    """From the first row where `anchor` holds on; null before it and while no volume was seen."""
    first = bars.where(anchor).groupBy(F.col("sym").alias("__sym")).agg(F.min("t").alias("__from"))
    rows = bars.join(first, F.col("sym").eqNullSafe(F.col("__sym")), "left").drop("__sym").withColumn("on", F.coalesce(F.col("t") >= F.col("__from"), F.lit(False)))
    rows = scan.running(rows, ["sym"], ["t"], {"__q": ("sum", F.when(F.col("on"), F.col("q"))), "__b": ("sum", F.when(F.col("on"), base_volume()))})
    return rows.withColumn("vwap", F.when(F.col("__b") > 0, F.col("__q") / F.col("__b"))).drop("on", "__from", "__q", "__b")


def day_position(n: int = 24) -> Column:
    """Place of the close in the range of the last n bars, itself included; one half without a range."""
    low, high = F.min("low").over(upto(n)), F.max("high").over(upto(n))
    return F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5)


def day_position_before(n: int = 24) -> Column:
    """The same of the bar before, in the range of the n bars that end with it."""
    low, high = F.min("low").over(before(n)), F.max("high").over(before(n))
    return F.when(high > low, (F.lag("close").over(by_time()) - low) / (high - low)).otherwise(0.5)


def range_position(n: int = 96) -> Column:
    low, high = F.min("low").over(by_time().rowsBetween(-n, 0)), F.max("high").over(by_time().rowsBetween(-n, 0))
    return F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5)


def change(k: int, of: str = "close") -> Column:
    """Return over k rows, clamped to the first row where the series is shorter."""
    then = F.coalesce(F.lag(of, k).over(by_time()), F.first(of).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return F.try_divide(F.col(of), then) - 1


def up_share(n: int) -> Column:
    """Share of volume in bars that closed up; 0.5 without volume."""
    w = upto(n)
    return F.coalesce(F.try_divide(F.sum(F.when(F.col("close") >= F.col("open"), F.col("q")).otherwise(0.0)).over(w), F.sum("q").over(w)), F.lit(0.5))


def taker_share(n: int) -> Column:
    """Taker share of volume, null where any taker volume is unknown."""
    w = upto(n)
    return F.when(F.count("tq").over(w) == F.count("*").over(w), F.try_divide(F.sum("tq").over(w), F.sum("q").over(w)))


def prior_high(n: int = 24, of: str = "high") -> Column:
    return F.max(of).over(before(n))


def squash(x: Column) -> Column:
    return x / (1 + F.abs(x))


def strength(bars: DataFrame, per_hour: int = 1) -> DataFrame:
    """Composite strength in [3, 98] of bars with oi and funding: 50, and by fixed weights open interest and price over four hours, buying
    share, room in the range and volume for it, high funding against it. The first hour takes the first value; 50 if there is none."""
    hour, four, day = per_hour, 4 * per_hour, 8 * per_hour
    n, sd = F.count("q").over(before(day)), F.stddev_pop("q").over(before(day))
    rows = bars.withColumns({
        "i": index(), "r4": change(four), "pos": range_position(day), "buy": up_share(four + 1),
        "o4": F.coalesce(F.when(F.coalesce(F.lag("oi", four).over(by_time()), F.first("oi").over(by_time().rowsBetween(Window.unboundedPreceding, 0))) > 0, change(four, "oi")), F.lit(0.0)),
        "vz": F.when((n > 0) & (sd > 0), (F.col("q") - F.avg("q").over(before(day))) / sd).otherwise(0.0),
    })
    within = lambda x, low, high: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))
    score = (
        50 + 24 * squash(F.col("o4") / 0.05) + 16 * squash(F.col("r4") / 0.06) + 14 * within((F.col("buy") - 0.5) * 2, -1, 1) + 20 * (0.5 - F.col("pos"))
        + 8 * squash(F.col("vz") / 2) - 14 * within((F.coalesce("funding", F.lit(0.0)) - 0.03) / 0.05, 0, 1)
    )
    rows = rows.withColumn("s", F.when(F.col("i") >= hour, within(score, 3, 98)))
    first = F.first("s", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("strength", F.coalesce("s", first, F.lit(50.0))).drop("i", "r4", "o4", "vz", "pos", "buy", "s")


def bottoms(bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Adds w_neck: of the last 20 bars, two local minima 2 to 12 apart and within tolerance, the second under seven bars old, and a close
    above the highest high between; w_spring: the bar before fell below a local minimum 2 to 12 before it and closed above it."""
    rows = bars.withColumns({"lo": F.collect_list("low").over(upto(20)), "hi": F.collect_list("high").over(upto(20)), "prior": F.lag("close").over(by_time())})
    at = lambda i: F.get("lo", i)
    minimum = lambda i: (at(i) <= at(i - 1)) & (at(i) <= at(i + 1))
    close = lambda j, i: F.abs(F.try_divide(at(j), at(i)) - 1) <= tolerance
    neck = lambda j, i: F.array_max(F.slice("hi", i + 2, j - i - 1))
    sure = lambda c: F.coalesce(c, F.lit(False))
    pair = lambda j, i: sure(minimum(j) & minimum(i) & close(j, i) & (neck(j, i) > 0) & (F.col("close") > neck(j, i)))
    ints = lambda a, b: F.array(*[F.lit(x) for x in range(a, b)])
    double = F.exists(ints(13, 19), lambda j: F.exists(ints(2, 13), lambda apart: pair(j, j - apart)))
    spring = F.exists(ints(6, 17), lambda i: sure(minimum(i) & (at(F.lit(18)) < at(i)) & (F.col("prior") > at(i))))
    whole = (F.size("lo") == 20) & (index() >= 29)
    return rows.withColumns({"w_neck": whole & double, "w_spring": whole & spring}).drop("lo", "hi", "prior")


def ranked(rows: DataFrame, n: int, by: list[Column], within: str = "t") -> DataFrame:
    """The first n rows of each group in a total order; Spark cuts each task's rows to n before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*by))).where(F.col("rank") <= n)


def flush_shape(bars: DataFrame, of: str = "close", n: int = 48) -> DataFrame:
    """Peak of the last n + 1 values, the first on ties, then the lowest value after it: drop and rebound in percent."""
    frame = F.collect_list(of).over(by_time().rowsBetween(-n, 0))
    rows = bars.withColumn("f", frame).withColumn("peak", F.array_max("f")).withColumn("k", F.array_position("f", F.col("peak")))
    after = F.slice("f", F.col("k").cast("int"), F.size("f"))
    rows = rows.withColumn("trough", F.array_min(after))
    return rows.withColumns({"drop_pct": (1 - F.try_divide("trough", "peak")) * 100, "rebound_pct": (F.try_divide(F.col(of), F.col("trough")) - 1) * 100}).drop("f", "k")


def causal_drawdown(bars: DataFrame, n: int = 96) -> DataFrame:
    """Largest fall from a peak to a later trough among the last n closes; on ties the earliest peak and the latest trough."""
    frame = F.collect_list("close").over(upto(n))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"))
    step = lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.greatest(a["worst"], F.coalesce(1 - F.try_divide(x, F.greatest(a["top"], x)), F.lit(0.0))).alias("worst"))
    return bars.withColumn("drawdown", F.aggregate(frame, start, step, lambda a: a["worst"]))


def high_age(bars: DataFrame, cap: int = 240) -> DataFrame:
    """Bars since a high at or above the current close, at most cap."""
    frame = F.reverse(F.collect_list("high").over(before(cap)))
    here = F.array_position(F.transform(frame, lambda h: h >= F.col("close")), F.lit(True))
    return bars.withColumn("age", F.when(here > 0, here).otherwise(F.lit(cap)).cast("long"))


def wicks(bars: DataFrame, n: int = 4) -> DataFrame:
    """Largest upper and lower wick share of the last n bars, with the time of the bar that has it, the earliest on ties, and whether that
    bar closed at or under its open, or in the upper half of its range."""
    span = F.col("high") - F.col("low")
    rows = bars.withColumns({
        "uw": F.coalesce(F.try_divide(F.col("high") - F.greatest("open", "close"), span), F.lit(0.0)),
        "lw": F.coalesce(F.try_divide(F.least("open", "close") - F.col("low"), span), F.lit(0.0)),
    })
    best = lambda x, mark: F.max(F.struct(F.col(x).alias("v"), (-F.col("t")).alias("nt"), mark.alias("mark"))).over(upto(n))
    rows = rows.withColumns({"u": best("uw", F.col("close") <= F.col("open")), "l": best("lw", F.col("close") > F.col("low") + 0.5 * span)})
    return rows.withColumns({
        "upper_wick": F.col("u.v"), "upper_t": -F.col("u.nt"), "upper_red": (F.col("u.v") > 0) & F.col("u.mark"), "lower_wick": F.col("l.v"), "lower_t": -F.col("l.nt"), "lower_strong": (F.col("l.v") > 0) & F.col("l.mark"),
    }).drop("uw", "lw", "u", "l")


def below_run(rows: DataFrame, flag: Column, n: int) -> DataFrame:
    """Adds `run`: the flag held on all of the n rows before."""
    w = before(n)
    rows = rows.withColumn("flag", flag.cast("int"))
    return rows.withColumn("run", (F.count("flag").over(w) == n) & (F.min("flag").over(w) == 1)).drop("flag")


def latest_cross(rows: DataFrame, fast: str, slow: str, n: int = 8) -> DataFrame:
    """Adds `cross`: 1 or -1 for the latest sign change of fast - slow within n rows, 0 without one; and cross_t, its time."""
    sign = F.signum(F.col(fast) - F.col(slow)).cast("int")
    rows = rows.withColumn("sg", sign).withColumn("pv", F.lag("sg").over(by_time()))
    rows = rows.withColumn("x", F.when((F.col("sg") != F.col("pv")) & (F.col("sg") != 0), F.col("sg")))
    rows = rows.withColumn("cross_t", F.max(F.when(F.col("x").isNotNull(), F.col("t"))).over(upto(n)))
    return rows.withColumn("cross", F.coalesce(F.last("x", ignorenulls=True).over(upto(n)), F.lit(0))).drop("sg", "pv", "x")


def presence_start(rows: DataFrame, on: Column) -> DataFrame:
    """Adds `since`: first t of the current run of rows on which the flag holds, null while it doesn't (gaps and islands)."""
    rows = rows.withColumn("on", F.coalesce(on, F.lit(False)))
    # a run goes on while no row without the flag lies between: its start is the first row with it after the last one without
    rows = scan.running(rows, ["sym"], ["t"], {"__off": ("max", F.when(~F.col("on"), F.col("t")))})
    starts = rows.where("on").groupBy(F.col("sym").alias("__sym"), F.col("__off").alias("__after")).agg(F.min("t").alias("since"))
    same = F.col("sym").eqNullSafe(F.col("__sym")) & F.col("__off").eqNullSafe(F.col("__after")) & F.col("on")
    return rows.join(starts, same, "left").drop("__off", "__sym", "__after")


def squeeze(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds `tight`: band width at most three average true ranges, relative to the mean; `breakout`: close above the high since the first tight bar of the last six."""
    rows = atr(bars.withColumn("w", bandwidth(n)), n).withColumn("tight", F.coalesce(F.col("w") <= F.try_divide(2 * 1.5 * F.col("atr"), F.abs(F.avg(F.col("close")).over(upto(n)))), F.lit(False)))
    flags, highs = F.collect_list("tight").over(before(6)), F.collect_list("high").over(before(6))
    rows = rows.withColumns({"fl": flags, "hi": highs}).withColumn("k", F.array_position("fl", F.lit(True)))
    since = F.array_max(F.slice("hi", F.greatest(F.col("k"), F.lit(1)).cast("int"), 6))
    return rows.withColumn("breakout", (F.col("k") > 0) & (F.col("close") > since)).drop("w", "atr", "fl", "hi", "k")


def double_bottom(bars: DataFrame, frame: int = 20, recent: int = 6, apart: tuple[int, int] = (2, 12), tolerance: float = 0.01) -> DataFrame:
    """Adds `bottom`: among the last bars, two local minima of the lows within tolerance and far enough apart, the second recent, and a close above the highest high between them."""
    rows = bars.withColumns({"lo": F.collect_list("low").over(upto(frame)), "hi": F.collect_list("high").over(upto(frame))})
    n = F.size("lo")
    at = lambda x, i: F.get(F.col(x), i)
    minimum = lambda i: (at("lo", i) < at("lo", i - 1)) & (at("lo", i) <= at("lo", i + 1))
    pair = lambda j, i: (
        minimum(i) & minimum(j) & (j - i >= apart[0]) & (j - i <= apart[1])
        & (F.abs(at("lo", j) - at("lo", i)) <= tolerance * F.abs(at("lo", i))) & (F.col("close") > F.array_max(F.slice("hi", i + 1, j - i + 1)))
    )
    seconds = F.sequence(n - recent, n - 2)
    firsts = lambda j: F.sequence(F.greatest(F.lit(1), j - apart[1]), F.greatest(F.lit(1), j - apart[0]))
    return rows.withColumn("bottom", F.when(n == frame, F.exists(seconds, lambda j: F.exists(firsts(j), lambda i: F.coalesce(pair(j, i), F.lit(False))))).otherwise(False)).drop("lo", "hi")


def pullback(bars: DataFrame, n: int = 97) -> DataFrame:
    """Adds `pullback`: lowest close over the running peak of the window so far, minus one."""
    dd = causal_drawdown(bars, n)
    return dd.withColumn("pullback", -F.col("drawdown")).drop("drawdown")
