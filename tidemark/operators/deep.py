"""Deep-reclaim geometry, entry methods, decisions, selection and robustness grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rank_score
from . import folds
from . import windows as X
from .asof import range_sum
from .outcomes import path


def measures(bars: DataFrame, frame: int = 96) -> DataFrame:
    """Adds what reclaims are judged by: drawdown, trough_age, trough_low, level, pos, r4, atr, ema20, ema50, prev_close, prev_ema and the row number i.

    The fall is the largest from a peak to a later trough among the last `frame` closes; the level is the higher of EMA50 and the
    highest high since the trough.
    """
    rows = folds.emas(X.atr(bars), {"ema20": 20, "ema50": 50})
    rows = rows.withColumns({"cl": F.collect_list("close").over(X.upto(frame)), "hi": F.collect_list("high").over(X.upto(frame)), "lo": F.collect_list("low").over(X.upto(frame))})
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        top = F.greatest(a["top"], x)
        down = F.coalesce(1 - F.try_divide(x, top), F.lit(0.0))
        later = (down >= a["worst"]) & (down > 0)
        return F.struct(top.alias("top"), F.when(later, down).otherwise(a["worst"]).alias("worst"), F.when(later, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

    rows = rows.withColumn("dd", F.aggregate("cl", start, step))
    n = F.size("cl")
    after = F.slice("hi", F.col("dd.at") + 2, F.greatest(n - F.col("dd.at") - 1, F.lit(0)))
    rows = rows.withColumns({
        "i": X.index(), "drawdown": F.col("dd.worst"), "trough_age": n - 1 - F.col("dd.at"), "trough_low": F.get("lo", F.col("dd.at")), "level": F.greatest(F.col("ema50"), F.array_max(after)), "pos": X.range_position(frame), "r4": X.change(4),
        "prev_close": F.lag("close").over(X.by_time()), "prev_ema": F.lag("ema20").over(X.by_time()),
    })
    return rows.drop("cl", "hi", "lo", "dd")


def rejections(frame: int, fall: tuple[float, float], age: tuple[int, int], top_pos: float, rise4: float, reach: float) -> list[tuple[str, Column]]:
    """Rules over measures, in order: (reason, what must hold). A close farther than `reach` true ranges above EMA20 is extended."""
    c, e = F.col("close"), F.col("ema20")
    return [
        ("history", F.col("i") >= frame - 1), ("drawdown", F.col("drawdown").between(*fall)), ("trough-age", F.col("trough_age").between(*age)), ("position", F.col("pos") <= top_pos),
        ("return-4h", (F.col("r4") > 0) & (F.col("r4") <= rise4)), ("cross", (c > e) & (F.col("prev_close") <= F.col("prev_ema"))), ("slope", e > F.col("prev_ema")), ("extended", c - e <= reach * F.col("atr")),
    ]


def geometry(bars: DataFrame, frame: int = 96, fall: tuple[float, float] = (0.06, 0.2), age: tuple[int, int] = (4, 80), top_pos: float = 0.7, rise4: float = 0.06, reach: float = 3.0) -> DataFrame:
    """Adds drawdown, trough_age, trough_low, level, the rank score of candidates and `reject`: the first reason, in order, against a reclaim, or null for a candidate."""
    rows = measures(bars, frame)
    reject = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rejections(frame, fall, age, top_pos, rise4, reach)])
    gap = F.try_divide(F.col("level") - F.col("close"), F.col("atr"))
    score = rank_score(gap, F.col("drawdown"), F.col("pos"), F.col("trough_age"), F.col("r4"), fall, top_pos, age, rise4)
    return rows.withColumn("reject", reject).withColumn("score", F.when(F.col("reject").isNull(), score)).drop("i", "pos", "r4", "prev_close", "prev_ema", "ema20", "ema50", "atr")


def quantity_decision(age: Column, change1h: Column, change4h: Column, most_age: int = 600) -> Column:
    """missing, future, stale, rejected or pass, in this order; an age below zero reads the future."""
    return F.when(age.isNull() | change1h.isNull() | change4h.isNull(), "missing").when(age < 0, "future").when(age > most_age, "stale").when((change1h > 0) & (change4h >= 3), "pass").otherwise("rejected")


#: Entry methods: name -> predicate over the path of an event, with the event's px and atr, the bar, and the highest high before it.
METHODS = {
    "immediate": "true",
    "retest": "bar_low <= px AND bar_close >= px",
    "atr-reclaim": "bar_low <= px - 0.5 * atr AND bar_close > px - 0.5 * atr",
    "fixed-pullback": "bar_low <= px * 0.98",
    "breakout": "bar_close > peak",
}


def entries(events: DataFrame, bars: DataFrame, horizon: int, methods: dict[str, str] | None = None) -> DataFrame:
    """(id, method, entry_t, entry_px): the first bar of each event's path on which a method's predicate holds. Events have id, sym, since, px, atr."""
    w = Window.partitionBy("id").orderBy("bar_t").rowsBetween(Window.unboundedPreceding, -1)
    p = path(events, bars, horizon).withColumn("peak", F.max("bar_high").over(w))
    met = F.array_compact(F.array(*[F.when(F.expr(text), F.lit(name)) for name, text in (methods or METHODS).items()]))
    rows = p.select("id", "bar_t", "bar_close", F.explode(met).alias("method"))
    return rows.groupBy("id", "method").agg(F.min("bar_t").alias("entry_t"), F.min_by("bar_close", "bar_t").alias("entry_px"))


def fill_methods(pullback: float = 2.0, fixed: float = 0.05, band: float = 0.5) -> dict[str, str]:
    """Entry method -> when a completed bar is ready, over the path with prior averages, the peak before the bar, and whether the pullback was touched."""
    back = f"(peak - {pullback} * atr)"
    return {
        "breakout-retest": f"bar_high >= support - {band} * atr AND bar_low <= support + {band} * atr AND bar_close >= support AND bar_close <= support + {band} * atr",
        "atr-ema20": "touched AND bar_low <= bar_prev20 AND bar_close >= bar_prev20",
        "atr-reclaim": f"bar_low <= {back} AND bar_close >= {back}",
        "fixed": f"bar_low <= peak * {1 - fixed} AND bar_close >= peak * {1 - fixed}",
        "ema20": "bar_low <= bar_prev20 AND bar_close >= bar_prev20",
        "ema50": "bar_low <= bar_prev50 AND bar_close >= bar_prev50",
    }


def entry_fills(events: DataFrame, bars: DataFrame, width: int, wait: int, delay: int, pullback: float = 2.0, fixed: float = 0.05, band: float = 0.5, missed: float = 0.15) -> DataFrame:
    """(id, method, terminal, fill_t, fill_px) for every event and method: filled at the next bar's open after a bar that is ready, or expired;
    a retest also ends invalidated or missed, judged before readiness. `immediate` fills at the first open.

    events: id, sym, since, px, support, atr. A bar counts when it has closed: from `delay` after the event on, before `wait` after it.
    """
    lag = lambda c: F.lag(c).over(X.by_time())
    rows = folds.emas(bars, {"ema20": 20, "ema50": 50})
    rows = rows.select("sym", "t", "open", "high", "low", "close", lag("ema20").alias("prev20"), lag("ema50").alias("prev50"), F.lead("t").over(X.by_time()).alias("next_t"), F.lead("open").over(X.by_time()).alias("next_open"))
    w = Window.partitionBy("id").orderBy("bar_t")
    done = F.col("bar_t") + width
    late, due = done >= F.col("since") + wait, done >= F.col("since") + delay
    p = path(events, rows, wait).withColumn("peak", F.greatest("px", F.max("bar_high").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    touch = due & (F.col("bar_low") <= F.col("peak") - pullback * F.col("atr"))
    p = p.withColumn("touched", F.max(F.coalesce(touch, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    here, after = (F.struct(F.lit("filled").alias("terminal"), F.col(t).alias("fill_t"), F.col(px).alias("fill_px")) for t, px in (("bar_t", "bar_open"), ("bar_next_t", "bar_next_open")))
    ended = lambda name: F.struct(F.lit(name).alias("terminal"), F.lit(None).cast("long").alias("fill_t"), F.lit(None).cast("double").alias("fill_px"))
    ends = {"immediate": here}
    for name, ready in fill_methods(pullback, fixed, band).items():
        end = F.when(late, ended("expired"))
        if name == "breakout-retest":
            end = end.when(F.col("bar_close") < F.col("support") - F.col("atr"), ended("invalidated")).when(F.col("bar_high") >= F.col("px") * (1 + missed), ended("missed"))
        ends[name] = end.when(due & F.expr(ready) & (F.col("bar_next_t") <= F.col("since") + wait), after)
    each = [F.when(end.isNotNull(), F.struct(F.lit(name).alias("method"), end.alias("end"))) for name, end in ends.items()]
    met = p.select("id", "bar_t", F.inline(F.array_compact(F.array(*each)))).groupBy("id", "method").agg(F.min_by("end", "bar_t").alias("end"))
    every = events.select("id", F.explode(F.array(*map(F.lit, ends))).alias("method"))
    out = every.join(met, ["id", "method"], "left")
    return out.select("id", "method", F.coalesce("end.terminal", F.lit("expired")).alias("terminal"), "end.fill_t", "end.fill_px")


def fill_outcomes(fills: DataFrame, bars: DataFrame, horizon: int, up: float = 0.1, down: float = 0.05) -> DataFrame:
    """(id, method, mfe, mae, up_first) of fills (id, method, sym, since, fill_t, fill_px) from the fill to `horizon` after the event: whether the
    target came before the stop; within one bar the stop counts first."""
    e = fills.where("fill_px > 0").select("id", "method", "sym", F.col("since").alias("known"), (F.col("fill_t") - 1).alias("since"), F.col("fill_px").alias("px"))
    p = path(e, bars.select("sym", "t", "high", "low"), horizon).where(F.col("bar_t") < F.col("known") + horizon)
    stop = F.min(F.when(F.col("bar_low") <= F.col("px") * (1 - down), F.col("bar_t")))
    hit = F.min(F.when(F.col("bar_high") >= F.col("px") * (1 + up), F.col("bar_t")))
    rel = lambda x: F.try_divide(x, F.col("px")) - 1
    out = p.groupBy("id", "method", "px").agg(F.max("bar_high").alias("top"), F.min("bar_low").alias("bottom"), stop.alias("stop"), hit.alias("hit"))
    return out.select("id", "method", rel(F.greatest("top", "px")).alias("mfe"), rel(F.least("bottom", "px")).alias("mae"), F.coalesce((F.col("hit") < F.col("stop")) | (F.col("hit").isNotNull() & F.col("stop").isNull()), F.lit(False)).alias("up_first"))


def grid(rows: DataFrame, cells: dict[str, str], value: str) -> DataFrame:
    """(cell, n, mean, retention): each variant's predicate over the same rows, in one pass; retention is against the first cell."""
    named = F.array_compact(F.array(*[F.when(F.expr(text), F.lit(name)) for name, text in cells.items()]))
    out = rows.select(F.explode(named).alias("cell"), value).groupBy("cell").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    base = out.where(F.col("cell") == next(iter(cells))).select(F.col("n").alias("base"))
    return out.crossJoin(F.broadcast(base)).select("cell", "n", "mean", F.try_divide("n", "base").alias("retention"))  # base is one row


def select_daily(candidates: DataFrame, quota: int) -> DataFrame:
    """Adds `outcome`: per slot the best candidate by (score desc, sym) is selected until its day's quota is used; others say why not."""
    slot = Window.partitionBy("slot").orderBy(F.col("score").desc(), "sym")
    rows = candidates.withColumn("k", F.row_number().over(slot))
    day = Window.partitionBy("day").orderBy("slot")
    best = rows.where("k = 1").withColumn("d", F.row_number().over(day)).select("slot", "sym", F.when(F.col("d") <= quota, "selected").otherwise("quota").alias("best"))
    return rows.join(best, ["slot", "sym"], "left").withColumn("outcome", F.coalesce("best", F.lit("not-first"))).drop("k", "best")


def weighted_cost(positions: DataFrame, charges: DataFrame) -> DataFrame:
    """(id, cost): charges (sym, ts, rate) of entry <= ts <= exit, each by the part still open: 1 less the reductions before it, strictly.

    positions: id, sym, entry, exit (whole seconds), cuts array<struct<ts, part>>. The whole span counts by one, what lies behind a cut by
    minus its part; each is a difference of running sums, so positions never meet charges in pairs, however dense they are.
    """
    before = F.col("entry") - 1
    span = lambda low, weight: F.struct(low.cast("long").alias("low"), weight.cast("double").alias("weight"))
    spans = F.concat(F.array(span(before, F.lit(1.0))), F.transform("cuts", lambda c: span(F.greatest(c["ts"], before), -c["part"])))
    rows = positions.select("id", "sym", "exit", F.inline(spans)).withColumn("low", F.least("low", F.col("exit")))
    sums = range_sum(rows, charges, F.col("low"), F.col("exit"), "rate", "total")
    return sums.groupBy("id").agg(F.sum(F.col("weight") * F.col("total")).alias("cost"))


def holdout(rows: DataFrame, least: int, lift: float) -> DataFrame:
    """Adds `verdict`: insufficient below `least` events, else pass or fail on lift and net."""
    good = F.coalesce((F.col("lift") >= lift) & (F.col("net") > 0), F.lit(False))
    return rows.withColumn("verdict", F.when(F.col("n") < least, "insufficient").when(good, "pass").otherwise("fail"))


def prioritised(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted symbols first, in their order, then the rest as they stood (by `seq`)."""
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("sym"))
    order = [F.when(rank > 0, rank).otherwise(F.lit(1 << 30)), F.col("seq")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def vwap_reclaim(bars: DataFrame, frame: int = 24) -> DataFrame:
    """Adds `rolling`: the close crosses the rolling VWAP upwards; `anchored`: it crosses the VWAP since the lowest low of the frame."""
    rows = X.rolling_vwap(bars, frame).withColumn("base", X.base_volume())
    for name in ("low", "q", "base"):
        rows = rows.withColumn(f"a_{name}", F.collect_list(F.coalesce(F.col(name), F.lit(0.0))).over(X.upto(frame)))
    first = F.array_position("a_low", F.array_min("a_low")).cast("int")
    total = lambda c: F.aggregate(F.slice(c, first, frame), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("line", F.try_divide(total("a_q"), total("a_base")))
    before = lambda c: F.lag(c).over(X.by_time())
    up = lambda line: F.coalesce((F.col("close") > F.col(line)) & (before("close") <= before(line)), F.lit(False))
    return rows.withColumns({"rolling": up("vwap"), "anchored": up("line")}).drop("base", "a_low", "a_q", "a_base", "line", "vwap")


def squeeze_definitions(bars: DataFrame) -> DataFrame:
    """Adds d1 to d4, null never: the band width among the lowest tenth of 48 (24 known at least), at most 0.35 of the largest of 9, the
    Bollinger inside the Keltner band of 1.5 mean true ranges (the first bar's from its open), among the lowest 0.15 of 8 known ones."""
    before = F.coalesce(F.lag("close").over(X.by_time()), F.col("open"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = bars.withColumns({"__w": F.when(F.avg("close").over(X.upto(20)) > 0, F.round(X.bandwidth(20), 9)), "__tr": true_range})
    rows = rows.withColumns({"__k": F.try_divide(F.avg("__tr").over(X.upto(20)), F.avg("close").over(X.upto(20))), "__48": F.collect_list("__w").over(X.upto(48)), "__8": F.collect_list("__w").over(X.upto(8))})
    share = lambda c: F.size(F.filter(c, lambda w: w <= F.col("__w"))) / F.size(c)
    rules = {
        "d1": (F.size("__48") >= 24) & (share("__48") <= 0.1), "d2": F.col("__w") <= 0.35 * F.nullif(F.max("__w").over(X.upto(9)), F.lit(0.0)),
        "d3": (F.col("__k") > 0) & (F.col("__w") <= 3 * F.col("__k")), "d4": (F.size("__8") >= 8) & (share("__8") <= 0.15),
    }
    return rows.withColumns({n: F.coalesce(F.col("__w").isNotNull() & rule, F.lit(False)) for n, rule in rules.items()}).drop("__w", "__tr", "__k", "__48", "__8")


def squeeze_confirmed(setup: Column, mode: str) -> Column:
    """A squeeze with what confirms it: `funding` at most 0, `oi` not falling over 4 bars with takers buying half at least, `both`, `either`
    or `none`. Unknown inputs confirm nothing."""
    four = X.upto(4)
    cheap = F.coalesce(F.col("funding") <= 0, F.lit(False))
    held = F.coalesce((F.lag("oi", 4).over(X.by_time()) > 0) & (F.col("oi") >= F.lag("oi", 4).over(X.by_time())) & (F.try_divide(F.sum("tq").over(four), F.sum("q").over(four)) >= 0.5), F.lit(False))
    return setup & {"none": F.lit(True), "funding": cheap, "oi": held, "both": cheap & held, "either": cheap | held}[mode]


def squeeze_released(rows: DataFrame, setup: str, name: str, recent: int = 6, least_z: float = 1.5) -> DataFrame:
    """Adds whether a bar closes above every high since the first squeeze of the `recent` bars before it, on volume."""
    w = X.before(recent)
    seen = F.collect_list(F.struct(F.col(setup).alias("on"), "high")).over(w)
    since = F.aggregate("__s", F.struct(F.lit(False).alias("on"), F.lit(None).cast("double").alias("top")), lambda a, x: F.struct((a["on"] | x["on"]).alias("on"), F.when(a["on"] | x["on"], F.greatest(a["top"], x["high"])).alias("top")), lambda a: a["top"])
    rows = rows.withColumns({"__s": seen, "__z": X.zscore(24)})
    return rows.withColumn(name, F.coalesce((F.col("close") > since) & (F.col("__z") >= least_z), F.lit(False))).drop("__s", "__z")


def store_state(points: DataFrame, now: int, hours: int = 49) -> DataFrame:
    """(sym, points, warm, recent, fresh): retention, then whether history reaches 48 h, 4.5 h, and the newest point is under 20 minutes old."""
    kept = points.where(F.col("ts") > now - hours * 3600).where(F.col("ts") <= now)
    first, last = F.min("ts"), F.max("ts")
    return kept.groupBy("sym").agg(F.count("*").alias("points"), (first <= now - 47 * 3600).alias("warm"), (first <= now - 16200).alias("recent"), (last >= now - 1200).alias("fresh"))
