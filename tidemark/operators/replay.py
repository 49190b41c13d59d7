"""Replays of rules over history: cohorts through execution policies, variants of a watch on shared candidates, references against marks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from . import outcomes as O
from .asof import nearest
from .deep import rejections, weighted_cost
from .thinning import cooldown

HOUR = 3600


def cohorts(rows: DataFrame, rules: dict[str, str], wait: int | None = None) -> DataFrame:
    """(id, cohort, sym, since, px): every row on which a cohort's predicate holds; with `wait`, thinned by a cooldown of each cohort and symbol."""
    met = F.array_compact(F.array(*[F.when(F.expr(text), F.lit(name)) for name, text in rules.items()]))
    out = rows.select("sym", F.col("t").alias("since"), F.col("close").alias("px"), F.explode(met).alias("cohort"))
    if wait is not None:
        out = cooldown(out, wait, ["cohort", "sym"], "since")
    return out.select(F.concat_ws(":", "cohort", "sym", F.col("since").cast("string")).alias("id"), "cohort", "sym", "since", "px")


def executed(events: DataFrame, bars: DataFrame, charges: DataFrame, width: int, time_hold: int = 24 * HOUR, ladder_hold: int = 48 * HOUR, targets: tuple[float, float, float] = (0.04, 0.08, 0.15), parts: tuple[float, float] = (0.5, 0.3), stop: float = -0.03, cost: float = 0.003) -> DataFrame:
    """Each event (id, cohort, sym, since, px) under both policies: policy, whole, up_first (first target before the stop), funding_known, net.

    net is after costs and the charges (sym, ts, rate) that the open part met; charges of a symbol are known if there is any of it.
    A horizon that isn't whole has no net.
    """
    known = charges.select("sym").distinct().withColumn("__known", F.lit(True))
    events, out = kept(events), None
    for policy, hold in (("time", time_hold), ("ladder", ladder_hold)):
        rows = events.join(O.first_touch(events, bars, hold, targets, stop), "id", "left")
        stopped = F.coalesce("stop_t", F.lit(1 << 62))
        hit = [F.coalesce(F.col(f"t{i}") < stopped, F.lit(False)) for i in (1, 2, 3)]
        ended = F.when(F.col("stop_t").isNotNull(), F.lit(stop)).otherwise(F.try_divide("end_px", "px") - 1)
        exit_t, cuts, gross = F.coalesce("stop_t", "end_t"), F.array().cast("array<struct<ts:bigint,part:double>>"), ended
        if policy == "ladder":
            shares = [h.cast("double") * part for h, part in zip(hit, parts)]
            cut = lambda i: F.when(hit[i], F.struct(F.col(f"t{i + 1}").alias("ts"), F.lit(parts[i]).alias("part")))
            exit_t, cuts = F.when(hit[2], F.col("t3")).otherwise(exit_t), F.array_compact(F.array(cut(0), cut(1)))
            gross = shares[0] * targets[0] + shares[1] * targets[1] + (1 - shares[0] - shares[1]) * F.when(hit[2], F.lit(targets[2])).otherwise(ended)
        whole = F.coalesce("n", F.lit(0)) == hold // width
        rows = rows.select(*events.columns, F.lit(policy).alias("policy"), whole.alias("whole"), hit[0].alias("up_first"), F.coalesce(exit_t, "since").alias("exit"), cuts.alias("cuts"), F.when(whole, gross).alias("gross"))
        rows = kept(rows)
        paid = weighted_cost(rows.select("id", "sym", F.col("since").alias("entry"), "exit", "cuts"), charges)
        rows = rows.join(paid, "id").join(known, "sym", "left")
        rows = rows.select(*events.columns, "policy", "whole", "up_first", F.coalesce("__known", F.lit(False)).alias("funding_known"), (F.col("gross") - cost - F.col("cost")).alias("net"))
        out = rows if out is None else out.unionByName(rows)
    return out


def replay_summary(rows: DataFrame, by: list[str], stress: float = 0.003) -> DataFrame:
    """(by, events, trades, coins, days, net_mean, net_stressed, up_rate, coverage) over rows whose charges are known."""
    own, net = rows.where("funding_known"), F.col("net")
    day = F.floor(F.col("since") / 86400)
    return own.groupBy(*by).agg(
        F.count("*").alias("events"), F.count(net).alias("trades"), F.count_distinct(F.when(net.isNotNull(), F.col("sym"))).alias("coins"), F.count_distinct(F.when(net.isNotNull(), day)).alias("days"),
        F.avg(net).alias("net_mean"), (F.avg(net) - stress).alias("net_stressed"), F.avg(F.when(net.isNotNull(), F.col("up_first").cast("double"))).alias("up_rate"), F.avg(F.col("whole").cast("double")).alias("coverage"),
    )


@dataclass(frozen=True)
class Cell:
    """One variant of the deep-reclaim rule: thresholds of its geometry, its watch and its costs."""

    name: str = "base"
    fall: tuple[float, float] = (0.06, 0.2)
    age: tuple[int, int] = (4, 80)
    top_pos: float = 0.7
    rise4: float = 0.06
    q4: float = 3.0
    band: float = 0.5
    expiry: int = 24 * HOUR
    cost: float = 0.003
    #: band, breakout-or-band or breakout-only: what a close must do to confirm; only a band misses what runs away.
    confirm: str = "band"


def robustness_cells(base: Cell, part: float = 0.25, oldest: int = 95) -> list[Cell]:
    """The base, each threshold a quarter lower and higher, four expiries and a cost stress: 1 + 21 cells."""
    low, high = 1 - part, 1 + part
    of = lambda name, **change: replace(base, name=name, **change)
    cells = [base, of("q4-low", q4=base.q4 * low), of("q4-high", q4=base.q4 * high), of("band-low", band=base.band * low), of("band-high", band=base.band * high)]
    cells += [of(f"expiry-{h}h", expiry=base.expiry * h // 24) for h in (12, 18, 30, 36)] + [of("cost-40", cost=0.004)]
    for name, x in (("low", low), ("high", high)):
        cells += [
            of(f"fall-min-{name}", fall=(base.fall[0] * x, base.fall[1])), of(f"fall-max-{name}", fall=(base.fall[0], base.fall[1] * x)), of(f"age-min-{name}", age=(int(base.age[0] * x + 0.5), base.age[1])),
            of(f"age-max-{name}", age=(base.age[0], min(oldest, int(base.age[1] * x + 0.5)))), of(f"position-{name}", top_pos=base.top_pos * x), of(f"momentum-{name}", rise4=base.rise4 * x),
        ]
    return cells


def experiment_cells(base: Cell) -> list[Cell]:
    """What a close through the level and its reach does as a confirmation, alone, with the band, and at a higher cost."""
    return [replace(base, name="breakout-or-band", confirm="breakout-or-band"), replace(base, name="breakout-only", confirm="breakout-only"), replace(base, name="breakout-cost-40", confirm="breakout-or-band", cost=0.004)]


def variant_candidates(measured: DataFrame, cells: list[Cell], frame: int = 96, reach: float = 3.0) -> DataFrame:
    """(id, cell, sym, since, px, level, atr, trough_low, q1, q4 and the cell's settings): candidates of each cell, found over all rows in one pass.

    measured: deep.measures with the changes q1 and q4 of quantity. Cells differ in geometry, so none only filters another's candidates.
    """
    met = []
    for c in cells:
        ok = F.lit(True)
        for _, rule in rejections(frame, c.fall, c.age, c.top_pos, c.rise4, reach):
            ok = ok & rule
        settings = F.struct(F.lit(c.name).alias("cell"), F.lit(float(c.q4)).alias("least_q4"), F.lit(float(c.band)).alias("band"), F.lit(c.expiry).cast("long").alias("expiry"), F.lit(float(c.cost)).alias("charge"), F.lit(c.confirm).alias("confirm"))
        met.append(F.when(ok, settings))
    rows = measured.select("sym", F.col("t").alias("since"), F.col("close").alias("px"), "level", "atr", "trough_low", F.col("q1"), F.col("q4"), F.inline(F.array_compact(F.array(*met))))
    return rows.select(F.concat_ws(":", "sym", F.col("since").cast("string")).alias("id"), "*")


def variant_watches(candidates: DataFrame, bars: DataFrame, width: int, longest: int, reach: float = 2.0) -> DataFrame:
    """(id, cell, arm, sym, since, terminal, fill_t, fill_px, charge): every candidate watched with the quantity gate (arm `quantity`) and without (`price`).

    bars: sym, t, high, low, close, next_t, next_open, q1, q4. On each bar the first that holds ends the watch: expired, invalidated (a close
    under the trough), missed (a high `reach` true ranges over the level; bands only), or a confirming close, which the quantity
    rejects or which fills at the next open. Unknown quantities wait. A candidate the gate rejects at once has no quantity arm.
    """
    arms = F.array(F.when((F.col("q1") > 0) & (F.col("q4") >= F.col("least_q4")), F.lit("quantity")), F.lit("price"))
    e = candidates.withColumn("arm", F.explode(F.array_compact(arms))).drop("q1", "q4")
    p = O.path(e, bars, longest)
    away = F.col("level") + reach * F.col("atr")
    banded, broke = F.col("bar_close").between(F.col("level"), F.col("level") + F.col("band") * F.col("atr")), F.col("bar_close") >= away
    confirmed = F.when(F.col("confirm") == "band", banded).when(F.col("confirm") == "breakout-only", broke).otherwise(banded | broke)
    free, known = F.col("arm") == "price", F.col("bar_q1").isNotNull() & F.col("bar_q4").isNotNull()
    passes = free | ((F.col("bar_q1") > 0) & (F.col("bar_q4") >= F.col("least_q4")))
    terminal = (
        F.when(F.col("bar_t") + width >= F.col("since") + F.col("expiry"), "expired").when(F.col("bar_close") < F.col("trough_low"), "invalidated").when((F.col("confirm") == "band") & (F.col("bar_high") >= away), "missed")
        .when(confirmed & (free | known), F.when(~passes, "oi-rejected").when(F.col("bar_next_t").isNull(), "no-next-open").otherwise("confirmed"))
    )
    end = F.struct(terminal.alias("terminal"), F.col("bar_next_t").alias("fill_t"), F.col("bar_next_open").alias("fill_px"))
    first = p.withColumn("end", end).where("end.terminal is not null").groupBy("id", "cell", "arm").agg(F.min_by("end", "bar_t").alias("end"))
    rows = e.join(first, ["id", "cell", "arm"], "left")
    fill = lambda c: F.when(F.col("end.terminal") == "confirmed", F.col(f"end.{c}")).alias(c)
    return rows.select("id", "cell", "arm", "sym", "since", F.coalesce("end.terminal", F.lit("expired")).alias("terminal"), fill("fill_t"), fill("fill_px"), "charge")


def variant_nets(watches: DataFrame, bars: DataFrame, horizon: int, up: float = 0.1, down: float = 0.05) -> DataFrame:
    """Adds net (the last close before `horizon` after the candidate, less the charge; 0 without a fill) and up_first (the target before the stop)."""
    e = watches.where("fill_px > 0").select("id", "cell", "arm", "sym", F.col("since").alias("known"), (F.col("fill_t") - 1).alias("since"), "fill_px")
    p = O.path(e, bars.select("sym", "t", "high", "low", "close"), horizon).where(F.col("bar_t") < F.col("known") + horizon)
    stop = F.min(F.when(F.col("bar_low") <= F.col("fill_px") * (1 - down), F.col("bar_t")))
    hit = F.min(F.when(F.col("bar_high") >= F.col("fill_px") * (1 + up), F.col("bar_t")))
    met = p.groupBy("id", "cell", "arm").agg(F.max_by("bar_close", "bar_t").alias("__end"), stop.alias("__stop"), hit.alias("__hit"))
    rows = watches.join(met, ["id", "cell", "arm"], "left")
    first = F.coalesce((F.col("__hit") < F.col("__stop")) | (F.col("__hit").isNotNull() & F.col("__stop").isNull()), F.lit(False))
    return rows.select(*watches.columns, F.coalesce(F.try_divide("__end", "fill_px") - 1 - F.col("charge"), F.lit(0.0)).alias("net"), first.alias("up_first"))


def variant_summary(rows: DataFrame, base: str = "base") -> DataFrame:
    """A row a cell: alerts, confirms, coins, days, net_event, net_coin, hits, the price arm's net and hits on the same alerts, lift, retention and passed.

    A cell passes when its nets and its leads over the price arm are positive by event and by coin, its lift is above one, and three
    quarters of the base's confirmations are left.
    """
    on = F.col("terminal") == "confirmed"
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.struct("terminal", "net", "up_first"))).alias(name)
    both = rows.groupBy("id", "cell", "sym", "since").agg(arm("quantity"), arm("price")).where("quantity IS NOT NULL")
    both = both.select("cell", "sym", "since", "quantity.*", F.col("price.net").alias("__cn"), F.col("price.up_first").alias("__ch"))
    coins = both.groupBy("cell", "sym").agg(
        F.count("*").alias("n"), F.count_if(on).alias("c"), F.sum("net").alias("s"), F.sum(F.col("net") - F.col("__cn")).alias("d"), F.count_if("up_first").alias("h"), F.count_if("__ch").alias("ch")
    )
    days = both.where(on).groupBy("cell").agg(F.count_distinct(F.floor(F.col("since") / 86400)).alias("days"))
    cells = coins.groupBy("cell").agg(
        F.sum("n").alias("alerts"), F.sum("c").alias("confirms"), F.count_if(F.col("c") > 0).alias("coins"), F.try_divide(F.sum("s"), F.sum("n")).alias("net_event"), F.avg(F.col("s") / F.col("n")).alias("net_coin"),
        F.try_divide(F.sum("d"), F.sum("n")).alias("lead_event"), F.avg(F.col("d") / F.col("n")).alias("lead_coin"), F.sum("h").alias("hits"), F.sum("ch").alias("control_hits"),
    )
    lift = F.when(F.col("control_hits") > 0, F.col("hits") / F.col("control_hits")).when(F.col("hits") > 0, F.lit(float("inf"))).otherwise(0.0)
    kept = F.greatest(F.max(F.when(F.col("cell") == base, F.col("confirms"))).over(Window.partitionBy(F.lit(0))), F.lit(1))  # cells are few
    out = cells.withColumn("__base", kept).join(days, "cell", "left")
    out = out.withColumns({"days": F.coalesce("days", F.lit(0)), "lift": lift, "retention": F.col("confirms") / F.col("__base")}).drop("__base")
    good = [F.col(c) > 0 for c in ("net_event", "net_coin", "lead_event", "lead_coin")] + [F.col("lift") > 1, F.col("retention") >= 0.75]
    passed = F.lit(True)
    for g in good:
        passed = passed & F.coalesce(g, F.lit(False))
    return out.withColumn("passed", passed)


def verdict(summary: DataFrame, base: str = "base", confirms: int = 100, coins: int = 20, days: int = 20, lift: float = 1.25) -> DataFrame:
    """One row: passed, reasons in order, the base's counts. Cells that don't pass are one reason together, in the order of their names."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("cell"))))
    own = lambda c: F.max(F.when(F.col("cell") == base, F.col(c))).alias(c)
    one = summary.agg(*[own(c) for c in ("confirms", "coins", "days", "net_event", "net_coin", "lead_event", "lead_coin", "lift")], failed.alias("__failed"))
    rules = [("confirms", F.col("confirms") >= confirms), ("coins", F.col("coins") >= coins), ("days", F.col("days") >= days)]
    rules += [(name.replace("_", "-"), F.col(name) > 0) for name in ("net_event", "net_coin", "lead_event", "lead_coin")] + [("lift", F.col("lift") >= lift)]
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    broken.append(F.when(F.size("__failed") > 0, F.concat(F.lit("robustness: "), F.array_join("__failed", ","))))
    rows = one.withColumn("reasons", F.array_compact(F.array(*broken)))
    return rows.select((F.size("reasons") == 0).alias("passed"), F.array_join("reasons", "; ").alias("reasons"), "confirms", "coins", "days")


def missed_cohort(nets: DataFrame, base: str, variants: list[str]) -> DataFrame:
    """A row a variant: alerts the base missed, those of them it watched and confirmed, their mean net, hits and mean delay in hours."""
    mine = nets.where("arm = 'quantity'")
    missed = mine.where((F.col("cell") == base) & (F.col("terminal") == "missed")).select("id")
    on = F.col("terminal") == "confirmed"
    met = mine.where(F.col("cell").isin(variants)).join(missed, "id")
    return met.groupBy("cell").agg(F.count("*").alias("evaluated"), F.count_if(on).alias("captured"), F.avg(F.when(on, F.col("net"))).alias("net"), F.count_if(on & F.col("up_first")).alias("hits"), F.avg(F.when(on, (F.col("fill_t") - F.col("since")) / HOUR)).alias("delay_h"))


def anchored(signals: DataFrame, marks: DataFrame, within: int = 25 * 60) -> DataFrame:
    """Adds anchor_t and anchor_px: a signal's (id, sym, ts) mark (sym, t, px), the last at or before it, else the next, if within tolerance."""
    m = marks.select("sym", F.col("t").alias("ts"), F.struct(F.col("t").alias("t"), F.col("px").alias("px")).alias("m"))
    rows = nearest(signals, m, F.col("ts"), "m", "__m", max_age=within, within=within)
    return rows.select(*signals.columns, F.col("__m.t").alias("anchor_t"), F.col("__m.px").alias("anchor_px"))


def marked_returns(signals: DataFrame, marks: DataFrame, hours: tuple[int, ...] = (1, 4, 12, 24, 48), late: int = 40 * 60) -> DataFrame:
    """(id, h, last, peak, covered) of anchored signals: the last and the highest mark after the anchor within h hours of the signal, in percent; covered if the last is at most `late` from the end."""
    e = signals.where("anchor_px > 0").withColumn("since", F.col("ts"))
    p = O.path(e.withColumn("since", F.least("ts", "anchor_t")), marks.select("sym", "t", "px"), (max(hours) + 1) * HOUR).where("bar_t > anchor_t")
    each = F.explode(F.array(*map(F.lit, hours)))
    p = p.withColumn("h", each).where(F.col("bar_t") <= F.col("ts") + F.col("h") * HOUR)
    rel = lambda x: (F.try_divide(x, "anchor_px") - 1) * 100
    out = p.groupBy("id", "h", "ts", "anchor_px").agg(F.max_by("bar_px", "bar_t").alias("l"), F.max("bar_px").alias("p"), F.max("bar_t").alias("at"))
    return out.select("id", "h", rel(F.col("l")).alias("last"), rel(F.col("p")).alias("peak"), (F.col("ts") + F.col("h") * HOUR - F.col("at") <= late).alias("covered"))


def mark_ladder(signals: DataFrame, marks: DataFrame, targets: tuple[float, ...], stop: float, hours: int = 48) -> DataFrame:
    """(id, hits, stop_h, end, covered_h): targets reached before the stop's mark, hours to the stop, return at the end of the walk in percent, and hours walked. On one mark the stop counts first."""
    p = O.path(signals.where("anchor_px > 0").withColumn("since", F.least("ts", "anchor_t")), marks.select("sym", "t", "px"), (hours + 1) * HOUR)
    p = p.where((F.col("bar_t") > F.col("anchor_t")) & (F.col("bar_t") <= F.col("ts") + hours * HOUR))
    p = p.withColumn("stop_t", F.min(F.when(F.col("bar_px") <= F.col("anchor_px") * (1 + stop), F.col("bar_t"))).over(Window.partitionBy("id")))
    walked = p.where(F.col("stop_t").isNull() | (F.col("bar_t") <= F.col("stop_t")))
    before = F.col("stop_t").isNull() | (F.col("bar_t") < F.col("stop_t"))
    top = F.max(F.when(before, F.col("bar_px")))
    hits: Column = F.lit(0)
    for x in targets:
        hits = hits + F.coalesce((F.col("top") >= F.col("anchor_px") * (1 + x)).cast("int"), F.lit(0))
    out = walked.groupBy("id", "ts", "anchor_t", "anchor_px", "stop_t").agg(top.alias("top"), F.max_by("bar_px", "bar_t").alias("l"), F.max("bar_t").alias("at"))
    return out.select("id", hits.cast("long").alias("hits"), ((F.col("stop_t") - F.col("ts")) / HOUR).alias("stop_h"), ((F.try_divide("l", "anchor_px") - 1) * 100).alias("end"), ((F.col("at") - F.col("anchor_t")) / HOUR).alias("covered_h"))


def lead_over_proxy(signals: DataFrame, fires: DataFrame, span: int = 24 * HOUR) -> DataFrame:
    """(id, lead_h): hours from a signal to the first firing (sym, t) within `span` of it on either side; negative means the proxy was earlier."""
    p = O.path(signals.withColumn("since", F.col("ts") - span - 1), fires.select("sym", "t"), 2 * span + 1)
    return p.groupBy("id", "ts").agg(F.min("bar_t").alias("at")).select("id", ((F.col("at") - F.col("ts")) / HOUR).alias("lead_h"))
