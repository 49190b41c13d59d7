"""Operators on recorded evidence: states, setups with optional filters, frozen anchors, busy symbols, coverage, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as X
from .outcomes import path
from .thinning import thin

#: States of recorded rows. Thresholds are fixed values; an unknown basis, volume or share closes the state.
STATES = {
    "organic-spot-lift": "ret4h >= 2 AND basis_pct <= 0 AND spot_vol24h >= vol24h AND buy_share4h > 0.55",
    "leverage-only-froth": "funding >= 0.01 AND basis_pct >= 0.1 AND spot_vol24h < 0.5 * vol24h",
    "spot-led-v1": "ret4h >= 2 AND basis_pct <= 0 AND spot_vol24h >= vol24h AND spot_taker_share4h > 0.55",
    "strength-70": "strength >= 70",
}


def labelled(rows: DataFrame, predicates: dict[str, str], name: str) -> DataFrame:
    """A row for each predicate that holds, its key in column `name`: one scan, one explode."""
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(F.expr(text), F.lit(key)) for key, text in predicates.items()]))))


@dataclass(frozen=True)
class Setup:
    flush: float = 8.0
    inflect: float = 0.5
    base_range: float = 6.0
    neutral: float = 0.01
    vol_z: float = 1.5
    taker: float = 0.52
    ls_drop: float = 5.0
    strength: float = 2.0


def setup_variants(p: Setup) -> dict[str, str]:
    """Setup, breakout from it, and the breakout with each optional filter, over the columns of setup_rows."""
    shape = f"oi <= oi_max * {1 - p.flush / 100} AND oi > oi_lag * {1 + p.inflect / 100} AND base_range <= {p.base_range}"
    up = f"close > close_max AND vol_z >= {p.vol_z}"
    both = f"{shape} AND abs(funding) <= {p.neutral}"
    return {
        "setup": both,
        "breakout": f"{both} AND {up}",
        "breakout-taker": f"{both} AND {up} AND taker >= {p.taker}",
        "breakout-ls": f"{both} AND {up} AND ls > 0 AND ls_lag > 0 AND ls <= ls_lag * {1 - p.ls_drop / 100}",
        "breakout-strength": f"{both} AND {up} AND own_ret - bench_ret >= {p.strength / 100}",
        "breakout-asymmetric": f"{shape} AND funding <= {p.neutral} AND {up}",
    }


def setup_rows(bars: DataFrame, flush: int = 48, inflect: int = 6, base: int = 24) -> DataFrame:
    """What setup_variants reads, from bars (sym, t, close, q, tq) with oi, funding, ls and bench (the benchmark's close): one window partitioning."""
    w = X.by_time()
    top, low = F.max("close").over(X.before(base)), F.min("close").over(X.before(base))
    ret = lambda c: F.try_divide(F.col(c), F.lag(c, base).over(w)) - 1
    return bars.withColumns({
        "oi_max": F.max("oi").over(X.upto(flush + 1)), "oi_lag": F.lag("oi", inflect).over(w), "close_max": top, "base_range": (F.try_divide(top, low) - 1) * 100, "vol_z": X.zscore(24),
        "taker": F.try_divide(F.sum("tq").over(X.before(base)), F.sum("q").over(X.before(base))), "ls_lag": F.lag("ls", base).over(w), "own_ret": ret("close"), "bench_ret": ret("bench"),
    })


def anchors(bars: DataFrame, width: int = 3600, hours: int = 24, n: int = 14) -> DataFrame:
    """Adds support (highest high) and anchor_atr of the `hours` bars before each; null unless these are contiguous and end right before it."""
    rows = bars.withColumn("__tr", X.true_range())
    whole = F.col("t") - F.lag("t", hours).over(X.by_time()) == hours * width
    own = {"support": F.max("high").over(X.before(hours)), "anchor_atr": F.avg("__tr").over(X.before(n))}
    return rows.withColumns({k: F.when(whole, v) for k, v in own.items()}).drop("__tr")


# Margin, the two targets, the stop, the share closed at a target.
LEVERAGE, TARGET1, TARGET2, STOP, CLOSED, DUST = 20, 0.05, 0.1, 0.05, 0.5, 1e-9


def day_trades(edges: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """(day, sym, since, side, mode, roi): trades of a day on both sides, by ladder and all out, on margin.

    edges: sym, since. A trade opens at the close of the very next slot, or is skipped (roi is null), as is one without a later close on its
    day; it ends at the stop, the second target when all out, or the day's last close. One trade a day, symbol, side and mode is on at a
    time: all out, the first is the only one; a ladder's stop frees the symbol.
    """
    e = edges.select("sym", "since").withColumn("day", F.floor(F.col("since") / 86400)).withColumn("id", F.concat_ws(":", "sym", "since"))
    at = bars.select("sym", (F.col("t") - width).alias("since"), F.col("close").alias("px"))
    e = e.join(at, ["sym", "since"], "left").withColumn("end", (F.col("day") + 1) * 86400)
    opened = e.where((F.col("px") > 0) & (F.col("since") + width < F.col("end"))).withColumn("since", F.col("since") + width)
    walked = path(opened, bars.select("sym", "t", "close"), 86400).where((F.col("bar_t") < F.col("end")) & (F.col("bar_close") > 0))
    sides = [F.struct(F.lit(name).alias("side"), (sign * (F.col("bar_close") / F.col("px") - 1)).alias("gain")) for name, sign in (("long", 1), ("short", -1))]
    walked = walked.select("id", "bar_t", F.inline(F.array(*sides)))
    first = lambda on: F.min(F.when(on, F.col("bar_t")))
    found = walked.groupBy("id", "side").agg(first(F.col("gain") <= -STOP + DUST).alias("stop"), first(F.col("gain") >= TARGET1 - DUST).alias("one"), first(F.col("gain") >= TARGET2 - DUST).alias("two"), F.max_by("gain", "bar_t").alias("last"))
    before = lambda c: (F.col(c) < F.coalesce("stop", F.lit(1 << 62))) & F.col(c).isNotNull()
    rest = F.when(F.col("stop").isNotNull(), F.lit(-STOP)).otherwise(F.col("last"))
    part1 = F.when(before("one"), CLOSED).otherwise(0.0)
    part2 = F.when(before("two"), (1 - part1) * CLOSED).otherwise(0.0)
    ladder = LEVERAGE * (TARGET1 * part1 + TARGET2 * part2 + (1 - part1 - part2) * rest)
    out = LEVERAGE * F.when(before("two"), F.lit(TARGET2)).otherwise(rest)
    modes = [F.struct(F.lit("ladder").alias("mode"), ladder.alias("roi"), F.coalesce("stop", F.lit(1 << 62)).alias("until")), F.struct(F.lit("allout").alias("mode"), out.alias("roi"), F.lit(1 << 62).alias("until"))]
    found = found.select("id", "side", F.inline(F.array(*modes)))
    lanes = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(mode).alias("mode")) for side in ("long", "short") for mode in ("ladder", "allout")])
    rows = e.select("id", "day", "sym", "since", F.inline(lanes)).join(found, ["id", "side", "mode"], "left")
    rows = rows.select("day", "sym", "since", "side", "mode", "roi", F.coalesce(F.col("until") + 1, F.col("since")).alias("until"))
    return thin(rows, ["day", "sym", "side", "mode"], "since", F.col("until")).drop("until")


def reuse(status: Column, known: Column, found: Column) -> Column:
    """Whether an artifact may be used again: a missing one may, an invalid one not, else its digest decides."""
    return F.when(status == "missing", True).when(status == "invalid", False).otherwise(F.coalesce(known == found, F.lit(False)))


def active_days(members: DataFrame) -> DataFrame:
    """(day, members): how many members' spans, first to last (days since 1970), hold each day; days of none are left out.

    Spans come in on one day and go out on another, and a running sum over the calendar gives the rest: no member is spread over days.
    """
    moves = members.select(F.inline(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("day"), F.lit(-1).alias("n")))))
    moves = moves.groupBy("day").agg(F.sum("n").alias("n"))  # a row a day: the calendar is all that one window sees
    w = Window.orderBy("day")
    steps = moves.select("day", F.sum("n").over(w).alias("members"), (F.lead("day").over(w) - 1).alias("until")).where("members > 0")
    return steps.select(F.explode(F.sequence("day", "until")).alias("day"), "members")


def fingerprint(ids: Column) -> Column:
    """FNV-1a, 32 bits, of the ids (an array of ASCII strings), sorted and joined by |."""
    letters = F.filter(F.split(F.array_join(F.array_sort(ids), "|"), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def seed_merge(log: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """The log and what of the seed it doesn't have yet."""
    return log.unionByName(seed.join(log.select(*key), key, "left_anti"))
