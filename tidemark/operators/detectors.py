"""Registry of signal detectors and insights: predicates over feature rows, with parameters.

A predicate that reads an unknown value is unknown and does not fire. Defaults are the production thresholds; SCALED widens them to the
amplitude of the test series, whose hourly returns are noise of order one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    least_index: int = 25
    vol_z: float = 1.5
    flush_drop: float = 8.0
    turn: float = 1.005
    base_range: float = 6.0
    funding_abs: float = 0.01
    rise4: float = 6.0
    oi4: float = 3.0
    oi24: float = 8.0
    crowded: float = 0.02
    top_ret24: float = 15.0
    top_pos: float = 0.8
    reclaim_pos: float = 0.7
    spring_z: float = 1.25
    board_pos: float = 0.7
    ls_drop: float = 5.0
    rs: float = 2.0
    pop: float = 5.0
    deep: float = 8.0
    mild: float = 3.2
    flat: float = 0.01
    flat_oi: float = 1.5
    spot_z: float = 2.0
    spot_basis: float = 0.05
    spot_ratio: float = 1.5
    climax_z: float = 2.5
    spot_share: float = 0.55


PRODUCTION = Params()
SCALED = replace(PRODUCTION, climax_z=1.5, base_range=100_000.0, funding_abs=0.05, rise4=500.0, vol_z=1.0, reclaim_pos=0.9, flush_drop=20.0, board_pos=0.95, mild=500.0, flat=0.5, flat_oi=20.0, spot_z=1.0, spot_basis=60.0, spot_ratio=1.1, spring_z=0.5)


def predicates(p: Params = PRODUCTION) -> dict[str, tuple[str, str]]:
    """name -> (side, SQL predicate)."""
    envelope = f"i >= {p.least_index} AND close > hi24 AND vol_z >= {p.vol_z}"
    context = f"i >= 31 AND oi_max > 0 AND oi <= oi_max * {1 - p.flush_drop / 100} AND oi > oi_then * {p.turn} AND range24 <= {p.base_range} AND abs(funding) <= {p.funding_abs}"
    flush = f"oi_drop >= {p.flush_drop}"
    rebuild = f"{envelope} AND oi4h >= {p.oi4}"
    top = f"i >= 32 AND ret24h * 100 >= {p.top_ret24} AND pos24 >= {p.top_pos} AND vol_z >= {p.vol_z}"
    bottom = "ret24h * 100 >= 10"
    reclaim = f"close > ema20 AND prev_close <= prev_ema20 AND ret4h * 100 <= {p.rise4} AND pos <= {p.reclaim_pos} AND i >= 100"
    sweep = f"i >= 52 AND swept AND close > prev_high AND vol_z2 >= {p.vol_z}"
    calm = f"i >= 52 AND ret4h * 100 <= {p.rise4} AND pos24 <= {p.board_pos} AND vol_z >= {p.vol_z}"
    return {
        "breakout-envelope": ("long", envelope),
        "flush-context": ("long", context),
        "flush-breakout": ("long", f"{context} AND close > close_hi24 AND vol_z >= {p.vol_z}"),
        "rebuild-1": ("long", f"{rebuild} AND {flush}"),
        "rebuild-2": ("long", f"{rebuild} AND ret4h >= 0 AND ret4h * 100 <= {p.rise4}"),
        "rebuild-3": ("long", f"{rebuild} AND {flush} AND funding <= {p.crowded}"),
        "virgin-1": ("long", f"{rebuild} AND NOT ({flush})"),
        "virgin-2": ("long", f"{envelope} AND oi24h >= {p.oi24} AND NOT ({flush})"),
        "virgin-3": ("long", f"{envelope} AND oi24h >= {p.oi24} AND NOT ({flush}) AND funding <= {p.crowded}"),
        "top-1-reject": ("short", f"{top} AND twin_high > 0 AND abs(high / twin_high - 1) <= 0.01 AND close <= high * 0.99 AND close <= open"),
        "top-2-wick": ("short", f"{top} AND high > hi24 AND wick >= 0.5 AND oi4h <= -1.5"),
        "top-3-climax": ("short", f"{top} AND prev_z >= {p.climax_z} AND prev_pos >= 0.85 AND close < prev_low"),
        "top-4-stall": ("short", f"{top} AND funding >= 0.015 AND funding > f8h AND ret4h * 100 <= 1"),
        "w-bottom-1": ("long", f"{bottom} AND w_neck AND vol_z >= {p.vol_z}"),
        "w-bottom-2": ("long", f"{bottom} AND w_spring AND vol_z >= {p.spring_z} AND close > open"),
        "w-bottom-3": ("long", f"{bottom} AND w_neck AND vol_z >= {p.vol_z} AND oi4h >= 0"),
        "ema-reclaim": ("long", reclaim),
        "boarding-1": ("long", f"{reclaim} AND was_below AND vol_z >= {p.vol_z}"),
        "boarding-2": ("long", f"{reclaim} AND dense100 AND below48 AND vol_z >= {p.vol_z}"),
        "boarding-2-oi": ("long", f"{reclaim} AND dense100 AND below48 AND vol_z >= {p.vol_z} AND oi1h > 0 AND oi4h >= {p.oi4}"),
        "squeeze-setup": ("long", "squeezed"),
        "squeeze-breakout": ("long", "squeeze_up"),
        "boarding-oi": ("long", f"{reclaim} AND was_below AND oi4h >= {p.oi4}"),
        "flush-wick-1": ("long", sweep),
        "flush-wick-2": ("long", f"{sweep} AND ema20 > ema50"),
        "flush-wick-3": ("long", f"{sweep} AND coiled"),
        "early-setup": ("long", context),
        "early-accum": ("long", f"{context} AND ls_drop >= {p.ls_drop} AND rs24 >= {p.rs}"),
        "ignition-1h": ("long", f"i >= 25 AND change1h >= {p.pop} AND vol_z >= {p.vol_z}"),
        "boarding-deep": ("long", f"{calm} AND ret24h * 100 <= -{p.deep} AND pos24 <= 0.45 AND change1h >= 2"),
        "boarding-long": ("long", f"{calm} AND i >= 98 AND close > ema20 AND prev_close <= prev_ema20 AND below48"),
        "boarding-scan": ("long", f"{calm} AND close > ema20 AND prev_close <= prev_ema20 AND below24"),
        "boarding-mild": ("long", f"{calm} AND change1h > 0.2 AND change1h <= {p.mild} AND oi4h > 0.8 AND oi4h < 14 AND taker4 > 0.55 AND funding <= {p.crowded}"),
        "spot-pump": ("long", f"i >= 4 AND ret4h >= 0.02 AND abs(oi4h) < {p.flat_oi} AND spot_z >= {p.spot_z} AND spot_basis <= {p.spot_basis}"),
        "spot-accum": ("long", f"i >= 48 AND abs(ret4h) < {p.flat} AND spot_ratio >= {p.spot_ratio} AND spot_buy >= 0.55 AND abs(oi4h) < 2 * {p.flat_oi}"),
        "organic-spot": ("long", f"ret4h * 100 >= 2 AND taker4 > {p.spot_share} AND spot_basis <= 0 AND spot24 >= perp24"),
        "leverage-froth": ("short", "funding >= 0.01 AND spot_basis >= 0.1 AND spot24 < 0.5 * perp24"),
    }


#: Insights in order of evaluation: (id, tone, priority, predicate or @detector); the order breaks ties of priority. Thresholds are fixed values.
INSIGHTS = [
    ("flush-breakout", "bull", 10, "@flush-breakout"),
    ("early-accum", "info", 8, "@early-accum"),
    ("funding-cooling", "bull", 7, "f8h >= 0.008 AND funding >= 0 AND funding <= 0.003 AND funding < 0.6 * f8h AND ret4h > -0.01 AND change1h > -1"),
    ("funding-flip-negative", "bull", 8, "f8h > 0 AND funding < -0.001 AND ret4h > -0.005"),
    ("funding-overheat", "warn", 9, "funding >= 0.015 AND funding > f8h AND f8h > f24h AND oi4h > 3"),
    ("disbelief-rally", "bull", 8, "funding <= -0.005 AND f8h <= -0.002 AND ret4h >= 0.02 AND ret24h > 0"),
    ("long-trap", "bear", 7, "funding >= 0.006 AND oi4h > -1 AND ret4h <= -0.02 AND change1h < -0.5"),
    ("extreme-negative-funding", "bull", 6, "funding <= -0.02 AND f24h > funding AND ret24h < 0.03"),
    ("double-confirmation", "bull", 9, "funding > 0 AND funding <= 0.008 AND funding >= f8h AND oi4h >= 2 AND ret4h >= 0.015 AND pos > 0.6"),
    ("oi-up-price-up", "bull", 6, "oi4h >= 2 AND ret4h >= 0.015 AND buy_share > 0.52 AND NOT coalesce(funding > 0 AND funding <= 0.008 AND funding >= f8h AND pos > 0.6, false)"),
    ("oi-up-price-down", "bear", 7, "oi4h >= 2 AND ret4h <= -0.015"),
    ("oi-down-price-up", "info", 4, "oi4h <= -2 AND ret4h >= 0.015"),
    ("oi-down-price-down", "bear", 5, "oi4h <= -2 AND ret4h <= -0.015"),
    ("oi-coil", "info", 6, "oi4h >= 3 AND oi4h < 8 AND abs(change1h) < 0.5 AND abs(ret4h) < 0.008 AND pos > 0.3 AND pos < 0.7"),
    ("oi-spike", "warn", 7, "oi4h >= 8 AND abs(ret4h) < 0.025"),
    ("oi-divergence-high", "warn", 8, "new_high AND oi4h <= -1.5"),
    ("spot-led-breakout", "bull", 5, "ret4h >= 0.02 AND abs(oi4h) < 1.5 AND buy_share > 0.55 AND vol_z > 1"),
    ("spot-led-pump", "bull", 8, "@spot-pump"),
    ("stealth-spot-accum", "info", 6, "@spot-accum"),
    ("volume-ignition", "bull", 8, "vol_z >= 2 AND pos < 0.4 AND change1h >= 1.5 AND ret4h > 0"),
    ("volume-climax", "warn", 9, "vol_z >= 2.5 AND pos > 0.85 AND ret4h > 0.03 AND range_last >= 1.5 * range_avg"),
    ("absorption-stall", "warn", 7, "pos > 0.75 AND vol_z >= 1.5 AND abs(change1h) < 0.5 AND ret4h < 0.01 AND upper_wick > 0.3 AND NOT coalesce(vol_z >= 2.5 AND ret4h > 0.03, false)"),
    ("squeeze-breakout", "bull", 7, "@squeeze-breakout"),
    ("rebuild-breakout", "bull", 8, "@rebuild-1"),
    ("virgin-breakout", "bull", 8, "@virgin-2"),
    ("boarding-reclaim", "bull", 7, "@boarding-2"),
    ("squeeze-setup", "info", 6, "@squeeze-setup"),
    ("volatility-squeeze", "info", 6, "pctile <= 0.1 AND vol_z <= -0.3 AND abs(change1h) < 0.8"),
    ("ema-golden-cross", "bull", 7, "`cross` = 1"),
    ("ema-death-cross", "bear", 7, "`cross` = -1"),
    ("breakout-confirmed", "bull", 9, "close > hi24 AND vol_z >= 1.8 AND buy_share > 0.55"),
    ("breakout-thin", "warn", 6, "close > hi24 AND vol_z < 0.8"),
    ("upthrust-rejection", "bear", 8, "pos > 0.85 AND upper_wick >= 0.55 AND vol_z >= 1.5 AND ret4h < 0.015 AND upper_red"),
    ("capitulation-wick", "bull", 8, "pos < 0.15 AND lower_wick >= 0.55 AND vol_z >= 2 AND lower_strong"),
    ("buy-pressure-divergence", "info", 6, "buy_share > 0.6 AND ret4h >= -0.01 AND ret4h <= 0.005 AND pos < 0.85"),
    ("trend-health", "bull", 7, "ret24h > 0.03 AND green24 >= 0.55 AND pullback24 > -0.08 AND close > ema20 AND close > ema50"),
    ("failed-breakdown-reclaim", "bull", 7, "pos < 0.3 AND was_below AND close > ema20 AND change1h > 1 AND vol_z >= 1.2"),
    ("parabolic-overextension", "warn", 8, "ret4h > 0.08 AND pos > 0.9 AND pctile > 0.9 AND close > 1.05 * ema20 AND vol_z < 1"),
]

#: Insights that are only shown where they are switched on.
SWITCHED = frozenset({"flush-breakout", "early-accum", "spot-led-breakout", "spot-led-pump", "stealth-spot-accum", "squeeze-breakout", "rebuild-breakout", "virgin-breakout", "boarding-reclaim", "squeeze-setup", "volatility-squeeze"})


#: Controls: what a detector's events are measured against, as predicates on the same bars.
def controls(p: Params = PRODUCTION) -> dict[str, str]:
    known = {name: text for name, (_, text) in predicates(p).items()}
    return {
        "all": "close IS NOT NULL",
        "breakout": known["breakout-envelope"],
        "early-setup-envelope": f"oi_drop >= {p.flush_drop}",
        "ema-reclaim": known["ema-reclaim"],
        "top-envelope": f"i >= 32 AND ret24h * 100 >= {p.top_ret24} AND pos24 >= {p.top_pos} AND vol_z >= {p.vol_z}",
        "w-envelope": f"ret24h * 100 >= 10 AND vol_z >= {p.spring_z}",
        "early-envelope": "close <= hi24 AND pos >= 0.5 AND ret12 > 0 AND ret4h > 0",
        "spot-momentum": "i >= 4 AND ret4h >= 0.02",
        "spot-flat": f"i >= 48 AND abs(ret4h) < {p.flat}",
    }


#: The audit's detectors that read these bars: (key, predicate, control); sides are the predicates'. Strength and rank need the strength series.
AUDIT = [
    ("flush-breakout", "flush-breakout", "breakout"), ("early-setup", "early-setup", "early-setup-envelope"), ("squeeze-d3", "squeeze-breakout", "breakout"),
    ("boarding-b2", "boarding-scan", "ema-reclaim"), ("rebuild-r1", "rebuild-1", "breakout"), ("rebuild-r2", "rebuild-2", "breakout"), ("rebuild-r3", "rebuild-3", "breakout"),
    ("virgin-v1", "virgin-1", "breakout"), ("virgin-v2", "virgin-2", "breakout"), ("virgin-v3", "virgin-3", "breakout"),
    ("top-t1", "top-1-reject", "top-envelope"), ("top-t2", "top-2-wick", "top-envelope"), ("top-t3", "top-3-climax", "top-envelope"), ("top-t4", "top-4-stall", "top-envelope"),
    ("wbottom-w1", "w-bottom-1", "w-envelope"), ("wbottom-w2", "w-bottom-2", "w-envelope"), ("wbottom-w3", "w-bottom-3", "w-envelope"), ("spot-pump", "spot-pump", "spot-momentum"), ("spot-accum", "spot-accum", "spot-flat"), ("organic-spot", "organic-spot", "spot-momentum"), ("leverage-froth", "leverage-froth", "spot-momentum"),
    ("true-spot-led", "organic-spot", "spot-momentum"), ("umm-ema-control", "ema-reclaim", "all"), ("umm-b2", "boarding-2", "ema-reclaim"), ("umm-b2-oi", "boarding-2-oi", "ema-reclaim"),
]
#: Audited on rows with strength and its rank: (key, predicate, control).
AUDIT_STRENGTH = [("strength70", "strength >= 70 AND prev_strength < 70", "all"), ("top10", "place <= 10 AND coalesce(prev_place > 10, true)", "all")]


def detect(features: DataFrame, params: Params = PRODUCTION, names: list[str] | None = None) -> DataFrame:
    """(sym, t, detector, side) of every detector that fires: one scan of the features, one array, one explode."""
    known = predicates(params)
    fired = [F.when(F.expr(known[n][1]), F.struct(F.lit(n).alias("detector"), F.lit(known[n][0]).alias("side"))) for n in names or known]
    return features.select("sym", "t", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("d")).select("sym", "t", "d.*")


def insight_rules(switches: frozenset[str] = frozenset(), params: Params = PRODUCTION) -> list[tuple[str, str, int, str]]:
    """INSIGHTS as predicates, without those of SWITCHED that aren't in switches. A flush breakout says more than breakout-confirmed, which goes."""
    known = {f"@{name}": f"({text})" for name, (_, text) in predicates(params).items()}
    rules = [(name, tone, priority, known.get(text, text)) for name, tone, priority, text in INSIGHTS if name not in SWITCHED or name in switches]
    but = f" AND NOT coalesce({known['@flush-breakout']}, false)"
    return [(name, tone, priority, text + but if name == "breakout-confirmed" else text) for name, tone, priority, text in rules]


def insights(features: DataFrame, most: int = 6, switches: frozenset[str] = frozenset(), params: Params = PRODUCTION, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sym, t, rank, id, tone, priority and the features to keep): insights of a bar by priority, ties in order of evaluation, the first `most` of them."""
    fired = [
        F.when(F.expr(text), F.struct(F.lit(-priority).alias("p"), F.lit(i).alias("i"), F.lit(name).alias("id"), F.lit(tone).alias("tone")))
        for i, (name, tone, priority, text) in enumerate(insight_rules(switches, params))
    ]
    best = F.slice(F.array_sort(F.filter(F.array(*fired), lambda x: x.isNotNull())), 1, most)
    rows = features.select("sym", "t", *keep, F.posexplode(best).alias("k", "x"))
    return rows.select("sym", "t", (F.col("k") + 1).alias("rank"), "x.id", "x.tone", (-F.col("x.p")).alias("priority"), *keep)


#: Insights of an event: the feature that holds the time of its bar. All others are of the last bar.
ANCHORS = {"ema-golden-cross": "cross_t", "ema-death-cross": "cross_t", "upthrust-rejection": "upper_t", "capitulation-wick": "lower_t"}


def anchored_insights(features: DataFrame, **how) -> DataFrame:
    """insights with anchor_t: the bar that an insight marks."""
    columns = tuple(dict.fromkeys(ANCHORS.values()))
    at = F.coalesce(*[F.when(F.col("id") == name, F.col(c)) for name, c in ANCHORS.items()], F.col("t"))
    return insights(features, keep=columns, **how).withColumn("anchor_t", at).drop(*columns)


def remediation(side: Column) -> dict[str, Column]:
    """Side-aware filters; an unknown input never passes, also one that the side doesn't read. Returns and the change of open interest are
    shares, funding a rate, as rows() gives them."""
    long, c = side == "long", F.col

    def rule(read: list[str], of_long: Column, of_short: Column) -> Column:
        known = F.lit(True)
        for name in read:
            known &= c(name).isNotNull() & ~F.isnan(name)
        return F.coalesce(known & F.when(long, of_long).otherwise(of_short), F.lit(False))

    quiet = lambda most: c("oi4h").between(0, most)
    busy = (c("volume_ratio") >= 1.2) & c("strength").between(55, 85)
    return {
        "trend-aligned": rule(["ret4h", "ret24h", "bench24h"], (c("ret4h") > 0) & (c("ret24h") > 0) & (c("bench24h") >= 0), (c("ret4h") < 0) & (c("bench24h") <= 0)),
        "flow-confirmed": rule(["ret1h", "oi4h", "rate", "taker1h"], (c("ret1h") > 0) & quiet(0.15) & (c("rate") <= 0.0003) & (c("taker1h") >= 0.52), (c("ret1h") < 0) & quiet(0.15) & (c("rate") >= 0) & (c("taker1h") <= 0.48)),
        "uncrowded-trend": rule(["ret4h", "bench24h", "oi4h", "rate"], (c("ret4h") > 0) & (c("ret4h") <= 0.06) & (c("bench24h") >= 0) & quiet(0.1) & (c("rate") <= 0.0001), (c("ret4h") < 0) & (c("bench24h") <= 0) & quiet(0.1) & (c("rate") >= 0)),
        "reversal-confirmed": rule(["ret1h", "ret24h", "pos", "oi4h"], (c("ret24h") < 0) & (c("ret1h") > 0) & (c("pos") <= 0.65) & (c("oi4h") >= 0), (c("ret24h") > 0) & (c("ret1h") < 0) & (c("pos") >= 0.65) & (c("oi4h") >= 0)),
        "participation-quality": rule(["ret1h", "taker1h", "volume_ratio", "strength"], busy & (c("ret1h") > 0) & (c("taker1h") >= 0.52), busy & (c("ret1h") < 0) & (c("taker1h") <= 0.48)),
    }


def remediation_inputs(features: DataFrame, strength: DataFrame, benchmark: str) -> DataFrame:
    """What remediation() reads, beside sym and t: of feature rows with the benchmark's return of a day at the same time, and of
    strength (sym, t, strength)."""
    base = features.where(F.col("sym") == benchmark).select("t", F.col("ret24h").alias("bench24h"))
    rows = features.join(base, "t", "left").join(strength, ["sym", "t"], "left")
    return rows.select(
        "sym", "t", "ret4h", "ret24h", "bench24h", "pos", "strength", "volume_ratio", (F.col("change1h") / 100).alias("ret1h"), (F.col("oi4h") / 100).alias("oi4h"), (F.col("funding") / 100).alias("rate"), F.try_divide("tq", "q").alias("taker1h"),
    )
