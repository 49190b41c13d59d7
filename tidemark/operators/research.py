"""Research gates over event-study rows: matched lift, isolation, walk-forward, bootstrap, placebo, selection, gates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .outcomes import concentration, equity_drawdown


def last_by_id(rows: DataFrame) -> DataFrame:
    """Of rows of one id, the last by `seq`."""
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("r")).select("id", "r.*")


def matched_lift(primary: DataFrame, control: DataFrame) -> DataFrame:
    """One row: eligible, hits, control_hits, lift. Rows (id, success, seq); of a control id the last counts.

    Without control hits the lift is infinite if there are hits, else 0.
    """
    c = last_by_id(control).select("id", F.col("success").alias("control"))
    one = lambda x: F.coalesce(F.sum(F.col(x).cast("int")), F.lit(0)).cast("long")
    out = primary.join(c, "id").agg(F.count("*").alias("eligible"), one("success").alias("hits"), one("control").alias("control_hits"))
    lift = F.when(F.col("control_hits") > 0, F.col("hits") / F.col("control_hits")).when(F.col("hits") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("lift", lift)


def isolate(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`: the first rule that rejects a row, in order; of survivors with one id all but the first by seq are duplicates."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules], F.lit("kept"))
    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("id", "reason").orderBy("seq"))
    return rows.withColumn("reason", F.when((F.col("reason") == "kept") & (place > 1), "duplicate").otherwise(F.col("reason")))


def walk_forward(rows: DataFrame, folds: int, purge: int) -> DataFrame:
    """Rows (sym, since, value) by validation fold: months in order are dealt to folds; a row trains a fold if it ends `purge` seconds before it.

    (fold, months, n_train, n_valid, mean_train, mean_valid). Months are few; rows are aggregated by month before they meet the folds.
    """
    month = F.date_format(F.timestamp_seconds("since"), "yyyy-MM")
    months = rows.select(month.alias("month")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    months = months.withColumn("fold", F.floor((F.row_number().over(w) - 1) * folds / F.count("*").over(Window.partitionBy(F.lit(0)))).cast("int"))
    start = months.groupBy("fold").agg(F.min("month").alias("first"), F.count("*").alias("months"))
    bounds = start.select("fold", "months", F.unix_timestamp(F.to_timestamp(F.concat("first", F.lit("-01")))).alias("start"))
    labelled = rows.withColumn("month", month).join(F.broadcast(months), "month").withColumnRenamed("fold", "own")
    days = labelled.groupBy("own", F.floor(F.col("since") / 3600).alias("h")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    met = days.crossJoin(F.broadcast(bounds))  # hours by folds: `folds` rows each
    train, valid = F.col("h") * 3600 + 3600 <= F.col("start") - purge, F.col("own") == F.col("fold")
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = met.groupBy("fold", "months").agg(part(train, "n").alias("n_train"), part(valid, "n").alias("n_valid"), F.try_divide(F.sum(F.when(train, F.col("s"))), F.sum(F.when(train, F.col("n")))).alias("mean_train"), F.try_divide(F.sum(F.when(valid, F.col("s"))), F.sum(F.when(valid, F.col("n")))).alias("mean_valid"))
    return out


class Mulberry:
    """A 32-bit generator with fixed arithmetic: the same stream for a seed everywhere."""

    def __init__(self, seed: int) -> None:
        self.state = seed & 0xFFFFFFFF

    def next(self) -> float:
        m = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & m
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & m
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
        return ((t ^ (t >> 14)) & m) / 4294967296


def mulberry(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first to first + n - 1 of Mulberry(seed), at once: its state moves by a fixed step, so any draw can be reached."""
    # 32-bit products wrap by themselves
    t = np.arange(n, dtype=np.uint32)
    t += np.uint32((first + 1) & 0xFFFFFFFF)
    t *= np.uint32(0x6D2B79F5)
    t += np.uint32(seed & 0xFFFFFFFF)
    t = (t ^ (t >> np.uint32(15))) * (t | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296


#: Block sums that one task of a bootstrap holds, draws it makes at once, and tasks that share the draws of as many block sums.
CHUNK, DRAWS, SHARES = 8_000_000, 1 << 16, 8
#: Draws after which the generator's stream begins again.
PERIOD = 1 << 32


def _bounds(rounds: int, step: int, skip: int, n: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sections of the one random stream between all starts and ends of rounds: (first draws, lengths), without those that no round reads, and
    of each round its first section and how many it has. Draws repeat after a period, so no draw is made twice however many rounds read it."""
    starts = (np.arange(rounds, dtype=np.int64) * step + skip) % period
    edges = np.unique(np.concatenate([starts, (starts + n) % period]))
    lengths = np.diff(np.append(edges, edges[0] + period))
    first, behind = np.searchsorted(edges, starts), np.searchsorted(edges, (starts + n) % period)
    count = np.where(behind > first, behind - first, behind - first + len(edges))
    read = np.zeros(2 * len(edges) + 1, np.int64)
    np.add.at(read, first, 1)
    np.add.at(read, first + count, -1)
    read = read.cumsum()
    return edges, np.where(read[: len(edges)] + read[len(edges) : -1] > 0, lengths, 0), first, count


def _pieces(sums: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Block sums in order, packed: (keys, __first, __n, s, n), where __first is the place within its key of a piece's first block sum and s
    and n are compressed arrays. Rows are sorted in ranges; a key may take many of them."""
    ranged = sums.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [*keys, *order]]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in [*keys, *order]])

    def pack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, own in pdf.groupby(keys, sort=False, dropna=False):
                packed = {c: zlib.compress(own[c].to_numpy(t).tobytes(), 1) for c, t in (("s", "f8"), ("n", "i8"))}
                yield pd.DataFrame([{**{k: own[k].iloc[0] for k in keys}, "__n": len(own), **packed}])

    types = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    packed = ranged.select(*keys, F.col("s").cast("double").alias("s"), F.col("n").cast("long").alias("n")).mapInPandas(pack, f"{types}, __n long, s binary, n binary")
    packed = written(packed.withColumn("__at", F.monotonically_increasing_id()))
    earlier = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    places = packed.select(*keys, "__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__len"))
    return packed.join(places.drop(*keys), "__at").drop("__at")


def _resampled(sums: DataFrame, keys: list[str], order: list[str], rounds: int, seed: int, stride: str | None = None, start: str | None = None) -> DataFrame:
    """(keys, means array): means of `rounds` resamples of a key's block sums (s, n). stride and start name columns, the same in all rows of
    a key: draws of a round, and the first of them that are for these blocks.

    Block sums lie packed in chunks. A task holds one chunk and a share of the sections of the stream; of their draws it adds up those that
    meet its chunk. Copies of block sums are as many as shares, whatever the number of rounds.
    """
    extra = [c for c in (stride, start) if c]
    pieces = _pieces(sums.select(*keys, *order, "s", "n"), keys, order)
    if extra:
        pieces = pieces.join(sums.select(*keys, *extra).groupBy(*keys).agg(*[F.first(c).alias(c) for c in extra]), keys)
    n, step, skip = F.col("__len"), F.col(stride) if stride else F.col("__len"), F.col(start) if start else F.lit(0)
    dealt = pieces.select(*keys, "__first", "__n", "s", "n", n.alias("__len"), step.cast("long").alias("__step"), skip.cast("long").alias("__skip"), F.floor(F.col("__first") / CHUNK).alias("__chunk"))
    shares = F.least(F.lit(SHARES), F.ceil(F.col("__len") * rounds / (64 * DRAWS))).cast("int")
    dealt = dealt.withColumn("__shares", shares).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__first")
        size, step, skip, share, of = (int(pdf[c].iloc[0]) for c in ("__len", "__step", "__skip", "__share", "__shares"))
        low, (s, n) = int(pdf["__first"].iloc[0]), (np.concatenate([np.frombuffer(zlib.decompress(x), t) for x in pdf[c]]) for c, t in (("s", "f8"), ("n", "i8")))
        whole, ones = len(s) == size, bool((n == 1).all())
        edges, lengths, _, _ = _bounds(rounds, step, skip, size, PERIOD)
        total, found = int(lengths.sum()), []
        # a share is a stretch of all draws that are read; a section may be cut between two
        begin, end, done = total * share // of, total * (share + 1) // of, 0
        for k in np.flatnonzero(lengths):
            here, done = done, done + int(lengths[k])
            at, stop, sum_s, sum_n = max(begin - here, 0), min(end - here, int(lengths[k])), 0.0, 0
            while at < stop:
                pick = (mulberry(seed, int(edges[k]) + at, min(DRAWS, stop - at)) * size).astype(np.int64)
                at += len(pick)
                if not whole:
                    pick -= low
                    pick = pick[(pick >= 0) & (pick < len(s))]
                sum_s, sum_n = sum_s + s[pick].sum(), sum_n + (len(pick) if ones else int(n[pick].sum()))
            if max(begin - here, 0) < stop:
                found.append((int(k), float(sum_s), sum_n))
        out = pd.DataFrame(found, columns=["__k", "s", "n"])
        return out.assign(**{k: [pdf[k].iloc[0]] * len(out) for k in keys}, __len=size, __step=step, __skip=skip)[[*keys, "__len", "__step", "__skip", "__k", "s", "n"]]

    def means_of(pdf: pd.DataFrame) -> pd.DataFrame:
        size, step, skip = (int(pdf[c].iloc[0]) for c in ("__len", "__step", "__skip"))
        edges, _, first, count = _bounds(rounds, step, skip, size, PERIOD)
        s, n = np.zeros(2 * len(edges)), np.zeros(2 * len(edges))
        for half in (0, len(edges)):
            s[pdf["__k"].to_numpy() + half], n[pdf["__k"].to_numpy() + half] = pdf["s"], pdf["n"]
        means = sorted(float(s[a : a + c].sum() / n[a : a + c].sum()) for a, c in zip(first, count, strict=True))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "means": means}])

    types = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    # few bytes but long work, so partitions are not to be merged
    spread = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__chunk", "__share")
    parts = spread.groupBy(*keys, "__chunk", "__share").applyInPandas(draw, f"{types}, __len long, __step long, __skip long, __k long, s double, n long")
    parts = parts.groupBy(*keys, "__len", "__step", "__skip", "__k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    # two rows a round at most
    return parts.groupBy(*keys).applyInPandas(means_of, f"{types}, means array<double>")


def _lower(rounds: int, level: float) -> Column:
    return F.get("means", F.lit(min(rounds - 1, int(level * rounds))))


def block_bootstrap(rows: DataFrame, keys: list[str], block: list[str], rounds: int = 1000, level: float = 0.05, seed: int = 7, least: int = 5) -> DataFrame:
    """(keys, blocks, mean, lower): lower bound of the mean from resampled blocks; null with fewer than `least` blocks.

    Rows are first summed by block; draws are dealt out over the block sums of a key.
    """
    sums = written(rows.groupBy(*keys, *block).agg(F.sum("value").alias("s"), F.count("*").alias("n")))
    order = [c for c in sums.columns if c not in ("s", "n")]
    whole = sums.groupBy(*keys).agg(F.count("*").alias("blocks"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    means = _resampled(sums, keys, order, rounds, seed).select(*keys, _lower(rounds, level).alias("lower"))
    return whole.join(means, keys).withColumn("lower", F.when(F.col("blocks") >= least, F.col("lower")))


def paired_bounds(rows: DataFrame, keys: list[str], rounds: int = 2000, level: float = 0.05, seed: int = 7, least: int = 5) -> DataFrame:
    """(keys, event_blocks, coin_blocks, event_lower, coin_lower): lower bounds over blocks of a symbol and day, and over symbols.

    rows: keys, sym, since, value. The event bound resamples sums of symbol-days, the coin bound means of symbols; each round draws first
    the one and then the other from one random stream. Both are null unless there are `least` blocks of either kind.
    """
    days = written(rows.groupBy(*keys, "sym", F.floor(F.col("since") / 86400).alias("day")).agg(F.sum("value").alias("s"), F.count("*").alias("n")))
    coins = days.groupBy(*keys, "sym").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("s")).withColumn("n", F.lit(1).cast("long"))
    sizes = days.groupBy(*keys).agg(F.count("*").alias("event_blocks"), F.count_distinct("sym").alias("coin_blocks"))
    known = sizes.withColumn("__step", F.col("event_blocks") + F.col("coin_blocks")).where((F.col("event_blocks") >= least) & (F.col("coin_blocks") >= least))
    event = _resampled(days.join(known, keys), keys, ["sym", "day"], rounds, seed, "__step").select(*keys, _lower(rounds, level).alias("event_lower"))
    coin = _resampled(coins.join(known, keys), keys, ["sym"], rounds, seed, "__step", "event_blocks").select(*keys, _lower(rounds, level).alias("coin_lower"))
    return sizes.join(event, keys, "left").join(coin, keys, "left")


def placebo(rows: DataFrame, value: str = "value", parts: int = 3) -> DataFrame:
    """The metric shifted cyclically by a third of a symbol's rows: what is left of an effect must come from elsewhere."""
    w = Window.partitionBy("sym").orderBy("since")
    n = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("sym")))
    moved = n.select("sym", ((F.col("i") + F.floor(F.col("n") / parts)) % F.col("n")).alias("i"), F.col(value).alias("placebo"))
    return n.join(moved, ["sym", "i"]).select(*rows.columns, "placebo")


def gate_summary(rows: DataFrame, targets: list[float], horizons: list[str]) -> DataFrame:
    """Target by horizon grid per key: (key, target, horizon, n, hit_rate, baseline, lift). rows: key, role (event or control), mfe_<horizon>."""
    grid = [F.struct(F.lit(x).alias("target"), F.lit(h).alias("horizon"), (F.col(f"mfe_{h}") >= x).cast("double").alias("hit")) for x in targets for h in horizons]
    long = rows.select("key", "role", F.explode(F.array(*grid)).alias("g")).select("key", "role", "g.*")
    rate = lambda role: F.avg(F.when(F.col("role") == role, F.col("hit")))
    out = long.groupBy("key", "target", "horizon").agg(F.count_if((F.col("role") == "event") & F.col("hit").isNotNull()).alias("n"), rate("event").alias("hit_rate"), rate("control").alias("baseline"))
    return out.withColumn("lift", F.try_divide("hit_rate", "baseline"))


def best_filter(rows: DataFrame, least: int) -> DataFrame:
    """Of candidate filters (key, filter, part, value), the best in training per key by mean, ties by name, with its validation mean."""
    cells = rows.groupBy("key", "filter").agg(*[a for p in ("train", "valid") for a in (F.count_if(F.col("part") == p).alias(f"n_{p}"), F.avg(F.when(F.col("part") == p, F.col("value"))).alias(p))])
    good = cells.where(F.col("n_train") >= least)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.round("train", 9).desc(), "filter"))
    return good.withColumn("place", place).where("place = 1").drop("place")


def promotion(summary: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds passed and reasons: names of the rules that don't hold, in order; an unknown value fails its rule."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return summary.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0)


def with_all(registry: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every registered key, also without rows."""
    return registry.join(found, key, "left")


def strategy_summary(outcomes: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """One row a strategy: trades, coins, days, months, net_mean, max_drawdown, profit_factor (null without losses), top_sym_share,
    top_day_share. outcomes: keys, id, sym, since (seconds) and the net result; unknown results are left out."""
    day = F.floor(F.col("since") / 86400).cast("int")
    rows = outcomes.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("day", day)
    date, v = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), F.col(value)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_distinct("sym").alias("coins"), F.count_distinct("day").alias("days"), F.count_distinct(F.trunc(date, "month")).alias("months"),
        F.avg(v).alias("net_mean"), F.try_divide(F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))).alias("profit_factor"),
    )
    falls = equity_drawdown(rows, keys, ["since", "id", value], value).withColumnRenamed("drawdown", "max_drawdown")
    for part in (falls, concentration(rows, keys, "sym", value), concentration(rows, keys, "day", value)):
        out = out.join(part, keys)
    return out


def stage_rules(stage: str) -> list[tuple[str, Column]]:
    """What a strategy must show to be promoted from `shadow` or `paper`, in the order of its reasons, over strategy_summary with matched_lift,
    least_sensitivity, positive_folds, bootstrap_lower and stress_mean beside it. Numbers are fixed values."""
    c, shadow = F.col, stage == "shadow"
    trades, coins, days = (100, 40, 20) if shadow else (200, 60, 60)
    rules = [("trades", c("trades") >= trades), ("coins", c("coins") >= coins), ("days", c("days") >= days), ("expectancy", c("net_mean") > 0)]
    if shadow:
        return [*rules, ("matched-lift", c("matched_lift") >= 1.3), ("sensitivity", c("least_sensitivity") > 1.15)]
    return [
        *rules, ("months", c("months") >= 3), ("walk-forward", c("positive_folds") >= 3), ("bootstrap", c("bootstrap_lower") > 0), ("stress", c("stress_mean") > 0),
        ("drawdown", c("max_drawdown") <= 0.1), ("one-coin", c("top_sym_share") <= 0.1), ("one-day", c("top_day_share") <= 0.2),
    ]
