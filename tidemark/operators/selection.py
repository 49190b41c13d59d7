"""Exact values at given ranks of a key's values, by counting: no task sorts or holds a key.

A pass counts the values of a range by equal parts of it, with partial sums, and keeps the part that holds the wanted rank, as its least and
largest value. Parts shrink by a thousand a pass; a part of few rows is ranked by a window at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

PARTS, FEW = 1024, 50_000


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """(keys, n, one column a rank): the values at 0-based ranks, which are columns of n, the number of known values of the key.

    Null and NaN values are left out, and keys without any other; equal values have ranks one after another. Null keys are a key.
    """
    names = list(ranks)
    known = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    own = [f"__{k}" for k in keys]
    first = known.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = [F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]
    state = kept(first.select(*own, "n", "lo", "hi", F.col("n").alias("c"), F.inline(F.array(*wanted))))
    while state.where((F.col("lo") < F.col("hi")) & (F.col("c") > few)).limit(1).count():
        open_ = (F.col("lo") < F.col("hi")) & (F.col("c") > few)
        counts = _within(known, state.where(open_), own).groupBy(*own, "lo", "hi", _part(parts).alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy(*own, "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        met = _met(state.where(open_), counts, [*own, "lo", "hi"]).withColumn("__upto", F.sum("m").over(upto))
        inside = met.where((F.col("__upto") > F.col("rank")) & (F.col("__upto") - F.col("m") <= F.col("rank")))
        closer = inside.select(*own, "n", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("m").alias("c"), "name", (F.col("rank") - F.col("__upto") + F.col("m")).alias("rank"))
        state = kept(state.where(~open_).unionByName(closer))
    last = _within(known, state.where("lo < hi"), own).withColumn("__at", F.row_number().over(Window.partitionBy(*own, "lo", "hi").orderBy("v")) - 1)
    found = _met(state.where("lo < hi"), last, [*own, "lo", "hi"]).where("rank = __at").select(*own, "n", "name", "v")
    found = found.unionByName(state.where("lo = hi").select(*own, "n", "name", F.col("lo").alias("v")))
    out = found.groupBy(*own, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names])
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "n", *names)


def _part(parts: int) -> Column:
    width = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that the difference of large values stays finite
    return F.least(F.lit(parts - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * parts)).cast("int")


def _within(values: DataFrame, state: DataFrame, own: list[str]) -> DataFrame:
    """Values with the ranges of their key that hold them, each range once."""
    ranges = state.select(*[F.col(k).alias(f"{k}_r") for k in own], "lo", "hi").distinct()
    same = F.col("v").between(F.col("lo"), F.col("hi"))
    for k in own:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return values.join(ranges, same).drop(*[f"{k}_r" for k in own])


def _met(state: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    other = other.withColumnsRenamed({c: f"{c}_o" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_o"))
    return state.join(other, same).drop(*[f"{c}_o" for c in on])
