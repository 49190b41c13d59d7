"""As-of and range joins by blocks of time: a block is read with what is carried in from the ones before, so neither a range self-join nor a
task with a whole key is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from . import scan


def _stacked(left: DataFrame, right: DataFrame, by: str, at: Column, ts: str, order: list[str], right_first: bool) -> DataFrame:
    a = left.select(by, at.alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast("struct<" + ",".join(f"{c}:{right.schema[c].dataType.simpleString()}" for c in order) + ">").alias("__o"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in right.schema)}>").alias("__r"))
    b = right.select(by, F.col(ts).alias("__k"), F.lit(0 if right_first else 2).alias("__side"), F.struct(*order).alias("__o"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*right.columns).alias("__r"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, at: Column, names: dict[str, str], by: str = "sym", ts: str = "ts", order: list[str] | None = None, max_age: int | None = None, strict: bool = False, span: int = scan.SPAN) -> DataFrame:
    """Adds to each left row columns of the last right row with ts <= at (< at if strict), null if it is older than max_age.

    names: right column -> new name. Of right rows of one time the last by `order` (default ts) counts. Never reads the future.
    """
    rows = _stacked(left, right, by, at, ts, order or [ts], not strict)
    rows = scan.running(rows, [by], ["__k", "__side", "__o"], {"__m": ("last", F.col("__r"))}, span).where("__l is not null")
    fresh = F.lit(True) if max_age is None else F.col("__k") - F.col(f"__m.{ts}") <= max_age
    return rows.select("__l.*", *[F.when(fresh, F.col(f"__m.{c}")).alias(n) for c, n in names.items()])


def asof_forward(left: DataFrame, right: DataFrame, at: Column, names: dict[str, str], by: str = "sym", ts: str = "ts", order: list[str] | None = None, within: int | None = None, span: int = scan.SPAN) -> DataFrame:
    """As asof, but the first right row with ts > at, at most `within` later."""
    rows = _stacked(left, right, by, at, ts, order or [ts], True)
    rows = scan.running(rows, [by], ["__k", "__side", "__o"], {"__m": ("first", F.col("__r"))}, span, ahead=True).where("__l is not null")
    near = F.lit(True) if within is None else F.col(f"__m.{ts}") - F.col("__k") <= within
    return rows.select("__l.*", *[F.when(near, F.col(f"__m.{c}")).alias(n) for c, n in names.items()])


def nearest(left: DataFrame, right: DataFrame, at: Column, value: str, name: str, by: str = "sym", ts: str = "ts", order: list[str] | None = None, max_age: int | None = None, within: int | None = None) -> DataFrame:
    """Backward as-of, else the nearest later row within tolerance."""
    rows = kept(asof(left, right, at, {value: "__back"}, by, ts, order, max_age))  # each read looks at its rows twice
    rows = asof_forward(rows, right, at, {value: "__next"}, by, ts, order, within)
    return rows.withColumn(name, F.coalesce("__back", "__next")).drop("__back", "__next")


def range_sum(left: DataFrame, right: DataFrame, low: Column, high: Column, value: str, name: str, by: str = "sym", ts: str = "ts", span: int = scan.SPAN) -> DataFrame:
    """Sum of right values with low < ts <= high: the difference of two as-of reads of the running sum, so no pairs are made."""
    # values of one time are one, so the running sum has no ties
    run = right.groupBy(by, ts).agg(F.sum(value).alias("__x"), F.count("*").alias("__y"))
    run = scan.running(run, [by], [ts], {"__s": ("sum", F.col("__x")), "__n": ("sum", F.col("__y"))}, span).drop("__x", "__y")
    run = kept(run)
    rows = kept(asof(left, run, low, {"__s": "__s0", "__n": "__n0"}, by, ts, span=span))
    rows = asof(rows, run, high, {"__s": "__s1", "__n": "__n1"}, by, ts, span=span)
    none = F.lit(0)
    return rows.withColumns({name: F.coalesce("__s1", F.lit(0.0)) - F.coalesce("__s0", F.lit(0.0)), f"{name}_n": F.coalesce("__n1", none) - F.coalesce("__n0", none)}).drop("__s0", "__s1", "__n0", "__n1")


def splice(history: DataFrame, base: DataFrame) -> DataFrame:
    """History strictly before the first base row of a symbol, then base; symbols without base keep their history."""
    first = base.groupBy("sym").agg(F.min("t").alias("__first"))
    old = history.join(first, "sym", "left").where(F.col("__first").isNull() | (F.col("t") < F.col("__first"))).drop("__first")
    return old.unionByName(base)


def scale_splice(store: DataFrame, history: DataFrame, max_age: int, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """History before a store's first row, rescaled to it: ratio at the anchor within [low, high], else no history. Columns (sym, t, v)."""
    first = store.groupBy("sym").agg(F.min("t").alias("t"), F.min_by("v", "t").alias("v"))
    anchor = asof(first, history.withColumnRenamed("t", "ts"), F.col("t"), {"v": "hv"}, max_age=max_age)
    ratio = anchor.select("sym", F.col("t").alias("__first"), F.try_divide("v", "hv").alias("__k")).where(F.col("__k").between(low, high))
    old = history.join(ratio, "sym").where(F.col("t") < F.col("__first")).select("sym", "t", (F.col("v") * F.col("__k")).alias("v"))
    return old.unionByName(store.select("sym", "t", "v"))
