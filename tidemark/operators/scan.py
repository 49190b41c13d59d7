"""Running values over ordered rows in two passes, so that no task sorts a key.

A key's rows are cut into blocks of time. Each block has a summary (a sum, an extreme, the last known value), made with partial
aggregation; the summaries of a key, one row a block, are scanned; and within a block the running value starts from what is carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block in units of the time column: a day of seconds.
SPAN = 86400


def _summary(kind: str, value: Column, order: Column) -> Column:
    known = F.when(value.isNotNull(), order)
    return {"sum": lambda: F.sum(value), "count": lambda: F.count(value), "max": lambda: F.max(value), "min": lambda: F.min(value), "last": lambda: F.max_by(value, known), "first": lambda: F.min_by(value, known)}[kind]()


def _over(kind: str, value: Column, window) -> Column:
    found = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.first(v, ignorenulls=True)}[kind]
    return found(value).over(window)


def _joined(kind: str, carried: Column, own: Column, ahead: bool) -> Column:
    """The value of both parts, of which either may be missing. A last value is the block's own, else what is carried in, which lies
    before it; a first value the other way round; with `ahead`, both are turned."""
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), own).otherwise(carried + F.coalesce(own, F.lit(0)))
    if kind in ("last", "first"):
        return F.coalesce(own, carried) if (kind == "last") != ahead else F.coalesce(carried, own)
    return (F.greatest if kind == "max" else F.least)(carried, own)


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], span: int = SPAN, at: Column | None = None, ahead: bool = False) -> DataFrame:
    """Adds to each row the running value of each (kind, column): sum, count, max, min, last or first of the known values up to the row,
    itself included; with `ahead`, from the row on ('first' is then the next known value).

    order: columns that order a key's rows, without ties for a defined result; blocks are stretches of `at` (default: the first of them)
    and must follow the order. Null keys are a key like any other. Sums of no known value are null.
    """
    columns = rows.columns
    time = F.col(order[0]) if at is None else at
    rows = rows.withColumns({"__block": F.floor(time / span), **{f"__v_{n}": v for n, (_, v) in values.items()}})
    place = F.struct(*order)
    blocks = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__of")).agg(*[_summary(kind, F.col(f"__v_{n}"), place).alias(f"__s_{n}") for n, (kind, _) in values.items()])
    every = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__of")
    outside = every.rowsBetween(1, Window.unboundedFollowing) if ahead else every.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"__c_{n}": _over(kind, F.col(f"__s_{n}"), outside) for n, (kind, _) in values.items()}).drop(*[f"__s_{n}" for n in values])
    same = F.col("__block") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # frames always grow from their start, which costs one step a row; looking ahead, rows come in falling order and first and last are turned
    within = Window.partitionBy(*keys, "__block").orderBy(*[F.desc(c) if ahead else c for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    turned = {"first": "last", "last": "first"} if ahead else {}
    one = lambda kind, n: F.count(F.col(f"__v_{n}")).over(within) if kind == "count" else _over(turned.get(kind, kind), F.col(f"__v_{n}"), within)
    met = rows.join(blocks, same)
    return met.select(*columns, *[_joined(kind, F.col(f"__c_{n}"), one(kind, n), ahead).alias(n) for n, (kind, _) in values.items()])


def deepest_fall(rows: DataFrame, keys: list[str], order: list[str], step: Column, span: int = SPAN, at: Column | None = None) -> DataFrame:
    """(keys, fall): how far the running sum of `step` falls below its highest value before, 0 at least, starting at 0; one row a key.

    A block is summed up as its sum, its highest and lowest running sum, and the deepest fall within; blocks then combine in order, a
    fall across them being the highest before less the lowest here. A fall needs no row to carry a running value out of its block.
    """
    time = F.col(order[0]) if at is None else at
    rows = rows.select(*keys, *order, F.floor(time / span).alias("__block"), step.alias("__x"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum("__x").over(inside))
    rows = rows.withColumn("__d", F.greatest(F.lit(0.0), F.max("__s").over(inside)) - F.col("__s"))
    blocks = rows.groupBy(*keys, "__block").agg(F.sum("__x").alias("sum"), F.greatest(F.lit(0.0), F.max("__s")).alias("high"), F.least(F.lit(0.0), F.min("__s")).alias("low"), F.max("__d").alias("fall"))
    every = Window.partitionBy(*keys).orderBy("__block")
    blocks = blocks.withColumn("start", F.coalesce(F.sum("sum").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.max(F.col("start") + F.col("high")).over(every.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumn("fall", F.greatest("fall", F.coalesce(peak, F.lit(0.0)) - (F.col("start") + F.col("low"))))
    return blocks.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("fall")).alias("fall"))
