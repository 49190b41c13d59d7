"""Order-dependent folds: exponential averages.

A series is cut into blocks of rows. A linear recurrence y = (1 - k) y + k x carries over a block as one pair (decay, sum), so blocks are
folded apart, their pairs are chained per symbol (a few rows), and the blocks are folded once more with what is carried in: no task
holds more than a block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import indexed

BLOCK = 4096


def _carry(j: int, k: float):
    """A step over the blocks of a symbol: what average j is carried in with, block by block."""
    return lambda a, x: F.struct((a["y"] * F.pow(F.lit(1 - k), x[f"m{j}"]) + F.coalesce(x[f"s{j}"], F.lit(0.0))).alias("y"), F.concat(a["in"], F.array(a["y"])).alias("in"))


def emas(bars: DataFrame, periods: dict[str, int], of: str = "close", block: int = BLOCK) -> DataFrame:
    """Adds an exponential average for each name and period: k = 2 / (period + 1), seeded by the mean of the first `period` values at
    index period - 1, null before. Rows that are numbered already (`__i`) stay so. All are folded together, so the bars are read once more
    for the carries, however many there are. Within a block an average is a weighted running sum, so all of it stays in built-in functions;
    blocks are short enough that the weights, powers of 1 - k, stay within a double."""
    block = max(1, min(block, *(int(300 / -math.log(1 - 2.0 / (n + 1))) if n > 1 else block for n in periods.values())))
    rows = (bars if "__i" in bars.columns else indexed(bars)).withColumn("__b", F.floor(F.col("__i") / block))
    ks = {name: 2.0 / (n + 1) for name, n in periods.items()}
    # within a block, the value at offset j from its end weighs k (1 - k)^j; far offsets vanish
    back = (F.col("__b") + 1) * block - 1 - F.col("__i")
    parts = []
    for j, (name, n) in enumerate(periods.items()):
        early, late = F.col("__i") < n, F.col("__i") >= n
        parts += [
            F.sum(late.cast("int")).alias(f"m{j}"), F.sum(F.when(late, F.col(of) * ks[name] * F.pow(F.lit(1 - ks[name]), back))).alias(f"s{j}"),
            F.sum(F.when(early, F.col(of))).alias(f"e{j}"), F.count(F.when(early, F.col(of))).alias(f"n{j}"),
        ]
    sums = rows.groupBy("sym", "__b").agg(*parts)
    chain = sums.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("__b", *[f"{c}{j}" for j in range(len(periods)) for c in "msen"]))).alias("c"))
    carried = []
    for j, (name, n) in enumerate(periods.items()):
        total = lambda c: F.aggregate(F.transform("c", lambda x: F.coalesce(x[c], F.lit(0)).cast("double")), F.lit(0.0), lambda a, x: a + x)
        seed = F.when(total(f"n{j}") == n, total(f"e{j}") / n)
        carried.append(F.aggregate("c", F.struct(seed.alias("y"), F.array().cast("array<double>").alias("in")), _carry(j, ks[name]), lambda a: a["in"]).alias(f"__in{j}"))
    carry = chain.select(F.col("sym").alias("__sym"), F.posexplode(F.arrays_zip(*carried)).alias("__cb", "__in")).select("__sym", "__cb", *[f"__in.__in{j}" for j in range(len(periods))])
    met = rows.join(carry, (F.col("sym") == F.col("__sym")) & (F.col("__b") == F.col("__cb")))
    w = Window.partitionBy("sym", "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.col("__i") - F.col("__b") * block
    for j, (name, n) in enumerate(periods.items()):
        late, rest = F.col("__i") >= n, 1 - ks[name]
        # values divided by the power of their place, summed, and multiplied by the power of the row's own place
        inside = F.coalesce(F.sum(F.when(late, F.col(of) * ks[name] * F.pow(F.lit(rest), -offset))).over(w), F.lit(0.0)) * F.pow(F.lit(rest), offset)
        met = met.withColumn(name, F.when(F.col("__i") >= n - 1, F.col(f"__in{j}") * F.pow(F.lit(rest), F.count(F.when(late, 1)).over(w)) + inside))
    return met.select(*bars.columns, *periods)


def ema(bars: DataFrame, period: int, of: str = "close", name: str = "ema", block: int = BLOCK) -> DataFrame:
    return emas(bars, {name: period}, of, block)
