"""Greedy thinning: of a key's events in order, one is kept if none kept before it still lasts.

Small keys stream by, sorted, one row at a time. A key too long for one task is cut instead. Where nothing before an event lasts up to it,
it is kept whatever came before: such events start segments. Every event has a successor, the first one after it ends, and the kept events
are those that a segment's start leads to. Blocks of rows are followed inside to where they lead out; what is left are few places a block,
of which those reached are found by pointer doubling; and the blocks with a place reached mark their own events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from . import scan
from . import windows as W
from .asof import asof_forward

#: Rows of a key that one task takes; a longer key is cut. Rows in a block of a cut key.
MOST, BLOCK = 1_000_000, 4096


def thin(events: DataFrame, keys: list[str], at: str, until: Column, most: int = MOST, block: int = BLOCK, span: int = 30 * 86400) -> DataFrame:
    """The events that are kept: each lasts from `at` up to, but not including, `until`. Times are whole numbers.

    Of events of one key at one time, that with the smallest `until` comes first, and of those with the same, any. Where an event doesn't
    last at all, others of its time may be kept too. `most` changes the plan, never which times are kept.
    """
    rows = events.withColumns({"__until": until.cast("long"), "__key": F.to_json(F.struct(*keys))})  # one text a key, nulls left out
    longest = rows.groupBy("__key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= most:
        return _streamed(rows, at).drop("__until", "__key")
    times = rows.groupBy(F.col("__key").alias("sym"), F.col(at).cast("long").alias("t")).agg(F.min("__until").alias("until"))
    times = times.withColumn("until", F.greatest("until", F.col("t") + 1))
    found = _reached(times, block, span).select(F.col("sym").alias("__key"), F.col("t").alias("__t"), F.col("until").alias("__u"))
    met = rows.withColumn("__t", F.col(at).cast("long")).join(found, ["__key", "__t"])
    lasting = met.where((F.col("__until") == F.col("__u")) & (F.col("__until") > F.col("__t"))).dropDuplicates([*keys, at])
    passing = met.where(F.col("__until") <= F.col("__t"))
    return lasting.unionByName(passing).select(*events.columns)


def _streamed(rows: DataFrame, at: str) -> DataFrame:
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, end = None, None
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for n, (own, t, stop) in enumerate(zip(pdf["__key"], pdf[at], pdf["__until"], strict=True)):
                if own != key:
                    key, end = own, None
                if end is None or t >= end:
                    keep[n], end = True, stop
            yield pdf[keep]

    return rows.repartition("__key").sortWithinPartitions("__key", at, "__until").mapInPandas(run, ", ".join(names))


def _reached(times: DataFrame, block: int, span: int) -> DataFrame:
    """Of (sym, t, until), one row a time, those that are kept."""
    rows = kept(scan.running(W.indexed(times, span), ["sym"], ["t"], {"__lasts": ("max", F.col("until"))}, span))
    after = rows.select("sym", F.col("t").alias("ts"), F.col("__i").alias("to"))
    rows = asof_forward(rows, after, F.col("until") - 1, {"to": "__to"}, span=span)
    rows = W.in_blocks(rows, lambda part: part.withColumn("__free", F.coalesce(F.col("t") >= F.lag("__lasts").over(W.by_time()), F.col("__i") == 0)), block, lead=1)
    rows = kept(rows.select("sym", "t", "until", "__i", "__to", "__free", F.floor(F.col("__i") / block).alias("__b")))

    def lead_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        first, to = int(pdf["__i"].iloc[0]), pdf["__to"].fillna(-1).to_numpy().astype(np.int64)
        for n in range(len(to) - 1, -1, -1):
            if 0 <= to[n] - first < len(to):
                to[n] = to[to[n] - first]
        return pd.DataFrame({"sym": pdf["sym"], "a": pdf["__i"], "b": pd.Series(to, index=pdf.index).where(to >= 0).astype("Int64")})

    # a start of a segment needs no way to it, and ways end where the next segment starts
    ways = rows.groupBy("sym", "__b").applyInPandas(lead_out, "sym string, a long, b long").where("b IS NOT NULL")
    starts = rows.where("__free").select("sym", F.col("__i").alias("a"))
    ways = kept(ways)
    places = ways.select("sym", F.col("b").alias("a")).unionByName(starts).distinct()
    jumps = kept(ways.join(places, ["sym", "a"], "left_semi"))
    reached = kept(starts)
    while True:
        new = reached.join(jumps, ["sym", "a"]).select("sym", F.col("b").alias("a")).distinct().join(reached, ["sym", "a"], "left_anti")
        more = kept(new)
        if not more.limit(1).count():
            break
        reached = kept(reached.unionByName(more))
        onward = jumps.select("sym", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = kept(jumps.join(onward, ["sym", "b"]).select("sym", "a", F.col("c").alias("b")))
    entries = reached.select("sym", F.col("a").alias("__i"), F.lit(True).alias("__in"))
    marked = rows.join(entries, ["sym", "__i"], "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        first, to, keep = int(pdf["__i"].iloc[0]), pdf["__to"].fillna(-1).to_numpy().astype(np.int64), np.zeros(len(pdf), bool)
        for n in np.flatnonzero(pdf["__in"].fillna(False).to_numpy().astype(bool)):
            while 0 <= n < len(to) and not keep[n]:
                keep[n] = True
                n = to[n] - first if to[n] >= 0 else -1
        return pdf[keep][["sym", "t", "until"]]

    return marked.groupBy("sym", "__b").applyInPandas(follow, "sym string, t long, until long")


def cooldown(events: DataFrame, wait: int, keys: list[str], at: str = "t", **how) -> DataFrame:
    """An event is kept if at least `wait` has passed since the last one kept of its keys."""
    return thin(events, keys, at, F.col(at) + wait, **how)
