"""Keyed state machines on event time: inputs are taken in the order of their times, and a machine ends by a timer where no input comes.

A key's inputs wait in its state, by stretches of event time, until the watermark has passed a stretch; a timer at its end hands them over
in order. A machine that would end at some time has a timer at the end of that stretch too, so a key that falls silent still ends, as the
watermark, which all keys move, goes on. A task holds one stretch of one key at a time; all else is in the state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Timers and maps need the store on disk; a setting of the session that is there already stays."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and value != value else value


class Timed(StatefulProcessor):
    """Runs a machine with observe(row) -> events, due() -> the time it would end at, or None, and expire() -> events.

    Inputs of a stretch that the watermark had passed when they came are dropped. Inputs of one time come by seq. A machine due at the time
    of an input ends before it.
    """

    def __init__(self, machine: Callable, width: int) -> None:
        self.machine, self.width = machine, width

    def init(self, handle) -> None:
        kinds = {"int": "long", "float": "double", "str": "string"}
        self.handle = handle
        self.own = handle.getValueState("own", ", ".join(f"`{f.name}` {kinds[f.type]}" for f in fields(self.machine)))
        self.held = handle.getMapState("held", "stretch long", "rows string")

    def _end_of(self, ts: int) -> int:
        return -(-ts // self.width) * self.width

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            stretches: dict[int, list] = {}
            for row in pdf.to_dict("records"):
                row.pop("at", None)
                end = self._end_of(int(row["ts"]))
                if end * 1000 > passed:
                    stretches.setdefault(end, []).append({k: _plain(v) for k, v in row.items()})
            for end, new in stretches.items():
                old = json.loads(self.held.getValue((end,))[0]) if self.held.containsKey((end,)) else []
                self.held.updateValue((end,), (json.dumps(old + new),))
                self.handle.registerTimer(end * 1000)
        yield pd.DataFrame({"sym": pd.Series([], dtype=object), "t": pd.Series([], dtype="int64"), "event": pd.Series([], dtype=object), "px": pd.Series([], dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        own, out = self.machine(*self.own.get()) if self.own.exists() else self.machine(), []
        rows = []
        if self.held.containsKey((end,)):
            rows = json.loads(self.held.getValue((end,))[0])
            self.held.removeKey((end,))
        for row in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            due = own.due()
            if due is not None and due <= row["ts"]:
                out += [(key[0], due, event, None) for event in own.expire()]
            out += [(key[0], int(row["ts"]), event, row["px"]) for event in own.observe(row)]
        due = own.due()
        if due is not None and due <= end:
            out += [(key[0], due, event, None) for event in own.expire()]
        elif due is not None:
            self.handle.registerTimer(self._end_of(due) * 1000)
        self.own.update(astuple(own))
        yield pd.DataFrame(out, columns=["sym", "t", "event", "px"]).astype({"t": "int64", "px": "float64"})

    def close(self) -> None:
        pass


def run(machine: Callable, stream: DataFrame, width: int = 60, late: str = "0 seconds") -> DataFrame:
    """(sym, t, event, px) of a machine a symbol; px is null where a timer ended it. Needs state_store while it runs. width: seconds of a
    stretch, which is also how long an event may be in coming."""
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("ts")).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("sym").transformWithStateInPandas(Timed(machine, width), "sym string, t long, event string, px double", "Append", "EventTime")
