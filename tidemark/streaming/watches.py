"""Watches of one symbol as keyed state machines: entry watches after a push, and watches of a deep reclaim.

Machines take completed bars and other inputs in time order (see timed); what is not after the last input seen is ignored, so a replay
changes nothing. A watch that still waits expires by a timer. Ends are judged in a fixed order before readiness, so that a bar that also touches the band never counts for more than it shows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import timed

# Bands in true ranges, windows in seconds, and the move that counts as missed.
BAND_ATR, INVALID_ATR, MISSED_ATR = 0.5, 1.0, 2.0
DELAY, EXPIRY, OI_AGE = 30 * 60, 24 * 3600, 600
MISSED = 0.15
ACTIVE = ("watching", "ready", "sending")


def _price(*values: float | None) -> bool:
    return all(v is not None and math.isfinite(v) and v > 0 for v in values)


@dataclass
class EntryWatch:
    """From a push with its support and true range to expiry, invalidation, a missed move, or readiness and its delivery.

    One watch a symbol: a push of another source supersedes an active one. A failed delivery is tried again from its retry time on.
    """

    source: int = -1
    since: int = -1
    px: float = 0.0
    support: float = 0.0
    atr: float = 0.0
    status: str = "none"
    last: int = -1
    retry: int = -1
    attempts: int = 0
    seen: int = -1
    seq: int = -1

    def observe(self, r: dict) -> list[str]:
        """Events of one input: kind push (source, px, support, atr), bar (high, low, px as close), sending, failed (retry) or delivered."""
        if (r["ts"], r["seq"]) <= (self.seen, self.seq):
            return []
        self.seen, self.seq = r["ts"], r["seq"]
        return getattr(self, "_" + r["kind"])(r)

    def _push(self, r: dict) -> list[str]:
        if not _price(r["px"], r["support"], r["atr"]) or r["atr"] >= r["support"] or r["source"] == self.source:
            return []
        gone = ["superseded"] if self.status in ACTIVE else []
        self.source, self.since, self.px, self.support, self.atr = r["source"], r["ts"], r["px"], r["support"], r["atr"]
        self.status, self.last, self.retry, self.attempts = "watching", -1, -1, 0
        return [*gone, "armed"]

    def _bar(self, r: dict) -> list[str]:
        if self.status != "watching" or not _price(r["px"], r["high"], r["low"]) or r["ts"] <= self.since or r["ts"] <= self.last:
            return []
        t, close, top = r["ts"], r["px"], self.support + BAND_ATR * self.atr
        if t >= self.since + EXPIRY:
            return self._end("expired")
        if close < self.support - INVALID_ATR * self.atr:
            return self._end("invalid")
        if r["high"] >= self.px * (1 + MISSED):
            return self._end("missed")
        self.last = t
        touched = r["low"] <= top and r["high"] >= self.support - BAND_ATR * self.atr
        if t >= self.since + DELAY and touched and self.support <= close <= top:
            self.status = "ready"
            return ["ready"]
        return []

    def _sending(self, r: dict) -> list[str]:
        if self.status == "ready" and r["ts"] >= self.retry:
            self.status, self.retry, self.attempts = "sending", -1, self.attempts + 1
        return []

    def _failed(self, r: dict) -> list[str]:
        if self.status != "sending" or r["retry"] <= r["ts"]:
            return []
        self.status, self.retry = "ready", r["retry"]
        return ["delivery-failed"]

    def _delivered(self, r: dict) -> list[str]:
        return self._end("delivered") if self.status in ("ready", "sending") else []

    def due(self) -> int | None:
        """When the watch would expire; only one that still waits for its band does."""
        return self.since + EXPIRY if self.status == "watching" else None

    def expire(self) -> list[str]:
        return self._end("expired")

    def _end(self, status: str) -> list[str]:
        self.status = status
        return [status]


def decision(age: float | None, change1h: float | None, change4h: float | None) -> str:
    """Of an open-interest observation: missing, future, stale, rejected or pass; only the last two are fresh."""
    if any(x is None or not math.isfinite(x) for x in (age, change1h, change4h)):
        return "missing"
    return "future" if age < 0 else "stale" if age > OI_AGE else "pass" if change1h > 0 and change4h >= 3 else "rejected"


@dataclass
class DeepWatch:
    """From a setup whose quantity passed to expiry, a close under the trough, a missed move, or a close in the band above the level that
    fresh quantity confirms or rejects; without a fresh observation the watch waits and stays."""

    since: int = -1
    trough: float = 0.0
    level: float = 0.0
    atr: float = 0.0
    status: str = "none"
    last: int = -1
    seen: int = -1
    seq: int = -1

    def observe(self, r: dict) -> list[str]:
        """Events of one input: kind setup (trough, level, atr, age, change1h, change4h) or bar (high, px as close, and an observation)."""
        if (r["ts"], r["seq"]) <= (self.seen, self.seq):
            return []
        self.seen, self.seq = r["ts"], r["seq"]
        found = decision(r["age"], r["change1h"], r["change4h"])
        if r["kind"] == "setup":
            if self.status == "watching" or found != "pass" or not _price(r["trough"], r["level"], r["atr"]):
                return []
            self.since, self.trough, self.level, self.atr, self.status, self.last = r["ts"], r["trough"], r["level"], r["atr"], "watching", r["ts"]
            return ["armed"]
        if self.status != "watching" or not _price(r["px"], r["high"]) or r["ts"] <= self.last:
            return []
        if r["ts"] >= self.since + EXPIRY:
            return self._end("expired")
        if r["px"] < self.trough:
            return self._end("invalid")
        if r["high"] >= self.level + MISSED_ATR * self.atr:
            return self._end("missed")
        self.last = r["ts"]
        if not self.level <= r["px"] <= self.level + BAND_ATR * self.atr:
            return []
        if found == "pass":
            return self._end("confirmed")
        return self._end("oi-rejected") if found == "rejected" else ["oi-wait"]

    def due(self) -> int | None:
        return self.since + EXPIRY if self.status == "watching" else None

    def expire(self) -> list[str]:
        return self._end("expired")

    def _end(self, status: str) -> list[str]:
        self.status = status
        return [status]


def entry_watches(stream: DataFrame, width: int = 60, late: str = "0 seconds") -> DataFrame:
    """Events of entry watches from inputs with sym, ts, seq, kind, px and what EntryWatch reads; expiry needs no further input."""
    return timed.run(EntryWatch, stream, width, late)


def deep_watches(stream: DataFrame, width: int = 60, late: str = "0 seconds") -> DataFrame:
    return timed.run(DeepWatch, stream, width, late)


def valid(source: Column, since: Column, px: Column, support: Column, atr: Column, status: Column, last: Column, retry: Column) -> Column:
    """Whether a stored entry watch can be taken up again: each row is judged by itself, and what is unknown is not valid."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)
    timely = (since > 0) & ((last == -1) | ((last > since) & (last < since + EXPIRY))) & ((retry == -1) | ((retry > since) & (status == "ready")))
    return F.coalesce((source >= 0) & sound(px) & sound(support) & sound(atr) & (atr < support) & status.isin(*ACTIVE) & timely, F.lit(False))
