"""Keyed books: paper positions, portfolio limits, blotters. Each book is a fold in time order.

Books are independent, so they are dealt over the cluster; within a task rows pass by sorted and only open positions are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Rules:
    most_open: int = 5
    stop: float = 0.03
    targets: tuple[float, ...] = (0.04, 0.08, 0.15)
    parts: tuple[float, ...] = (0.5, 0.3, 0.2)
    timeout: int = 48 * 3600
    fill_within: int = 45 * 60
    #: A day's realised loss that blocks entries, and a fall from the peak that locks the book.
    day_loss: float = 0.3
    lock: float = 0.9


@dataclass
class Book:
    rules: Rules
    open: dict[str, dict] = field(default_factory=dict)
    intents: dict[str, int] = field(default_factory=dict)
    equity: float = 1.0
    peak: float = 1.0
    day: int = -1
    day_pnl: float = 0.0

    def tick(self, t: int, sym: str, px: float, edge: bool) -> list[tuple]:
        """(t, sym, action, px, part, pnl) rows. Exits come before entries; one fill a position and tick, stop first, then the highest target; then a timeout of the rest."""
        r, out = self.rules, []
        if t // 86400 != self.day:
            self.day, self.day_pnl = t // 86400, 0.0
        p = self.open.get(sym)
        if p is not None and px > 0:
            gain = px / p["px"] - 1
            if gain <= -r.stop:
                out.append(self._fill(t, sym, "stop", px, p["left"], -r.stop))
            else:
                hit = [i for i, x in enumerate(r.targets) if gain >= x and i not in p["done"]]
                if hit:
                    i = hit[-1]
                    part = p["left"] if i == len(r.targets) - 1 else min(r.parts[i], p["left"])
                    p["done"].add(i)
                    out.append(self._fill(t, sym, f"tp{i + 1}", px, part, r.targets[i]))
                if sym in self.open and t - p["t"] >= r.timeout:
                    out.append(self._fill(t, sym, "timeout", px, p["left"], gain))
        due = self.intents.pop(sym, None)
        if due is not None and t > due and t - due <= r.fill_within and sym not in self.open and len(self.open) < r.most_open and px > 0 and not self.blocked():
            self.open[sym] = {"t": t, "px": px, "left": 1.0, "done": set()}
            out.append((t, sym, "open", px, 1.0, 0.0))
        if edge and sym not in self.open:
            self.intents[sym] = t
        return out

    def blocked(self) -> bool:
        return self.day_pnl <= -self.rules.day_loss or self.equity <= self.peak * (1 - self.rules.lock)

    def _fill(self, t: int, sym: str, action: str, px: float, part: float, gain: float) -> tuple:
        p = self.open[sym]
        pnl = part * gain / self.rules.most_open
        p["left"] -= part
        self.equity, self.day_pnl = self.equity * (1 + pnl), self.day_pnl + pnl
        self.peak = max(self.peak, self.equity)
        if p["left"] <= 1e-9:
            del self.open[sym]
        return t, sym, action, px, part, pnl


@dataclass
class Policy:
    """Limits of a portfolio, as shares of its equity; the stop turns risk into size."""

    most_open: int = 4
    risk: float = 0.005
    open_risk: float = 0.02
    size: float = 0.2
    stop: float = 0.03
    fill_within: int = 45 * 60
    slot: int = 900
    #: A day's realised loss that blocks entries until the next, and a fall from the peak that locks for good.
    day_loss: float = 0.02
    lock: float = 0.1


@dataclass
class Portfolio:
    policy: Policy
    equity: float = 10_000.0
    peak: float = 10_000.0
    day: int = -1
    day_start: float = 10_000.0
    day_pnl: float = 0.0
    blocked: bool = False
    locked: bool = False
    open: dict[str, dict] = field(default_factory=dict)

    def _roll(self, t: int) -> None:
        if t // 86400 != self.day:
            self.day, self.day_start, self.day_pnl, self.blocked = t // 86400, self.equity, 0.0, False

    def enter(self, t: int, sym: str, bar_t: int | None, px: float | None, eligible: bool = True) -> tuple[str, float]:
        """(outcome, notional): `opened`, or the first of the limits that speaks against it. The fill is the open of the next slot after t."""
        self._roll(t)
        p = self.policy
        risk = self.equity * p.risk
        reasons = [
            ("not-eligible", not eligible), ("drawdown-lock", self.locked), ("day-loss", self.blocked), ("no-bar", bar_t is None or px is None or bar_t != -(-t // p.slot) * p.slot),
            ("too-late", bar_t is not None and bar_t - t > p.fill_within), ("held", sym in self.open), ("full", len(self.open) >= p.most_open),
            ("open-risk", sum(x["risk"] for x in self.open.values()) + risk > self.equity * p.open_risk + 1e-9),
        ]
        for reason, against in reasons:
            if against:
                return reason, 0.0
        notional = min(risk / p.stop, self.equity * p.size)
        if not (notional > 0 and px > 0):
            return "invalid", 0.0
        self.open[sym] = {"notional": notional, "risk": risk, "px": px}
        return "opened", notional

    def settle(self, t: int, sym: str, net: float) -> tuple[str, float]:
        """(outcome, gain or loss) of closing a position at a net return."""
        self._roll(t)
        if sym not in self.open or net != net:
            return "ignored", 0.0
        pnl = self.open.pop(sym)["notional"] * net
        self.equity = max(0.0, self.equity + pnl)
        self.peak, self.day_pnl = max(self.peak, self.equity), self.day_pnl + pnl
        self.blocked = self.blocked or self.day_pnl <= -self.day_start * self.policy.day_loss
        self.locked = self.locked or (self.peak - self.equity) / self.peak >= self.policy.lock
        return "settled", pnl


def portfolios(inputs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(book, t, sym, outcome, amount, equity) from inputs (book, t, seq, sym, kind enter or settle, bar_t, px, net): one row an input."""
    policy = policy or Policy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, None
        for pdf in batches:
            out = []
            for name, t, sym, kind, bar_t, px, net in zip(*(pdf[c] for c in ("book", "t", "sym", "kind", "bar_t", "px", "net")), strict=True):
                if name != key:
                    key, own = name, Portfolio(policy)
                known = lambda x, as_type: None if x is None or x != x else as_type(x)
                done = own.enter(int(t), sym, known(bar_t, int), known(px, float)) if kind == "enter" else own.settle(int(t), sym, float(net))
                out.append((name, int(t), sym, *done, own.equity))
            yield pd.DataFrame(out, columns=["book", "t", "sym", "outcome", "amount", "equity"])

    rows = inputs.select("book", "t", "seq", "sym", "kind", "bar_t", "px", "net").repartition("book").sortWithinPartitions("book", "t", "seq")
    return rows.mapInPandas(run, "book string, t long, sym string, outcome string, amount double, equity double")


def ledger(ticks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(book, t, sym, action, px, part, pnl, equity) from ticks (book, t, seq, sym, px, edge)."""
    rules = rules or Rules()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, book = None, None
        for pdf in batches:
            out = []
            for name, t, sym, px, edge in zip(pdf["book"], pdf["t"], pdf["sym"], pdf["px"], pdf["edge"], strict=True):
                if name != key:
                    key, book = name, Book(rules)
                out += [(name, *row, book.equity) for row in book.tick(int(t), sym, float(px), bool(edge))]
            yield pd.DataFrame(out, columns=["book", "t", "sym", "action", "px", "part", "pnl", "equity"])

    rows = ticks.select("book", "t", "seq", "sym", "px", "edge").repartition("book").sortWithinPartitions("book", "t", "seq")
    return rows.mapInPandas(run, "book string, t long, sym string, action string, px double, part double, pnl double, equity double")


def blotter(rows: DataFrame) -> DataFrame:
    """Fills grouped into positions: a position starts at each open of a book and symbol."""
    w = Window.partitionBy("book", "sym").orderBy("t", (F.col("action") == "open").cast("int"))
    opened = (F.col("action") == "open").cast("int")
    rows = rows.withColumn("pos", F.sum(opened).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fill = F.col("action") != "open"
    return rows.groupBy("book", "sym", "pos").agg(
        F.min("t").alias("opened"), F.max(F.when(fill, F.col("t"))).alias("last_fill"), F.count_if(fill).alias("fills"), F.sum(F.when(fill, F.col("part"))).alias("closed"), F.sum("pnl").alias("pnl")
    )


def daily_sides(rows: DataFrame) -> DataFrame:
    """(day, side, n, win_rate, total, mean) of trades (since, side, net)."""
    return rows.groupBy(F.floor(F.col("since") / 86400).cast("long").alias("day"), "side").agg(F.count("*").alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.sum("net").alias("total"), F.avg("net").alias("mean"))
