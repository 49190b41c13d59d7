"""Paper arms: one stream of sweeps through four books, three that enter at once by ladders of their own and one that waits for the next sweep."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ladder:
    #: Prices of the targets and the stop, as multiples of the entry.
    targets: tuple[float, float, float]
    stop: float
    #: Parts sold at the targets; None sells all that is left.
    parts: tuple[float, float, float | None]
    hold: int = 1
    #: The stop moves to the entry once the first target is filled.
    breakeven: bool = False


#: Fixed values of the arms.
LADDERS = {
    "A": Ladder((1.04, 1.08, 1.15), 0.97, (0.5, 0.3, None)),
    "B": Ladder((1.1, 1.25, 1.5), 0.85, (0.3, 0.3, 0.35), 2, True),
    "C": Ladder((1.09, 1.09, 1.09), 0.8, (0.0, 0.0, None), 2),
}


@dataclass(frozen=True)
class Settings:
    equity: float = 10_000.0
    #: Share of the equity that a stop may cost, and the fee of each fill.
    risk: float = 0.01
    fee: float = 0.0005
    timeout: int = 48 * 3600
    most_open: int = 5
    #: A confirmed entry is filled at a later sweep, at most this long after its signal.
    fill_within: int = 45 * 60


@dataclass
class Arm:
    """One book. sweep() takes all marks of one time; positions are marked before any is opened, so what closes reopens at the next sweep at the earliest."""

    ladder: Ladder
    settings: Settings
    confirmed: bool = False
    equity: float = 0.0
    open: dict[str, dict] = field(default_factory=dict)
    pending: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.equity = self.equity or self.settings.equity

    def sweep(self, t: int, marks: dict[str, float], edges: list[str], enabled: bool = True) -> list[tuple]:
        """(sym, action, px, part, pnl, equity) rows. Edges count while entries are enabled; disabled, waiting signals expire and positions go on."""
        out, edges = [], edges if enabled else []
        due = self._due(t, marks, enabled, out) if self.confirmed else None
        for sym in list(self.open):
            px = marks.get(sym)
            if px is not None and px > 0:
                out += self._mark(t, sym, px)
        for sym in edges if due is None else due:
            opened = self._enter(t, sym, marks.get(sym))
            if due is not None:
                out.append((sym, "filled" if opened else "capacity", marks[sym], 0.0, 0.0, self.equity))
            out += opened
        if self.confirmed:
            for sym in edges:
                px = marks.get(sym)
                if sym not in self.open and sym not in self.pending and px is not None and px > 0:
                    self.pending[sym] = (t, px)
                    out.append((sym, "queued", px, 0.0, 0.0, self.equity))
        return out

    def _due(self, t: int, marks: dict[str, float], enabled: bool, out: list[tuple]) -> list[str]:
        due = []
        for sym, (since, px) in list(self.pending.items()):
            if not enabled or t > since + self.settings.fill_within:
                del self.pending[sym]
                out.append((sym, "expired", px, 0.0, 0.0, self.equity))
            elif t > since and (marks.get(sym) or 0) > 0:
                del self.pending[sym]
                due.append(sym)
        return due

    def _fill(self, sym: str, action: str, px: float, part: float) -> tuple:
        p = self.open[sym]
        size = part * p["size"]
        pnl = size * (px - p["px"]) - abs(size * px) * self.settings.fee
        p["left"] -= part
        self.equity += pnl
        return sym, action, px, part, pnl, self.equity

    def _mark(self, t: int, sym: str, px: float) -> list[tuple]:
        """At most one of stop and targets, the highest target first, at its own price; then a timeout of what is left."""
        p, ladder, out = self.open[sym], self.ladder, []
        if px <= p["stop"]:
            out.append(self._fill(sym, "stop", p["stop"], p["left"]))
        else:
            hit = next((i for i in (2, 1, 0) if px >= p["px"] * ladder.targets[i] and i not in p["done"]), None)
            if hit is not None:
                part = p["left"] if ladder.parts[hit] is None else min(ladder.parts[hit], p["left"])
                p["done"].add(hit)
                out.append(self._fill(sym, f"tp{hit + 1}", p["px"] * ladder.targets[hit], part))
                if hit == 0 and ladder.breakeven:
                    p["stop"] = max(p["stop"], p["px"])
        if p["left"] > 1e-9 and t - p["t"] > self.settings.timeout * ladder.hold:
            out.append(self._fill(sym, "timeout", px, p["left"]))
        if p["left"] <= 1e-9:
            del self.open[sym]
        return out

    def _enter(self, t: int, sym: str, px: float | None) -> list[tuple]:
        if px is None or not px > 0 or sym in self.open or len(self.open) >= self.settings.most_open:
            return []
        size = self.equity * self.settings.risk / (px * (1 - self.ladder.stop))
        if not size > 0:
            return []
        fee = px * size * self.settings.fee
        self.equity -= fee
        self.open[sym] = {"t": t, "px": px, "size": size, "left": 1.0, "stop": px * self.ladder.stop, "done": set()}
        return [(sym, "open", px, 1.0, -fee, self.equity)]


SCHEMA = "book string, arm string, t long, i int, sym string, action string, px double, part double, pnl double, equity double"


def arms(sweeps: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(book, arm, t, i, sym, action, px, part, pnl, equity): fills of the arms A, B, C and confirmed, and the confirmed arm's queue.

    sweeps: book, t, seq, sym, px, edge, enabled; rows of one book and t are one sweep, of a symbol's rows in it the last by seq counts. Every
    arm of every book is a key of its own; a task holds one sweep and the open positions of one arm.
    """
    settings = settings or Settings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, held = None, None, []

        def done(rows: list[tuple]) -> list[tuple]:
            nonlocal key, own
            if not rows:
                return []
            book, arm, t = rows[0][:3]
            if (book, arm) != key:
                key = book, arm
                own = Arm(LADDERS[arm if arm in LADDERS else "A"], settings, arm not in LADDERS)
            last = {r[3]: r for r in rows}
            marks = {s: r[4] for s, r in last.items() if r[4] == r[4]}
            found = own.sweep(int(t), marks, [s for s, r in last.items() if r[5]], all(r[6] for r in rows))
            return [(book, arm, int(t), i, *x) for i, x in enumerate(found)]

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            rows = zip(*(pdf[c].tolist() for c in ("book", "arm", "t", "sym", "px", "edge", "enabled")), strict=True)
            for sweep, members in groupby(rows, key=lambda r: r[:3]):
                if held and held[0][:3] != sweep:
                    out += done(held)
                    held = []
                held += members
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(held), columns=names)

    each = F.explode(F.array(*map(F.lit, [*LADDERS, "confirmed"])))
    rows = sweeps.select("book", each.alias("arm"), "t", "seq", "sym", F.col("px").cast("double").alias("px"), F.coalesce("edge", F.lit(False)).alias("edge"), F.coalesce("enabled", F.lit(True)).alias("enabled"))
    return rows.repartition("book", "arm").sortWithinPartitions("book", "arm", "t", "seq").mapInPandas(run, SCHEMA)


def blotter_lines(rows: DataFrame) -> DataFrame:
    """(book, arm, sym, opened, entry, action, at, px, part, pnl): one line an open and one a fill, ready for a CSV writer; queue rows are left out."""
    fills = rows.where(~F.col("action").isin("queued", "filled", "expired", "capacity"))
    w = Window.partitionBy("book", "arm", "sym").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    began = F.last(F.when(F.col("action") == "open", F.struct(F.col("t").alias("t"), F.col("px").alias("px"))), ignorenulls=True).over(w)
    return fills.withColumn("o", began).select("book", "arm", "sym", F.col("o.t").alias("opened"), F.col("o.px").alias("entry"), "action", F.col("t").alias("at"), "px", "part", "pnl")
