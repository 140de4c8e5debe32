"""The layered plan that indicators are built in.

An indicator asks the frame for intermediate columns: window expressions (`add`)
and ordered scans (`scan`).  Equal requests are made once.  `build` arranges them
in stages: a column's stage is the number of scans on its longest way from the
bars, so all scans that don't need each other's outputs share one pass.  Within a
stage, expressions that build on each other are layers of projections.

A stage with windows has one exchange on the key and one sort, for its windows and
its scan together.  A later stage without windows has neither: the rows leave a
scan as they came in, by key and in order, and go straight into the next one.
Columns that nothing later needs are dropped before a scan.

With `block_bars` a key's bars are cut into blocks of so many bars, and no task holds
a whole key (see plans.blocks): windows are over a block and its halo, running values
wait for the end of the stage, as scans do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import INF, NAN, number
from . import blocks as B
from .scan import ordered_scan

_TEMP = re.compile(r"__t\d+_\d*")


class Frame:
    """df with a key and an order. order: columns that order a key's bars without ties.

    block_bars: bars of a block, if keys are too long for one task; more if windows or seeds need more.
    "auto": by the number of bars and of tasks.
    """

    def __init__(self, df: DataFrame, key: str | list[str], order: str | list[str], block_bars: int | str | None = None):
        self.df, self.block_bars = df, block_bars
        self.keys = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        self.window = Window.partitionBy(*self.keys, B.BLOCK).orderBy(B.BAR) if block_bars else Window.partitionBy(*self.keys).orderBy(*self.order)
        self._known: dict[str, str] = {}
        self._exprs: dict[tuple[int, int], list[tuple[str, Column]]] = {}
        self._scans: dict[int, list[tuple[str, Callable, list[str], int]]] = {}
        self._runs: dict[int, list[tuple[str, str, str]]] = {}
        self._level: dict[str, int] = {}
        self._stage: dict[str, int] = {}

    # -- intermediate columns

    def _place(self, expression: Column) -> tuple[int, int]:
        """(stage, layer): the first in which all that the expression names is there."""
        names = set(_TEMP.findall(str(expression)))
        stage = max((self._stage[n] for n in names), default=0)
        return stage, max((self._level[n] + 1 for n in names if self._stage[n] == stage), default=0)

    def add(self, expression: Column) -> Column:
        text = str(expression)
        if text[8:-2] in self._level:
            return expression
        if text not in self._known:
            name = f"__t{len(self._level)}_"
            place = self._place(expression)
            self._stage[name], self._level[name] = place
            self._exprs.setdefault(place, []).append((name, expression))
            self._known[text] = name
        return F.col(self._known[text])

    def scan(self, kernel: Callable, inputs: list[Column], outputs: int = 1) -> list[Column]:
        """Columns that a kernel makes of the inputs, bar by bar in order. kernel: makes a fresh state (see operators.kernels)."""
        text = f"{getattr(kernel, 'label', kernel)}({', '.join(map(str, inputs))})"
        if text not in self._known:
            ins = [_TEMP.search(str(self.add(c)))[0] for c in inputs]
            stage = max((self._stage[n] for n in ins), default=0)
            base = f"__t{len(self._level)}_"
            self._scans.setdefault(stage, []).append((base, kernel, ins, outputs))
            for name in (base, *(f"{base}{k}" for k in range(outputs))):
                self._stage[name], self._level[name] = stage + 1, -1
            self._known[text] = base
        return [F.col(f"{self._known[text]}{k}") for k in range(outputs)]

    # -- what indicators are made of

    def rows(self, start: int, end: int):
        return self.window.rowsBetween(start, end)

    def trailing(self, p: int):
        return self.window.rowsBetween(1 - p, 0)

    @property
    def rn(self) -> Column:
        """0-based index of the bar in its key."""
        return F.col(B.BAR) if self.block_bars else self.add(F.row_number().over(self.window) - F.lit(1))

    def value(self, c: str | Column) -> Column:
        return number(F.col(f"`{c}`") if isinstance(c, str) else c)

    def lag(self, x: Column, k: int) -> Column:
        return self.add(F.lag(x, k).over(self.window)) if k else x

    def mean(self, x: Column, p: int) -> Column:
        return self.add(F.avg(x).over(self.trailing(p)))

    def sum(self, x: Column, p: int) -> Column:
        return self.add(F.sum(x).over(self.trailing(p)))

    def highest(self, x: Column, p: int) -> Column:
        return self.add(F.max(x).over(self.trailing(p)))

    def lowest(self, x: Column, p: int) -> Column:
        return self.add(F.min(x).over(self.trailing(p)))

    def running(self, op: str, x: Column) -> Column:
        """Sum or max ("sum", "max") of x over the key's bars so far."""
        if not self.block_bars:
            return self.add({"sum": F.sum, "max": F.max}[op](x).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))
        text = f"{op} so far ({x})"
        if text not in self._known:
            name = _TEMP.search(str(self.add(x)))[0]
            made = f"__t{len(self._level)}_"
            self._runs.setdefault(self._stage[name], []).append((made, op, name))
            self._stage[made], self._level[made] = self._stage[name] + 1, -1
            self._known[text] = made
        return F.col(self._known[text])

    def poisoned(self, x: Column, p: int) -> Column:
        """Whether a running sum over p bars would be NaN for good: a NaN came in, or an infinity went out."""
        spoils = F.isnan(x) | (F.abs(F.coalesce(self.lag(x, p), F.lit(0.0))) == INF)
        return self.running("max", spoils)

    def gate(self, value: Column, lookback: int, bad: Column | None = None) -> Column:
        """NULL before the lookback, NaN where `bad`."""
        out = value if bad is None else F.when(bad, F.lit(NAN)).otherwise(value)
        return F.when(self.rn >= lookback, out)

    # -- the plan

    def _live(self, stage: int, columns: list[str], outputs: dict[str, Column], kept: list[str]) -> list[str]:
        """The columns that the scan of a stage or anything after it needs."""
        texts = [str(e) for (s, _), es in self._exprs.items() if s > stage for _, e in es]
        needed = set(re.findall(r"\w+", " ".join([*texts, *map(str, outputs.values())])))
        needed.update(n for s, scans in self._scans.items() if s >= stage for _, _, ins, _ in scans for n in ins)
        needed.update(n for s, runs in self._runs.items() if s >= stage for _, _, n in runs)
        return [c for c in columns if c in needed or c in kept or not re.fullmatch(r"\w+", c)]

    def _block_size(self) -> tuple[int, dict[int, int]]:
        """Bars of a block, and how far back the windows of each stage reach together."""
        back: dict[str, int] = {}
        halo: dict[int, int] = {}
        for stage, layer in sorted(self._exprs):
            for name, e in self._exprs[stage, layer]:
                text = str(e)
                behind = max((back[n] for n in _TEMP.findall(text) if self._stage[n] == stage and n in back), default=0)
                back[name] = behind + B.reach(text)
                halo[stage] = max(halo.get(stage, 0), back[name])
        asked = 1 if self.block_bars == "auto" else self.block_bars
        warm = [scan[1]().warmup for scans in self._scans.values() for scan in scans if B.is_linear(scan)]
        return max([asked, *(h + 1 for h in halo.values()), *(w + 1 for w in warm)]), halo

    def _build_blocks(self, outputs: dict[str, Column], kept: list[str]) -> DataFrame:
        size, halo = self._block_size()
        # Written to the shared folder: with the columns that anything names, which a scan would prune to.
        df = self.df.select(*(F.col(f"`{c}`") for c in self._live(-1, self.df.columns, outputs, [*kept, *self.keys, *self.order])))
        df, size = B.blocked(df, self.keys, self.order, size, self.block_bars == "auto")
        for stage in range(1 + max([*(s for s, _ in self._exprs), *self._scans, *self._runs], default=-1)):
            layers = [self._exprs[at] for at in sorted(self._exprs) if at[0] == stage]
            windows = any(B.has_window(str(e)) for layer in layers for _, e in layer)
            if windows:
                df = B.with_halo(df, size, halo.get(stage, 0))
            for layer in layers:
                df = df.withColumns(dict(layer))
            if windows:
                df = B.without_halo(df, size)
            scans, runs = self._scans.get(stage, []), self._runs.get(stage, [])
            if scans or runs:
                live = self._live(stage, df.columns, outputs, [*kept, *self.keys, *self.order, B.BAR, B.BLOCK])
                df = B.barrier(df.select(*(F.col(f"`{c}`") for c in live)), self.keys, size, scans, runs, written=stage == 0 and not windows)
        return df.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in outputs.items()))

    def build(self, outputs: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
        df = self.df
        kept = self.df.columns if keep is None else keep
        if self.block_bars:
            return self._build_blocks(outputs, kept)
        for stage in range(1 + max([*(s for s, _ in self._exprs), *self._scans], default=-1)):
            layers = [self._exprs[at] for at in sorted(self._exprs) if at[0] == stage]
            dealt = stage == 0 or any(" OVER (" in str(e) for layer in layers for _, e in layer)
            if dealt and stage in self._scans:
                df = df.repartition(*(F.col(f"`{k}`") for k in self.keys))
            for layer in layers:
                df = df.withColumns(dict(layer))
            if stage in self._scans:
                live = self._live(stage, df.columns, outputs, [*kept, *self.keys, *self.order])
                df = df.select(*(F.col(f"`{c}`") for c in live))
                if dealt:
                    df = df.sortWithinPartitions(*(F.col(f"`{c}`") for c in [*self.keys, *self.order]))
                df = ordered_scan(df, self.keys, self._scans[stage])
        return df.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in outputs.items()))
