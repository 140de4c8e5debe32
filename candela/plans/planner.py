"""Indicators(df, key, order).with_(...): many indicators in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import Frame
from .registry import Spec


class Indicators:
    """Collects indicator calls over one table and plans them together.

    Equal intermediate columns are computed once; all windows share one exchange and
    sort, and all recurrences of a layer run in one scan.

    block_bars: cut keys into blocks of so many bars, so that a key is spread over many
    tasks (see plans.blocks), or "auto".  For keys that are too long for one task each.
    """

    def __init__(self, df: DataFrame, key: str | list[str] = "key", order: str | list[str] = "ts", block_bars: int | str | None = None):
        self.df, self.key, self.order, self.block_bars = df, key, order, block_bars
        self.specs: dict[str, Spec] = {}

    def with_(self, **specs: Spec) -> Indicators:
        out = Indicators(self.df, self.key, self.order, self.block_bars)
        out.specs = self.specs | specs
        return out

    def planned(self, flat: bool = True) -> tuple[Frame, dict[str, Column]]:
        """The frame with all that the outputs need, and the outputs."""
        frame, outputs = Frame(self.df, self.key, self.order, self.block_bars), {}
        for name, spec in self.specs.items():
            made = spec.columns_of(frame)
            if len(made) == 1:
                outputs[name] = next(iter(made.values()))
            elif flat:
                outputs |= {f"{name}_{k}": c for k, c in made.items()}
            else:
                outputs[name] = F.struct(*(c.alias(k) for k, c in made.items()))
        return frame, outputs

    def frame(self, flat: bool = True, keep: list[str] | None = None) -> DataFrame:
        """df's columns and the outputs. flat: several outputs of a call as name_output columns, else as one struct."""
        frame, outputs = self.planned(flat)
        return frame.build(outputs, keep)


def trim(df: DataFrame, column: str) -> DataFrame:
    """The short form of a result: bars from the lookback on."""
    return df.filter(F.col(column).isNotNull())
