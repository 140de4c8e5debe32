"""The registry of indicators and the specs that calls make."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class Indicator:
    """build(frame, *inputs, **params) gives one column per output."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    params: dict
    build: Callable
    family: str

    def __call__(self, *columns: str, **params) -> Spec:
        unknown = set(params) - set(self.params)
        if unknown:
            raise TypeError(f"{self.name}: no parameter {sorted(unknown)}")
        if len(columns) > len(self.inputs):
            raise TypeError(f"{self.name} takes {self.inputs}")
        return Spec(self, (*columns, *self.inputs[len(columns) :]), self.params | params)


@dataclass(frozen=True)
class Spec:
    """A call of an indicator: its input columns and parameters, fixed when the plan is made."""

    indicator: Indicator
    columns: tuple
    params: dict = field(hash=False)

    def columns_of(self, frame) -> dict[str, Column]:
        made = self.indicator.build(frame, *(frame.value(c) for c in self.columns), **self.params)
        made = made if isinstance(made, tuple) else (made,)
        return dict(zip(self.indicator.outputs, made, strict=True))


INDICATORS: dict[str, Indicator] = {}


def indicator(*inputs: str, outputs: tuple[str, ...] = ("value",), family: str = "custom", name: str | None = None):
    """Registers build(frame, *input columns, **params with defaults)."""

    def register(build: Callable) -> Callable:
        params = {p.name: p.default for p in inspect.signature(build).parameters.values() if p.default is not inspect.Parameter.empty}
        own = name or build.__name__.rstrip("_")
        INDICATORS[own] = Indicator(own, tuple(inputs), tuple(outputs), params, build, family)
        return build

    return register
