"""Indicators of the user's own: from a column-building function or a kernel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .functions.numerics import ieee_div
from .operators.kernels import Maker
from .plans.registry import INDICATORS, Indicator, Spec, indicator


def register_indicator(name: str, inputs: tuple[str, ...], build: Callable | None = None, kernel: type | None = None, outputs: tuple[str, ...] = ("value",), lookback: Callable[..., int] | int = 0, **params) -> Indicator:
    """Adds ta.<name>.

    build(frame, *inputs, **params) gives one column per output.  Or kernel: a class
    whose push(*arrays) gives one array per output (see operators.kernels), made with
    the parameters; lookback: bars without a value, or a function of the parameters.
    """
    if (build is None) == (kernel is None):
        raise ValueError("give build or kernel")
    if kernel is not None:

        def build(f, *columns, **given):
            start = lookback(**given) if callable(lookback) else lookback
            return tuple(f.gate(c, start) for c in f.scan(Maker(kernel, **given), list(columns), len(outputs)))

    INDICATORS[name] = Indicator(name, tuple(inputs), tuple(outputs), params, build, "custom")
    return INDICATORS[name]


@indicator("high", "low", "close", "volume", family="custom", name="_vwap")
def vwap(f, h, l, c, v, period=14):  # noqa: E741
    """Rolling volume-weighted price: the worked example of a custom indicator. NaN over a window without volume."""
    weighted = f.add((h + l + c) / 3.0 * v)
    value = ieee_div(f.sum(weighted, period), f.sum(v, period))
    return f.gate(F.when(f.sum(v, period) == 0, F.lit(float("nan"))).otherwise(value), period - 1, f.poisoned(weighted, period))


VWAP = INDICATORS.pop("_vwap")


def vwap_spec(*columns: str, **params) -> Spec:
    return VWAP(*columns, **params)
