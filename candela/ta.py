"""Indicators by name: ta.sma("close", period=3), ta.macd(), ta.cdldoji(), ...

Each call gives a Spec for Indicators(df, key, order).with_(name=spec).  Columns
default to the inputs that the indicator names (close, high, low, ...).
"""

from __future__ import annotations

from .operators import patterns, recurrences, windows  # noqa: F401  they fill the registry
from .plans.registry import INDICATORS, Indicator


def __getattr__(name: str) -> Indicator:
    try:
        return INDICATORS[name]
    except KeyError:
        raise AttributeError(f"no indicator {name!r}") from None


def __dir__() -> list[str]:
    return sorted(INDICATORS)


def names(family: str | None = None) -> list[str]:
    return sorted(n for n, i in INDICATORS.items() if family in (None, i.family))
