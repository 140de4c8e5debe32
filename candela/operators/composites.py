"""Indicators as single kernels over raw prices: what columns do around a kernel in a plan, done on arrays.

For SQL table functions, which have no columns around them.  Like kernels, these give the
same results however a series is cut into chunks.
"""

from __future__ import annotations

import numpy as np

from .kernels import Ema, FromFirst, Kama, WilderSum


class _Past:
    """The last n values of a series: NaN before its first bar."""

    def __init__(self, n: int):
        self.values = np.full(n, np.nan)

    def join(self, x: np.ndarray) -> np.ndarray:
        """The n values before x, then x."""
        both = np.concatenate([self.values, x])
        self.values = both[len(x) :]
        return both


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


class Rsi:
    def __init__(self, p: int):
        self.past, self.up, self.down = _Past(1), Ema(p, 1, 1.0 / p), Ema(p, 1, 1.0 / p)

    def push(self, x: np.ndarray) -> tuple[np.ndarray]:
        step = np.diff(self.past.join(x))
        side = lambda s: np.where(np.isnan(s), s, np.maximum(s, 0.0))
        (up,), (down,) = self.up.push(side(step)), self.down.push(side(-step))
        with np.errstate(all="ignore"):
            value = 100.0 - 100.0 / (1.0 + up / down)
        return (np.where(up == 0, 0.0, np.where(down == 0, 100.0, value)),)


class Adx:
    """A bar without a high or low spoils all that follow."""

    def __init__(self, p: int):
        self.high, self.low, self.begun, self.spoiled = _Past(1), _Past(1), False, False
        self.plus, self.minus, self.mean = WilderSum(p), WilderSum(p), Ema(p, p, 1.0 / p)

    def push(self, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray]:
        if not len(high):
            return (np.zeros(0),)
        up, down = np.diff(self.high.join(high)), -np.diff(self.low.join(low))
        sound = ~np.isnan(up) & ~np.isnan(down)
        plus = np.where(sound, np.where((up > down) & (up > 0), up, 0.0), np.nan)
        minus = np.where(sound, np.where((down > up) & (down > 0), down, 0.0), np.nan)
        if not self.begun:
            plus[0] = minus[0] = 0.0
            self.begun = True
        (p,), (m,) = self.plus.push(plus), self.minus.push(minus)
        bad = np.logical_or.accumulate(np.isnan(high) | np.isnan(low)) | self.spoiled
        self.spoiled = bool(bad[-1])
        return self.mean.push(np.where(bad, np.nan, _ratio(np.abs(p - m) * 100.0, p + m)))


class Adosc:
    def __init__(self, fast: int, slow: int):
        self.fast, self.slow, self.total = FromFirst(fast), FromFirst(slow), 0.0

    def push(self, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> tuple[np.ndarray]:
        span = high - low
        with np.errstate(all="ignore"):
            flow = np.where(high > low, (close + close - high - low) / span * volume, 0.0)
        line = np.cumsum(np.concatenate([[self.total], flow]))
        self.total = float(line[-1])
        return (self.fast.push(line[1:])[0] - self.slow.push(line[1:])[0],)


class KamaOf:
    """Kama with its efficiency ratios: the net move over the path of p bars; 0 once a NaN has come in."""

    def __init__(self, p: int):
        self.p, self.past, self.kernel, self.at, self.spoiled = p, _Past(p), Kama(p), 0, False

    def push(self, x: np.ndarray) -> tuple[np.ndarray]:
        if not len(x):
            return (np.zeros(0),)
        both = self.past.join(x)
        moves = np.abs(np.diff(both))
        # Moves before the second bar don't count.
        real = np.arange(self.at - self.p + 1, self.at + len(x)) >= 1
        path = np.lib.stride_tricks.sliding_window_view(np.where(real, moves, 0.0), self.p).sum(axis=1)
        bad = np.logical_or.accumulate(np.isnan(moves[self.p - 1 :]) & real[self.p - 1 :]) | self.spoiled
        self.spoiled, self.at = bool(bad[-1]), self.at + len(x)
        with np.errstate(all="ignore"):
            ratio = np.abs(x - both[: len(x)]) / path
        return self.kernel.push(x, np.where(bad | ~(path > 0) | np.isnan(ratio), 0.0, ratio))
