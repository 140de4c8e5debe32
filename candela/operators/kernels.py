"""Stateful kernels (classes S3 and S4): recurrences over a key's bars in order.

A kernel is made once per key and is pushed consecutive chunks of bars, as arrays;
it returns arrays of the same length.  Splitting a series into other chunks gives
the same results, so one definition serves batch scans, streaming state and tests.
State is a few numbers and short rings; kernels pickle.

Bars before a recurrence's first value are NaN here; the planner turns the lookback
into NULL.  A NaN that enters a recurrence stays, as it would in the arithmetic.
"""

from __future__ import annotations

import math
import operator
from collections import deque
from functools import reduce

import numpy as np
import pandas as pd

from .linear import Linear, compose

NAN = float("nan")


class Maker:
    """Makes fresh kernels; equal makers have equal labels."""

    def __init__(self, kind: type, *args, **options):
        self.kind, self.args, self.options = kind, args, options
        self.label = f"{kind.__name__}{args}{sorted(options.items())}"

    def __call__(self):
        return self.kind(*self.args, **self.options)


def smooth(last: float, x: np.ndarray, k: float) -> np.ndarray:
    """y = x k + y (1 - k) from y = last on; NaN for good after the first NaN."""
    out = np.full(len(x), NAN)
    if math.isnan(last):
        return out
    spoiled = np.flatnonzero(np.isnan(x))
    n = int(spoiled[0]) if len(spoiled) else len(x)
    if n:
        out[:n] = pd.Series(np.concatenate(([last], x[:n]))).ewm(alpha=k, adjust=False).mean().to_numpy()[1:]
    return out


class Ema(Linear):
    """Exponential mean. Its seed, the mean of bars first .. first + p - 1, is the value of that last bar.

    k: 2 / (p + 1) if not given; p = 1 / k makes it Wilder's mean.
    """

    def __init__(self, p: int, first: int = 0, k: float | None = None):
        self.p, self.first, self.k = p, first, 2.0 / (p + 1) if k is None else k
        self.seed_at = first + p - 1
        self.warmup = self.seed_at + 1
        self.at, self.total, self.last = 0, 0.0, NAN

    def enter(self, at: int, state: np.ndarray) -> None:
        self.at, self.last = at, float(state[0])

    def leave(self) -> np.ndarray:
        return np.array([self.last])

    def step(self) -> np.ndarray:
        return np.array([[1.0 - self.k]])

    def push(self, x: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(x), NAN)
        lo, rest = self.first - self.at, 0
        if self.at <= self.seed_at:
            rest = self.seed_at - self.at + 1
            for v in x[max(0, lo) : rest].tolist():
                self.total += v
            if rest <= len(x):
                self.last = out[rest - 1] = self.total / self.p
        if rest < len(x):
            out[rest:] = smooth(self.last, x[rest:], self.k)
            self.last = float(out[-1])
        self.at += len(x)
        return (out,)


class Chain(Linear):
    """`count` exponential means, each of the one before; each seeds on its input's first p values. Gives all of them."""

    def __init__(self, p: int, count: int, first: int = 0):
        self.parts = [Ema(p, first + j * (p - 1)) for j in range(count)]
        self.states, self.warmup = count, self.parts[-1].warmup

    def enter(self, at: int, state: np.ndarray) -> None:
        for part, v in zip(self.parts, state):
            part.enter(at, [v])

    def leave(self) -> np.ndarray:
        return np.array([part.last for part in self.parts])

    def step(self) -> np.ndarray:
        # A mean takes the share k of the one before it, which has moved already.
        k = self.parts[0].k
        return np.array([[(1.0 - k) * k ** (j - i) if i <= j else 0.0 for i in range(self.states)] for j in range(self.states)])

    def push(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for part in self.parts:
            (x,) = part.push(x)
            out.append(x)
        return out


class Macd(Linear):
    """macd, signal, histogram: the fast mean seeds on the last `fast` bars of the slow one's seed."""

    def __init__(self, fast: int, slow: int, signal: int, fast_k: float | None = None, slow_k: float | None = None):
        self.fast, self.slow = Ema(fast, slow - fast, fast_k), Ema(slow, 0, slow_k)
        self.signal = Ema(signal, slow - 1)
        self.states, self.warmup = 3, self.signal.warmup

    def enter(self, at: int, state: np.ndarray) -> None:
        for part, v in zip((self.fast, self.slow, self.signal), state):
            part.enter(at, [v])

    def leave(self) -> np.ndarray:
        return np.array([self.fast.last, self.slow.last, self.signal.last])

    def step(self) -> np.ndarray:
        f, s, g = 1.0 - self.fast.k, 1.0 - self.slow.k, self.signal.k
        return np.array([[f, 0.0, 0.0], [0.0, s, 0.0], [g * f, -g * s, 1.0 - g]])

    def push(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        line = self.fast.push(x)[0] - self.slow.push(x)[0]
        (signal,) = self.signal.push(line)
        return line, signal, line - signal


class FromFirst(Linear):
    """Exponential mean that starts at the first bar's value, without a seed mean."""

    def __init__(self, p: int):
        self.k, self.last, self.begun = 2.0 / (p + 1), NAN, False

    def enter(self, at: int, state: np.ndarray) -> None:
        self.last, self.begun = float(state[0]), True

    def leave(self) -> np.ndarray:
        return np.array([self.last])

    def step(self) -> np.ndarray:
        return np.array([[1.0 - self.k]])

    def push(self, x: np.ndarray) -> tuple[np.ndarray]:
        out = np.empty(len(x))
        skip = 0
        if not self.begun and len(x):
            self.last, self.begun, skip = float(x[0]), True, 1
            out[0] = self.last
        if skip < len(x):
            out[skip:] = smooth(self.last, x[skip:], self.k)
            self.last = float(out[-1])
        return (out,)


class WilderSum(Linear):
    """Wilder's running sum: values 1 .. p - 1 are added up, then s = s - s / p + v. NaN before bar p - 1."""

    def __init__(self, p: int):
        self.p, self.at, self.total = p, 0, 0.0
        self.warmup = p

    def enter(self, at: int, state: np.ndarray) -> None:
        self.at, self.total = at, float(state[0])

    def leave(self) -> np.ndarray:
        return np.array([self.total])

    def step(self) -> np.ndarray:
        return np.array([[1.0 - 1.0 / self.p]])

    def push(self, v: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(v), NAN)
        p, rest = self.p, 0
        if self.at <= p - 1:
            rest = min(len(v), p - self.at)
            for j in range(rest):
                if self.at + j >= 1:
                    self.total += float(v[j])
            if self.at + rest == p and rest:
                out[rest - 1] = self.total
        if rest < len(v):
            out[rest:] = smooth(self.total / p, v[rest:], 1.0 / p) * p
            self.total = float(out[-1])
        self.at += len(v)
        return (out,)


class Kama(Linear):
    """y += c (x - y), with the squared smoothing constant c of each bar from its efficiency ratio; y starts at bar p - 1."""

    def __init__(self, p: int):
        self.start, self.at, self.y = p - 1, 0, NAN
        self.warmup = p

    def enter(self, at: int, state: np.ndarray) -> None:
        self.at, self.y = at, float(state[0])

    def leave(self) -> np.ndarray:
        return np.array([self.y])

    @staticmethod
    def constants(ratio: np.ndarray) -> np.ndarray:
        return (ratio * (2.0 / 3.0 - 2.0 / 31.0) + 2.0 / 31.0) ** 2

    def decay(self, x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        return np.array([[np.prod(1.0 - self.constants(ratio))]])

    def push(self, x: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(x), NAN)
        # Bars up to the start have no value; the start's price is the first state.
        skip = min(len(x), max(0, self.start - self.at + 1))
        if skip and self.at + skip == self.start + 1:
            self.y = float(x[skip - 1])
        if skip < len(x):
            c = self.constants(ratio[skip:])
            out[skip:] = compose(1.0 - c, c * x[skip:], self.y)
            self.y = float(out[-1])
        self.at += len(x)
        return (out,)


def _least(*xs: float) -> float:
    """Smallest that isn't NaN."""
    return min((x for x in xs if x == x), default=NAN)


def _most(*xs: float) -> float:
    return max((x for x in xs if x == x), default=NAN)


class Sar:
    """Parabolic stop and reverse with factors (initial, step, limit) for either side.

    start: the first stop, if not 0. offset: added at reversals. signed: stops of a
    short side are negative.
    """

    def __init__(self, long: tuple[float, float, float], short: tuple[float, float, float], start: float = 0.0, offset: float = 0.0, signed: bool = False):
        self.factors = {True: long, False: short}
        self.start, self.offset, self.signed = start, offset, signed
        self.bars: deque = deque(maxlen=3)
        self.at, self.up, self.extreme, self.stop, self.pace = 0, True, NAN, NAN, 0.0

    def _begin(self, before: tuple[float, float], now: tuple[float, float]) -> None:
        up = now[0] >= before[0]
        if math.isnan(now[0] if up else now[1]):
            up = not up
        self.up, self.extreme = up, now[0] if up else now[1]
        self.stop = self.start if self.start != 0.0 else before[1] if up else before[0]
        self.pace = self.factors[up][0]

    def _advance(self, high: float, low: float) -> float:
        # A short side is a long side on mirrored prices.
        sign = 1.0 if self.up else -1.0
        here = (high, low) if self.up else (-low, -high)
        past = [(b[0], b[1]) if self.up else (-b[1], -b[0]) for b in self.bars]
        past = past[-2:] if self.at >= 3 else past[-1:]
        extreme, stop = sign * self.extreme, sign * self.stop
        stop = _least(stop + self.pace * (extreme - stop), *(lo for _, lo in past))
        if here[1] <= stop:
            turned = _most(extreme, *(hi for hi, _ in past)) + self.offset
            self.up, self.extreme = not self.up, sign * here[1]
            self.pace = self.factors[self.up][0]
            return sign * turned
        if here[0] > extreme:
            self.extreme = sign * here[0]
            self.pace = _least(self.pace + self.factors[self.up][1], self.factors[self.up][2])
        return sign * stop

    def push(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(high), NAN)
        for j, bar in enumerate(zip(high.tolist(), low.tolist())):
            if self.at == 1:
                self._begin(self.bars[-1], bar)
            if self.at:
                self.stop = self._advance(*bar)
                out[j] = -self.stop if self.signed and not self.up else self.stop
            self.bars.append(bar)
            self.at += 1
        return (out,)


#: Fixed values of the discrete Hilbert transform.
HILBERT_A, HILBERT_B = 0.0962, 0.5769


class _Quadrature:
    """A Hilbert stage: four taps on the bar itself and those two, four and six bars before it."""

    def __init__(self):
        # The last three inputs of bars of either parity.
        self.past = [deque([0.0] * 3, maxlen=3) for _ in range(2)]

    def __call__(self, x: float, parity: int, gain: float) -> float:
        six, four, two = self.past[parity]
        self.past[parity].append(x)
        return (HILBERT_A * x - HILBERT_A * six - HILBERT_B * four + HILBERT_B * two) * gain


class _Cycle:
    """In-phase and quadrature parts of the smoothed price, and the dominant period.

    warmup: bars after the first three that only fill the price smoother.
    """

    def __init__(self, warmup: int):
        self.warmup, self.at = warmup, 0
        self.prices: deque = deque(maxlen=4)
        self.detrend, self.quadrature, self.advance_i, self.advance_q = (_Quadrature() for _ in range(4))
        self.delay = [[0.0, 0.0], [0.0, 0.0]]  # detrended values two and three bars back, as either parity sees them
        self.before = 0j  # smoothed phasor of the last bar
        self.product = 0j
        self.period = self.smooth_period = 0.0
        self.smoothed = NAN
        self.inphase = self.quad = 0.0

    def take(self, price: float) -> bool:
        """Whether the bar is one that the engine runs on."""
        self.prices.append(price)
        t, self.at = self.at, self.at + 1
        if t < 3 + self.warmup:
            return False
        p = self.prices
        self.smoothed = (4.0 * p[-1] + 3.0 * p[-2] + 2.0 * p[-3] + p[-4]) / 10.0
        gain, parity = 0.075 * self.period + 0.54, t % 2
        detrended = self.detrend(self.smoothed, parity, gain)
        self.quad = self.quadrature(detrended, parity, gain)
        self.inphase = self.delay[parity][1]
        ahead_i = self.advance_i(self.inphase, parity, gain)
        ahead_q = self.advance_q(self.quad, parity, gain)
        other = self.delay[1 - parity]
        other[1], other[0] = other[0], detrended
        phasor = 0.2 * complex(self.inphase - ahead_q, self.quad + ahead_i) + 0.8 * self.before
        turn = phasor.conjugate() * self.before  # how far the phasor turned since the last bar
        self.product = 0.2 * turn + 0.8 * self.product
        self.before = phasor
        return True

    def settle(self) -> None:
        """The period after this bar."""
        last, now = self.period, self.period
        if self.product.imag != 0.0 and self.product.real != 0.0:
            now = 360.0 / math.degrees(math.atan(self.product.imag / self.product.real))
        if now > 1.5 * last:
            now = 1.5 * last
        if now < 0.67 * last:
            now = 0.67 * last
        now = min(max(now, 6.0), 50.0) if now == now else now
        self.period = 0.2 * now + 0.8 * last
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period


class Phasor:
    """smooth period, in-phase, quadrature."""

    def __init__(self):
        self.cycle = _Cycle(9)

    def push(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = np.full((3, len(x)), NAN)
        for j, v in enumerate(x.tolist()):
            if self.cycle.take(v):
                self.cycle.settle()
                out[:, j] = self.cycle.smooth_period, self.cycle.inphase, self.cycle.quad
        return tuple(out)


class Hilbert:
    """phase, sine, lead sine, trendline, trend mode."""

    RING = 50

    def __init__(self):
        self.cycle = _Cycle(34)
        self.smooth: deque = deque([0.0] * self.RING, maxlen=self.RING)  # newest last
        self.raw: deque = deque(maxlen=self.RING + 2)
        self.phase, self.averages = 0.0, [0.0, 0.0, 0.0]
        self.days, self.waves = 0, (0.0, 0.0)

    def _phase(self, last: float, length: int) -> float:
        real = imag = 0.0
        for k in range(length):
            angle = 2.0 * math.pi * k / length
            price = self.smooth[-1 - k % self.RING]
            real += math.sin(angle) * price
            imag += math.cos(angle) * price
        phase = last
        if abs(imag) > 0.0:
            phase = math.degrees(math.atan(real / imag))
        elif imag == 0.0 and real != 0.0 and real == real:
            phase += math.copysign(90.0, real)
        phase += 90.0
        if self.cycle.smooth_period != 0.0:
            phase += 360.0 / self.cycle.smooth_period
        if imag < 0.0:
            phase += 180.0
        return phase - 360.0 if phase > 315.0 else phase

    def _trend(self, last: float, trendline: float, waves: tuple[float, float]) -> float:
        period, trend = self.cycle.smooth_period, 1.0
        was = self.waves
        if (waves[0] > waves[1] and was[0] <= was[1]) or (waves[0] < waves[1] and was[0] >= was[1]):
            self.days, trend = 0, 0.0
        self.days += 1
        if self.days < 0.5 * period:
            trend = 0.0
        if period != 0.0 and 0.67 * 360.0 / period < self.phase - last < 1.5 * 360.0 / period:
            trend = 0.0
        if trendline != 0.0 and abs((self.cycle.smoothed - trendline) / trendline) >= 0.015:
            trend = 1.0
        self.waves = waves
        return trend

    def push(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = np.full((5, len(x)), NAN)
        for j, v in enumerate(x.tolist()):
            self.raw.append(v)
            if not self.cycle.take(v):
                continue
            self.cycle.settle()
            self.smooth.append(self.cycle.smoothed)
            period = self.cycle.smooth_period
            length = int(period + 0.5) if period == period else 0
            last = self.phase
            self.phase = self._phase(last, length)
            waves = math.sin(math.radians(self.phase)), math.sin(math.radians(self.phase + 45.0))
            bars = list(self.raw)[-length:] if length else []
            if 0 < len(bars) < length:  # before the first bar there is the first bar
                bars = [bars[0]] * (length - len(bars)) + bars
            average = reduce(operator.add, reversed(bars), 0.0) / length if length else 0.0  # not `sum`, which compensates
            a = self.averages
            trendline = (4.0 * average + 3.0 * a[0] + 2.0 * a[1] + a[2]) / 10.0
            self.averages = [average, a[0], a[1]]
            out[:, j] = self.phase, *waves, trendline, self._trend(last, trendline, waves)
        return tuple(out)


class Mama:
    """Adaptive mean and its follower: the smoothing constant follows how fast the phase turns."""

    def __init__(self, fast: float, slow: float):
        self.fast, self.slow, self.cycle = fast, slow, _Cycle(9)
        self.phase = self.mean = self.follower = 0.0

    def push(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = np.full((2, len(x)), NAN)
        for j, v in enumerate(x.tolist()):
            if not self.cycle.take(v):
                continue
            i = self.cycle.inphase
            phase = math.degrees(math.atan(self.cycle.quad / i)) if i != 0.0 else 0.0
            step, self.phase = self.phase - phase, phase
            rate = self.fast
            if step > 1.0:
                rate = self.slow if self.fast / step < self.slow else self.fast / step
            elif step != step:
                rate = NAN if i == i else self.fast
            self.mean = rate * v + (1.0 - rate) * self.mean
            self.follower = 0.5 * rate * self.mean + (1.0 - 0.5 * rate) * self.follower
            out[:, j] = self.mean, self.follower
            self.cycle.settle()
        return tuple(out)


class Hikkake:
    """A false breakout of an inside bar and its confirmation within three bars.

    modified: two nested inside bars, and the earlier one closes near its low (high).
    """

    def __init__(self, modified: bool = False, lookback: int = 2):
        self.depth, self.lookback = 3 if modified else 2, lookback
        self.modified = modified
        self.bars: deque = deque(maxlen=4)
        self.at, self.setup, self.setup_at, self.inside = 0, 0, 0, (NAN, NAN)

    def push(self, high: np.ndarray, low: np.ndarray, close: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray]:
        out = np.zeros(len(high))
        nears = near.tolist() if near is not None else [0.0] * len(high)
        for j, (h, lo, c, n) in enumerate(zip(high.tolist(), low.tolist(), close.tolist(), nears)):
            self.bars.append((h, lo, c))
            t, self.at = self.at, self.at + 1
            if t < self.depth:
                continue
            b = self.bars
            nested = all(b[-k][0] < b[-k - 1][0] and b[-k][1] > b[-k - 1][1] for k in range(2, self.depth + 1))
            down, up = h < b[-2][0] and lo < b[-2][1], h > b[-2][0] and lo > b[-2][1]
            if self.modified:
                down = down and b[-3][2] <= b[-3][1] + n
                up = up and b[-3][2] >= b[-3][0] - n
            code = 0.0
            if nested and (down or up):
                self.setup, self.setup_at, self.inside = 100 if h < b[-2][0] else -100, t, b[-2][:2]
                code = float(self.setup)
            elif self.setup and t <= self.setup_at + 3:
                if c > self.inside[0] if self.setup > 0 else c < self.inside[1]:
                    code, self.setup, self.setup_at = 2.0 * self.setup, 0, 0
            if t >= self.lookback:
                out[j] = code
        return (out,)
