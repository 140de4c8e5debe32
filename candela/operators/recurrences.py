"""Indicators with recurrences (classes S3, S4): kernels in the ordered scan, windows around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numerics import NAN, ieee_div, safe_ratio
from ..plans.frame import Frame
from ..plans.registry import indicator
from . import kernels as K
from .kernels import Maker
from .windows import ad, sma_of, stochf, trima_of, true_range, wma_of

# --- moving averages --------------------------------------------------------------


def ema_of(f: Frame, x: Column, p: int, lookback: int = 0) -> Column:
    return f.gate(f.scan(Maker(K.Ema, p, lookback), [x])[0], lookback + p - 1)


def _chain(f: Frame, x: Column, p: int, count: int, lookback: int) -> list[Column]:
    return f.scan(Maker(K.Chain, p, count, lookback), [x], count)


def dema_of(f, x, p, lookback=0):
    a, b = _chain(f, x, p, 2, lookback)
    return f.gate(a * 2.0 - b, lookback + 2 * (p - 1))


def tema_of(f, x, p, lookback=0):
    a, b, c = _chain(f, x, p, 3, lookback)
    return f.gate(a * 3.0 - b * 3.0 + c, lookback + 3 * (p - 1))


def t3_of(f, x, p, lookback=0, vfactor=0.7):
    if p == 1:
        return x
    e, v = _chain(f, x, p, 6, lookback), vfactor
    # (1 + v - v * shift) cubed, spread over the third to sixth mean.
    weights = [(1 + v) ** 3, -3 * v * (1 + v) ** 2, 3 * v * v * (1 + v), -(v**3)]
    return f.gate(sum((m * w for m, w in zip(e[2:], weights)), F.lit(0.0)), lookback + 6 * (p - 1))


def kama_of(f, x, p, lookback=0):
    move = f.add(F.abs(x - f.lag(x, 1)))
    path = f.add(F.sum(move).over(f.trailing(p)))
    spoiled = f.running("max", F.isnan(F.coalesce(move, F.lit(0.0))))
    ratio = F.when(spoiled | ~(path > 0) | path.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.abs(x - f.lag(x, p)), path))
    ratio = F.when(F.isnan(ratio) | ratio.isNull(), F.lit(0.0)).otherwise(ratio)
    # The kernel starts at bar p - 1 of what it gets; bars before the input's first value don't count.
    return f.gate(f.scan(Maker(K.Kama, p + lookback), [x, f.add(ratio)])[0], lookback + p)


#: The numbers of the moving-average types. 7 is the exponential mean too.
MATYPES = {0: sma_of, 1: ema_of, 2: wma_of, 3: dema_of, 4: tema_of, 5: trima_of, 6: kama_of, 7: ema_of, 8: t3_of}


def ma_lookback(p: int, matype: int) -> int:
    return {3: 2, 4: 3, 8: 6}.get(matype, 1) * (p - 1) + (matype == 6)


def ma_of(f: Frame, x: Column, p: int, matype: int, lookback: int = 0) -> Column:
    return MATYPES.get(matype, ema_of)(f, x, p, lookback)


@indicator("close", family="trend")
def ema(f, x, period=20):
    return ema_of(f, x, period)


@indicator("close", family="trend")
def dema(f, x, period=20):
    return dema_of(f, x, period)


@indicator("close", family="trend")
def tema(f, x, period=20):
    return tema_of(f, x, period)


@indicator("close", family="trend")
def t3(f, x, period=5, vfactor=0.7):
    return t3_of(f, x, period, 0, vfactor)


@indicator("close", family="trend")
def kama(f, x, period=10):
    return kama_of(f, x, period)


@indicator("close", family="trend")
def ma(f, x, period=30, matype=1):
    return ma_of(f, x, period, matype)


# --- MACD ---------------------------------------------------------------------------

_MACD = ("macd", "signal", "hist")


def _none(n: int) -> tuple[Column, ...]:
    return tuple(F.lit(None).cast("double") for _ in range(n))


@indicator("close", outputs=_MACD, family="trend")
def macd(f, x, fast_period=12, slow_period=26, signal_period=9):
    if slow_period < fast_period:
        return _none(3)
    made = f.scan(Maker(K.Macd, fast_period, slow_period, signal_period), [x], 3)
    return tuple(f.gate(c, slow_period + signal_period - 2) for c in made)


@indicator("close", outputs=_MACD, family="trend")
def macdfix(f, x, signal_period=9):
    """12 / 26 with fixed constants."""
    made = f.scan(Maker(K.Macd, 12, 26, signal_period, fast_k=0.15, slow_k=0.075), [x], 3)
    return tuple(f.gate(c, 25 + signal_period - 1) for c in made)


@indicator("close", outputs=_MACD, family="trend")
def macdext(f, x, fast_period=12, fast_matype=0, slow_period=26, slow_matype=0, signal_period=9, signal_matype=0):
    if slow_period < fast_period:
        return _none(3)
    if fast_matype == slow_matype == signal_matype == 1:
        return macd(f, x, fast_period, slow_period, signal_period)
    slow_start, fast_start = ma_lookback(slow_period, slow_matype), ma_lookback(fast_period, fast_matype)
    if fast_start > slow_start:
        return _none(3)
    line = f.add(f.gate(ma_of(f, x, fast_period, fast_matype) - ma_of(f, x, slow_period, slow_matype), slow_start))
    signal = f.add(ma_of(f, line, signal_period, signal_matype, slow_start))
    lookback = slow_start + ma_lookback(signal_period, signal_matype)
    return f.gate(line, lookback), f.gate(signal, lookback), f.gate(line - signal, lookback)


@indicator("close", family="oscillator")
def trix(f, x, period=5):
    third = f.add(f.gate(_chain(f, x, period, 3, 0)[2], 3 * (period - 1)))
    before = f.lag(third, 1)
    return f.gate(safe_ratio(third - before, before) * 100.0, 3 * (period - 1) + 1)


# --- Wilder -------------------------------------------------------------------------


def wilder_of(f: Frame, x: Column, p: int, first: int) -> Column:
    """Wilder's mean; its seed is the mean of bars first .. first + p - 1."""
    return f.scan(Maker(K.Ema, p, first, 1.0 / p), [x])[0]


def _gains(f: Frame, x: Column) -> tuple[Column, Column]:
    step = f.add(x - f.lag(x, 1))
    side = lambda sign: F.when(step.isNull() | F.isnan(step), step).otherwise(F.greatest(step * sign, F.lit(0.0)))
    return f.add(side(1.0)), f.add(side(-1.0))


def rsi_of(f: Frame, x: Column, p: int) -> Column:
    up, down = (wilder_of(f, g, p, 1) for g in _gains(f, x))
    value = F.when(up == 0, F.lit(0.0)).when(down == 0, F.lit(100.0)).otherwise(F.lit(100.0) - ieee_div(F.lit(100.0), F.lit(1.0) + ieee_div(up, down)))
    return f.gate(value, p)


@indicator("close", family="oscillator")
def rsi(f, x, period=14):
    return rsi_of(f, x, period)


@indicator("close", family="oscillator")
def cmo(f, x, period=14):
    up, down = (wilder_of(f, g, period, 1) for g in _gains(f, x))
    return f.gate(safe_ratio((up - down) * 100.0, up + down), period)


@indicator("close", outputs=("fastk", "fastd"), family="oscillator")
def stochrsi(f, x, period=14, fastk_period=5, fastd_period=3):
    strength = f.add(rsi_of(f, x, period))
    k, d = stochf(f, strength, strength, strength, fastk_period, fastd_period, lookback=period)
    return k, d


@indicator("high", "low", "close", family="volatility")
def atr(f, h, l, c, period=14):  # noqa: E741
    return f.gate(wilder_of(f, f.add(true_range(f, h, l, c)), period, 1), period)


@indicator("high", "low", "close", family="volatility")
def natr(f, h, l, c, period=14):  # noqa: E741
    return ieee_div(atr(f, h, l, c, period) * 100.0, c)


def _movements(f: Frame, h: Column, l: Column, strict: bool) -> tuple[Column, Column]:  # noqa: E741
    """+DM and -DM. strict: a NaN bar gives NaN, else nothing."""
    up, down = f.add(h - f.lag(h, 1)), f.add(f.lag(l, 1) - l)
    sound = ~F.isnan(up) & ~F.isnan(down)
    nan = F.lit(NAN) if strict else F.lit(0.0)
    plus = F.when(~sound, nan).when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when(~sound, nan).when((down > up) & (down > 0), down).otherwise(0.0)
    return f.add(plus), f.add(minus)


def _wilder_sum(f: Frame, x: Column, p: int) -> Column:
    return f.scan(Maker(K.WilderSum, p), [x])[0]


@indicator("high", "low", family="oscillator")
def plus_dm(f, h, l, period=14):  # noqa: E741
    return f.gate(_wilder_sum(f, _movements(f, h, l, False)[0], period), period - 1)


@indicator("high", "low", family="oscillator")
def minus_dm(f, h, l, period=14):  # noqa: E741
    return f.gate(_wilder_sum(f, _movements(f, h, l, False)[1], period), period - 1)


def _directional(f, h, l, c, p, side):  # noqa: E741
    range_ = _wilder_sum(f, f.add(true_range(f, h, l, c)), p)
    return f.gate(safe_ratio(_wilder_sum(f, _movements(f, h, l, True)[side], p) * 100.0, range_), p)


@indicator("high", "low", "close", family="oscillator")
def plus_di(f, h, l, c, period=14):  # noqa: E741
    return _directional(f, h, l, c, period, 0)


@indicator("high", "low", "close", family="oscillator")
def minus_di(f, h, l, c, period=14):  # noqa: E741
    return _directional(f, h, l, c, period, 1)


def _dx(f, h, l, c, p):  # noqa: E741
    """The ratio needs no range, but a NaN range spoils it for good."""
    plus, minus = (_wilder_sum(f, m, p) for m in _movements(f, h, l, True))
    spoiled = f.running("max", F.isnan(F.coalesce(true_range(f, h, l, c), F.lit(0.0))))
    return F.when(spoiled, F.lit(NAN)).otherwise(safe_ratio(F.abs(plus - minus) * 100.0, plus + minus))


@indicator("high", "low", "close", family="oscillator")
def dx(f, h, l, c, period=14):  # noqa: E741
    return f.gate(_dx(f, h, l, c, period), period)


@indicator("high", "low", "close", family="trend")
def adx(f, h, l, c, period=14):  # noqa: E741
    return f.gate(wilder_of(f, f.add(_dx(f, h, l, c, period)), period, period), 2 * period - 1)


@indicator("high", "low", "close", family="oscillator")
def adxr(f, h, l, c, period=14):  # noqa: E741
    line = f.add(adx(f, h, l, c, period))
    return f.gate((line + f.lag(line, period - 1)) / 2.0, 3 * period - 2)


@indicator("high", "low", "close", "volume", family="volume")
def adosc(f, h, l, c, v, fast_period=3, slow_period=10):  # noqa: E741
    line = ad(f, h, l, c, v)
    fast, slow = (f.scan(Maker(K.FromFirst, p), [line])[0] for p in (fast_period, slow_period))
    return f.gate(fast - slow, max(fast_period, slow_period) - 1)


# --- state machines -----------------------------------------------------------------


@indicator("high", "low", family="trend")
def sar(f, h, l, acceleration=0.02, maximum=0.2):  # noqa: E741
    side = (acceleration, acceleration, maximum)
    return f.gate(f.scan(Maker(K.Sar, side, side), [h, l])[0], 1)


@indicator("high", "low", family="trend")
def sarext(f, h, l, startvalue=0.0, offsetonreverse=0.0, accelerationinitlong=0.02, accelerationlong=0.02, accelerationmaxlong=0.2, accelerationinitshort=0.02, accelerationshort=0.02, accelerationmaxshort=0.2):  # noqa: E741
    long = (accelerationinitlong, accelerationlong, accelerationmaxlong)
    short = (accelerationinitshort, accelerationshort, accelerationmaxshort)
    return f.gate(f.scan(Maker(K.Sar, long, short, startvalue, offsetonreverse, True), [h, l])[0], 1)


@indicator("close", outputs=("mama", "fama"), family="trend")
def mama(f, x, fastlimit=0.5, slowlimit=0.05):
    return tuple(f.gate(c, 32) for c in f.scan(Maker(K.Mama, fastlimit, slowlimit), [x], 2))


def _phasor(f, x):
    return [f.gate(c, 32) for c in f.scan(Maker(K.Phasor), [x], 3)]


def _hilbert(f, x):
    return [f.gate(c, 63) for c in f.scan(Maker(K.Hilbert), [x], 5)]


@indicator("close", family="hilbert")
def ht_dcperiod(f, x):
    return _phasor(f, x)[0]


@indicator("close", outputs=("inphase", "quadrature"), family="hilbert")
def ht_phasor(f, x):
    return tuple(_phasor(f, x)[1:])


@indicator("close", family="hilbert")
def ht_dcphase(f, x):
    return _hilbert(f, x)[0]


@indicator("close", outputs=("sine", "leadsine"), family="hilbert")
def ht_sine(f, x):
    return tuple(_hilbert(f, x)[1:3])


@indicator("close", family="hilbert")
def ht_trendline(f, x):
    return _hilbert(f, x)[3]


@indicator("close", family="hilbert")
def ht_trendmode(f, x):
    """0 before bar 63, else the mode."""
    return F.coalesce(_hilbert(f, x)[4], F.lit(0.0))
