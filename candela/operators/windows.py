"""Indicators of bounded and running windows (classes S0, S1, S2) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions.numerics import NAN, finite_or_null, gt, ieee_div, safe_ratio
from ..plans.frame import Frame
from ..plans.registry import indicator

# --- element-wise --------------------------------------------------------------


def _of(formula):
    return lambda f, *columns: formula(*columns)


for _name, _f in M.UNARY.items():
    indicator("close", family="math_transform", name=_name)(_of(_f))
for _name, _f in M.BINARY.items():
    indicator("real0", "real1", family="math_ops", name=_name)(_of(_f))
for _name, (_inputs, _f) in M.PRICE.items():
    indicator(*_inputs, family="oscillator" if _name == "bop" else "price_transform", name=_name)(_of(_f))

# --- moving averages -----------------------------------------------------------


def sma_of(f: Frame, x: Column, p: int, lookback: int = 0) -> Column:
    """Mean of the last p values of x, whose own first value is at bar `lookback`."""
    return f.gate(f.mean(x, p), lookback + p - 1, f.poisoned(x, p))


def slope_of(f: Frame, x: Column, p: int) -> Column:
    """Least-squares slope per bar; NaN over a single bar. A NaN counts only while it is in the window."""
    if p == 1:
        return F.lit(NAN)
    return f.add(F.regr_slope(x, f.rn.cast("double")).over(f.trailing(p)))


def wma_of(f: Frame, x: Column, p: int, lookback: int = 0) -> Column:
    """Weights 1 to p are their mean and a rise about it: the mean of the window and a share of its slope."""
    value = f.mean(x, p) if p == 1 else f.mean(x, p) + slope_of(f, x, p) * ((p - 1) / 6.0)
    return f.gate(value, lookback + p - 1, f.poisoned(x, p))


def trima_of(f: Frame, x: Column, p: int, lookback: int = 0) -> Column:
    a, b = ((p + 1) // 2, (p + 1) // 2) if p % 2 else (p // 2 + 1, p // 2)
    return f.gate(f.sum(f.sum(x, a), b) / (a * b), lookback + p - 1, f.poisoned(x, p))


@indicator("close", family="trend")
def sma(f, x, period=20):
    return sma_of(f, x, period)


@indicator("close", family="trend")
def wma(f, x, period=20):
    return wma_of(f, x, period)


@indicator("close", family="trend")
def trima(f, x, period=14):
    return trima_of(f, x, period)


@indicator("close", "periods", family="trend")
def mavp(f, x, periods, minperiod=2, maxperiod=30):
    """Mean over a length of each bar's own; a NaN length gives NaN.

    A NaN value poisons the sum until the length changes: the run of bars of one
    length starts where the length differs from the bar before.
    """
    n = F.when(F.isnan(periods), F.lit(None)).otherwise(F.least(F.greatest(F.round(periods), F.lit(minperiod)), F.lit(maxperiod))).cast("int")
    n = f.add(n)
    window = f.add(F.collect_list(x).over(f.trailing(maxperiod)))
    values = F.slice(window, -n, n)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    # Bars from which a run of one length, and the last NaN mean, date.
    counted = f.rn >= maxperiod - 1
    fresh = ~f.lag(n, 1).eqNullSafe(n) | (f.rn == maxperiod - 1)
    run, nan = f.running("max", F.when(counted & fresh, f.rn)), f.running("max", F.when(counted & F.isnan(mean), f.rn))
    spoiled = F.coalesce(nan >= run, F.lit(False))
    return f.gate(F.when(n.isNull() | F.isnan(mean) | spoiled, F.lit(NAN)).otherwise(mean), maxperiod - 1)


@indicator("close", outputs=("upper", "middle", "lower"), family="trend")
def bbands(f, x, period=20, nbdevup=2.0, nbdevdn=2.0):
    middle = sma_of(f, x, period)
    dev = f.gate(f.add(F.stddev_pop(x).over(f.trailing(period))), period - 1, f.poisoned(x, period))
    return middle + dev * nbdevup, middle, middle - dev * nbdevdn


@indicator("close", family="trend")
def midpoint(f, x, period=14):
    """NaN if the oldest bar is NaN; other NaNs are skipped."""
    y = finite_or_null(x)
    mid = (f.highest(y, period) + f.lowest(y, period)) / 2
    return f.gate(F.when(F.isnan(f.lag(x, period - 1)), F.lit(NAN)).otherwise(mid), period - 1)


@indicator("high", "low", family="trend")
def midprice(f, h, l, period=14):  # noqa: E741
    mid = (f.highest(finite_or_null(h), period) + f.lowest(finite_or_null(l), period)) / 2
    bad = F.isnan(f.lag(h, period - 1)) | F.isnan(f.lag(l, period - 1)) | mid.isNull()
    return f.gate(F.when(bad, F.lit(NAN)).otherwise(mid), period - 1)


# --- differences and ratios -----------------------------------------------------


def _past(name: str, formula):
    @indicator("close", family="oscillator", name=name)
    def build(f, x, period=10):
        return f.gate(formula(x, f.lag(x, period)), period)


_past("mom", lambda x, b: x - b)
_past("roc", lambda x, b: safe_ratio(x - b, b) * 100.0)
_past("rocp", lambda x, b: safe_ratio(x - b, b))
_past("rocr", lambda x, b: safe_ratio(x, b))
_past("rocr100", lambda x, b: safe_ratio(x, b) * 100.0)

def _nothing() -> Column:
    return F.lit(None).cast("double")


@indicator("close", family="oscillator")
def apo(f, x, fast_period=12, slow_period=26):
    if fast_period >= slow_period:
        return _nothing()
    return sma_of(f, x, fast_period) - sma_of(f, x, slow_period)


@indicator("close", family="oscillator")
def ppo(f, x, fast_period=12, slow_period=26):
    if fast_period >= slow_period:
        return _nothing()
    slow = sma_of(f, x, slow_period)
    return f.gate(safe_ratio(sma_of(f, x, fast_period) - slow, slow) * 100.0, slow_period - 1)


# --- highest and lowest ---------------------------------------------------------


def _index(f: Frame, x: Column, p: int, largest: bool, latest: bool) -> Column:
    """Index of the window's extremum; ties go to the latest or the earliest bar."""
    rn = f.rn
    by = F.struct(x, rn if largest == latest else -rn)
    pick = F.max_by(rn, by) if largest else F.min_by(rn, by)
    return f.add(pick.over(f.trailing(p))).cast("double")


def _extremum(f: Frame, x: Column, p: int, largest: bool, latest: bool = False, exact_nan: bool = False) -> tuple[Column, Column]:
    """Value and index of the window's extremum.

    exact_nan: as a scan finds it that looks through the window anew, from its oldest bar on,
    only when the last extremum has left it, and otherwise looks at the newest bar alone.
    A NaN never beats a number, but a search that begins at one ends with it: the value is
    NaN, and the index the oldest bar's, from a search with a NaN at the oldest bar until a
    number is there.  Else NaN is the largest value, as it is in Spark.
    """
    if not exact_nan:
        return (f.highest(x, p) if largest else f.lowest(x, p)), _index(f, x, p, largest, latest)
    y, rn = f.add(finite_or_null(x)), f.rn
    best = f.highest(y, p) if largest else f.lowest(y, p)
    # Bars without a number are no candidates: a null in the struct would count.
    by = F.when(y.isNotNull(), F.struct(y, rn if largest == latest else -rn))
    pick = F.max_by(rn, by) if largest else F.min_by(rn, by)
    where = f.add(pick.over(f.trailing(p)))
    oldest = rn - (p - 1)
    begins_nan = f.add(F.isnan(f.lag(x, p - 1)))
    searched = F.coalesce(f.lag(where, 1) < oldest, F.lit(True)) | (oldest == 0)
    # The last bar with a number at its oldest bar, and the last search.
    sound = f.running("max", F.when((oldest >= 0) & ~begins_nan, rn))
    search = f.running("max", F.when((oldest >= 0) & searched, rn))
    spoiled = f.add(F.coalesce(search > F.coalesce(sound, F.lit(-1)), F.lit(False)) & F.coalesce(begins_nan, F.lit(False)))
    return F.when(spoiled, F.lit(NAN)).otherwise(best), F.when(spoiled, oldest).otherwise(where).cast("double")


@indicator("close", family="math_ops", name="max")
def max_(f, x, period=30, exact_nan=False):
    return f.gate(_extremum(f, x, period, True, exact_nan=exact_nan)[0], period - 1)


@indicator("close", family="math_ops", name="min")
def min_(f, x, period=30, exact_nan=False):
    return f.gate(_extremum(f, x, period, False, exact_nan=exact_nan)[0], period - 1)


@indicator("close", family="math_ops", name="sum")
def sum_(f, x, period=30):
    return f.gate(f.sum(x, period), period - 1, f.poisoned(x, period))


@indicator("close", family="math_ops")
def maxindex(f, x, period=30, exact_nan=False):
    return f.gate(_extremum(f, x, period, True, exact_nan=exact_nan)[1], period - 1)


@indicator("close", family="math_ops")
def minindex(f, x, period=30, exact_nan=False):
    return f.gate(_extremum(f, x, period, False, exact_nan=exact_nan)[1], period - 1)


@indicator("close", outputs=("min", "max"), family="math_ops")
def minmax(f, x, period=30, exact_nan=False):
    return min_(f, x, period, exact_nan), max_(f, x, period, exact_nan)


@indicator("close", outputs=("min_idx", "max_idx"), family="math_ops")
def minmaxindex(f, x, period=30, exact_nan=False):
    return minindex(f, x, period, exact_nan), maxindex(f, x, period, exact_nan)


@indicator("high", "low", outputs=("up", "down"), family="oscillator")
def aroon(f, h, l, period=14, exact_nan=False):  # noqa: E741
    since = lambda c, largest: (period - (f.rn - _extremum(f, c, period + 1, largest, True, exact_nan)[1])) * 100.0 / period
    return f.gate(since(h, True), period), f.gate(since(l, False), period)


@indicator("high", "low", family="oscillator")
def aroonosc(f, h, l, period=14, exact_nan=False):  # noqa: E741
    up, down = aroon(f, h, l, period, exact_nan)
    return up - down


_EPS = 2.220446049250313e-16


def _place_in_range(f: Frame, h: Column, l: Column, c: Column, p: int, exact_nan: bool, formula) -> Column:  # noqa: E741
    """formula(top, bottom) over the window's range; 0 where there is none."""
    top, bottom = (_extremum(f, x, p, largest, exact_nan=exact_nan)[0] for x, largest in ((h, True), (l, False)))
    value = F.when(F.abs(top - bottom) < _EPS, F.lit(0.0)).otherwise(formula(top, bottom))
    return F.when(F.isnan(c), F.lit(NAN)).otherwise(value) if exact_nan else value


def _raw_k(f: Frame, h: Column, l: Column, c: Column, p: int, exact_nan: bool = False) -> Column:  # noqa: E741
    return _place_in_range(f, h, l, c, p, exact_nan, lambda top, bottom: ieee_div(c - bottom, top - bottom) * 100.0)


@indicator("high", "low", "close", outputs=("slowk", "slowd"), family="oscillator")
def stoch(f, h, l, c, fastk_period=5, slowk_period=3, slowd_period=3, exact_nan=False):  # noqa: E741
    start = fastk_period - 1
    k = f.add(f.gate(_raw_k(f, h, l, c, fastk_period, exact_nan), start))
    slow = f.add(sma_of(f, k, slowk_period, start))
    lookback = start + slowk_period + slowd_period - 2
    return f.gate(slow, lookback), sma_of(f, slow, slowd_period, start + slowk_period - 1)


@indicator("high", "low", "close", outputs=("fastk", "fastd"), family="oscillator")
def stochf(f, h, l, c, fastk_period=5, fastd_period=3, lookback=0, exact_nan=False):  # noqa: E741
    start = lookback + fastk_period - 1
    k = f.add(f.gate(_raw_k(f, h, l, c, fastk_period, exact_nan), start))
    return f.gate(k, start + fastd_period - 1), sma_of(f, k, fastd_period, start)


@indicator("high", "low", "close", family="oscillator")
def willr(f, h, l, c, period=14, exact_nan=False):  # noqa: E741
    return f.gate(_place_in_range(f, h, l, c, period, exact_nan, lambda top, bottom: ieee_div(top - c, top - bottom) * -100.0), period - 1)


@indicator("high", "low", "close", family="oscillator")
def cci(f, h, l, c, period=20):  # noqa: E741
    price = f.add((h + l + c) / 3.0)
    mean, values = f.mean(price, period), f.add(F.collect_list(price).over(f.trailing(period)))
    spread = f.add(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / period)
    return f.gate(safe_ratio(price - mean, spread * 0.015), period - 1)


@indicator("high", "low", "close", "volume", family="oscillator")
def mfi(f, h, l, c, v, period=14):  # noqa: E741
    """Share of the flow of rising bars; a bar with a NaN has no flow."""
    price = f.add((h + l + c) / 3.0)
    before, flow = f.lag(price, 1), price * v
    sound = ~F.isnan(flow)
    up = f.add(F.when(sound & gt(price, before), flow).otherwise(0.0))
    down = f.add(F.when(sound & gt(before, price), flow).otherwise(0.0))
    total = f.sum(up, period) + f.sum(down, period)
    return f.gate(safe_ratio(f.sum(up, period) * 100.0, total), period)


@indicator("high", "low", "close", family="oscillator")
def ultosc(f, h, l, c, period1=7, period2=14, period3=28):  # noqa: E741
    before = f.lag(c, 1)
    floor = F.least(l, before)
    pressure, true = f.add(c - floor), f.add(F.greatest(h, before) - floor)
    spoiled = f.running("max", F.isnan(F.coalesce(pressure + true, F.lit(0.0))))
    a = [safe_ratio(f.sum(pressure, p), f.sum(true, p)) for p in (period1, period2, period3)]
    # The first bar has no bar before it.
    return f.gate((a[0] * 4 + a[1] * 2 + a[2]) * 100.0 / 7.0, max(period1, period2, period3), spoiled)


@indicator("high", "low", "close", family="volatility")
def trange(f, h, l, c):  # noqa: E741
    return f.gate(true_range(f, h, l, c), 1)


def true_range(f: Frame, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    before = f.lag(c, 1)
    wide = F.greatest(h - l, F.abs(h - before), F.abs(l - before))
    return F.when(F.isnan(h) | F.isnan(l), F.lit(NAN)).when(F.isnan(before), h - l).otherwise(wide)


# --- volume ---------------------------------------------------------------------


@indicator("high", "low", "close", "volume", family="volume")
def ad(f, h, l, c, v):  # noqa: E741
    """Running sum of where the close stands in the bar's range, times volume; bars without range add nothing."""
    span = h - l
    add = F.when(gt(h, l), F.try_divide(c + c - h - l, span) * v).otherwise(0.0)
    return f.running("sum", add)


@indicator("close", "volume", family="volume")
def obv(f, c, v):
    before = f.lag(c, 1)
    step = F.when(f.rn == 0, v).when(gt(c, before), v).when(gt(before, c), -v).otherwise(0.0)
    return f.running("sum", step)


# --- rolling statistics -----------------------------------------------------------


@indicator("real0", "real1", family="statistic")
def beta(f, x, y, period=5):
    """Slope of y's returns on x's."""
    rx, ry = (f.add(ieee_div(c - f.lag(c, 1), f.lag(c, 1))) for c in (x, y))
    both, one, two, square = f.add(rx * ry), rx, ry, f.add(rx * rx)
    n = float(period)
    below = f.sum(square, period) * n - f.sum(one, period) * f.sum(one, period)
    above = f.sum(both, period) * n - f.sum(one, period) * f.sum(two, period)
    spoiled = f.running("max", F.isnan(F.coalesce(rx + ry, F.lit(0.0))))
    return f.gate(safe_ratio(above, below), period, spoiled)


@indicator("real0", "real1", family="statistic")
def correl(f, x, y, period=30):
    w = f.trailing(period)
    joint = f.add(F.covar_pop(x, y).over(w))
    below = f.add(F.stddev_pop(x).over(w)) * f.add(F.stddev_pop(y).over(w))
    return f.gate(safe_ratio(joint, below), period - 1, f.poisoned(f.add(x + y), period))


@indicator("close", family="statistic")
def stddev(f, x, period=5, nbdev=1.0):
    return f.gate(f.add(F.stddev_pop(x).over(f.trailing(period))) * nbdev, period - 1, f.poisoned(x, period))


@indicator("close", family="statistic")
def var(f, x, period=5, nbdev=1.0):
    return f.gate(f.add(F.var_pop(x).over(f.trailing(period))) * (nbdev * nbdev), period - 1, f.poisoned(x, period))


def _line(name: str, at):
    @indicator("close", family="statistic", name=name)
    def build(f, x, period=14):
        return f.gate(at(f.mean(x, period), slope_of(f, x, period), period), period - 1)


_line("linearreg", lambda m, s, p: m + s * ((p - 1) / 2))
_line("linearreg_angle", lambda m, s, p: F.degrees(F.atan(s)))
_line("linearreg_intercept", lambda m, s, p: m - s * ((p - 1) / 2))
_line("linearreg_slope", lambda m, s, p: s)
_line("tsf", lambda m, s, p: m + s * ((p + 1) / 2))
