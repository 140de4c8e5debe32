"""The 61 candlestick patterns.

A pattern is a rule over the last bars, written in a small notation, and the code
that it gives.  The notation is turned into SQL expressions, which Catalyst plans
as lags and window means that all patterns of a query share.

Notation (k: bars ago, 0 the current bar; a: the bar a mean is anchored at):

    O0 H0 L0 C0     prices of the bar            W0, B0     white (C >= O), black
    RB0 US0 LS0     body, upper, lower shadow    hi0, lo0   body's top and bottom
    X@a             a threshold: factor times the mean of a quantity over the n
                    bars before bar a (THRESHOLDS)

`&`, `|`, `!` stand for and, or, not.  A NaN price makes its bar black; a comparison with
a NaN is false.  So is one with a threshold once a NaN has entered its running sum.

Offsets: for the (pattern, threshold) pairs in OFFSETS the sum is seeded on other
bars than its window, which leaves a constant for the whole series:
sum over the seed bars less the window's sum at the first bar.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numerics import NAN, finite_or_null
from ..plans.frame import Frame
from ..plans.registry import indicator
from . import kernels as K
from .kernels import Maker

#: Quantity, bars in the mean, factor.
THRESHOLDS = {
    "BL": ("RB", 10, 1.0),
    "BS": ("RB", 10, 1.0),
    "BD": ("HL", 10, 0.1),
    "SVS": ("HL", 10, 0.1),
    "SS": ("SH", 10, 0.5),
    "N": ("HL", 5, 0.2),
    "F": ("HL", 5, 0.6),
    "E": ("HL", 5, 0.05),
    "N10": ("HL", 10, 0.2),
    "E10": ("HL", 10, 0.05),
    "VU": ("US", 10, 0.1),
}

#: Pattern -> (lookback, [(rule, code)]), first rule that holds. s0: sign of the bar's colour.
PATTERNS: dict[str, tuple[int, list[tuple[str, str]]]] = {
    "cdl2crows": (12, [("W2 & RB2>BL@2 & B1 & O1>C2 & B0 & C1<O0 & O0<O1 & O2<C0 & C0<C2", "-100")]),
    "cdl3blackcrows": (12, [("B2 & B1 & B0 & C0<C1 & C1<C2 & C2<O1 & O1<O2 & C1<O0 & O0<O1 & US2<SVS@2 & US1<SVS@1 & US0<SVS@0", "-100")]),
    "cdl3inside": (12, [("RB2>BL@2 & RB1<BS@1 & hi1<hi2 & lo1>lo2 & B2 & W0 & C0>O2", "100"), ("RB2>BL@2 & RB1<BS@1 & hi1<hi2 & lo1>lo2 & W2 & B0 & C0<O2", "-100")]),
    "cdl3linestrike": (13, [("B3 & B2 & B1 & C3>C2 & C2>C1 & O3>O2 & O2>O1 & W0 & O0<C1 & C0>O3", "100"), ("W3 & W2 & W1 & C3<C2 & C2<C1 & O3<O2 & O2<O1 & B0 & O0>C1 & C0<O3", "-100")]),
    "cdl3outside": (2, [("B2 & W1 & C1>O2 & O1<C2 & C0>C1", "100"), ("W2 & B1 & C1<O2 & O1>C2 & C0<C1", "-100")]),
    "cdl3starsinsouth": (12, [("B2 & B1 & B0 & RB2>BL@2 & LS2>SVS@2 & RB1<RB2 & H1<O2 & L1>L2 & LS1>SVS@2 & RB0<RB1 & H0<=O0 & L0>=C0", "100")]),
    "cdl3whitesoldiers": (12, [("W2 & W1 & W0 & C0>C1 & C1>C2 & O2<O1 & O1<C2 & O1<O0 & O0<C1 & US2<SVS@2 & US1<SVS@1 & US0<SVS@0", "100")]),
    "cdlabandonedbaby": (12, [("RB2>BL@2 & RB1<=BD@1 & RB0>BL@0 & B2 & H1<L2 & W0 & L0>H1 & C0>C2+RB2*PEN", "100"), ("RB2>BL@2 & RB1<=BD@1 & RB0>BL@0 & W2 & L1>H2 & B0 & H0<L1 & C0<C2-RB2*PEN", "-100")]),
    "cdladvanceblock": (12, [("W2 & W1 & W0 & C0>C1 & C1>C2 & O2<O1 & O1<=C2+N@2 & O1<O0 & O0<=C1+N@1 & RB2>BL@2 & US2<SS@2 & ((RB1<RB2-F@2 & RB0<RB1+N@1) | RB0<RB1-F@1 | (RB0<RB1 & RB1<RB2 & (US0>SS@0 | US1>SS@1)) | (RB0<RB1 & US0>RB0))", "-100")]),
    "cdlbelthold": (10, [("RB0>BL@0 & W0 & LS0<SVS@0", "100"), ("RB0>BL@0 & B0 & US0<SVS@0", "-100")]),
    "cdlbreakaway": (14, [("B4 & RB4>BL@4 & B3 & H3<L4 & B2 & B1 & C3>C2 & C2>C1 & H2<L4 & H1<L4 & W0 & O3<C0 & C0<C4", "100"), ("W4 & RB4>BL@4 & W3 & L3>H4 & W2 & W1 & C3<C2 & C2<C1 & L2>H4 & L1>H4 & B0 & C4<C0 & C0<O3", "-100")]),
    "cdlclosingmarubozu": (10, [("RB0>BL@0 & W0 & US0<SVS@0", "100"), ("RB0>BL@0 & B0 & LS0<SVS@0", "-100")]),
    "cdlconcealbabyswall": (13, [("B3 & B2 & B1 & B0 & US3<SVS@3 & LS3<SVS@3 & US2<SVS@2 & LS2<SVS@2 & O1<C2 & H1>C2 & O0>=hi1 & C0<=lo1", "100")]),
    "cdlcounterattack": (11, [("RB1>BL@1 & RB0>BL@1 & abs(C0-C1)<=E@1 & B1 & W0", "100"), ("RB1>BL@1 & RB0>BL@1 & abs(C0-C1)<=E@1 & W1 & B0", "-100")]),
    "cdldarkcloudcover": (11, [("W1 & RB1>BL@1 & B0 & O0>H1 & O1<C0 & C0<C1-RB1*PEN", "-100")]),
    "cdldoji": (10, [("RB0<=BD@0", "100")]),
    "cdldojistar": (11, [("RB1>BL@1 & RB0<=BD@0 & B1 & hi0<C1", "100"), ("RB1>BL@1 & RB0<=BD@0 & W1 & lo0>C1", "-100")]),
    "cdldragonflydoji": (10, [("RB0<=BD@0 & US0<SVS@0 & LS0>SVS@0", "100")]),
    "cdlengulfing": (1, [("B1 & W0 & C0>O1 & O0<C1", "100"), ("W1 & B0 & C0<O1 & O0>C1", "-100")]),
    "cdleveningdojistar": (12, [("W2 & RB2>BL@2 & RB1<=BD@1 & lo1>C2 & B0 & RB0>BL@0 & C0<C2-RB2*PEN", "-100")]),
    "cdleveningstar": (12, [("W2 & RB2>BL@2 & RB1<=BS@1 & lo1>C2 & B0 & RB0>BL@0 & C0<C2-RB2*PEN", "-100")]),
    "cdlgapsidesidewhite": (7, [("lo1>hi2 & lo0>hi2 & W1 & W0 & abs(RB0-RB1)<N@1 & abs(O0-O1)<E@1", "100"), ("hi1<lo2 & hi0<lo2 & W1 & W0 & abs(RB0-RB1)<N@1 & abs(O0-O1)<E@1", "-100")]),
    "cdlgravestonedoji": (10, [("RB0<=BD@0 & LS0<SVS@0 & US0>SVS@0", "100")]),
    "cdlhammer": (11, [("RB0<BS@0 & LS0>RB0 & US0<SVS@0 & lo0<=L1+N@1", "100")]),
    "cdlhangingman": (11, [("RB0<BS@0 & LS0>RB0 & US0<SVS@0 & lo0>=H1-N@1", "-100")]),
    "cdlharami": (11, [("RB1>BL@1 & RB0<BS@0 & hi0<hi1 & lo0>lo1 & B1", "100"), ("RB1>BL@1 & RB0<BS@0 & hi0<hi1 & lo0>lo1 & W1", "-100")]),
    "cdlharamicross": (11, [("RB1>BL@1 & RB0<=BD@0 & hi0<hi1 & lo0>lo1", "-100*s1"), ("RB1>BL@1 & RB0<=BD@0 & hi0<=hi1 & lo0>=lo1", "-80*s1")]),
    "cdlhighwave": (10, [("RB0<BS@0 & US0>2*RB0 & LS0>2*RB0", "100*s0")]),
    "cdlhomingpigeon": (11, [("B1 & B0 & RB1>BL@1 & RB0<=BS@0 & O0<O1 & C0>C1", "100")]),
    "cdlidentical3crows": (12, [("B2 & B1 & B0 & US2<=VU@2 & US1<=VU@2 & US0<=VU@2 & abs(O1-C2)<=E10@2 & abs(O0-C1)<=E10@2", "-100")]),
    "cdlinneck": (11, [("B1 & RB1>BL@1 & W0 & O0<L1 & abs(C0-C1)<=E10@1", "-100")]),
    "cdlinvertedhammer": (11, [("RB0<BS@0 & US0>RB0 & LS0<SVS@0 & hi0<lo1", "100")]),
    "cdlkicking": (11, [("B1 & W0 & {kick} & lo0>hi1", "100"), ("W1 & B0 & {kick} & hi0<lo1", "-100")]),
    "cdlkickingbylength": (11, [("((B1 & W0 & lo0>hi1) | (W1 & B0 & hi0<lo1)) & {kick} & RB0>RB1", "100*s0"), ("((B1 & W0 & lo0>hi1) | (W1 & B0 & hi0<lo1)) & {kick}", "100*s1")]),
    "cdlladderbottom": (14, [("B4 & B3 & B2 & O4>O3 & O3>O2 & C4>C3 & C3>C2 & B1 & US1>SVS@1 & W0 & O0>O1 & C0>H1", "100")]),
    "cdllongleggeddoji": (10, [("RB0<=BD@0 & (US0>RB0 | LS0>RB0)", "100")]),
    "cdllongline": (10, [("RB0>BL@0 & US0<SS@0 & LS0<SS@0", "100*s0")]),
    "cdlmarubozu": (10, [("RB0>BL@0 & US0<=SVS@0 & LS0<=SVS@0", "100*s0")]),
    "cdlmatchinglow": (6, [("B1 & B0 & abs(C0-C1)<=E@1", "100")]),
    "cdlmathold": (14, [("W4 & RB4>BL@4 & RB3<BS@4 & RB2<BS@4 & RB1<BS@4 & hi3<C4 & hi2<C4 & hi1<C4 & lo3>O4 & lo2>O4 & lo1>O4 & W0 & C0>C4", "100")]),
    "cdlmorningdojistar": (12, [("B2 & RB2>BL@2 & RB1<=BD@1 & hi1<C2 & W0 & RB0>BS@0 & C0>(O2+C2)*0.5", "100")]),
    "cdlmorningstar": (12, [("B2 & RB2>BL@2 & RB1<BS@1 & hi1<C2 & W0 & RB0>BS@0 & C0>C2+0.3*(O2-C2)", "100")]),
    "cdlonneck": (11, [("B1 & RB1>BL@1 & W0 & O0<L1 & abs(C0-L1)<=E10@1", "-100")]),
    "cdlpiercing": (11, [("B1 & RB1>BL@1 & W0 & RB0>BL@1 & O0<L1 & (O1+C1)*0.5<C0 & C0<O1", "100")]),
    "cdlrickshawman": (10, [("RB0<=BD@0 & US0>RB0 & LS0>RB0 & lo0<=(H0+L0)*0.5+N@0 & hi0>=(H0+L0)*0.5-N@0", "100")]),
    "cdlrisefall3methods": (14, [("W4 & RB4>BL@4 & B3 & B2 & B1 & RB3<BS@4 & RB2<BS@4 & RB1<BS@4 & C3>O4 & C1<C4 & O3<C4 & W0 & O0>C1 & C0>C4", "100"), ("B4 & RB4>BL@4 & W3 & W2 & W1 & RB3<BS@4 & RB2<BS@4 & RB1<BS@4 & C3<O4 & C1>C4 & O3>C4 & B0 & O0<C1 & C0<C4", "-100")]),
    "cdlseparatinglines": (11, [("((W0 & B1 & LS0<SVS@0) | (B0 & W1 & US0<SVS@0)) & abs(O0-O1)<=E@1 & RB0>BL@0", "100*s0")]),
    "cdlshootingstar": (11, [("RB0<BS@0 & US0>RB0 & LS0<SVS@0 & lo0>hi1", "-100")]),
    "cdlshortline": (10, [("RB0<BS@0 & US0<SS@0 & LS0<SS@0", "100*s0")]),
    "cdlspinningtop": (10, [("RB0<BS@0 & US0>RB0 & LS0>RB0", "100*s0")]),
    "cdlstalledpattern": (12, [("W2 & W1 & W0 & RB2>BL@2 & RB1>BL@2 & RB0<BS@2 & abs(O1-C2)<=N10@2 & US0<SVS@2", "-100")]),
    "cdlsticksandwich": (7, [("B2 & W1 & B0 & L1>C2 & abs(C0-C2)<=E@2", "100")]),
    "cdltakuri": (10, [("RB0<=BD@0 & US0<=SVS@0 & LS0>2*RB0", "100")]),
    "cdltasukigap": (7, [("lo1>hi2 & W1 & B0 & O1<O0 & O0<C1 & hi2<C0 & C0<O1 & abs(RB1-RB0)<N@1", "100"), ("hi1<lo2 & B1 & W0 & C1<O0 & O0<O1 & O1<C0 & C0<lo2 & abs(RB1-RB0)<N@1", "-100")]),
    "cdlthrusting": (11, [("B1 & RB1>BL@1 & W0 & O0<L1 & C1<C0 & C0<(O1+C1)*0.5-E10@1", "-100")]),
    "cdltristar": (12, [("RB2<=BD@2 & RB1<=BD@2 & RB0<=BD@2 & lo1>hi2 & hi0<hi1", "-100"), ("RB2<=BD@2 & RB1<=BD@2 & RB0<=BD@2 & hi1<lo2 & lo0>lo1", "100")]),
    "cdlunique3river": (12, [("B2 & RB2>BL@2 & B1 & L1<L2 & RB1<BS@2 & C1>C2 & W0 & RB0<BS@2 & C0<O1", "100")]),
    "cdlupsidegap2crows": (12, [("W2 & RB2>BL@2 & B1 & O1>C2 & B0 & O0>O1 & C2<C0 & C0<C1", "-100")]),
    "cdlxsidegap3methods": (2, [("W2 & W1 & B0 & lo1<O0 & O0<hi1 & lo2<C0 & C0<hi2 & lo1>hi2", "100"), ("B2 & B1 & W0 & lo1<O0 & O0<hi1 & lo2<C0 & C0<hi2 & hi1<lo2", "-100")]),
}
_KICK = "RB1>BL@1 & US1<SVS@1 & LS1<SVS@1 & RB0>BL@0 & US0<SVS@0 & LS0<SVS@0"
#: Default of the tunable penetration.
PENETRATION = {"cdlabandonedbaby": 0.3, "cdldarkcloudcover": 0.5, "cdleveningdojistar": 0.3, "cdleveningstar": 0.3}

#: Fixed values: (pattern, threshold) -> (first, last) bar that its sum is seeded on.
OFFSETS = {
    ("cdl3blackcrows", "SVS@1"): (0, 9),
    ("cdl3blackcrows", "SVS@0"): (0, 9),
    ("cdl3whitesoldiers", "SVS@1"): (0, 9),
    ("cdl3whitesoldiers", "SVS@0"): (0, 9),
    ("cdl3inside", "BS@1"): (0, 9),
    ("cdlharami", "BS@0"): (0, 9),
    ("cdlabandonedbaby", "BD@1"): (0, 9),
    ("cdlconcealbabyswall", "SVS@2"): (0, 9),
    ("cdlcounterattack", "E@1"): (0, 4),
}

_TOKEN = re.compile(r"\b(N10|E10|BL|BS|BD|SVS|SS|VU|N|F|E)@(\d)|\b([OHLCWBs])(\d)\b|\b(RB|US|LS|hi|lo)(\d)\b|\bPEN\b|&|\||!")


def rule_sql(rule: str, threshold, penetration: float | None = None) -> str:
    """The rule as SQL over columns o0, h0, l0, c0, o1, ...; threshold(name, anchor): SQL of a threshold."""

    def one(m: re.Match) -> str:
        if m[1]:
            return threshold(m[1], int(m[2]))
        if m[3]:
            k = m[4]
            return {"W": f"coalesce(c{k}>=o{k}, FALSE)", "B": f"(NOT coalesce(c{k}>=o{k}, FALSE))", "s": f"(CASE WHEN c{k}>=o{k} THEN 1 ELSE -1 END)"}.get(m[3], f"{m[3].lower()}{k}")
        if m[5]:
            k = m[6]
            return {"RB": f"abs(c{k}-o{k})", "US": f"(h{k}-greatest(o{k},c{k}))", "LS": f"(least(o{k},c{k})-l{k})", "hi": f"greatest(o{k},c{k})", "lo": f"least(o{k},c{k})"}[m[5]]
        return {"&": " AND ", "|": " OR ", "!": " NOT ", "PEN": str(penetration)}[m[0]]

    return _TOKEN.sub(one, rule.replace("{kick}", _KICK))


def _quantity(name: str, o: Column, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    """A body's ends are those of the prices that are numbers."""
    up, down = h - F.greatest(*map(finite_or_null, (o, c))), F.least(*map(finite_or_null, (o, c))) - l
    return {"RB": F.abs(c - o), "HL": h - l, "US": F.coalesce(up, F.lit(NAN)), "SH": F.coalesce(up + down, F.lit(NAN))}[name]


def _threshold(f: Frame, bars: tuple, name: str, anchor: int, lookback: int, seed: tuple[int, int] | None) -> Column:
    """factor * mean of the n bars before the anchor bar; NULL once a NaN has been summed."""
    kind, n, factor = THRESHOLDS[name]
    x = f.add(_quantity(kind, *bars))
    total = f.add(F.sum(x).over(f.rows(-(anchor + n), -(anchor + 1))))
    # Sums begin with the first bar of the window at the first output.
    begin = seed[0] if seed else lookback - anchor - n
    counted = f.add(F.when(f.rn >= begin, F.isnan(x)).otherwise(False))
    spoiled = F.coalesce(f.lag(f.running("max", counted), anchor + 1), F.lit(False))
    if seed:
        within = F.when(f.rn.between(*seed), x)
        usual = F.when(f.rn.between(lookback - anchor - n, lookback - anchor - 1), x)
        # Both sums are over the first bars, which every output bar has behind it.
        behind = f.running("sum", F.coalesce(within, F.lit(0.0))) - f.running("sum", F.coalesce(usual, F.lit(0.0)))
        total = total + behind
    return f.add(F.when(~spoiled, total * (factor / n)))


def candle(f: Frame, name: str, o: Column, h: Column, l: Column, c: Column, penetration: float | None = None, strict_windows: bool = False) -> Column:  # noqa: E741
    """strict_windows: every threshold's mean is that of its window, without the offsets."""
    lookback, rules = PATTERNS[name]
    bars = tuple(f.add(x) for x in (o, h, l, c))
    # NaN as NULL: a comparison with it is not true, and a body's ends are those of the prices that are there.
    prices = tuple(f.add(finite_or_null(x)) for x in bars)

    def column(x: Column) -> str:
        return re.search(r"__t\d+_\d*", str(x))[0]

    def price(letter: str, k: int) -> str:
        return column(f.lag(prices["ohlc".index(letter)], k))

    def threshold(kind: str, anchor: int) -> str:
        seed = None if strict_windows else OFFSETS.get((name, f"{kind}@{anchor}"))
        return column(_threshold(f, bars, kind, anchor, lookback, seed))

    out = None
    for rule, code in rules:
        sql = rule_sql(rule, threshold, penetration)
        places = re.compile(r"\b([ohlc])(\d)\b")
        sql = places.sub(lambda m: price(m[1], int(m[2])), sql)
        value = places.sub(lambda m: price(m[1], int(m[2])), rule_sql(code, threshold))
        hit = F.expr(sql)
        out = F.when(hit, F.expr(f"cast({value} AS double)")) if out is None else out.when(hit, F.expr(f"cast({value} AS double)"))
    return F.when(f.rn >= lookback, out.otherwise(0.0)).otherwise(0.0)


def _register(name: str) -> None:
    if name in PENETRATION:

        def build(f, o, h, l, c, penetration=PENETRATION[name], strict_windows=False):  # noqa: E741
            return candle(f, name, o, h, l, c, penetration, strict_windows)
    else:

        def build(f, o, h, l, c, strict_windows=False):  # noqa: E741
            return candle(f, name, o, h, l, c, None, strict_windows)

    indicator("open", "high", "low", "close", family="pattern", name=name)(build)


for _name in PATTERNS:
    _register(_name)


@indicator("open", "high", "low", "close", family="pattern")
def cdlhikkake(f, o, h, l, c):  # noqa: E741
    return f.scan(Maker(K.Hikkake), [h, l, c])[0]


@indicator("open", "high", "low", "close", family="pattern")
def cdlhikkakemod(f, o, h, l, c):  # noqa: E741
    """The near threshold's sum keeps the ranges of bars 1 and 2 for good (bars 0 to 2 while it fills)."""
    span = f.add(h - l)
    early = f.running("sum", F.when(f.rn.between(0, 2), span).otherwise(0.0))
    first = f.running("sum", F.when(f.rn == 0, span).otherwise(0.0))
    one = f.running("sum", F.when(f.rn == 1, span).otherwise(0.0))
    moving = f.add(F.sum(span).over(f.rows(-5, -3)))
    near = F.when(f.rn >= 6, early - first + moving).when(f.rn == 5, early + early - first).when(f.rn == 4, early + one).otherwise(early)
    return f.scan(Maker(K.Hikkake, True, 8), [h, l, c, f.add(near * (0.2 / 5))])[0]
