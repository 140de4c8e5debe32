"""Candlestick patterns in plain Python, one by one, over lists of bars: what the rule table is tested against.

Means are running sums as a loop over the bars would keep them: seeded, then one bar in and
one bar out, so a NaN that has come in stays.
"""

import math


def number(pick, a, b):
    """pick of those that aren't NaN."""
    return pick((x for x in (a, b) if not math.isnan(x)), default=math.nan)


class Bars:
    def __init__(self, o, h, l, c):  # noqa: E741
        self.o, self.h, self.l, self.c = o, h, l, c
        body = [abs(b - a) for a, b in zip(o, c)]
        upper = [x - number(max, a, b) for x, a, b in zip(h, o, c)]
        lower = [number(min, a, b) - x for x, a, b in zip(l, o, c)]
        self.of = {"body": body, "upper": upper, "lower": lower, "range": [a - b for a, b in zip(h, l)], "shadows": [a + b for a, b in zip(upper, lower)]}
        self.sums = {}

    def mean(self, t, what, n, back, first, seed=None):
        """Mean of n bars up to the one before bar t - back, kept up from the first output `first` on; seed: the bars first summed, if others."""
        key = (what, n, back, first, seed)
        if key not in self.sums:
            q = self.of[what]
            total = sum(q[i] for i in (range(seed[0], seed[1] + 1) if seed else range(first - back - n, first - back)))
            out = {}
            for i in range(first, len(q)):
                out[i] = total / n
                total += q[i - back] - q[i - back - n]
            self.sums[key] = out
        return self.sums[key][t]


class View:
    """The bars as the pattern at bar t sees them; arguments are bars ago."""

    def __init__(self, bars, t, first, penetration=None):
        self.bars, self.t, self.first, self.p = bars, t, first, penetration

    def O(self, k): return self.bars.o[self.t - k]  # noqa: E743,E704,N802
    def H(self, k): return self.bars.h[self.t - k]  # noqa: E704,N802
    def L(self, k): return self.bars.l[self.t - k]  # noqa: E704,N802
    def C(self, k): return self.bars.c[self.t - k]  # noqa: E704,N802
    def white(self, k): return self.C(k) >= self.O(k)  # noqa: E704
    def black(self, k): return not self.white(k)  # noqa: E704
    def sign(self, k): return 1 if self.white(k) else -1  # noqa: E704
    def body(self, k): return self.bars.of["body"][self.t - k]  # noqa: E704
    def upper(self, k): return self.bars.of["upper"][self.t - k]  # noqa: E704
    def lower(self, k): return self.bars.of["lower"][self.t - k]  # noqa: E704
    def top(self, k): return number(max, self.O(k), self.C(k))  # noqa: E704
    def bottom(self, k): return number(min, self.O(k), self.C(k))  # noqa: E704

    def m(self, what, n, back, seed=None): return self.bars.mean(self.t, what, n, back, self.first, seed)  # noqa: E704
    def long(self, k, at=None): return self.body(k) > self.m("body", 10, k if at is None else at)  # noqa: E704
    def short(self, k, at=None, seed=None): return self.body(k) < self.m("body", 10, k if at is None else at, seed)  # noqa: E704
    def doji(self, k, at=None, seed=None): return self.body(k) <= 0.1 * self.m("range", 10, k if at is None else at, seed)  # noqa: E704
    def tiny(self, k, seed=None): return 0.1 * self.m("range", 10, k, seed)  # noqa: E704
    def near(self, k, n=5): return 0.2 * self.m("range", n, k)  # noqa: E704
    def far(self, k): return 0.6 * self.m("range", 5, k)  # noqa: E704
    def equal(self, k, n=5, seed=None): return 0.05 * self.m("range", n, k, seed)  # noqa: E704
    def half(self, k): return 0.5 * self.m("shadows", 10, k)  # noqa: E704


FIRST_TEN = (0, 9)


def two(up, down):
    return 100 if up else -100 if down else 0


def crows2(v):
    return -100 if v.white(2) and v.long(2) and v.black(1) and v.O(1) > v.C(2) and v.black(0) and v.C(1) < v.O(0) < v.O(1) and v.O(2) < v.C(0) < v.C(2) else 0


def blackcrows3(v):
    down = all(v.black(k) for k in (0, 1, 2)) and v.C(0) < v.C(1) < v.C(2) and v.C(2) < v.O(1) < v.O(2) and v.C(1) < v.O(0) < v.O(1)
    return -100 if down and v.upper(2) < v.tiny(2) and v.upper(1) < v.tiny(1, FIRST_TEN) and v.upper(0) < v.tiny(0, FIRST_TEN) else 0


def inside3(v):
    if not (v.long(2) and v.short(1, seed=FIRST_TEN) and v.top(1) < v.top(2) and v.bottom(1) > v.bottom(2)):
        return 0
    return two(v.black(2) and v.white(0) and v.C(0) > v.O(2), v.white(2) and v.black(0) and v.C(0) < v.O(2))


def linestrike3(v):
    up = all(v.black(k) for k in (3, 2, 1)) and v.C(3) > v.C(2) > v.C(1) and v.O(3) > v.O(2) > v.O(1) and v.white(0) and v.O(0) < v.C(1) and v.C(0) > v.O(3)
    down = all(v.white(k) for k in (3, 2, 1)) and v.C(3) < v.C(2) < v.C(1) and v.O(3) < v.O(2) < v.O(1) and v.black(0) and v.O(0) > v.C(1) and v.C(0) < v.O(3)
    return two(up, down)


def outside3(v):
    return two(v.black(2) and v.white(1) and v.C(1) > v.O(2) and v.O(1) < v.C(2) and v.C(0) > v.C(1), v.white(2) and v.black(1) and v.C(1) < v.O(2) and v.O(1) > v.C(2) and v.C(0) < v.C(1))


def starsinsouth3(v):
    return 100 if (
        all(v.black(k) for k in (0, 1, 2)) and v.long(2) and v.lower(2) > v.tiny(2) and v.body(1) < v.body(2) and v.H(1) < v.O(2) and v.L(1) > v.L(2) and v.lower(1) > v.tiny(2)
        and v.body(0) < v.body(1) and v.H(0) <= v.O(0) and v.L(0) >= v.C(0)
    ) else 0


def whitesoldiers3(v):
    up = all(v.white(k) for k in (0, 1, 2)) and v.C(0) > v.C(1) > v.C(2) and v.O(2) < v.O(1) < v.C(2) and v.O(1) < v.O(0) < v.C(1)
    return 100 if up and v.upper(2) < v.tiny(2) and v.upper(1) < v.tiny(1, FIRST_TEN) and v.upper(0) < v.tiny(0, FIRST_TEN) else 0


def abandonedbaby(v):
    if not (v.long(2) and v.doji(1, seed=FIRST_TEN) and v.long(0)):
        return 0
    up = v.black(2) and v.H(1) < v.L(2) and v.white(0) and v.L(0) > v.H(1) and v.C(0) > v.C(2) + v.body(2) * v.p
    down = v.white(2) and v.L(1) > v.H(2) and v.black(0) and v.H(0) < v.L(1) and v.C(0) < v.C(2) - v.body(2) * v.p
    return two(up, down)


def advanceblock(v):
    if not (all(v.white(k) for k in (0, 1, 2)) and v.C(0) > v.C(1) > v.C(2) and v.O(2) < v.O(1) <= v.C(2) + v.near(2) and v.O(1) < v.O(0) <= v.C(1) + v.near(1) and v.long(2) and v.upper(2) < v.half(2)):
        return 0
    shrinking = v.body(1) < v.body(2) - v.far(2) and v.body(0) < v.body(1) + v.near(1)
    smaller = v.body(0) < v.body(1) - v.far(1)
    shaded = v.body(0) < v.body(1) < v.body(2) and (v.upper(0) > v.half(0) or v.upper(1) > v.half(1))
    return -100 if shrinking or smaller or shaded or (v.body(0) < v.body(1) and v.upper(0) > v.body(0)) else 0


def breakaway(v):
    up = v.black(4) and v.long(4) and v.black(3) and v.H(3) < v.L(4) and v.black(2) and v.black(1) and v.C(3) > v.C(2) > v.C(1) and v.H(2) < v.L(4) and v.H(1) < v.L(4) and v.white(0) and v.O(3) < v.C(0) < v.C(4)
    down = v.white(4) and v.long(4) and v.white(3) and v.L(3) > v.H(4) and v.white(2) and v.white(1) and v.C(3) < v.C(2) < v.C(1) and v.L(2) > v.H(4) and v.L(1) > v.H(4) and v.black(0) and v.C(4) < v.C(0) < v.O(3)
    return two(up, down)


def concealbabyswall(v):
    marubozu = v.upper(3) < v.tiny(3) and v.lower(3) < v.tiny(3) and v.upper(2) < v.tiny(2, FIRST_TEN) and v.lower(2) < v.tiny(2, FIRST_TEN)
    return 100 if all(v.black(k) for k in range(4)) and marubozu and v.O(1) < v.C(2) and v.H(1) > v.C(2) and v.O(0) >= v.top(1) and v.C(0) <= v.bottom(1) else 0


def counterattack(v):
    if not (v.long(1) and v.long(0, at=1) and abs(v.C(0) - v.C(1)) <= v.equal(1, seed=(0, 4))):
        return 0
    return two(v.black(1) and v.white(0), v.white(1) and v.black(0))


def gapsidesidewhite(v):
    up, down = v.bottom(1) > v.top(2) and v.bottom(0) > v.top(2), v.top(1) < v.bottom(2) and v.top(0) < v.bottom(2)
    alike = v.white(1) and v.white(0) and abs(v.body(0) - v.body(1)) < v.near(1) and abs(v.O(0) - v.O(1)) < v.equal(1)
    return two(up, down) if alike else 0


def haramicross(v):
    if not (v.long(1) and v.doji(0)):
        return 0
    if v.top(0) < v.top(1) and v.bottom(0) > v.bottom(1):
        return -100 * v.sign(1)
    return -80 * v.sign(1) if v.top(0) <= v.top(1) and v.bottom(0) >= v.bottom(1) else 0


def kick(v):
    apart = v.long(1) and v.upper(1) < v.tiny(1) and v.lower(1) < v.tiny(1) and v.long(0) and v.upper(0) < v.tiny(0) and v.lower(0) < v.tiny(0)
    return apart and (v.black(1) and v.white(0) and v.bottom(0) > v.top(1) or v.white(1) and v.black(0) and v.top(0) < v.bottom(1))


def mathold(v):
    small = all(v.short(k, at=4) and v.top(k) < v.C(4) and v.bottom(k) > v.O(4) for k in (3, 2, 1))
    return 100 if v.white(4) and v.long(4) and small and v.white(0) and v.C(0) > v.C(4) else 0


def risefall3methods(v):
    if not (v.long(4) and all(v.short(k, at=4) for k in (3, 2, 1))):
        return 0
    up = v.white(4) and all(v.black(k) for k in (3, 2, 1)) and v.C(3) > v.O(4) and v.C(1) < v.C(4) and v.O(3) < v.C(4) and v.white(0) and v.O(0) > v.C(1) and v.C(0) > v.C(4)
    down = v.black(4) and all(v.white(k) for k in (3, 2, 1)) and v.C(3) < v.O(4) and v.C(1) > v.C(4) and v.O(3) > v.C(4) and v.black(0) and v.O(0) < v.C(1) and v.C(0) < v.C(4)
    return two(up, down)


def separatinglines(v):
    if not (v.sign(1) == -v.sign(0) and abs(v.O(0) - v.O(1)) <= v.equal(1) and v.long(0)):
        return 0
    return two(v.white(0) and v.lower(0) < v.tiny(0), v.black(0) and v.upper(0) < v.tiny(0))


def tasukigap(v):
    if not abs(v.body(1) - v.body(0)) < v.near(1):
        return 0
    up = v.bottom(1) > v.top(2) and v.white(1) and v.black(0) and v.O(1) < v.O(0) < v.C(1) and v.top(2) < v.C(0) < v.O(1)
    down = v.top(1) < v.bottom(2) and v.black(1) and v.white(0) and v.C(1) < v.O(0) < v.O(1) and v.O(1) < v.C(0) < v.bottom(2)
    return two(up, down)


def tristar(v):
    if not all(v.doji(k, at=2) for k in (2, 1, 0)):
        return 0
    return two(v.top(1) < v.bottom(2) and v.bottom(0) > v.bottom(1), v.bottom(1) > v.top(2) and v.top(0) < v.top(1))


def xsidegap3methods(v):
    if not (v.sign(2) == v.sign(1) == -v.sign(0) and v.bottom(1) < v.O(0) < v.top(1) and v.bottom(2) < v.C(0) < v.top(2)):
        return 0
    return two(v.white(2) and v.bottom(1) > v.top(2), v.black(2) and v.top(1) < v.bottom(2))


def yes(value, rule):
    return lambda v: value if rule(v) else 0


def signed(rule):
    return lambda v: 100 * v.sign(0) if rule(v) else 0


def star(v, small, first):
    """An evening star: small(v) says what the middle bar is."""
    return v.white(2) and v.long(2) and small and v.bottom(1) > v.C(2) and v.black(0) and v.long(0) and v.C(0) < v.C(2) - v.body(2) * v.p


def fallen(v):
    """A long black bar and a white one that opens below its low."""
    return v.black(1) and v.long(1) and v.white(0) and v.O(0) < v.L(1)


#: pattern -> (lookback, function of a View)
CANDLES = {
    "cdl2crows": (12, crows2), "cdl3blackcrows": (12, blackcrows3), "cdl3inside": (12, inside3), "cdl3linestrike": (13, linestrike3), "cdl3outside": (2, outside3), "cdl3starsinsouth": (12, starsinsouth3),
    "cdl3whitesoldiers": (12, whitesoldiers3), "cdlabandonedbaby": (12, abandonedbaby), "cdladvanceblock": (12, advanceblock),
    "cdlbelthold": (10, lambda v: two(v.long(0) and v.white(0) and v.lower(0) < v.tiny(0), v.long(0) and v.black(0) and v.upper(0) < v.tiny(0))), "cdlbreakaway": (14, breakaway),
    "cdlclosingmarubozu": (10, lambda v: two(v.long(0) and v.white(0) and v.upper(0) < v.tiny(0), v.long(0) and v.black(0) and v.lower(0) < v.tiny(0))), "cdlconcealbabyswall": (13, concealbabyswall), "cdlcounterattack": (11, counterattack),
    "cdldarkcloudcover": (11, yes(-100, lambda v: v.white(1) and v.long(1) and v.black(0) and v.O(0) > v.H(1) and v.O(1) < v.C(0) < v.C(1) - v.body(1) * v.p)), "cdldoji": (10, yes(100, lambda v: v.doji(0))),
    "cdldojistar": (11, lambda v: two(v.long(1) and v.doji(0) and v.black(1) and v.top(0) < v.C(1), v.long(1) and v.doji(0) and v.white(1) and v.bottom(0) > v.C(1))),
    "cdldragonflydoji": (10, yes(100, lambda v: v.doji(0) and v.upper(0) < v.tiny(0) and v.lower(0) > v.tiny(0))),
    "cdlengulfing": (1, lambda v: two(v.black(1) and v.white(0) and v.C(0) > v.O(1) and v.O(0) < v.C(1), v.white(1) and v.black(0) and v.C(0) < v.O(1) and v.O(0) > v.C(1))),
    "cdleveningdojistar": (12, yes(-100, lambda v: star(v, v.doji(1), 12))), "cdleveningstar": (12, yes(-100, lambda v: star(v, v.body(1) <= v.m("body", 10, 1), 12))), "cdlgapsidesidewhite": (7, gapsidesidewhite),
    "cdlgravestonedoji": (10, yes(100, lambda v: v.doji(0) and v.lower(0) < v.tiny(0) and v.upper(0) > v.tiny(0))),
    "cdlhammer": (11, yes(100, lambda v: v.short(0) and v.lower(0) > v.body(0) and v.upper(0) < v.tiny(0) and v.bottom(0) <= v.L(1) + v.near(1))),
    "cdlhangingman": (11, yes(-100, lambda v: v.short(0) and v.lower(0) > v.body(0) and v.upper(0) < v.tiny(0) and v.bottom(0) >= v.H(1) - v.near(1))),
    "cdlharami": (11, lambda v: -100 * v.sign(1) if v.long(1) and v.short(0, seed=FIRST_TEN) and v.top(0) < v.top(1) and v.bottom(0) > v.bottom(1) else 0), "cdlharamicross": (11, haramicross),
    "cdlhighwave": (10, signed(lambda v: v.short(0) and v.upper(0) > 2 * v.body(0) and v.lower(0) > 2 * v.body(0))),
    "cdlhomingpigeon": (11, yes(100, lambda v: v.black(1) and v.black(0) and v.long(1) and v.body(0) <= v.m("body", 10, 0) and v.O(0) < v.O(1) and v.C(0) > v.C(1))),
    "cdlidentical3crows": (12, yes(-100, lambda v: all(v.black(k) and v.upper(k) <= 0.1 * v.m("upper", 10, 2) for k in (2, 1, 0)) and abs(v.O(1) - v.C(2)) <= v.equal(2, 10) and abs(v.O(0) - v.C(1)) <= v.equal(2, 10))),
    "cdlinneck": (11, yes(-100, lambda v: fallen(v) and abs(v.C(0) - v.C(1)) <= v.equal(1, 10))),
    "cdlinvertedhammer": (11, yes(100, lambda v: v.short(0) and v.upper(0) > v.body(0) and v.lower(0) < v.tiny(0) and v.top(0) < v.bottom(1))),
    "cdlkicking": (11, lambda v: 100 * v.sign(0) if kick(v) else 0), "cdlkickingbylength": (11, lambda v: 100 * v.sign(0 if v.body(0) > v.body(1) else 1) if kick(v) else 0),
    "cdlladderbottom": (14, yes(100, lambda v: all(v.black(k) for k in (4, 3, 2)) and v.O(4) > v.O(3) > v.O(2) and v.C(4) > v.C(3) > v.C(2) and v.black(1) and v.upper(1) > v.tiny(1) and v.white(0) and v.O(0) > v.O(1) and v.C(0) > v.H(1))),
    "cdllongleggeddoji": (10, yes(100, lambda v: v.doji(0) and (v.upper(0) > v.body(0) or v.lower(0) > v.body(0)))), "cdllongline": (10, signed(lambda v: v.long(0) and v.upper(0) < v.half(0) and v.lower(0) < v.half(0))),
    "cdlmarubozu": (10, signed(lambda v: v.long(0) and v.upper(0) <= v.tiny(0) and v.lower(0) <= v.tiny(0))), "cdlmatchinglow": (6, yes(100, lambda v: v.black(1) and v.black(0) and abs(v.C(0) - v.C(1)) <= v.equal(1))), "cdlmathold": (14, mathold),
    "cdlmorningdojistar": (12, yes(100, lambda v: v.black(2) and v.long(2) and v.doji(1) and v.top(1) < v.C(2) and v.white(0) and v.long(0) and v.C(0) > (v.O(2) + v.C(2)) / 2)),
    "cdlmorningstar": (12, yes(100, lambda v: v.black(2) and v.long(2) and v.short(1) and v.top(1) < v.C(2) and v.white(0) and v.long(0) and v.C(0) > v.C(2) + 0.3 * (v.O(2) - v.C(2)))),
    "cdlonneck": (11, yes(-100, lambda v: fallen(v) and abs(v.C(0) - v.L(1)) <= v.equal(1, 10))), "cdlpiercing": (11, yes(100, lambda v: fallen(v) and v.long(0, at=1) and (v.O(1) + v.C(1)) / 2 < v.C(0) < v.O(1))),
    "cdlrickshawman": (10, yes(100, lambda v: v.doji(0) and v.upper(0) > v.body(0) and v.lower(0) > v.body(0) and v.bottom(0) <= (v.H(0) + v.L(0)) / 2 + v.near(0) and v.top(0) >= (v.H(0) + v.L(0)) / 2 - v.near(0))),
    "cdlrisefall3methods": (14, risefall3methods), "cdlseparatinglines": (11, separatinglines),
    "cdlshootingstar": (11, yes(-100, lambda v: v.short(0) and v.upper(0) > v.body(0) and v.lower(0) < v.tiny(0) and v.bottom(0) > v.top(1))),
    "cdlshortline": (10, signed(lambda v: v.short(0) and v.upper(0) < v.half(0) and v.lower(0) < v.half(0))), "cdlspinningtop": (10, signed(lambda v: v.short(0) and v.upper(0) > v.body(0) and v.lower(0) > v.body(0))),
    "cdlstalledpattern": (12, yes(-100, lambda v: all(v.white(k) for k in (2, 1, 0)) and v.long(2) and v.long(1, at=2) and v.short(0, at=2) and abs(v.O(1) - v.C(2)) <= v.near(2, 10) and v.upper(0) < v.tiny(2))),
    "cdlsticksandwich": (7, yes(100, lambda v: v.black(2) and v.white(1) and v.black(0) and v.L(1) > v.C(2) and abs(v.C(0) - v.C(2)) <= v.equal(2))),
    "cdltakuri": (10, yes(100, lambda v: v.doji(0) and v.upper(0) <= v.tiny(0) and v.lower(0) > 2 * v.body(0))), "cdltasukigap": (7, tasukigap),
    "cdlthrusting": (11, yes(-100, lambda v: fallen(v) and v.C(1) < v.C(0) < (v.O(1) + v.C(1)) / 2 - v.equal(1, 10))), "cdltristar": (12, tristar),
    "cdlunique3river": (12, yes(100, lambda v: v.black(2) and v.long(2) and v.black(1) and v.L(1) < v.L(2) and v.short(1, at=2) and v.C(1) > v.C(2) and v.white(0) and v.short(0, at=2) and v.C(0) < v.O(1))),
    "cdlupsidegap2crows": (12, yes(-100, lambda v: v.white(2) and v.long(2) and v.black(1) and v.O(1) > v.C(2) and v.black(0) and v.O(0) > v.O(1) and v.C(2) < v.C(0) < v.C(1))), "cdlxsidegap3methods": (2, xsidegap3methods),
}
PENETRATION = {"cdlabandonedbaby": 0.3, "cdldarkcloudcover": 0.5, "cdleveningdojistar": 0.3, "cdleveningstar": 0.3}


def pattern(name, o, h, l, c):  # noqa: E741
    first, rule = CANDLES[name]
    bars = Bars(o, h, l, c)
    return [0 if t < first else rule(View(bars, t, first, PENETRATION.get(name))) for t in range(len(o))]
