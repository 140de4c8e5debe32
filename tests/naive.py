"""Indicators over plain lists, straight from their definitions; None stands for the lookback."""

import math

NAN = float("nan")


def pad(values, n):
    return [None] * (n - len(values)) + values


def poisoned(xs, t):
    return any(math.isnan(v) for v in xs[: t + 1])


def rolling(xs, p, f):
    return [None if t < p - 1 else NAN if poisoned(xs, t) else f(xs[t - p + 1 : t + 1]) for t in range(len(xs))]


def sma(xs, p):
    return rolling(xs, p, lambda w: sum(w) / p)


def wma(xs, p):
    return rolling(xs, p, lambda w: sum((k + 1) * v for k, v in enumerate(w)) / (p * (p + 1) / 2))


def ema(xs, p, k=None):
    """xs may start with None."""
    k = 2 / (p + 1) if k is None else k
    start = next((i for i, v in enumerate(xs) if v is not None), len(xs))
    out, y = [None] * len(xs), None
    for t in range(start + p - 1, len(xs)):
        y = sum(xs[start : start + p]) / p if y is None else xs[t] * k + y * (1 - k)
        out[t] = y
    return out


def combine(f, *series):
    return [None if any(v is None for v in vs) else f(*vs) for vs in zip(*series)]


def dema(xs, p):
    a = ema(xs, p)
    return combine(lambda u, v: 2 * u - v, a, ema(a, p))


def tema(xs, p):
    a = ema(xs, p)
    b = ema(a, p)
    return combine(lambda u, v, w: 3 * u - 3 * v + w, a, b, ema(b, p))


def rsi(xs, p):
    d = [None] + [b - a for a, b in zip(xs, xs[1:])]
    side = lambda s: [None if v is None else NAN if math.isnan(v) else max(0.0, s * v) for v in d]
    up, down = ema(side(1), p, 1 / p), ema(side(-1), p, 1 / p)
    return combine(lambda g, v: 0.0 if g == 0 else 100.0 if v == 0 else 100 - 100 / (1 + g / v), up, down)


def true_range(h, l, c):  # noqa: E741
    out = [None]
    for t in range(1, len(h)):
        if math.isnan(h[t]) or math.isnan(l[t]):
            out.append(NAN)
        elif math.isnan(c[t - 1]):
            out.append(h[t] - l[t])
        else:
            out.append(max(h[t] - l[t], abs(h[t] - c[t - 1]), abs(l[t] - c[t - 1])))
    return out


def atr(h, l, c, p):  # noqa: E741
    return ema(true_range(h, l, c), p, 1 / p)


def wilder_sum(v, p, first_out):
    out, s = [None] * len(v), 0.0
    for t in range(1, len(v)):
        s = s + v[t] if t < p else s * (1 - 1 / p) + v[t]
        if t >= first_out:
            out[t] = s
    return out


def moves(h, l, strict):  # noqa: E741
    plus, minus = [0.0], [0.0]
    for t in range(1, len(h)):
        up, down = h[t] - h[t - 1], l[t - 1] - l[t]
        bad = math.isnan(up) or math.isnan(down)
        plus.append(NAN if bad and strict else up if up > down and up > 0 else 0.0)
        minus.append(NAN if bad and strict else down if down > up and down > 0 else 0.0)
    return plus, minus


def plus_dm(h, l, p):  # noqa: E741
    return wilder_sum(moves(h, l, False)[0], p, p - 1)


def dx(h, l, c, p):  # noqa: E741
    a, b = (wilder_sum(m, p, p) for m in moves(h, l, True))
    tr = true_range(h, l, c)
    bad = [any(v is not None and math.isnan(v) for v in tr[: t + 1]) for t in range(len(tr))]
    line = combine(lambda u, v: 0.0 if u + v == 0 else 100 * abs(u - v) / (u + v), a, b)
    return [NAN if b and v is not None else v for v, b in zip(line, bad)]


def adx(h, l, c, p):  # noqa: E741
    return ema(dx(h, l, c, p), p, 1 / p)


def kama(xs, p):
    out, y = [None] * len(xs), None
    for t in range(p - 1, len(xs)):
        if t == p - 1:
            y = xs[t]
            continue
        path = sum(abs(b - a) for a, b in zip(xs[t - p : t], xs[t - p + 1 : t + 1]))
        er = abs(xs[t] - xs[t - p]) / path if path > 0 else 0.0
        c = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        y = y + c * (xs[t] - y)
        out[t] = y
    return out


def obv(c, v):
    out, s = [], v[0]
    for t in range(len(c)):
        if t:
            s += v[t] if c[t] > c[t - 1] else -v[t] if c[t] < c[t - 1] else 0.0
        out.append(s)
    return out


def linear(xs, p, at):
    out = []
    for t in range(len(xs)):
        if t < p - 1:
            out.append(None)
            continue
        w = xs[t - p + 1 : t + 1]
        mid, mean = (p - 1) / 2, sum(w) / p
        slope = sum((k - mid) * v for k, v in enumerate(w)) / sum((k - mid) ** 2 for k in range(p))
        out.append(mean + slope * (at(p) - mid))
    return out


def extremum(xs, p, largest, latest):
    """(value, index) with the rule for NaN: a window that is looked through anew starts from its oldest bar."""
    sign = 1 if largest else -1
    beats = (lambda a, b: a >= b) if latest else (lambda a, b: a > b)
    out, best, where = [], NAN, -1
    for t in range(len(xs)):
        lo = t - p + 1
        if lo < 0:
            out.append((None, None))
            continue
        if where < lo or math.isnan(best):
            best, where = sign * xs[lo], lo
            for k in range(lo + 1, t + 1):
                if beats(sign * xs[k], best):
                    best, where = sign * xs[k], k
        elif beats(sign * xs[t], best):
            best, where = sign * xs[t], t
        out.append((sign * best, where))
    return out


def hilbert(xs, warmup):
    """List of None or dict per bar: the cycle engine written with explicit even and odd lines."""
    out = [None] * len(xs)
    lines = {(s, e): {"ring": [0.0] * 3, "prev": 0.0, "last": 0.0} for s in "dqij" for e in (0, 1)}
    idx = 0
    i1 = {0: [0.0, 0.0], 1: [0.0, 0.0]}
    pi2 = pq2 = re = im = period = sp = phase = 0.0
    smooth, its = [], [0.0, 0.0, 0.0]

    def stage(name, e, x, adj):
        s = lines[name, e]
        y = -s["ring"][idx] + 0.0962 * x - s["prev"]
        s["ring"][idx] = 0.0962 * x
        s["prev"] = 0.5769 * s["last"]
        s["last"] = x
        return (y + s["prev"]) * adj

    for t in range(3 + warmup, len(xs)):
        adj, e = 0.075 * period + 0.54, t % 2
        sm = (4 * xs[t] + 3 * xs[t - 1] + 2 * xs[t - 2] + xs[t - 3]) / 10
        d = stage("d", e, sm, adj)
        q1 = stage("q", e, d, adj)
        i = i1[e][1]
        ji, jq = stage("i", e, i, adj), stage("j", e, q1, adj)
        if e == 0:
            idx = (idx + 1) % 3
        q2, i2 = 0.2 * (q1 + ji) + 0.8 * pq2, 0.2 * (i - jq) + 0.8 * pi2
        i1[1 - e] = [d, i1[1 - e][0]]
        re, im = 0.2 * (i2 * pi2 + q2 * pq2) + 0.8 * re, 0.2 * (i2 * pq2 - q2 * pi2) + 0.8 * im
        pq2, pi2 = q2, i2
        before = period
        if re and im:
            period = 360 / (math.atan(im / re) * 180 / math.pi)
        period = min(period, 1.5 * before)
        period = max(period, 0.67 * before)
        period = 0.2 * min(max(period, 6.0), 50.0) + 0.8 * before
        sp = 0.33 * period + 0.67 * sp
        smooth.append(sm)
        n = int(sp + 0.5)
        prices = ([0.0] * 50 + smooth)[-50:][::-1]
        a = sum(math.sin(2 * math.pi * k / n) * prices[k] for k in range(n))
        b = sum(math.cos(2 * math.pi * k / n) * prices[k] for k in range(n))
        was = phase
        if b:
            phase = math.atan(a / b) * 180 / math.pi
        elif a:
            phase += 90 if a > 0 else -90
        phase += 90 + 360 / sp
        if b < 0:
            phase += 180
        if phase > 315:
            phase -= 360
        avg = sum(xs[max(t - k, 0)] for k in range(n)) / n if n else 0.0
        line = (4 * avg + 3 * its[0] + 2 * its[1] + its[2]) / 10
        its = [avg, *its[:2]]
        out[t] = {"sp": sp, "i": i, "q": q1, "phase": phase, "was": was, "sine": math.sin(math.radians(phase)), "lead": math.sin(math.radians(phase + 45)), "line": line, "smooth": sm}
    return out
