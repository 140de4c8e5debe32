"""All rule-table patterns against plain Python, by position."""

import numpy as np
import pandas as pd
import pytest

import candles as P
from candela import ta
from candela.plans.planner import Indicators

GRID = 64.0  # prices on a binary grid: sums are exact, so ties of means and bodies are ties in any order of adding


def series(seed, n=400, nans=0):
    """Runs of one colour with bodies and shadows of mixed size, gaps, dojis and equal prices."""
    r = np.random.default_rng(seed)
    o, h, l, c = (np.zeros(n) for _ in range(4))  # noqa: E741
    last, colour = 200.0, 1
    for t in range(n):
        if r.random() < 0.4:
            colour = -colour
        body = r.choice([0, 1, 2, 8, 24, 40], p=[0.1, 0.1, 0.15, 0.2, 0.25, 0.2]) + r.integers(0, 3)
        gap = r.choice([0, 0, 1, -1, 6, -6, 14, -14, 30, -30]) + r.integers(-1, 2)
        if t > 1 and r.random() < 0.15:
            o[t] = o[t - 1]
        else:
            o[t] = last + gap / GRID
        c[t] = o[t] + colour * body / GRID
        if t > 1 and r.random() < 0.1:
            c[t] = c[t - r.integers(1, 3)]
        up, down = (r.choice([0, 0, 0, 1, 4, 20]) / GRID for _ in range(2))
        h[t], l[t] = max(o[t], c[t]) + up, min(o[t], c[t]) - down
        last = c[t]
    for x in (o, h, l, c):
        x[r.choice(np.arange(n // 2, n), nans, replace=False)] = np.nan
    return pd.DataFrame({"open": o, "high": h, "low": l, "close": c})


@pytest.fixture(scope="module")
def frames():
    return {k: series(k, nans=0 if k < 25 else 1 + k % 2) for k in range(60)}


@pytest.fixture(scope="module")
def got(spark, frames):
    table = spark.createDataFrame(pd.concat([f.assign(key=k, rn=np.arange(len(f))) for k, f in frames.items()]).sample(frac=1, random_state=1))
    out = Indicators(table, "key", "rn").with_(**{n: getattr(ta, n)() for n in P.CANDLES}).frame(keep=["key", "rn"])
    return out.toPandas().sort_values(["key", "rn"]).reset_index(drop=True)


def test_every_table_pattern_is_there():
    assert set(P.CANDLES) == set(ta.names("pattern")) - {"cdlhikkake", "cdlhikkakemod"}


@pytest.mark.parametrize("name", P.CANDLES)
def test_pattern_equals_plain_python(frames, got, name):
    want = np.concatenate([P.pattern(name, *(frames[k][c].tolist() for c in ("open", "high", "low", "close"))) for k in sorted(frames)])
    mine = got[name].to_numpy(float)
    wrong = np.flatnonzero(mine != want)
    assert len(wrong) == 0, (len(wrong), [(got.key[i], got.rn[i], mine[i], want[i]) for i in wrong[:5]])


def test_most_patterns_occur(got):
    fired = {n for n in P.CANDLES if (got[n] != 0).any()}
    assert len(fired) > 50, sorted(set(P.CANDLES) - fired)
