"""Keys cut into blocks give what whole keys give."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela import oracle, queries, ta
from candela.operators import kernels as K
from candela.operators.linear import compose
from candela.plans import blocks
from candela.plans.frame import Frame
from candela.plans.planner import Indicators
from candela.plans.positions import positioned
from candela.plans.registry import INDICATORS
from candela.queries import spec_of

MAKERS = [
    K.Maker(K.Ema, 7), K.Maker(K.Ema, 5, 3, 0.2), K.Maker(K.Chain, 4, 6), K.Maker(K.Chain, 5, 2, 4), K.Maker(K.Macd, 4, 9, 3), K.Maker(K.Macd, 12, 26, 9, fast_k=0.15, slow_k=0.075), K.Maker(K.FromFirst, 6),
    K.Maker(K.WilderSum, 8), K.Maker(K.Kama, 9),
]


@pytest.mark.parametrize("maker", MAKERS, ids=lambda m: m.label)
@pytest.mark.parametrize("nan", [None, 20, 90])
def test_states_compose(maker, nan):
    """Blocks started from composed states go on as one pass does."""
    r = np.random.default_rng(1)
    inputs = [50 + np.cumsum(r.normal(size=200))] + ([r.uniform(0, 1, 200)] if maker.kind is K.Kama else [])
    if nan:
        inputs[0][nan] = np.nan
    whole = maker().push(*inputs)
    size = 60
    state, pieces = None, []
    for b in range(0, 200, size):
        part = [x[b : b + size] for x in inputs]
        kernel, summary = maker(), maker()
        assert size > kernel.warmup
        if b:
            kernel.enter(b, state)
            summary.enter(b, np.zeros(kernel.states))
        pieces.append(kernel.push(*part))
        decay = summary.decay(*part)
        summary.push(*part)
        state = decay @ state + summary.leave() if b else summary.leave()
    for k, out in enumerate(whole):
        assert np.allclose(np.concatenate([p[k] for p in pieces]), out, rtol=1e-10, atol=0, equal_nan=True)


def test_compose_is_the_recurrence():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 1000):
        gain, add = r.uniform(-1, 1, n), r.normal(size=n)
        y, want = 3.0, []
        for a, b in zip(gain, add):
            y = a * y + b
            want.append(y)
        assert np.allclose(compose(gain, add, 3.0), want, rtol=1e-12)


@pytest.fixture(scope="module")
def table(spark):
    """Three keys (one null) of 400, 150 and 9 bars; NaNs late in the second."""
    r = np.random.default_rng(3)
    frames = []
    for key, n in (("a", 400), (None, 150), ("c", 9)):
        c = np.abs(60 + np.cumsum(r.normal(0, 1, n)))
        o = c + r.normal(0, 0.6, n)
        h, l = np.maximum(o, c) + r.exponential(0.4, n), np.minimum(o, c) - r.exponential(0.4, n)  # noqa: E741
        f = pd.DataFrame({"key": key, "rn": np.arange(n), "open": o, "high": h, "low": l, "close": c, "volume": r.uniform(1, 9, n)})
        if key is None:
            f.loc[[120, 131], "close"] = np.nan
            f.loc[125, "high"] = np.nan
        frames.append(f)
    df = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=1), "key string, rn long, open double, high double, low double, close double, volume double").repartition(3)
    df = df.withColumns({"real0": F.col("close"), "real1": F.col("high"), "periods": F.col("volume") * 3, "unit": F.col("close") / 100})
    return df.persist()


def _rows(table, specs, block):
    out = Indicators(table, "key", "rn", block_bars=block).with_(**specs).frame(keep=["key", "rn"])
    df = out.toPandas()
    return df.assign(key=df.key.fillna("none")).sort_values(["key", "rn"]).reset_index(drop=True)


FAMILIES = sorted({i.family for i in INDICATORS.values()})


@pytest.mark.parametrize("family", FAMILIES)
def test_blocks_equal_whole_keys(spark, table, family):
    names = sorted(n for n, i in INDICATORS.items() if i.family == family)
    specs = {f"x_{n}": spec_of(n) for n in names}
    whole, cut = _rows(table, specs, None), _rows(table, specs, 30)
    assert list(whole.columns) == list(cut.columns) and len(whole) == len(cut) == 559
    for c in whole.columns[2:]:
        a, b = whole[c].to_numpy(float), cut[c].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), c
        assert (whole[c].isna() == cut[c].isna()).all(), c


def test_nested_averages_and_fallback(spark, table):
    specs = {"m": ta.macdext(fast_matype=6, slow_matype=8, signal_matype=4, slow_period=13, fast_period=6), "t": ta.ma(period=11, matype=5), "s": ta.sar(), "r": ta.stochrsi()}
    whole, cut = _rows(table, specs, None), _rows(table, specs, 64)
    for c in whole.columns[2:]:
        assert np.allclose(whole[c].to_numpy(float), cut[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_positions_and_sums(spark):
    r = np.random.default_rng(4)
    rows = [(("x", None, "y")[k % 3 if k % 7 else 0], int(r.integers(0, 50)), k, None if k % 11 == 0 else int(r.integers(-5, 9))) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v int").repartition(5)
    got = positioned(df, ["k"], ["o", "id"], "at", {"before": "v"}).collect()
    want = {}
    for key in ("x", None, "y"):
        total = 0
        for i, (_, id_, v) in enumerate(sorted((o, id_, v or 0) for k, o, id_, v in rows if k == key)):
            want[id_] = (i, total)
            total += v
    assert {x.id: (x["at"], x.before) for x in got} == want and len(got) == 500


def test_halo_reaches_back_as_far_as_windows_do(spark):
    text = "avg(__t1_) OVER (PARTITION BY key, __block ORDER BY __bar ASC NULLS FIRST ROWS BETWEEN -13 AND CURRENT ROW)"
    assert blocks.reach(text) == 13 and blocks.reach("(lag(__t0_, 5, NULL, false) OVER (x) + lag(coalesce(a, b), 9, NULL) OVER (y))") == 9
    frame = Frame(spark.range(3).selectExpr("id as key", "id as rn", "cast(id as double) as close"), "key", "rn", 10)
    frame.sum(frame.lag(F.col("close"), 4), 7)
    assert frame._block_size() == (11, {0: 10})  # the window of a lag reaches back through both
    assert blocks.reach("sum(x) OVER (ORDER BY b ROWS BETWEEN -12 AND -3)") == 12 and blocks.reach("a + b") == 0


@pytest.mark.parametrize("name", queries.LONG)
def test_long_queries_equal_their_sql(spark, monkeypatch, name):
    """In blocks of some hundred bars; NULL for NULL."""
    monkeypatch.setattr(blocks, "LEAST_BARS", 300)
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    got, want = queries.queries()[name](spark, path).toPandas().sort_values("rn"), con.execute(oracle.oracle_sql()[name]).df().sort_values("rn")
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 1000
    for c in want.columns:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.allclose(a, b, rtol=0, atol=1.5e-6, equal_nan=True), c


def test_slopes_need_no_lists(spark, table):
    plan = Indicators(table, "key", "rn").with_(w=ta.wma(), r=ta.linearreg(), t=ta.tsf()).frame()._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "regr_slope" in plan
