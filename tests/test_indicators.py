import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import naive as N
from candela import oracle, queries, ta
from candela.operators import kernels as K
from candela.plans.planner import Indicators, trim
from candela.sources import synthetic


def bars(n=120, seed=0, nans=0):
    r = np.random.default_rng(seed)
    c = np.round(np.abs(50 + np.cumsum(r.normal(0, 1, n))), 2)
    o = np.round(c + r.normal(0, 0.6, n), 2)
    h, l = np.round(np.maximum(o, c) + r.exponential(0.4, n), 2), np.round(np.minimum(o, c) - r.exponential(0.4, n), 2)  # noqa: E741
    df = pd.DataFrame({"open": o, "high": h, "low": l, "close": c, "volume": np.round(r.uniform(1, 9, n), 1)})
    for name in ("high", "low", "close"):
        df.loc[r.choice(np.arange(n // 3, n), nans, replace=False), name] = np.nan
    return df


def run(spark, frames, **specs):
    """One data frame per key, in order, from shuffled and repartitioned rows."""
    table = spark.createDataFrame(pd.concat([f.assign(key=k, rn=np.arange(len(f))) for k, f in frames.items()]).sample(frac=1, random_state=1)).repartition(3)
    table = table.withColumns({"real0": F.col("close"), "real1": F.col("high"), "periods": F.col("volume") * 3, "unit": F.col("close") / 100})
    out = Indicators(table, "key", "rn").with_(**specs).frame(keep=["key", "rn"]).toPandas()
    return {k: out[out.key == k].sort_values("rn").reset_index(drop=True) for k in frames}


def same(got, want, tolerance=1e-8):
    assert len(got) == len(want)
    for t, (a, b) in enumerate(zip(got, want)):
        missing = a is None or (isinstance(a, float) and math.isnan(a))
        if b is None or math.isnan(b):
            assert missing, (t, a, b)
        else:
            assert not missing and abs(a - b) <= tolerance * max(1, abs(b)), (t, a, b)


@pytest.mark.parametrize("nans", [0, 2])
def test_against_naive_definitions(spark, nans):
    frames = {"a": bars(120, 1, nans), "b": bars(90, 2, nans), "one": bars(1, 3), "few": bars(13, 4)}
    got = run(
        spark, frames, sma=ta.sma(period=7), wma=ta.wma(period=5), ema=ta.ema(period=9), dema=ta.dema(period=6), tema=ta.tema(period=5), rsi=ta.rsi(period=6), atr=ta.atr(period=5),
        plus_dm=ta.plus_dm(period=5), dx=ta.dx(period=5), adx=ta.adx(period=5), kama=ta.kama(period=6), obv=ta.obv(), linreg=ta.linearreg(period=6), tsf=ta.tsf(period=6), trange=ta.trange(),
    )
    for k, f in frames.items():
        h, l, c, v = (f[x].tolist() for x in ("high", "low", "close", "volume"))  # noqa: E741
        want = {
            "sma": N.sma(c, 7), "wma": N.wma(c, 5), "ema": N.ema(c, 9), "dema": N.dema(c, 6), "tema": N.tema(c, 5), "rsi": N.rsi(c, 6), "atr": N.atr(h, l, c, 5), "plus_dm": N.plus_dm(h, l, 5),
            "dx": N.dx(h, l, c, 5), "adx": N.adx(h, l, c, 5), "kama": N.kama(c, 6), "obv": N.obv(c, v), "linreg": N.linear(c, 6, lambda p: p - 1), "tsf": N.linear(c, 6, lambda p: p), "trange": N.true_range(h, l, c),
        }
        for name, w in want.items():
            if name == "obv" and nans:
                w = N.obv(c, v)
            same(got[k][name].tolist(), w)


def test_lookback_is_null_and_nan_stays(spark):
    f = bars(40, 5)
    f.loc[20, "close"] = np.nan
    table = spark.createDataFrame(f.assign(key="a", rn=range(40)))
    out = Indicators(table, "key", "rn").with_(x=ta.sma(period=5), y=ta.linearreg(period=5)).frame(keep=["rn"]).orderBy("rn").collect()
    assert [r.x is None for r in out] == [t < 4 for t in range(40)]
    assert all(math.isnan(r.x) for r in out[20:])
    assert [math.isnan(r.y) for r in out[4:]] == [20 <= t < 25 for t in range(4, 40)]
    short = Indicators(table, "key", "rn").with_(x=ta.sma(period=5)).frame(keep=["rn"])
    assert trim(short, "x").count() == 36


def test_nulls_count_as_nan_and_empty_tables(spark):
    schema = "key string, rn int, open double, high double, low double, close double, volume double"
    empty = spark.createDataFrame([], schema)
    assert Indicators(empty, "key", "rn").with_(a=ta.rsi(), b=ta.cdldoji(), c=ta.sma()).frame().count() == 0
    rows = [(None, t, 1.0, 2.0, 0.5, None if t == 3 else 1.0 + t, 1.0) for t in range(12)]
    out = Indicators(spark.createDataFrame(rows, schema), "key", "rn").with_(x=ta.ema(period=3), y=ta.mom(period=2)).frame(keep=["rn"]).orderBy("rn").collect()
    assert out[2].x == 2.0 and all(math.isnan(r.x) for r in out[3:])
    assert math.isnan(out[5].y) and out[6].y == 2.0


@pytest.mark.parametrize("block", [None, 16])
def test_extrema_follow_the_search_on_nan(spark, block):
    """By position, over many series full of NaNs and ties."""
    r = np.random.default_rng(5)
    frames = []
    for k in range(60):
        x = r.integers(0, 6, (3, 50)).astype(float)
        x[r.random((3, 50)) < (0.1, 0.25, 0.5)[k % 3]] = np.nan
        frames.append(pd.DataFrame({"key": k, "rn": np.arange(50), "high": x[0], "low": x[1], "close": x[2]}))
    table = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=1))
    exact = dict(period=6, exact_nan=True)
    specs = dict(mx=ta.max(**exact), mn=ta.min(**exact), mm=ta.minmax(**exact), at=ta.minmaxindex(**exact), aroon=ta.aroon(period=5, exact_nan=True), willr=ta.willr(**exact), k=ta.stochf(fastk_period=6, fastd_period=1, exact_nan=True))
    out = Indicators(table, "key", "rn", block_bars=block).with_(**specs).frame().toPandas()
    for k, f in enumerate(frames):
        got = out[out.key == k].sort_values("rn").reset_index(drop=True)
        find = lambda c, *how: N.extremum(f[c].tolist(), 6, *how)  # noqa: B023, E731
        top, bottom = find("close", True, False), find("close", False, False)
        same(got.mx.tolist(), [v for v, _ in top])
        same(got.mm_min.tolist(), [v for v, _ in bottom])
        same(got.at_max_idx.tolist(), [i for _, i in top])
        same(got.at_min_idx.tolist(), [i for _, i in bottom])
        since = lambda found: [None if i is None else (5 - (t - i)) * 20.0 for t, (_, i) in enumerate(found)]
        same(got.aroon_up.tolist(), since(find("high", True, True)))
        same(got.aroon_down.tolist(), since(find("low", False, True)))
        ends = list(zip(find("high", True, False), find("low", False, False), f.close))
        place = lambda formula: [None if h[0] is None else math.nan if math.isnan(h[0] + l[0] + c) else 0.0 if h[0] == l[0] else formula(h[0], l[0], c) for h, l, c in ends]
        same(got.willr.tolist(), place(lambda h, l, c: (h - c) / (h - l) * -100))  # noqa: E741
        # The mean over one bar keeps a NaN for good.
        raw = place(lambda h, l, c: (c - l) / (h - l) * 100)  # noqa: E741
        same(got.k_fastk.tolist(), raw)


def test_hilbert_and_mama_against_naive(spark):
    f = bars(150, 9)
    got = run(spark, {"a": f}, dc=ta.ht_dcperiod(), phase=ta.ht_dcphase(), phasor=ta.ht_phasor(), sine=ta.ht_sine(), line=ta.ht_trendline(), mode=ta.ht_trendmode(), mama=ta.mama())["a"]
    short, long = N.hilbert(f.close.tolist(), 9), N.hilbert(f.close.tolist(), 34)
    pick = lambda rows, name, start: [None if t < start else r[name] for t, r in enumerate(rows)]
    same(got.dc.tolist(), pick(short, "sp", 32))
    same(got.phasor_inphase.tolist(), pick(short, "i", 32))
    same(got.phasor_quadrature.tolist(), pick(short, "q", 32))
    for name, column in (("phase", "phase"), ("sine", "sine_sine"), ("lead", "sine_leadsine"), ("line", "line")):
        same(got[column].tolist(), pick(long, name, 63), 1e-6)
    assert got["mode"].tolist()[:63] == [0.0] * 63 and set(got["mode"]) <= {0.0, 1.0}
    assert got.mama_mama.isna().sum() == 32 and (got.mama_mama[60:] - f.close[60:]).abs().max() < 15


def test_kernels_do_not_depend_on_chunks():
    r = np.random.default_rng(1)
    x, h, l = (100 + np.cumsum(r.normal(size=150)) for _ in range(3))  # noqa: E741
    cases = [
        (K.Maker(K.Ema, 9), (x,)), (K.Maker(K.Chain, 4, 6), (x,)), (K.Maker(K.Macd, 5, 9, 4), (x,)), (K.Maker(K.FromFirst, 4), (x,)), (K.Maker(K.WilderSum, 6), (x,)), (K.Maker(K.Kama, 6), (x, np.abs(np.sin(x)))),
        (K.Maker(K.Sar, (0.02, 0.02, 0.2), (0.02, 0.02, 0.2)), (np.maximum(h, l), np.minimum(h, l))), (K.Maker(K.Phasor), (x,)), (K.Maker(K.Hilbert), (x,)), (K.Maker(K.Mama, 0.5, 0.05), (x,)),
        (K.Maker(K.Hikkake), (np.maximum(h, l), np.minimum(h, l), x)),
    ]
    for maker, inputs in cases:
        whole, kernel = maker().push(*inputs), maker()
        cuts = [1, 2, 5, 6, 40, 41, 99]
        parts = [kernel.push(*c) for c in zip(*(np.split(i, cuts) for i in inputs))]
        for k, out in enumerate(whole):
            np.testing.assert_allclose(np.concatenate([p[k] for p in parts]), out, rtol=1e-9, equal_nan=True, err_msg=maker.label)


def test_keys_are_independent(spark):
    frames = {k: bars(50 + k, k) for k in range(4)}
    together = run(spark, frames, a=ta.macd(), b=ta.cdlhikkake(), c=ta.stochrsi(), d=ta.adosc())
    for k, f in frames.items():
        alone = run(spark, {k: f}, a=ta.macd(), b=ta.cdlhikkake(), c=ta.stochrsi(), d=ta.adosc())[k]
        pd.testing.assert_frame_equal(together[k], alone)


def test_every_indicator_equals_duckdb_on_random_bars(spark):
    """The oracles of all indicators that have one, over bars that make most patterns fire."""
    frames = {str(k): bars(400, 20 + k) for k in range(3)}
    whole = pd.concat([f.assign(key=k, rn=np.arange(len(f))) for k, f in frames.items()], ignore_index=True)
    table = spark.createDataFrame(whole).withColumns({"real0": F.col("close"), "real1": F.col("high"), "periods": F.col("volume") * 3, "unit": F.col("close") / (1 + F.abs("close"))}).cache()
    con = duckdb.connect()
    con.register("whole", whole)
    sql = oracle.oracle_sql()
    begin = sql["sma"].index("bars AS")
    end = sql["sma"].index("b AS (") + sql["sma"][sql["sma"].index("b AS (") :].index("FROM bars)") + len("FROM bars)")
    own = "b AS (SELECT *, close AS real0, high AS real1, volume * 3 AS periods, close / (1 + abs(close)) AS unit FROM whole)"
    names = [n for n in ta.names() if n in sql]
    fired = 0
    for lo in range(0, len(names), 20):
        part = names[lo : lo + 20]
        made = Indicators(table, "key", "rn").with_(**{n: queries.spec_of(n) for n in part}).frame(keep=["key", "rn"]).toPandas()
        for n in part:
            want = con.execute(sql[n].replace(sql["sma"][begin:end], own)).df().sort_values(["key", "rn"]).reset_index(drop=True)
            columns = {c: n if len(want.columns) == 3 else f"{n}_{c}" for c in want.columns if c not in ("key", "rn")}
            got = made[["key", "rn", *columns.values()]].dropna().sort_values(["key", "rn"]).reset_index(drop=True)
            assert len(got) == len(want), n
            for c, g in columns.items():
                np.testing.assert_allclose(got[g].to_numpy(float), want[c].to_numpy(float), rtol=1e-6, atol=2e-6, err_msg=f"{n}.{c}")
            fired += n.startswith("cdl") and bool((want.iloc[:, 2] != 0).any())
    assert fired > 38


def test_all_158_are_there():
    assert len(ta.names()) == 158 and len(ta.names("pattern")) == 61 and len(queries.queries()) == 159 + len(queries.LONG) + len(queries.WHOLE)
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", queries.WHOLE)
def test_whole_queries_equal_their_sql(spark, name):
    """By position: lookbacks, NaN bars and all types of means."""
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    got, want = (d.sort_values(["key", "rn"]).reset_index(drop=True) for d in (queries.queries()[name](spark, path).toPandas(), con.execute(oracle.oracle_sql()[name]).df()))
    assert len(got) > 3000 and (name != "nan_bars" or got["sma_nan"].any() and got["search_min_nan"].any() and not got["search_max_nan"].equals(got["max_nan"]))
    pd.testing.assert_frame_equal(got[sorted(got.columns)], want[sorted(want.columns)], check_exact=False, rtol=0, atol=1.5e-6)


def test_struct_outputs_and_shared_plan(spark):
    table = synthetic.waves(spark, 60, 2)
    ind = Indicators(table, "key", "rn").with_(a=ta.sma(period=3), b=ta.bbands(period=5), c=ta.max(period=4), d=ta.cdlengulfing())
    df = ind.frame(flat=False)
    assert [f.name for f in df.schema["b"].dataType.fields] == ["upper", "middle", "lower"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_penetration_and_matype_parameters(spark):
    f = {"a": bars(200, 31)}
    got = run(spark, f, x=ta.cdldarkcloudcover(penetration=0.0), y=ta.cdldarkcloudcover(penetration=0.9), **{f"m{t}": ta.ma(period=6, matype=t) for t in range(9)}, **{"w": ta.wma(period=6), "k": ta.kama(period=6)})["a"]
    assert (got.x != 0).sum() >= (got.y != 0).sum()
    pd.testing.assert_series_equal(got.m2, got.w, check_names=False)
    pd.testing.assert_series_equal(got.m6, got.k, check_names=False)
    pd.testing.assert_series_equal(got.m7, got.m1, check_names=False)
    with pytest.raises(TypeError):
        ta.sma(length=3)


@pytest.mark.parametrize("name", synthetic.DATASETS)
def test_fixture_datasets_run_everything(spark, name):
    frame = synthetic.DATASETS[name]().head(200)
    got = run(spark, {"a": frame}, **{n: queries.spec_of(n) for n in ("sma", "bbands", "correl", "cci", "rsi", "adx", "sar", "cdlharami", "stochf", "ultosc", "beta", "natr", "t3")})["a"]
    assert len(got) == 200
    if name == "all_same_value":
        assert set(got.correl.dropna()) == {0.0} and set(got.rsi.dropna()) == {0.0} and set(got.cci.dropna()) == {0.0}
