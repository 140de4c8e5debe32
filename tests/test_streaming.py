"""Streams give what the whole table gives."""

import os

import numpy as np
import pandas as pd
import pytest

from candela import ta
from candela.plans.planner import Indicators
from candela.streaming.planned import stream_indicators
from candela.streaming.reorder import ROCKSDB

SPECS = dict(
    sma=ta.sma(period=7), stddev=ta.stddev(period=6), stoch=ta.stoch(), obv=ta.obv(), ad=ta.ad(), engulfing=ta.cdlengulfing(), three=ta.cdl3whitesoldiers(), hikkake=ta.cdlhikkakemod(), ema=ta.ema(period=9), macd=ta.macd("close", fast_period=5, slow_period=9, signal_period=4),
    rsi=ta.rsi(period=5), adxr=ta.adxr(period=4), sar=ta.sar(), kama=ta.kama(period=5), aroon=ta.aroon(period=6), mavp=ta.mavp(maxperiod=9), linreg=ta.linearreg(period=5), trend=ta.ht_trendline(), ultosc=ta.ultosc(period1=3, period2=5, period3=8),
)


def bars(n, seed, start="2024-01-01"):
    r = np.random.default_rng(seed)
    c = np.abs(60 + np.cumsum(r.normal(0, 1, n)))
    o = c + r.normal(0, 0.6, n)
    h, l = np.maximum(o, c) + r.exponential(0.4, n), np.minimum(o, c) - r.exponential(0.4, n)  # noqa: E741
    f = pd.DataFrame({"ts": pd.date_range(start, periods=n, freq="h"), "open": o, "high": h, "low": l, "close": c, "volume": r.uniform(1, 9, n)})
    f["real0"], f["real1"], f["periods"] = f.close, f.high, f.volume * 2
    return f


SCHEMA = "key string, ts timestamp, open double, high double, low double, close double, volume double, real0 double, real1 double, periods double"


def feed(spark, folder, parts):
    """A stream of one file per part; a part is a micro-batch."""
    os.makedirs(folder)
    for k, part in enumerate(parts):
        made = f"{folder}-part{k}"
        spark.createDataFrame(part[[c.split()[0] for c in SCHEMA.split(", ")]], SCHEMA).coalesce(1).write.parquet(made)
        (name,) = [x for x in os.listdir(made) if x.endswith(".parquet")]
        os.rename(f"{made}/{name}", f"{folder}/{k:03}.parquet")
        os.utime(f"{folder}/{k:03}.parquet", (1e9 + k, 1e9 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def whole(spark, frame, specs):
    table = spark.createDataFrame(frame[[c.split()[0] for c in SCHEMA.split(", ")]], SCHEMA)
    return sorted_(Indicators(table, "key", "ts").with_(**specs).frame(keep=["key", "ts"]).toPandas())


def sorted_(df):
    return df.sort_values(["key", "ts"], na_position="first").reset_index(drop=True)


def equal(got, want, rows=None):
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert (got.ts == want.ts).all() and (got.key.fillna("") == want.key.fillna("")).all()
    for c in want.columns[2:]:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        assert (got[c].isna() == want[c].isna()).all(), c


def test_stream_of_every_class_equals_batch(spark, tmp_path):
    a, b, c = bars(100, 1).assign(key="a"), bars(40, 2).assign(key=None), bars(3, 3, "2024-01-03").assign(key="c")
    b.loc[[25, 30], "close"] = np.nan
    data = pd.concat([a, b, c])
    edges = pd.to_datetime(["2024-01-01", "2024-01-01 03:00", "2024-01-01 04:00", "2024-01-03", "2024-01-03 01:00", "2025-01-01"], format="mixed")
    parts = [data[(data.ts >= lo) & (data.ts < hi)].sample(frac=1, random_state=1) for lo, hi in zip(edges, edges[1:])]
    # A bar that comes again, and one from before, change nothing.
    parts[3] = pd.concat([parts[3], a[:2].assign(close=1.0)])
    stream = feed(spark, str(tmp_path / "in"), parts)
    stream_indicators(stream, str(tmp_path / "state"), keep=["key", "ts"], **SPECS).trigger(availableNow=True).start().awaitTermination()
    got = sorted_(spark.read.parquet(str(tmp_path / "state" / "results")).drop("n").toPandas())
    equal(got, whole(spark, data, SPECS))


def test_restarted_stream_goes_on(spark, tmp_path, monkeypatch):
    from candela.streaming import planned

    monkeypatch.setattr(planned, "COMPACT", 2)
    data = pd.concat([bars(30, 4).assign(key="a"), bars(12, 5).assign(key="b")])
    specs = {k: SPECS[k] for k in ("sma", "obv", "rsi", "engulfing")}
    cut = lambda lo, hi: data[(data.ts >= data.ts.min() + pd.Timedelta(hours=lo)) & (data.ts < data.ts.min() + pd.Timedelta(hours=hi))]
    folder = str(tmp_path / "in")
    stream = feed(spark, folder, [cut(0, 4), cut(4, 10), cut(10, 11), cut(11, 20), cut(20, 30)])
    held = f"{folder}-later"
    os.makedirs(held)
    for k in (3, 4):
        os.rename(f"{folder}/{k:03}.parquet", f"{held}/{k:03}.parquet")
    run = lambda: stream_indicators(stream, str(tmp_path / "state"), keep=["key", "ts"], **specs).trigger(availableNow=True).start().awaitTermination()
    run()
    for k in (3, 4):
        os.rename(f"{held}/{k:03}.parquet", f"{folder}/{k:03}.parquet")
    run()
    got = sorted_(spark.read.parquet(str(tmp_path / "state" / "results")).drop("n").toPandas())
    equal(got, whole(spark, data, specs))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.unset(name)


def test_shuffled_arrival_within_the_delay_equals_batch(spark, tmp_path, rocks):
    data = pd.concat([bars(60, 6).assign(key="a"), bars(60, 7).assign(key="b")])
    r = np.random.default_rng(8)
    arrival = data.ts + pd.to_timedelta(r.uniform(0, 5, len(data)), unit="h")
    shuffled = data.assign(at=arrival).sort_values("at").drop(columns="at")
    parts = [shuffled[k : k + 25] for k in range(0, len(shuffled), 25)]
    late = bars(1, 9).assign(key="a", close=-1.0)  # far behind the watermark
    parts[-1] = pd.concat([parts[-1], late])
    end = pd.concat([bars(1, 10, "2024-02-01").assign(key=k) for k in "ab"])  # lets the last bars pass
    specs = {k: SPECS[k] for k in ("sma", "stoch", "obv", "ema", "engulfing", "adxr")}
    stream = feed(spark, str(tmp_path / "in"), [*parts, end])
    seen = []
    stream_indicators(stream, str(tmp_path / "state"), lambda df, n: seen.append(df.toPandas()), delay="6 hours", keep=["key", "ts"], **specs).trigger(availableNow=True).start().awaitTermination()
    got = pd.concat([s for s in seen if len(s)])
    # Each key's bars left in order, over micro-batches.
    assert all(g.ts.is_monotonic_increasing for _, g in got.groupby("key")) and sum(len(s) > 0 for s in seen) > 2
    equal(sorted_(got), whole(spark, data, specs))
