"""The fixture datasets as tables of bars, from numpy's seeded generator (fixed values: seeds, sizes and scales)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _frame(o, h, l, c, v) -> pd.DataFrame:  # noqa: E741
    return pd.DataFrame({"open": o, "high": h, "low": l, "close": c, "volume": v})


def normal_1000() -> pd.DataFrame:
    r = np.random.default_rng(42)
    c = np.abs(100 + np.cumsum(r.normal(0, 2, 1000)))
    h, l = c * (1 + r.uniform(0, 0.02, 1000)), c * (1 - r.uniform(0, 0.02, 1000))  # noqa: E741
    return _frame(c * (1 + r.normal(0, 0.005, 1000)), h, l, c, r.uniform(1e6, 1e7, 1000))


def boundary_exact(lookback: int) -> pd.DataFrame:
    r, n = np.random.default_rng(123), lookback + 1
    c = np.abs(100 + np.cumsum(r.normal(0, 1, n)))
    return _frame(c, c * 1.01, c * 0.99, c, np.full(n, 1e6))


def boundary_short(lookback: int) -> pd.DataFrame:
    x = np.full(max(lookback, 1), 100.0)
    return _frame(x, x, x, x, x)


def with_nan_5pct() -> pd.DataFrame:
    df, r = normal_1000(), np.random.default_rng(99)
    for name in ("close", "high", "low"):
        df.loc[r.choice(1000, 50, replace=False), name] = np.nan
    return df


def all_same_value() -> pd.DataFrame:
    x = np.full(1000, 100.0)
    return _frame(x, x + 1, x - 1, x, np.full(1000, 1e6))


def real_btcusdt_1d() -> pd.DataFrame:
    r = np.random.default_rng(2024)
    c = 30_000 * np.exp(np.cumsum(r.normal(0.001, 0.03, 1000)))
    h, l = c * (1 + r.uniform(0, 0.03, 1000)), c * (1 - r.uniform(0, 0.03, 1000))  # noqa: E741
    return _frame(np.concatenate(([c[0]], c[:-1])), h, l, c, r.uniform(1e3, 1e5, 1000))


def real_flat_period() -> pd.DataFrame:
    c = np.abs(100 + np.cumsum(np.random.default_rng(555).normal(0, 0.05, 500)) * 0.001)
    return _frame(c, c + 0.05, c - 0.05, c, np.full(500, 1e6))


DATASETS = {f.__name__: f for f in (normal_1000, with_nan_5pct, all_same_value, real_btcusdt_1d, real_flat_period)}


def table(spark: SparkSession, frames: dict[str, pd.DataFrame]) -> DataFrame:
    """key, rn and the bars of each frame."""
    return spark.createDataFrame(pd.concat([f.assign(key=k, rn=np.arange(len(f))) for k, f in frames.items()], ignore_index=True))


def waves(spark: SparkSession, rows: int, keys: int = 1) -> DataFrame:
    """The benchmark's input, for each key: 100 + 10 sin(.01 i) + 5 sin(.003 i), made on the executors."""
    i = F.col("rn").cast("double")
    close = F.lit(100.0) + F.sin(i * 0.01) * 10 + F.sin(i * 0.003) * 5
    return spark.range(rows * keys).select((F.col("id") % keys).alias("key"), F.floor(F.col("id") / keys).alias("rn")).withColumn("close", close).select(
        "key", "rn", F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", F.lit(1e6).alias("volume")
    )
