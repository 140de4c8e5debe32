"""Bars (key, ts, open, high, low, close, volume) from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "key string, ts timestamp, open double, high double, low double, close double, volume double"


def resample(df: DataFrame, key: str, ts: str, value: str, unit: str = "hour", order: list[str] | None = None) -> DataFrame:
    """OHLCV bars of a value per key and calendar unit; volume counts the rows.

    order: columns that tell the first and the last row of a bar; without ties.
    One partial aggregation before the shuffle on (key, unit).
    """
    first = F.struct(*(F.col(c) for c in order or [ts]))
    return (
        df.groupBy(F.col(key).cast("string").alias("key"), F.date_trunc(unit, F.col(ts)).alias("ts"))
        .agg(
            F.min_by(value, first).cast("double").alias("open"),
            F.max(value).cast("double").alias("high"),
            F.min(value).cast("double").alias("low"),
            F.max_by(value, first).cast("double").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour", key: str = "event_type") -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/events.parquet"), key, "ts", "value", unit, ["ts", "event_id"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "day", ["o_orderkey"])


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: a bar per order, of its lines' prices; volume counts the lines.

    Prices are over 997: means of values with two decimals would end in a five where they are rounded.
    """
    value = F.col("l_extendedprice") / 997
    at = F.struct("l_linenumber", value)
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.lit("all").alias("key"), F.col("l_orderkey").alias("ts"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
    )
