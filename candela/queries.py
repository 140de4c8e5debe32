"""One query per indicator over hourly bars of `events`, rounded to six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ta
from .plans.planner import Indicators
from .plans.registry import INDICATORS
from .sources.bars import event_bars, line_bars

#: Indicators whose input must lie in (-1, 1) or shouldn't be large.
UNIT = ["acos", "asin", "atan", "cos", "cosh", "exp", "sin", "sinh", "tan", "tanh"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the inputs that some indicators name: real0, real1, periods, unit."""
    return event_bars(spark, sf_dir).select(
        "*",
        F.col("close").alias("real0"),
        F.col("high").alias("real1"),
        (F.col("volume") * 3).alias("periods"),
        F.try_divide(F.col("close"), F.lit(1.0) + F.abs("close")).alias("unit"),
    )


def rounded(c: Column) -> Column:
    # Adding zero turns -0.0 into 0.0.
    return F.round(c, 6) + F.lit(0.0)


def spec_of(name: str):
    return INDICATORS[name]("unit") if name in UNIT else INDICATORS[name]()


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        outputs = INDICATORS[name].outputs
        table = bars(spark, sf_dir)
        whole = Indicators(table, "key", "ts").with_(v=spec_of(name), rn=_index()).frame(keep=["key"])
        columns = {o: F.col(f"v_{o}" if len(outputs) > 1 else "v") for o in outputs}
        sound = [c.isNotNull() & ~F.isnan(c) for c in columns.values()]
        for s in sound:
            whole = whole.filter(s)
        return whole.select("key", F.col("rn").cast("long").alias("rn"), *(rounded(c).alias(o) for o, c in columns.items()))

    return run


def _index():
    """The bar's index as an indicator of its own, so that it shares the plan."""
    from .plans.registry import Indicator

    return Indicator("rn", (), ("value",), {}, lambda f: f.rn, "index")()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI, MACD, Bollinger bands and engulfing bars of every event type, in one plan."""
    return (
        Indicators(bars(spark, sf_dir), "key", "ts")
        .with_(rsi=ta.rsi("close", period=14), macd=ta.macd(), bb=ta.bbands(period=20), engulfing=ta.cdlengulfing())
        .frame(keep=["key", "ts", "close"])
    )


def vwap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .custom import vwap_spec

    out = Indicators(bars(spark, sf_dir), "key", "ts").with_(v=vwap_spec(period=14), rn=_index()).frame(keep=["key"])
    return out.filter(F.col("v").isNotNull() & ~F.isnan("v")).select("key", F.col("rn").cast("long").alias("rn"), rounded(F.col("v")).alias("value"))


#: Queries over one long series, cut into time blocks: indicators of each class, with what they are called.
LONG = {
    "long_windows": lambda: {
        "sma": ta.sma(), "wma": ta.wma(), "trima": ta.trima(), "stddev": ta.stddev(), "mom": ta.mom(), "max": ta.max(), "willr": ta.willr(), "cci": ta.cci(), "correl": ta.correl(), "linearreg": ta.linearreg(), "stoch": ta.stoch(),
    },
    "long_running": lambda: {"obv": ta.obv(), "ad": ta.ad(), "ultosc": ta.ultosc(), "bbands": ta.bbands()},
    "long_means": lambda: {"ema": ta.ema(), "dema": ta.dema(), "tema": ta.tema(), "t3": ta.t3(), "trix": ta.trix()},
    "long_momentum": lambda: {"macd": ta.macd(), "rsi": ta.rsi(), "atr": ta.atr(), "adx": ta.adx(), "adosc": ta.adosc()},
    "long_patterns": lambda: {n: getattr(ta, n)() for n in ("cdlengulfing", "cdldoji", "cdlharami", "cdl3outside", "cdlmorningstar", "cdlmatchinglow")},
}


def long_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """All bars of the series: index and indicators, NULL where they have no value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars_ = line_bars(spark, sf_dir).select("*", F.col("close").alias("real0"), F.col("high").alias("real1"))
        out = Indicators(bars_, "key", "ts", block_bars="auto").with_(rn=_index(), **LONG[name]()).frame(keep=[])
        return out.select(F.col("rn").cast("long").alias("rn"), *(rounded(F.col(f"`{c}`")).alias(c) for c in out.columns if c != "rn"))

    return run


#: Queries whose rows are all bars, also those without a value; in nan_bars, close is NaN at some.
WHOLE = {
    "ma_types": lambda: {f"type{t}": ta.ma("close", period=10, matype=t) for t in range(9)},
    "macdext_types": lambda: {
        "mean": ta.macdext("close", fast_matype=1, slow_matype=0, signal_matype=2),
        "double": ta.macdext("close", fast_matype=3, slow_matype=2, signal_matype=1),
        "adaptive": ta.macdext("close", fast_matype=6, slow_matype=5, signal_matype=4),
    },
    "nan_bars": lambda: {
        "sma": ta.sma(), "ema": ta.ema(), "wma": ta.wma(), "stddev": ta.stddev(), "mom": ta.mom(), "linearreg": ta.linearreg(), "trange": ta.trange(),
        "max": ta.max("close", period=30), "min": ta.min("close", period=30), "obv": ta.obv(), "engulfing": ta.cdlengulfing(),
        "search_max": ta.max("close", period=30, exact_nan=True), "search_maxindex": ta.maxindex("close", period=30, exact_nan=True),
        "search_min": ta.min("close", period=30, exact_nan=True), "search_minindex": ta.minindex("close", period=30, exact_nan=True),
    },
}


def with_gaps(bars_: DataFrame) -> DataFrame:
    """close is NaN where its hundredths leave a rest of 7 over 199."""
    return bars_.withColumn("close", F.when(F.floor(F.col("close") * 100) % 199 == 7, F.lit(float("nan"))).otherwise(F.col("close")))


def whole_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """All bars: key, index and, for each output, its value (NULL where it has none) and <output>_nan, whether it is NaN."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = event_bars(spark, sf_dir)
        table = with_gaps(table) if name == "nan_bars" else table
        out = Indicators(table, "key", "ts").with_(rn=_index(), **WHOLE[name]()).frame(keep=["key"])
        columns = [c for c in out.columns if c not in ("key", "rn")]
        nan = {c: F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)) for c in columns}
        values = (F.when(~nan[c], rounded(F.col(c).cast("double"))).alias(c) for c in columns)
        return out.select("key", F.col("rn").cast("long").alias("rn"), *values, *(n.alias(f"{c}_nan") for c, n in nan.items()))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in ta.names()} | {"vwap": vwap_query} | {name: long_query(name) for name in LONG} | {name: whole_query(name) for name in WHOLE}
