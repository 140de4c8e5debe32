"""Fixture files: one JSON object with meta, input and output maps of number arrays (null: not a number)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType

from ..plans.planner import Indicators
from ..plans.registry import INDICATORS, Spec
from . import synthetic

_SERIES = MapType(StringType(), ArrayType(DoubleType()))
SCHEMA = StructType([
    StructField("meta", StructType([
        StructField("indicator", StringType()), StructField("params", MapType(StringType(), DoubleType())), StructField("talib_version", StringType()),
        StructField("generated_at", StringType()), StructField("dataset", StringType()),
    ])),
    StructField("input", _SERIES), StructField("output", _SERIES), StructField("lookback", LongType()), StructField("output_length", LongType()),
])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files that a path or glob names, with their file."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def long_form(records: DataFrame, column: str = "input") -> DataFrame:
    """file, indicator, series, rn, value: one row per number; null is NaN."""
    series = records.select("file", F.col("meta.indicator").alias("indicator"), F.explode(column).alias("series", "values"))
    return series.select("file", "indicator", "series", F.posexplode("values").alias("rn", "value")).withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def write_golden(records: DataFrame, path: str) -> None:
    """Records as JSON lines; numbers that aren't finite become null."""

    def finite(c: str):
        clean = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
        return F.transform_values(c, lambda _, xs: F.transform(xs, clean))

    records.select("meta", finite("input").alias("input"), finite("output").alias("output"), "lookback", "output_length").write.option("ignoreNullFields", False).mode("overwrite").json(path)


#: Output names of fixture files that differ from the library's.
OUTPUT_NAMES = {"values": "value", "minidx": "min_idx", "maxidx": "max_idx", "aroon_up": "up", "aroon_down": "down"}
#: Series that fixture files may have as input.
SERIES = ["open", "high", "low", "close", "volume", "periods", "real0", "real1"]


def spec_for(indicator: str, params: dict[str, float]) -> Spec:
    """The call that a file's meta asks for. Parameter names may lack the library's underscores."""
    kind = INDICATORS[indicator]
    own = {p.replace("_", ""): p for p in kind.params}
    given = {own[k.replace("_", "").lower()]: v for k, v in params.items()}
    typed = {k: type(kind.params[k])(v) if isinstance(kind.params[k], (int, float)) else v for k, v in given.items()}
    # Files give single-series indicators the series "close", whatever the library's default is.
    return kind(**typed)


def input_bars(records: DataFrame) -> DataFrame:
    """file, rn and the input series as columns (null: not in the file, or not a number)."""
    rows = records.select("file", "input", F.posexplode(F.map_values("input")[0]).alias("rn", "_"))
    return rows.select("file", "rn", *(F.get(F.try_element_at("input", F.lit(c)), F.col("rn")).alias(c) for c in SERIES))


def computed(records: DataFrame) -> DataFrame:
    """file, series, rn, got: what the library makes of the files' inputs, one plan for each indicator and parameters that some file has."""
    kinds = records.select(F.col("meta.indicator").alias("indicator"), F.map_entries("meta.params").alias("params")).distinct().collect()  # as many as there are kinds of files
    bars, out = input_bars(records), []
    names = {v: k for k, v in OUTPUT_NAMES.items() if k != "values"}
    for kind in kinds:
        if kind["indicator"] not in INDICATORS:
            continue
        spec = spec_for(kind["indicator"], {e["key"]: e["value"] for e in kind["params"] or []})
        mine = records.filter((F.col("meta.indicator") == kind["indicator"]) & F.map_entries("meta.params").eqNullSafe(F.lit(None) if kind["params"] is None else F.array(*(F.struct(F.lit(e["key"]).alias("key"), F.lit(e["value"]).alias("value")) for e in kind["params"])).cast("array<struct<key:string,value:double>>")))
        table = bars.join(mine.select("file"), "file", "left_semi")
        made = Indicators(table, "file", "rn").with_(v=spec).frame(keep=["file", "rn"], flat=False)
        outputs = spec.indicator.outputs
        series = {("values" if len(outputs) == 1 else names.get(o, o)): F.col("v") if len(outputs) == 1 else F.col(f"v.{o}") for o in outputs}
        pairs = F.array(*(F.struct(F.lit(n).alias("series"), c.alias("got")) for n, c in series.items()))
        out.append(made.select("file", "rn", F.explode(pairs).alias("p")).select("file", "p.series", "rn", "p.got"))
    empty = records.sparkSession.createDataFrame([], "file string, series string, rn int, got double")
    return reduce(DataFrame.unionByName, out, empty)


def check_golden(records: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row per file and output series: rows, wrong, worst (largest error), first_wrong (index), lookback_right, length_right.

    Values are compared by position: a null of the file (lookback or not a number) must be NULL or
    NaN here and nothing else may be; others must agree to `tolerance`, relative above 1.  lookback: no
    value before it, and a value or NaN at it if the file is that long.  length: as many numbers in
    the first output as the file says.  Series that one side lacks count as wrong throughout.
    """
    want = records.select("file", F.explode("output").alias("series", "values")).select("file", "series", F.posexplode("values").alias("rn", "want"))
    facts = records.select("file", F.col("meta.indicator").alias("indicator"), F.col("meta.dataset").alias("dataset"), F.col("lookback").alias("lookback"), F.col("output_length").alias("length"))
    both = want.withColumn("asked", F.lit(True)).join(computed(records).withColumn("made", F.lit(True)), ["file", "series", "rn"], "full")
    none = lambda c: F.col(c).isNull() | F.isnan(c)
    error = F.abs(F.col("got") - F.col("want")) / F.greatest(F.lit(1.0), F.abs("want"))
    wrong = F.col("asked").isNull() | F.col("made").isNull() | (none("got") != none("want")) | (~none("got") & ~none("want") & (error > tolerance))
    checked = both.join(facts, "file").withColumns({"error": F.when(~none("got") & ~none("want"), error), "wrong": wrong})
    return checked.groupBy("file", "indicator", "dataset", "series").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("wrong").cast("int")).alias("wrong"),
        F.max("error").alias("worst"),
        F.min(F.when(F.col("wrong"), F.col("rn"))).alias("first_wrong"),
        F.bool_and(F.when(F.col("rn") < F.col("lookback"), none("got")).when(F.col("rn") == F.col("lookback"), F.col("got").isNotNull()).otherwise(True)).alias("lookback_right"),
        (F.sum((~none("got")).cast("int")) == F.first("length")).alias("length_right"),
    )


def inputs_for(lookback: int) -> dict[str, pd.DataFrame]:
    """The input of each dataset, for an indicator of so much lookback; the two boundary datasets depend on it."""
    made = {name: make() for name, make in synthetic.DATASETS.items()}
    made |= {"boundary_exact": synthetic.boundary_exact(lookback), "boundary_short": synthetic.boundary_short(lookback)}
    return {n: f.assign(real0=f.close, real1=f.high, periods=np.arange(len(f)) % 29 + 2.0) for n, f in made.items()}


def fixture(indicator: str, params: dict, dataset: str, bars: pd.DataFrame, outputs: dict[str, list], lookback: int, made_by: str = "candela") -> dict:
    """A record as fixture files hold it: NaN and infinities are null."""
    finite = lambda xs: [None if x is None or not np.isfinite(x) else float(x) for x in xs]
    clean = {k: finite(v) for k, v in outputs.items()}
    inputs = {c: finite(bars[c]) for c in INDICATORS[indicator].inputs}
    length = sum(v is not None for v in next(iter(clean.values())))
    return {"meta": {"indicator": indicator, "params": params, "talib_version": made_by, "generated_at": "", "dataset": dataset}, "input": inputs, "output": clean, "lookback": lookback, "output_length": length}
