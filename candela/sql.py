"""Indicators in SQL: table functions over Arrow batches, for TABLE(t) PARTITION BY (key) ORDER BY (ts).

    SELECT * FROM ta_ema(TABLE(SELECT key, ts, close FROM bars) PARTITION BY (key) ORDER BY (ts), 14)

A function's table has key and order, then the series it takes.  Indicators of windows
(classes S0 to S2) need none of this: they are SQL already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .operators import composites as C
from .operators import kernels as K
from .plans.scan import share_code


def _sar(a: float, m: float) -> K.Sar:
    return K.Sar((a, a, m), (a, a, m))


#: name -> (kernel from the parameters, their defaults, series, outputs, bars without a value)
TABLE_FUNCTIONS = {
    "ta_ema": (lambda p: K.Ema(int(p)), (20,), 1, ("value",), lambda p: p - 1),
    "ta_rma": (lambda p: K.Ema(int(p), 0, 1.0 / p), (14,), 1, ("value",), lambda p: p - 1),
    "ta_macd": (lambda a, b, c: K.Macd(int(a), int(b), int(c)), (12, 26, 9), 1, ("macd", "signal", "hist"), lambda a, b, c: b + c - 2),
    "ta_kama": (lambda p: C.KamaOf(int(p)), (10,), 1, ("value",), lambda p: p),
    "ta_rsi": (lambda p: C.Rsi(int(p)), (14,), 1, ("value",), lambda p: p),
    "ta_adx": (lambda p: C.Adx(int(p)), (14,), 3, ("value",), lambda p: 2 * p - 1),
    "ta_adosc": (lambda a, b: C.Adosc(int(a), int(b)), (3, 10), 4, ("value",), lambda a, b: max(a, b) - 1),
    "ta_sar": (_sar, (0.02, 0.2), 2, ("value",), lambda a, m: 1),
    "ta_mama": (lambda a, b: K.Mama(float(a), float(b)), (0.5, 0.05), 1, ("mama", "fama"), lambda a, b: 32),
    "ta_hilbert": (lambda: K.Hilbert(), (), 1, ("phase", "sine", "leadsine", "trendline", "trendmode"), lambda: 63),
    "ta_hikkake": (lambda: K.Hikkake(), (), 3, ("value",), lambda: 0),
}


def _function(make, defaults: tuple, series: int, outputs: tuple[str, ...], lookback):
    names = ["key", "rn", *outputs]

    class Scan:
        def __init__(self):
            self.kernel, self.at = None, 0

        def eval(self, rows: pa.RecordBatch, *params) -> Iterator[pa.Table]:
            """rows: a batch of one partition: key, order, series."""
            if not rows.num_rows:
                return
            if self.kernel is None:
                given = tuple(float(p[0].as_py()) for p in params)
                given += defaults[len(given) :]
                self.kernel, self.skip = make(*given), int(lookback(*given))
            values = [rows.column(2 + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(series)]  # null becomes NaN
            index = np.arange(self.at, self.at + rows.num_rows)
            self.at += rows.num_rows
            made = (pa.array(m, pa.float64(), mask=index < self.skip, from_pandas=False) for m in self.kernel.push(*values))
            yield pa.table([rows.column(0).cast(pa.string()), pa.array(index, pa.int64()), *made], names=names)

    return arrow_udtf(Scan, returnType="key string, rn long, " + ", ".join(f"{o} double" for o in outputs))


def register(spark: SparkSession) -> list[str]:
    """Registers the table functions with the session; returns their names."""
    share_code(spark)
    for name, parts in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, _function(*parts))
    return sorted(TABLE_FUNCTIONS)
