"""The ordered scan: stateful kernels over the bars of each key, in order.

Each task streams its rows, which come by key and in order, through the kernels
batch by batch.  A kernel keeps a few numbers per key, so a task never holds more
than one batch, however long a key's series is.  Rows leave in the order they came.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StructField, StructType


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def _changes(batch: pa.RecordBatch, keys: list[int]) -> list[int]:
    """Rows at which the key differs from the row before."""
    n = batch.num_rows
    differs = np.zeros(max(0, n - 1), bool)
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(0, n - 1), column.slice(1)
        equal = pc.fill_null(pc.equal(a, b), False)
        both_null = pc.and_(pc.is_null(a), pc.is_null(b))
        differs |= ~pc.or_(equal, both_null).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(differs) + 1).tolist(), n]


def ordered_scan(df: DataFrame, keys: list[str], scans: list[tuple[str, Callable, list[str], int]]) -> DataFrame:
    """df with the columns of the scans. df: a key's rows in one partition, together and in order.

    scans: (output base name, kernel maker, input columns, outputs).
    """
    share_code(df.sparkSession)
    names = df.columns
    key_at, in_at = [names.index(k) for k in keys], [[names.index(c) for c in ins] for _, _, ins, _ in scans]
    outputs = [f"{base}{k}" for base, _, _, count in scans for k in range(count)]
    makers = [maker for _, maker, _, _ in scans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kernels = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _changes(batch, key_at)
            columns = [[batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in ks] for ks in in_at]
            pieces: list[list[np.ndarray]] = [[] for _ in outputs]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(batch.column(k)[lo].as_py() for k in key_at)
                if now is None or key != now:
                    now, kernels = key, [make() for make in makers]
                at = 0
                for kernel, cs in zip(kernels, columns):
                    for out in kernel.push(*(c[lo:hi] for c in cs)):
                        pieces[at].append(out)
                        at += 1
            made = [pa.array(np.concatenate(p), pa.float64(), from_pandas=False) for p in pieces]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *outputs])

    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in outputs)])
    return df.mapInArrow(run, schema)
