"""Long keys in time blocks: windows with a halo, running values in two levels, recurrences as composed maps.

A key's bars are numbered in two levels (plans.positions) and cut into blocks of equally
many bars, so that a key is spread over as many tasks as it has blocks:

* windows of bounded length: a block also gets the last bars of the block before it,
  as many as the windows of a stage reach back together (the halo); these copies go
  when the stage's windows are done.
* running sums and extrema: a block's totals, a partial aggregate, are added up over the
  blocks before it and joined to its bars.
* recurrences that are affine in their state (exponential and Wilder means, their chains,
  MACD, adaptive means): a first pass over a block from state zero gives what the block
  adds, its kernel says what it makes of the state before it.  These maps, one small row
  a block, are composed along each key, and a second pass starts each block with its state.
* other recurrences (stop and reverse, Hilbert, hikkake) can't be cut: their pass, and
  only theirs, has a key's bars in one task.

What passes need twice is written to the shared folder in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.linear import Linear
from .positions import join_on, positioned
from .scan import _changes, ordered_scan, share_code
from .staging import stage

BAR, BLOCK = "__bar", "__block"
_REACH = re.compile(r"ROWS BETWEEN -(\d+) AND|, (\d+), NULL(?:, \w+)?\) OVER")

Scan = tuple[str, Callable, list[str], int]


def reach(expression: str) -> int:
    """How many bars before its own an expression's windows look at."""
    return max((int(a or b) for a, b in _REACH.findall(expression)), default=0)


def has_window(expression: str) -> bool:
    return " OVER (" in expression


def is_linear(scan: Scan) -> bool:
    kind = getattr(scan[1], "kind", None)
    return isinstance(kind, type) and issubclass(kind, Linear)


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


#: Bars of a block that is chosen by the table: some blocks a task, in these bounds.
LEAST_BARS, MOST_BARS = 4096, 1 << 20


def blocked(df: DataFrame, keys: list[str], order: list[str], least: int, by_table: bool = False) -> tuple[DataFrame, int]:
    """df with the bar's index in its key and its block, and the block's bars: `least`, or more by the table."""
    df, size = positioned(df, keys, order, BAR, name="bars"), least
    if by_table:
        tasks = 4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        size = max(least, min(MOST_BARS, max(LEAST_BARS, df.count() // tasks)))
    return df.withColumn(BLOCK, F.expr(f"{BAR} div {size}")), size


def with_halo(df: DataFrame, size: int, halo: int) -> DataFrame:
    """df with a copy of each block's last `halo` bars in the block after it."""
    if not halo:
        return df
    block = F.col(BLOCK)
    into = F.when(F.col(BAR) % size >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn(BLOCK, F.explode(into))


def without_halo(df: DataFrame, size: int) -> DataFrame:
    return df.filter(F.col(BLOCK) == F.expr(f"{BAR} div {size}"))


def _aggregate(op: str, x: Column) -> Column:
    return {"sum": F.sum, "max": F.max}[op](x)


def _running_before(staged: DataFrame, keys: list[str], runs: list[tuple[str, str, str]]) -> DataFrame:
    """keys, block and each run's value over all blocks before."""
    totals = staged.groupBy(*_cols([*keys, BLOCK])).agg(*(_aggregate(op, F.col(x)).alias(name) for name, op, x in runs))
    before = Window.partitionBy(*_cols(keys)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*_cols([*keys, BLOCK]), *(_aggregate(op, F.col(name)).over(before).alias(f"{name}before") for name, op, _ in runs))


def _with_runs(df: DataFrame, keys: list[str], runs: list[tuple[str, str, str]]) -> DataFrame:
    inside = Window.partitionBy(*_cols([*keys, BLOCK])).orderBy(BAR).rowsBetween(Window.unboundedPreceding, 0)

    def whole(name: str, op: str, x: str) -> Column:
        here, before = _aggregate(op, F.col(x)).over(inside), F.col(f"{name}before")
        return F.greatest(before, here) if op == "max" else F.coalesce(before + here, before, here)

    return df.withColumns({name: whole(name, op, x) for name, op, x in runs}).drop(*(f"{name}before" for name, _, _ in runs))


def _segments(batch: pa.RecordBatch, at: list[int]) -> Iterator[tuple[int, int]]:
    edges = _changes(batch, at)
    return zip(edges, edges[1:])


def _inputs(batch: pa.RecordBatch, places: list[int]) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in places]


def _summaries(df: DataFrame, keys: list[str], size: int, scans: list[Scan]) -> DataFrame:
    """keys, block and, for each scan k, a<k> (the matrix that the block multiplies the state by) and b<k> (what it adds). df: blocks together, in order."""
    names = df.columns
    key_at, block_at = [names.index(k) for k in keys], names.index(BLOCK)
    makers, in_at = [m for _, m, _, _ in scans], [[names.index(c) for c in ins] for _, _, ins, _ in scans]
    fields = [df.schema[k] for k in [*keys, BLOCK]]
    parts = [StructField(f"{x}{k}", ArrayType(DoubleType())) for k in range(len(scans)) for x in "ab"]
    types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kernels, decays, done = None, [], [], []
        nonlocal types

        def close() -> None:
            if now is not None:
                done.append((*now, *(v for kernel, a in zip(kernels, decays) for v in (a.ravel().tolist(), kernel.leave().tolist()))))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(c, t) for c, t in zip(columns, [*types, *[pa.list_(pa.float64())] * (2 * len(scans))])]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, BLOCK, *(p.name for p in parts)])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in [*key_at, block_at]]
            columns = [_inputs(batch, places) for places in in_at]
            for lo, hi in _segments(batch, [*key_at, block_at]):
                at = tuple(batch.column(k)[lo].as_py() for k in [*key_at, block_at])
                if at != now:
                    close()
                    now, kernels = at, [m() for m in makers]
                    decays = [np.eye(kernel.states) for kernel in kernels]
                    if at[-1]:
                        for kernel in kernels:
                            kernel.enter(at[-1] * size, np.zeros(kernel.states))
                for k, (kernel, cs) in enumerate(zip(kernels, columns)):
                    inputs = [c[lo:hi] for c in cs]
                    decays[k] = kernel.decay(*inputs) @ decays[k]
                    kernel.push(*inputs)
            if len(done) >= 1024:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    return df.mapInArrow(run, StructType([*fields, *parts]))


def _states(summaries: DataFrame, keys: list[str], counts: list[int]) -> DataFrame:
    """keys, block and, for each scan k, s<k>: the state in which the block begins (null for a key's first block)."""
    fields = StructType([*(summaries.schema[k] for k in [*keys, BLOCK]), *(StructField(f"s{k}", ArrayType(DoubleType())) for k in range(len(counts)))])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        made: list[list] = []
        for k, n in enumerate(counts):
            state, out = None, []
            for a, b in zip(table.column(f"a{k}").to_pylist(), table.column(f"b{k}").to_pylist()):
                out.append(None if state is None else state.tolist())
                state = np.array(b) if state is None else np.reshape(a, (n, n)) @ state + b
            made.append(out)
        return pa.table([*(table.column(c) for c in [*keys, BLOCK]), *(pa.array(m, pa.list_(pa.float64())) for m in made)], names=fields.fieldNames())

    return summaries.groupBy(*_cols(keys)).applyInArrow(compose, fields)


def _block_scan(df: DataFrame, keys: list[str], size: int, scans: list[Scan]) -> DataFrame:
    """df with the scans' columns in place of the states s<k>. df: blocks together, in order, each row with its block's states."""
    names = df.columns
    key_at, block_at = [names.index(k) for k in keys], names.index(BLOCK)
    in_at, state_at = [[names.index(c) for c in ins] for _, _, ins, _ in scans], [names.index(f"s{k}") for k in range(len(scans))]
    makers = [m for _, m, _, _ in scans]
    kept = [i for i in range(len(names)) if i not in state_at]
    outputs = [f"{base}{k}" for base, _, _, count in scans for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kernels = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_inputs(batch, places) for places in in_at]
            pieces: list[list[np.ndarray]] = [[] for _ in outputs]
            for lo, hi in _segments(batch, [*key_at, block_at]):
                at = tuple(batch.column(k)[lo].as_py() for k in [*key_at, block_at])
                if at != now:
                    now, kernels = at, [m() for m in makers]
                    if at[-1]:
                        for kernel, k in zip(kernels, state_at):
                            kernel.enter(at[-1] * size, np.array(batch.column(k)[lo].as_py()))
                made = (out for kernel, cs in zip(kernels, columns) for out in kernel.push(*(c[lo:hi] for c in cs)))
                for piece, out in zip(pieces, made):
                    piece.append(out)
            arrays = [pa.array(np.concatenate(p), pa.float64(), from_pandas=False) for p in pieces]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *arrays], names=[*(batch.schema.names[i] for i in kept), *outputs])

    schema = StructType([*(df.schema.fields[i] for i in kept), *(StructField(n, DoubleType()) for n in outputs)])
    return df.mapInArrow(run, schema)


def barrier(df: DataFrame, keys: list[str], size: int, scans: list[Scan], runs: list[tuple[str, str, str]], written: bool = False) -> DataFrame:
    """df with the columns of scans and runs. df: bars without halo; written: it is hardly more than a table in the shared folder."""
    share_code(df.sparkSession)
    linear, others = [s for s in scans if is_linear(s)], [s for s in scans if not is_linear(s)]
    by = [*keys, BLOCK]
    if linear or runs:
        df = df if written else stage(df, "bars")
        known = None
        if runs:
            known = _running_before(df, keys, runs)
        if linear:
            ordered = df.select(*_cols([*by, BAR]), *dict.fromkeys(c for _, _, ins, _ in linear for c in ins)).repartition(*_cols(by)).sortWithinPartitions(*_cols([*by, BAR]))
            states = _states(_summaries(ordered, keys, size, linear), keys, [m().states for _, m, _, _ in linear])
            known = states if known is None else join_on(known, states, by)
        df = join_on(df, stage(known, "blocks"), by)
        if linear:
            df = df.repartition(*_cols(by))
        if runs:
            df = _with_runs(df, keys, runs)
        if linear:
            df = _block_scan(df.sortWithinPartitions(*_cols([*by, BAR])), keys, size, linear)
    if others:
        df = ordered_scan(df.repartition(*_cols(keys)).sortWithinPartitions(*_cols([*keys, BAR])), keys, others)
    return df
