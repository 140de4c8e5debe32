"""Indicators of every class over a stream of bars: the batch plan, continued from one micro-batch to the next.

A micro-batch's new bars of a key are what a block is to a long key (plans.blocks), and
the same columns are computed over them:

* windows also see the key's last bars, a ring as long as the windows of a stage reach back;
* running sums and extrema are added to what they had come to;
* kernels go on from their state.

What a key carries over is one row: its number of bars and last time, a ring and running
values per stage, and its kernels.  Each micro-batch writes the rows of the keys it has
touched to the state folder, under its own number, and every COMPACT-th all keys' rows,
so a later one reads few folders.  A micro-batch that is run again reads the same rows
and overwrites its own, so results are those of a single run.

With a `delay` bars go through a buffer first (streaming.reorder), which lets them pass in
order when the watermark has passed them.  Without one, bars must come in order: one that
isn't later than its key's last is dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..plans import blocks as B
from ..plans.frame import Frame
from ..plans.planner import Indicators
from ..plans.positions import join_on
from ..plans.registry import Spec
from ..plans.scan import share_code
from ..plans.staging import stage
from .reorder import in_order

#: Micro-batches between those that write every key's row.
COMPACT = 16
_BARS, _LAST = "__bars", "__last"


def _kernel_scan(df: DataFrame, keys: list[str], scans: list[B.Scan], carried: str) -> DataFrame:
    """df with the scans' columns; column `carried` has the kernels a key begins with and, on a key's last row of each Arrow batch, those it ends with."""
    names = df.columns
    key_at, carried_at = [names.index(k) for k in keys], names.index(carried)
    in_at, makers = [[names.index(c) for c in ins] for _, _, ins, _ in scans], [m for _, m, _, _ in scans]
    kept = [i for i in range(len(names)) if i != carried_at]
    outputs = [f"{base}{k}" for base, _, _, count in scans for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kernels = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [B._inputs(batch, places) for places in in_at]
            pieces: list[list[np.ndarray]] = [[] for _ in outputs]
            states: list[bytes | None] = [None] * batch.num_rows
            for lo, hi in B._segments(batch, key_at):
                at = tuple(batch.column(k)[lo].as_py() for k in key_at)
                if now is None or at != now:
                    held = batch.column(carried_at)[lo].as_py()
                    now, kernels = at, pickle.loads(held) if held else [m() for m in makers]
                made = (out for kernel, cs in zip(kernels, columns) for out in kernel.push(*(c[lo:hi] for c in cs)))
                for piece, out in zip(pieces, made):
                    piece.append(out)
                states[hi - 1] = pickle.dumps(kernels)
            arrays = [pa.array(np.concatenate(p), pa.float64(), from_pandas=False) for p in pieces]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *arrays, pa.array(states, pa.binary())], names=[*(batch.schema.names[i] for i in kept), *outputs, carried])

    schema = StructType([*(df.schema.fields[i] for i in kept), *(StructField(n, DoubleType()) for n in outputs), StructField(carried, BinaryType())])
    return df.mapInArrow(run, schema)


class Advance:
    """One micro-batch: results of the new bars and the rows that their keys carry over.

    carried: those rows from before (None at first). frame: indicators over the new bars,
    planned with deferred running values (block_bars).
    """

    def __init__(self, frame: Frame, outputs: dict, keep: list[str], carried: DataFrame | None):
        self.frame, self.keys = frame, frame.keys
        bars = stage(frame.df, "stream-new")
        if carried is not None:
            touched = bars.select(*B._cols(self.keys)).distinct()
            carried = stage(join_on(carried, touched, self.keys, "left_semi"), "stream-carried")
        self.carried, self.parts = carried, []
        df = self._numbered(bars)
        _, halo = frame._block_size()
        for k in range(1 + max([*(s for s, _ in frame._exprs), *frame._scans, *frame._runs], default=-1)):
            df = self._stage(df, k, halo.get(k, 0), outputs, keep)
        ends = df.groupBy(*B._cols(self.keys)).agg((F.max(B.BAR) + 1).alias(_BARS), F.max(f"`{frame.order[0]}`").alias(_LAST))
        self.state = reduce(lambda a, b: join_on(a, b, self.keys), self.parts, ends)
        self.results = df.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for n, c in outputs.items()))

    def _with(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """df with columns of the carried rows (new name -> name), null where there are none."""
        if self.carried is None or not set(columns.values()) <= set(self.carried.columns):
            raise KeyError(columns)
        return join_on(df, self.carried.select(*B._cols(self.keys), *(F.col(c).alias(n) for n, c in columns.items())), self.keys, "left")

    def _numbered(self, bars: DataFrame) -> DataFrame:
        order = F.col(f"`{self.frame.order[0]}`")
        if self.carried is None:
            bars = bars.withColumn(_BARS, F.lit(0).cast("long"))
        else:
            bars = self._with(bars, {_BARS: _BARS, _LAST: _LAST}).filter(F.col(_LAST).isNull() | (order > F.col(_LAST))).drop(_LAST)
        place = F.row_number().over(Window.partitionBy(*B._cols(self.keys)).orderBy(*B._cols(self.frame.order)))
        numbered = bars.withColumn(B.BAR, F.coalesce(F.col(_BARS), F.lit(0)) + place - 1).drop(_BARS)
        return stage(numbered.withColumn(B.BLOCK, F.lit(0).cast("long")), "stream-bars")

    def _stage(self, df: DataFrame, k: int, halo: int, outputs: dict, keep: list[str]) -> DataFrame:
        frame, by = self.frame, B._cols(self.keys)
        layers = [frame._exprs[at] for at in sorted(frame._exprs) if at[0] == k]
        if halo:
            ring, own = f"__ring{k}", [c for c in df.columns if c != B.BLOCK]
            df = df.withColumn("__old", F.lit(False))
            if self.carried is not None:
                rows = self.carried.select(F.explode(ring).alias("r")).select(*(F.col(f"r.`{c}`") for c in own))
                df = df.unionByName(rows.withColumns({B.BLOCK: F.lit(0).cast("long"), "__old": F.lit(True)}))
            newest = df.withColumn("__top", F.max(B.BAR).over(Window.partitionBy(*by))).filter(F.col(B.BAR) > F.col("__top") - halo)
            # As many bars as the windows reach back, however many a micro-batch brings.
            self.parts.append(stage(newest.groupBy(*by).agg(F.collect_list(F.struct(*B._cols(own))).alias(ring)), "stream-ring"))
        for layer in layers:
            df = df.withColumns(dict(layer))
        if halo:
            df = df.filter(~F.col("__old")).drop("__old")
        scans, runs = frame._scans.get(k, []), frame._runs.get(k, [])
        if not scans and not runs:
            return df
        live = frame._live(k, df.columns, outputs, [*keep, *self.keys, *frame.order, B.BAR, B.BLOCK])
        df = df.select(*(F.col(f"`{c}`") for c in live))
        for name, _, x in runs:
            before = {f"{name}before": name}
            df = self._with(df, before) if self.carried is not None else df.withColumn(f"{name}before", F.lit(None).cast(df.schema[x].dataType))
        if runs:
            df = B._with_runs(df, self.keys, runs)
        kernels = f"__kernels{k}"
        if scans:
            df = self._with(df, {kernels: kernels}) if self.carried is not None else df.withColumn(kernels, F.lit(None).cast("binary"))
            df = _kernel_scan(df.repartition(*by).sortWithinPartitions(*by, B.BAR), self.keys, scans, kernels)
        df = stage(df, "stream-stage")
        ends = [F.max_by(F.col(name), B.BAR).alias(name) for name, _, _ in runs]
        if scans:
            ends.append(F.max_by(kernels, F.when(F.col(kernels).isNotNull(), F.col(B.BAR))).alias(kernels))
        self.parts.append(df.groupBy(*by).agg(*ends))
        return df.drop(kernels)


def _carried(spark: SparkSession, folder: str, keys: list[str], number: int) -> DataFrame | None:
    """The rows of all keys as micro-batch `number` finds them."""
    try:
        log = spark.read.option("basePath", folder).parquet(f"{folder}/n=*")
    except AnalysisException:  # nothing written so far
        return None
    since = number // COMPACT * COMPACT - 1
    log = log.filter((F.col("n") < number) & (F.col("n") >= since))
    if log.isEmpty():
        return None
    names = [c for c in log.columns if c not in (*keys, "n")]
    last = log.groupBy(*B._cols(keys)).agg(F.max_by(F.struct(*B._cols(names)), "n").alias("s"))
    return last.select(*B._cols(keys), *(F.col(f"s.`{c}`") for c in names))


def stream_indicators(
    bars: DataFrame, state_dir: str, sink: Callable[[DataFrame, int], None] | None = None, key: str | list[str] = "key", order: str = "ts", delay: str | None = None, keep: list[str] | None = None, **specs: Spec
) -> DataStreamWriter:
    """A writer, ready to be started, of the indicators of a stream's bars.

    state_dir: a folder that all executors share, for the checkpoint and what keys carry
    over; results go to its folder `results` as Parquet, by micro-batch, or to sink(df, n),
    which may get a micro-batch again.  keep: columns of bars to give along; all if None.
    delay: how late bars may come.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kept = bars.columns if keep is None else keep
    share_code(bars.sparkSession)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _carried(spark, f"{state_dir}/carried", keys, number)
        frame, outputs = Indicators(batch, keys, order, block_bars=1).with_(**specs).planned()
        made = Advance(frame, outputs, kept, before)
        if sink is None:
            made.results.write.mode("overwrite").parquet(f"{state_dir}/results/n={number}")
        else:
            sink(made.results, number)
        state = made.state
        if number % COMPACT == COMPACT - 1 and before is not None:
            state = state.unionByName(join_on(before, stage(state.select(*B._cols(keys)), "stream-touched"), keys, "left_anti"))
        state.write.mode("overwrite").parquet(f"{state_dir}/carried/n={number}")

    if delay:
        bars = in_order(bars, keys, order, delay)
    return bars.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_dir}/checkpoint")
