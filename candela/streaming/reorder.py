"""Bars of a stream in order: a buffer that holds bars back until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..plans.scan import share_code

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(ts: pd.Series) -> pd.Series:
    """Milliseconds, rounded up: a bar goes when the watermark has reached it."""
    return -(-ts.astype("datetime64[us]").astype("int64") // 1000)


class Reorder(StatefulProcessor):
    """Keeps a key's bars (a list, as long as the watermark's delay is) and gives them away in order."""

    def __init__(self, schema, order: str):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)

    def _wait(self, bars: pd.DataFrame) -> None:
        if len(bars):
            self.handle.registerTimer(int(_millis(bars[self.order]).min()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for bars in rows:
            if len(bars):
                names = self.schema.fieldNames()
                self.pending.appendList(list(bars[names].astype(object).where(bars[names].notna(), None).itertuples(index=False, name=None)))
                self._wait(bars)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.pending.get()), columns=self.schema.fieldNames())
        if not len(held):
            return
        held[self.order] = pd.to_datetime(held[self.order])
        due = _millis(held[self.order]) <= timerValues.getCurrentWatermarkInMs()
        if not due.any():
            return
        rest = held[~due]
        self.pending.clear()
        if len(rest):
            self.pending.put(list(rest.astype(object).where(rest.notna(), None).itertuples(index=False, name=None)))
            self._wait(rest)
        # Of bars of one time the first that came counts.
        yield held[due].drop_duplicates(self.order).sort_values(self.order, kind="stable")

    def close(self) -> None:
        pass


def in_order(bars: DataFrame, keys: list[str], order: str, delay: str) -> DataFrame:
    """The stream's bars, each when the watermark (the latest time seen less `delay`) has passed it.

    Every key's bars leave in order over all micro-batches, however they came in within
    the delay; later ones are dropped by the watermark.  A stream's last bars are held
    until later ones come.  The session's state store must be RocksDB.
    """
    share_code(bars.sparkSession)
    watched = bars.withWatermark(order, delay).groupBy(*keys)
    return watched.transformWithStateInPandas(Reorder(bars.schema, order), bars.schema, "Append", "EventTime")
