"""Recurrences over a stream of bars: state per key in the state store.

Row-frame windows aren't allowed on streams, so every class goes through a kernel
there.  Each micro-batch's new bars of a key are sorted, bars that aren't later
than the last one seen are dropped (an indicator can't take a bar back), and the
kernels continue from their pickled state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import Maker
from ..plans.scan import share_code


def stream_scan(bars: DataFrame, scans: dict[str, tuple[Maker, list[str], int]], key: str = "key", order: str = "ts", watermark: str | None = None) -> DataFrame:
    """bars' key and order columns with one column per kernel output.

    scans: name -> (kernel maker, input columns, bars without a value).  Kernels with
    several outputs give name_0, name_1, ...  watermark: how late bars may come; later
    ones are dropped before they reach the state.
    """
    share_code(bars.sparkSession)
    if watermark:
        bars = bars.withWatermark(order, watermark)
    order_type = bars.schema[order].dataType.simpleString()
    key_type = bars.schema[key].dataType.simpleString()
    widths = {n: len(maker().push(*[np.zeros(0)] * len(ins))) for n, (maker, ins, _) in scans.items()}
    columns = [n if widths[n] == 1 else f"{n}_{k}" for n in scans for k in range(widths[n])]
    schema = f"`{key}` {key_type}, `{order}` {order_type}, " + ", ".join(f"`{c}` double" for c in columns)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernels, at, last = pickle.loads(state.get[0]) if state.exists else ([m() for m, _, _ in scans.values()], 0, None)
        # One micro-batch's bars of one key: bounded by the trigger's rate limit.
        new = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable").drop_duplicates(order)
        if last is not None:
            new = new[new[order] > last]
        if not len(new):
            return
        out = {key: [group[0]] * len(new), order: new[order].to_numpy()}
        index = np.arange(at, at + len(new))
        for (name, (_, ins, lookback)), kernel in zip(scans.items(), kernels):
            made = kernel.push(*(new[c].to_numpy(dtype=np.float64) for c in ins))
            for k, values in enumerate(made):
                out[name if len(made) == 1 else f"{name}_{k}"] = [None if i < lookback else v for i, v in zip(index, values)]
        state.update((pickle.dumps((kernels, at + len(new), new[order].iloc[-1])),))
        yield pd.DataFrame(out)

    timeout = GroupStateTimeout.NoTimeout
    return bars.groupBy(key).applyInPandasWithState(update, schema, "state binary", "append", timeout)
