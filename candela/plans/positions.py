"""Row indexes and running sums over long keys, in two levels.

Rows are dealt by ranges of (keys, order), so that a key's rows are spread over as
many tasks as it needs.  A range's rows and sums are counted per key (a partial
aggregate), those few totals are added up over the ranges before, and each row adds
its own place in its range: no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: monotonically_increasing_id() is the task's number times 2**33 plus the row's place in the task.
_TASK_BITS = 33


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that takes nulls for equal, with the columns once. right has no other column of left."""
    other = right.select(*(F.col(f"`{c}`").alias(f"__on_{c}") if c in names else F.col(f"`{c}`") for c in right.columns))
    met = F.lit(True)
    for c in names:
        met = met & same(F.col(f"`{c}`"), F.col(f"`__on_{c}`"))
    return left.join(other, met, how).drop(*(f"__on_{c}" for c in names))


def positioned(df: DataFrame, keys: list[str], order: list[str], index: str = "__bar", sums: dict[str, str] | None = None, name: str = "positions") -> DataFrame:
    """df with each row's 0-based index in its key, and for each of `sums` (new name -> column) the sum over the key's earlier rows.

    Rows that tie on order are put in some order, the same for all new columns and all
    later reads: the ranged rows are written to the shared folder.  Null keys are one key;
    null order columns come last.  A null in a summed column adds nothing.
    """
    sums = sums or {}
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [F.col(f"`{k}`") for k in keys] + [F.col(f"`{c}`").asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(n, *at).sortWithinPartitions(*at).withColumn("__at", F.monotonically_increasing_id())
    ranged = stage(ranged, name).withColumn("__range", F.shiftright("__at", _TASK_BITS))
    by = ["__range", *keys]
    totals = ranged.groupBy(*(F.col(f"`{c}`") for c in by)).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), *(F.sum(f"`{c}`").alias(f"__sum_{s}") for s, c in sums.items()))
    before = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {"__n": F.sum("__n").over(before)} | {f"__sum_{s}": F.sum(f"__sum_{s}").over(before) for s in sums}
    offsets = totals.select(*(F.col(f"`{c}`") for c in by), "__first", *(F.coalesce(c, F.lit(0)).alias(k) for k, c in earlier.items()))
    out = join_on(ranged, stage(offsets, name + "-offsets"), by)
    inside = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = {s: F.col(f"__sum_{s}") + F.coalesce(F.sum(f"`{c}`").over(inside), F.lit(0)) for s, c in sums.items()}
    own = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*own, (F.col("__at") - F.col("__first") + F.col("__n")).alias(index), *(c.alias(s) for s, c in local.items()))
