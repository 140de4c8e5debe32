"""Session, path and staging helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir, stage, work_path  # noqa: F401

REPO_ROOT = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO_ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, path) if x)


#: Nodes of a plan that neither make a row twice nor take it from two tables.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "RelationV2", "DataSourceV2Relation"}


def _row_by_row(docs: DataFrame) -> bool:
    """Whether docs is a table of files with nothing but deterministic projections and filters over it.

    The hidden file and row columns survive generators, joins and unions, after which they tell rows no more.
    """
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _ROW_BY_ROW or not node.deterministic():
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def file_bytes(docs: DataFrame) -> int | None:
    """The size of a plain table's files, which costs no pass; None for other plans."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if _row_by_row(docs) else None


def table_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """About how many bytes docs has: of plain tables the files' size, which costs no pass; else that of the texts."""
    size = file_bytes(docs)
    return size if size is not None else docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def located(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with the locator of each row, which no two rows share.

    Anything but a plain table of Parquet files is written to the shared folder first.
    """

    def plain(table: DataFrame) -> DataFrame:
        hidden = table.metadataColumn("_metadata")
        return table.select("*", hidden["file_path"].alias(file), hidden["row_index"].alias(row))

    if not _row_by_row(docs):
        return plain(stage(docs, "documents"))
    try:
        return plain(docs)
    except AnalysisException:
        return plain(stage(docs, "documents"))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit (position: 0-based, long)."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def small_batches(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that only a slice's values become Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def text_slices(texts: list, budget: int = 2_000_000):
    """(from, to) ranges of a list of texts with about `budget` characters each."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= budget:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
