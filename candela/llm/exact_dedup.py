"""Exact deduplication with stateful streaming.

1. A fingerprint row per document is written to the shared folder: SHA-256 of the
   normalised text, a content locator (file and row of the text), the stable id
   and the original's length in code points.
2. Structured Streaming reads the fingerprints in several micro-batches and keeps,
   in RocksDB state that never expires, one entry per digest: the row that stays so
   far (stable id and locator) and the group's size.  Each micro-batch writes the
   entries it changed; an entry's last change is its state.
3. Hits, the rows of digests that were seen more than once, are found again in the
   texts by bitmaps of their rows and checked on their full bytes: they are grouped
   by the normalised text itself.  Should one digest stand for several texts, those
   texts' groups replace the digest's.

With a `state_dir` the fingerprints, the stream's checkpoint and the changes stay
there, and a later call with the same folder goes on from them: its rows meet those
of all calls before, whose texts are read by their locators where bytes are compared.

Normalised: every character of [\\x20\\x09-\\x0D] deleted.  Of equal texts the row
with the most code points in its original stays, then the smallest doc_id (null
last), then the first locator: exactly one row stays, also of rows that repeat.

Only DataFrame operations run; the streaming driver's batch function writes
DataFrames.  Copies are counted before the shuffle, so a digest that a third of
the rows share reaches its task as one partial row per map task.

Defined results: a null text counts as the empty one; blank texts form one group;
an empty table gives an empty table; extra columns are kept by `deduplicate`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit, fresh_name, located, shuffle_parts, stage, work_path

SPACE = r"[\x20\x09-\x0D]"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings of the state: RocksDB, small changelogs in place of snapshots at each commit.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Keys that one state store should hold. Each store has a fixed cost (RocksDB reserves 4 MB for its
#: manifest alone), so there are as many as the digests need, not one per shuffle partition.
KEYS_PER_STORE = 500_000


def normalised(text) -> object:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


PRINTS = "doc_id bigint, digest binary, chars bigint, _file string, _row bigint"


def digest_of(text, bits: int = 256) -> object:
    """SHA-256 of the normalised text (binary), its first `bits` bits."""
    digest = F.unhex(F.sha2(normalised(text), 256))
    return digest if bits == 256 else F.substring(digest, 1, bits // 8)


def fingerprints(rows: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id, digest, chars, _file, _row."""
    text = F.col("text")
    return rows.select("doc_id", digest_of(text, bits).alias("digest"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), "_file", "_row")


def preferred(columns=("chars", "doc_id", "_file", "_row")) -> object:
    """The smallest of these is the row that stays."""
    chars, key, file, row = (F.col(c) for c in columns)
    return F.struct((-chars).alias("less"), key.isNull().alias("none"), key.alias("doc_id"), file.alias("file"), row.alias("row"))


CHANGES = "digest binary, keep struct<less:bigint,none:boolean,doc_id:bigint,file:string,row:bigint>, group_size bigint, batch bigint"


def stream_state(spark: SparkSession, state_dir: str, keys: int, files_per_batch: int) -> DataFrame:
    """digest, keep (struct), group_size: the state after all fingerprints below state_dir have streamed through.

    keys: how many are expected; the number of stores is set by the first call and kept by the checkpoint.
    """
    stores = min(shuffle_parts(spark), max(spark.sparkContext.defaultParallelism, -(-keys // KEYS_PER_STORE)))
    settings = _STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    out = f"{state_dir}/changes"
    try:
        reader = spark.readStream.schema(PRINTS).option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(f"{state_dir}/prints/*").groupBy("digest").agg(F.min(preferred()).alias("keep"), F.count("*").alias("group_size"))

        def changed(batch: DataFrame, number: int) -> None:
            # A batch that is run again overwrites its own folder.
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

        query = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # A row that no batch wrote: the folder is there even when nothing has streamed.
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{out}/n=-1")
    changes = spark.read.schema(CHANGES).parquet(f"{out}/n=*")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s"))
    return last.select("digest", "s.keep", "s.group_size")


def hit_texts(texts: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """The rows of texts that members names: doc_id, digest, bytes, chars, _file, _row.

    The rows are told by a bitmap of each file's blocks, an eighth of a byte a row, which Spark
    broadcasts while it is small; texts aren't shuffled for it.
    """
    row = F.col("_row")
    blocks = members.groupBy("_file", F.bitmap_bucket_number(row).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("_bits"))
    blocks = stage(blocks, "exact-hit-rows")
    found = texts.withColumn("_block", F.bitmap_bucket_number(row)).join(blocks, ["_file", "_block"]).filter(bit(F.col("_bits"), F.bitmap_bit_position(row)))
    return found.select("doc_id", digest_of(F.col("text"), bits).alias("digest"), normalised(F.col("text")).alias("bytes"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "_file", "_row")


def write_prints(prints: DataFrame, path: str, batches: int) -> DataFrame:
    """The fingerprints as files of `path`, enough of them for so many micro-batches."""
    spark = prints.sparkSession
    prints.write.parquet(path)
    written = spark.read.schema(PRINTS).parquet(path)
    # A scan of few tasks writes few files, some of them without rows: these rows are dealt out evenly.
    if len(written.inputFiles()) < 4 * batches and (n := written.count()):
        even = path + "-even"
        written.repartition(min(batches, n)).write.parquet(even)
        Path = spark._jvm.org.apache.hadoop.fs.Path
        files = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(Path(path), True)
        files.rename(Path(even), Path(path))
        written = spark.read.schema(PRINTS).parquet(path)
    return written


def _groups(rows: DataFrame, bits: int, batches: int, state_dir: str | None, earlier=None) -> DataFrame:
    """rows: doc_id, text, _file, _row. earlier: reads such rows from a list of files."""
    spark = rows.sparkSession
    lasting = state_dir is not None
    state_dir = state_dir or work_path(spark, "exact-state")
    run = f"{state_dir}/prints/{uuid.uuid4().hex}"
    prints = write_prints(fingerprints(rows, bits), run, batches)
    state = stage(stream_state(spark, state_dir, prints.count(), -(-max(1, len(prints.inputFiles())) // batches)), "exact-digests")
    hits = state.filter("group_size > 1").select("digest")
    everything = spark.read.schema(PRINTS).parquet(f"{state_dir}/prints/*") if lasting else prints
    if lasting:
        hits = hits.join(prints, "digest", "left_semi")
    members = stage(everything.join(hits, "digest", "left_semi").select("digest", "_file", "_row"), "exact-hits")
    texts = rows
    if lasting:
        own = prints.select("_file").distinct()
        files = [r[0] for r in members.select("_file").distinct().join(own, "_file", "left_anti").collect()]  # names of input files
        texts = rows.unionByName(earlier(files)) if files else rows
    found = hit_texts(texts, members, bits)
    # Full bytes of every hit: grouping compares them, and copies are merged before the shuffle.
    checked = stage(found.groupBy("digest", "bytes").agg(F.min(preferred()).alias("keep"), F.count("*").alias("group_size")), "exact-checked")
    mixed = stage(checked.groupBy("digest").count().filter("count > 1").select("digest"), "exact-mixed")
    if mixed.take(1):
        # Several texts under one digest: their rows take the groups of their bytes.
        bad = found.join(mixed, "digest", "left_semi").join(checked, ["digest", "bytes"]).drop("bytes")
        if lasting:
            bad = bad.join(prints.select("_file", "_row"), ["_file", "_row"], "left_semi")
        own = prints.join(mixed, "digest", "left_anti").join(state, "digest").unionByName(bad)
    else:
        own = prints.join(state, "digest")
    same = (F.col("_file") == F.col("keep.file")) & (F.col("_row") == F.col("keep.row"))
    return own.select("doc_id", "digest", "keep", "group_size", same.alias("kept"), "_file", "_row")


def _rows(located_docs: DataFrame, at: str, row: str, id_col: str, text_col: str) -> DataFrame:
    return located_docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(at).alias("_file"), F.col(row).alias("_row"))


def _earlier(spark: SparkSession, id_col: str, text_col: str):
    def read(files: list[str]) -> DataFrame:
        table = spark.read.parquet(*files)
        at, row = fresh_name(table, "_file"), fresh_name(table, "_row")
        return _rows(located(table, at, row), at, row, id_col, text_col)

    return read


def exact_groups(docs: DataFrame, bits: int = 256, batches: int = 4, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, keep (struct with doc_id, file, row), group_size, kept, _file, _row: one row per row of docs.

    bits: how much of SHA-256 is the state's key; fewer make collisions, which the byte check resolves.
    batches: into how many micro-batches the fingerprints are divided, if there are as many files.
    state_dir: a folder that all executors share; groups then span all calls with it, each call's rows
    being new ones, and a row is kept if it is its group's best so far.
    """
    at, row = fresh_name(docs, "_file"), fresh_name(docs, "_row")
    rows = _rows(located(docs, at, row), at, row, id_col, text_col)
    return _groups(rows, bits, batches, state_dir, _earlier(docs.sparkSession, id_col, text_col))


def deduplicate(docs: DataFrame, bits: int = 256, batches: int = 4, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows that stay, with docs' own columns."""
    at, row = fresh_name(docs, "_file"), fresh_name(docs, "_row")
    whole = located(docs, at, row)
    groups = _groups(_rows(whole, at, row, id_col, text_col), bits, batches, state_dir, _earlier(docs.sparkSession, id_col, text_col))
    gone = groups.filter("not kept").select(F.col("_file").alias(at), F.col("_row").alias(row))
    return whole.join(stage(gone, "exact-gone"), [at, row], "left_anti").select(*(f"`{c}`" for c in docs.columns))
