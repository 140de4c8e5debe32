"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Documents are range-partitioned and sorted by id; each partition writes one
shard.  A shard is a sequence of blocks of about `block_ids` ids, so that
neither side ever holds more than one block (or one document).  A block is

    magic, counts            8 bytes, then 4 little-endian u64: documents, ids, distinct ids, data bytes
    documents                i64 id, u8 "id is null" and i64 token count, column by column
    rank table               u32 ids, most frequent first (ties: smaller id first)
    control bytes            2 bits a value: its length in bytes less 1, 4 values a byte
    data bytes               each value's rank, little-endian, 1 to 4 bytes

The control bytes stand apart from the data, so a block is decoded by numpy table
lookups: control byte -> four lengths, lengths -> offsets, offsets -> ranks,
ranks -> ids.

A shard is written under a name of its own attempt and then moved to its final
name, and its content depends on the sorted rows alone: a task that is run again
on another executor leaves the same file.  Paths are URIs below
spark.checkpoint.dir and are opened with pyarrow.fs.

Defined results: null and empty texts hold just the end id; null document ids
sort first; repeated rows are all written; ties of an id are ordered by text; an
empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_importable, shuffle_parts, small_batches, stage, table_bytes, text_slices, work_path
from .encoding import encoder, forget_encoders

MAGIC = b"CNDLTOK1"
_HEAD = struct.Struct("<8sQQQQ")
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"
#: Lengths of the four values that a control byte describes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_block(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[table] = np.arange(len(table), dtype="<u4")
    ranks = rank_of[ids]
    lens = (1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lens[:, None]]
    code = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    code[: len(ids)] = lens - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(table), len(data))
    return b"".join((head, docs.tobytes(), null.tobytes(), np.array(sizes, "<i8").tobytes(), table.tobytes(), control.tobytes(), data.tobytes()))


def decode_block(stream) -> tuple[list, np.ndarray, np.ndarray] | None:
    """(document ids, token counts, ids as u32) of the next block, or None at the end."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    magic, n_docs, n_ids, n_table, n_data = _HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("not a token file")
    docs = np.frombuffer(stream.read(8 * n_docs), "<i8").tolist()
    null = stream.read(n_docs)
    sizes = np.frombuffer(stream.read(8 * n_docs), "<i8")
    table = np.frombuffer(stream.read(4 * n_table), "<u4")
    control = np.frombuffer(stream.read(-(-n_ids // 4)), np.uint8)
    data = np.frombuffer(stream.read(n_data) + b"\0\0\0", np.uint8)
    lens = LENGTHS[control].reshape(-1)[:n_ids]
    at = np.cumsum(lens, dtype=np.int64) - lens
    ranks = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = lens > k
        if not more.any():
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else d for d, z in zip(docs, null)], sizes, table[ranks].astype("<u4")


def write_token_files(docs: DataFrame, spec: str, end_id: int | None = None, out_dir: str | None = None, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 27) -> DataFrame:
    """Encode docs and write the shards; returns the manifest, one row per shard in id order.

    shard_bytes: there are as many shards as docs' bytes need, and one per shuffle partition at least:
    a shard is one task's work.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    out_dir = out_dir or work_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, shard = encoder(spec), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        final, mine = f"{root}/shard-{shard:06d}.tok", f"{root}/.attempt-{shard:06d}-{uuid.uuid4().hex}"
        totals = [0, 0, 0]
        with store.open_output_stream(mine) as out:
            doc_ids, parts, sizes, held = [], [], [], 0

            def flush():
                block = encode_block(doc_ids, sizes, np.frombuffer(b"".join(parts), "<u4"))
                out.write(block)
                totals[0] += len(doc_ids)
                totals[1] += held
                totals[2] += len(block)
                doc_ids.clear(), parts.clear(), sizes.clear()

            for batch in small_batches(batches):
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lo, hi in text_slices(texts):
                    for key, ids in zip(keys[lo:hi], enc.arrays(texts[lo:hi])):
                        raw = ids.astype("<u4").tobytes() + end
                        doc_ids.append(key), parts.append(raw), sizes.append(len(raw) // 4)
                        held += sizes[-1]
                        if held >= block_ids:
                            flush()
                            held = 0
            if doc_ids:
                flush()
        store.move(mine, final)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([f"{out_dir}/shard-{shard:06d}.tok"]), *(pa.array([v], pa.int64()) for v in totals)
        ], names=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    shards = max(shuffle_parts(spark), -(-table_bytes(docs, text_col) // shard_bytes))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian u32 bytes), read from the shards."""
    ensure_importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        forget_encoders()  # the worker may have written shards before
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as stream:
                    while block := decode_block(stream):
                        doc_ids, sizes, ids = block
                        ends = np.cumsum(sizes)
                        # From buffers: pa.array() of memoryview slices never gives the block back.
                        cuts = np.concatenate(([0], 4 * ends)).astype(np.int32)
                        raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64()),
                            pa.array(start + ends - sizes, pa.int64()),
                            raw,
                        ], names=["doc_id", "start", "ids"])
                        start += int(ends[-1])

    # One row per shard: the running total over them is small whatever the corpus.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.filter("n_docs > 0").select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return shards.repartition(shuffle_parts(spark), "path").mapInArrow(run, "doc_id long, start long, ids binary")
