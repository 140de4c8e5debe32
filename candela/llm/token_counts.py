"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A document longer than `chunk` characters is never encoded in one piece.  It is
cut into chunks that overlap; each chunk is encoded with offsets, and two
neighbours are spliced at a position that is provably a boundary of the whole
text's encoding:

* the left chunk starts at a proven boundary, so each of its pre-token
  boundaries is true as long as it lies more than `guard` characters before the
  chunk's end (the split pattern looks one character ahead, and a special token
  that the cut may break is shorter than the guard);
* the pattern keeps no state, so from a true boundary that both chunks share,
  the right chunk's pre-tokens are those of the whole text.

When the overlap holds no common boundary it is widened, twofold each time; when
it has reached the left chunk's start the chunk itself is enlarged.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
give repeated results; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ensure_importable, text_slices
from .encoding import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _bounds(tokenizer, text: str) -> tuple[list[int], list[int], int]:
    """(pre-token boundaries, tokens before each of them, tokens in all)."""
    e = tokenizer.encode(text, add_special_tokens=False)
    at, before, last = [], [], object()
    for k, (word, (lo, _)) in enumerate(zip(e.word_ids, e.offsets)):
        if word != last or word is None:
            at.append(lo)
            before.append(k)
            last = word
    return at, before, len(e.ids)


def count_spliced(tokenizer, text: str, chunk: int = 16_384, overlap: int = 256, guard: int = 64, seen: list | None = None) -> int:
    """Tokens of `text`, encoded in overlapping chunks. seen: gets each splice's (position, overlap)."""
    n, base, size, done = len(text), 0, chunk, 0
    end = min(n, size)
    at, before, total = _bounds(tokenizer, text[:end])
    first = 0  # tokens of the left chunk that lie before base
    origin = 0  # where the left chunk's text starts
    while end < n:
        wide = overlap
        while True:
            start = end - wide
            if start <= base:
                size *= 2
                end, origin, first = min(n, base + size), base, 0
                at, before, total = _bounds(tokenizer, text[base:end])
                break
            stop = min(n, start + size)
            if stop <= end:
                size *= 2
                continue
            r_at, r_before, r_total = _bounds(tokenizer, text[start:stop])
            right = {start + p: k for p, k in zip(r_at, r_before) if p > 0}
            common = next(((origin + p, k) for p, k in zip(reversed(at), reversed(before)) if base < origin + p <= end - guard and origin + p in right), None)
            if common is None:
                wide *= 2
                continue
            position, k = common
            if seen is not None:
                seen.append((position, wide))
            done += k - first
            base, origin, first = position, start, right[position]
            at, before, total, end, size = r_at, r_before, r_total, stop, chunk
            break
    return done + total - first


def count_tokens(docs: DataFrame, spec: str, limit: int = 512, chunk: int = 16_384, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        guard = 2 + max([30, *map(len, enc.specials)])
        width = enc.dtype.itemsize
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                part = texts[lo:hi]
                counts = [len(b) // width for b in enc.encode([None if t and len(t) > chunk else t for t in part])]
                for i, t in enumerate(part):
                    if t and len(t) > chunk:
                        counts[i] = count_spliced(enc.tokenizer, t, chunk, overlap, guard)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi], pa.int64()),
                    pa.array([len(t.encode()) if t else 0 for t in part], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)
