"""Quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (1 to `order` words, `buckets` buckets)
are fitted: one to the trusted target texts, one to the whole raw corpus.  A
document's score is the mean over its n-grams of log p_target - log p_raw.  It is
kept when the base rules hold and the score is at least the threshold.

The threshold is deterministic: `threshold` if given, else `margin` below the
`quantile` of the target documents' own scores, all of which are counted (their
scores go into a histogram of `STEP`-wide bins, so the quantile needs no sort and
depends on no order).  Raw counts cover all rows, the target all labelled good
documents (see `trusted_texts`).  What the driver holds is `buckets` counts
twice and that histogram.

Rules of the base: n_words, word_chars (code points in words), n_symbols,
n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
inside a 3-word window that occurs twice or more).  base_failed: fewer than 50
words, or more than half of the words repeated.

Defined results: null and empty texts have no words, score 0 and fail; documents
of words but no target texts at all (an empty or null target) score 0 and only
the base rules decide; repeated rows are all scored; an empty table gives an
empty table.  Extra columns are kept by `filter_quality`, ignored by
`score_quality`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bit, ensure_importable, located, small_batches, stage
from .encoding import forget_encoders

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
STEP = 1 / 256
_KEEP = 200_000
_memo: dict[str, int] = {}

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit code of each word (xxhash of its lower-cased UTF-8)."""
    import xxhash

    if len(_memo) > _KEEP:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w.lower().encode())
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """Free this worker's codes: the next task may be another operator's."""
    _memo.clear()


def gram_buckets(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of every n-gram of 1 to order words."""
    out, rolled = [], np.zeros(len(codes), np.uint64)
    for k in range(min(order, len(codes))):
        n = len(codes) - k
        rolled = (rolled[:n] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ codes[k:]
        mixed = (rolled ^ rolled >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(32)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def measures(text: str | None, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, len(SYMBOL.findall(text)) if text else 0, 0, 0
    lines = text.split("\n")
    repeats = 0
    if len(set(lines)) < len(lines):
        repeats = sum(c - 1 for line, c in Counter(lines).items() if c > 1 and WORD.search(line))
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    inside = 0
    if len(words) > 3:
        n = len(ids)
        pairs = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)[1]
        _, at, counts = np.unique(pairs[:-1].astype(np.int64) * n + codes[2:], return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        if twice.any():
            hit = np.zeros(len(words), bool)
            for k in range(3):
                hit[k : len(twice) + k] |= twice
            inside = int(hit.sum())
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), repeats, inside


def gram_counts(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """n-gram counts of a one-column table of texts: one histogram per task, added up per bucket."""
    ensure_importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # the worker may have packed before
        total = np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(gram_buckets(word_codes(WORD.findall(text)), order, buckets), minlength=buckets)
        forget_words()
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket, both smoothed; zeros without target."""
    if not target.sum():
        return np.zeros(len(raw))
    p, q = ((c + smoothing) / (c.sum() + smoothing * len(c)) for c in (target, raw))
    return np.log(p) - np.log(q)


def _scored(rows: DataFrame, ratio: np.ndarray, order: int, threshold: float | None, keep_text: bool = False) -> DataFrame:
    """rows: text first, other columns after it; adds the columns of SCHEMA. The text itself goes unless keep_text."""
    begin = 0 if keep_text else 1
    others = rows.schema.fields[begin:]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # the worker may have packed before
        # Small slices also go back to Spark as small batches.
        for batch in small_batches(batches, 1024):
            out = [[] for _ in range(8)]
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text) if text else []
                m = measures(text, words)
                grams = gram_buckets(word_codes(words), order, len(ratio))
                score = float(ratio[grams].mean()) if len(grams) else 0.0
                failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
                for c, v in zip(out, (*m, score, failed, not failed and (threshold is None or score >= threshold))):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + begin) for k in range(len(names))), *(pa.array(c, t) for c, t in zip(out, kinds))], names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"])
        forget_words()

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{head}, {SCHEMA}" if head else SCHEMA)


def fit(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 16_384, quantile: float = 0.005, margin: float = 0.05, text_col: str = "text") -> tuple[np.ndarray, float | None]:
    """(log ratio of each bucket, threshold) from all texts of docs and of target (a table with a column text)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    text = f"cast(`{text_col}` as string) text"
    trusted = target.select("text").filter("text is not null")
    ratio = log_ratio(gram_counts(trusted, order, buckets), gram_counts(docs.selectExpr(text), order, buckets))
    return ratio, _threshold(_scored(trusted, ratio, order, None), quantile, margin)


def _threshold(scores: DataFrame, quantile: float, margin: float) -> float | None:
    """The threshold that the target's scores give; None without a sound target."""
    bins = scores.filter("not base_failed").groupBy(F.floor(F.col("score") / STEP).alias("bin")).count()
    seen = sorted((r.bin, r["count"]) for r in bins.collect())
    total, below = sum(c for _, c in seen), 0
    for b, c in seen:
        below += c
        if below > quantile * total:
            return b * STEP - margin
    return None


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float | None], order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ensure_importable(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{text_col}` as string) text", f"cast(`{id_col}` as long) doc_id")
    return _scored(rows, model[0], order, model[1])


def filter_quality(docs: DataFrame, model: tuple[np.ndarray, float | None], order: int = 2, text_col: str = "text") -> DataFrame:
    """docs' own rows and columns that are kept."""
    ensure_importable(docs.sparkSession)
    fields = docs.schema.fields
    # A text that is a string already passes through Python once.
    names = ["text" if f.name == text_col and f.dataType == StringType() else f"c{i}" for i, f in enumerate(fields)]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names) if n != "text"))
    kept = _scored(rows, model[0], order, model[1], "text" in names).filter("kept")
    return kept.select(*(F.col(n).alias(f.name) for f, n in zip(fields, names)))


def _good(labels: DataFrame) -> DataFrame:
    """good: the ids that no label calls bad, each once."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("good"))


def _trusted(docs: DataFrame, good: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.join(good, F.col("id") == F.col("good"), "left_semi").select("text")


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of all labelled good documents: the target.

    Only ids meet the labels: the join gives a bitmap for each block of rows of docs' files, by which
    the texts are picked where they are read.  No hint: the bitmaps, a bit a row, are staged, so Spark
    broadcasts them while they are small; beyond that the join shuffles the texts once.
    """
    rows = located(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "file", "row")
    block = F.bitmap_bucket_number("row").alias("block")
    found = rows.select("id", "file", "row").join(_good(labels), F.col("id") == F.col("good"), "left_semi")
    bits = stage(found.groupBy("file", block).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")), "quality-rows")
    placed = rows.select("text", "file", block, F.bitmap_bit_position("row").alias("place"))
    return stage(placed.join(bits, ["file", "block"]).filter(bit(F.col("bits"), F.col("place"))).select("text"), "quality-target")


def score_labelled(docs: DataFrame, labels: DataFrame, order: int = 2, buckets: int = 16_384, quantile: float = 0.005, margin: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score_quality by the model that trusted_texts and fit give, with each text scored once: the target's scores are taken from all rows'."""
    ensure_importable(docs.sparkSession)
    good = stage(_good(labels), "quality-ids")
    target = gram_counts(_trusted(docs, good, id_col, text_col), order, buckets)
    ratio = log_ratio(target, gram_counts(docs.selectExpr(f"cast(`{text_col}` as string) text"), order, buckets))
    scores = stage(score_quality(docs, (ratio, None), order, id_col, text_col), "quality-scores")
    threshold = _threshold(scores.join(good, F.col("doc_id") == F.col("good"), "left_semi"), quantile, margin)
    return scores if threshold is None else scores.withColumn("kept", F.col("kept") & (F.col("score") >= threshold))
