"""Whitening of embeddings by matrix-free block Lanczos.

1. Entries become integers (floor(scale * c) + shift).  Rows without a usable vector
   go; the fit list is every distinct integer vector once, written to the shared folder.
2. One pass gives the number of vectors n and the sums S of their dimensions.  Vectors
   are centred before they are multiplied: an integer near the mean is taken off exactly,
   then the rest of the mean, so nothing cancels.
3. The covariance V is never formed.  A pass takes a block of directions Q (dimensions by
   block, all that is broadcast) and gives V Q: each task multiplies its centred batches,
   and the partial sums, of the size of Q, are added up by position.
4. Block Lanczos: the new block is V Q less its parts along all directions before it
   (twice: full reorthogonalisation).  Directions that vanish in that are a breakdown and
   are replaced by fresh ones orthogonal to all others.  Ritz pairs of V on the directions
   so far are done when their residuals |V y - e y| fall below `tolerance` times the
   largest eigenvalue, or when the directions span the whole space.  A basis that has
   grown to `most` directions is restarted from its best Ritz vectors.
5. trace(V) is the sum of the vectors' squared deviations, over n^3.

The driver holds matrices of dimensions by `most` directions; nothing grows with the rows.

Defined results: a vector is dropped if it is null, empty, holds a null or non-finite
entry or one whose integer doesn't fit, or has not the most common length (ties: the longer); repeated vectors are
fitted once and each row gets its result; ids may be null or repeat; only components
whose eigenvalue is above rounding (dimensions * 2^-52 * trace) are returned, so a
table of one vector, like an empty one, gives no rows; a deviation that doesn't fit a
long is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, stage

_EPS = 2.0**-52


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S (integers); components: dimensions by k; values: their eigenvalues, falling; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def integers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x (array of long): the rows whose vectors are usable."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    # Compared within a range whose ends are doubles and fit a long; NaN is beyond it.
    sound = lambda c: c.isNotNull() & (F.abs(c * scale) < F.lit(2.0**62))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") > 0).filter(F.forall("v", sound))
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))
    return rows.select("vec_id", F.when(F.forall("v", sound), x).alias("x"))


def usual_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _added(fit: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray:
    """The sum of what `part` makes of each task's matrices of vectors (flat arrays of doubles), added up by position in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = part(_matrix(b.column(0)) for b in batches if b.num_rows)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made.ravel()], pa.list_(pa.float64()))], ["part"])

    parts = fit.select("x").mapInArrow(run, "part array<double>")
    rows = parts.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # as many as a block has entries
    out = np.zeros(len(rows))
    for r in rows:
        out[r["pos"]] = r["s"]
    return out


class _Centre:
    """x less the mean S / n, exact up to the last rounding."""

    def __init__(self, n: int, sums: list[int]):
        near = [(2 * s + n) // (2 * n) for s in sums]
        self.near = np.array(near, np.int64)
        self.rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.rest


def _products(fit: DataFrame, centre: _Centre, n: int) -> Callable[[np.ndarray], np.ndarray]:
    def times(q: np.ndarray) -> np.ndarray:
        def part(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in matrices:
                c = centre(x)
                made = c.T @ (c @ q)
                total = made if total is None else total + made
            return total

        return _added(fit, part).reshape(q.shape) / n

    return times


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, fresh: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal directions of block off basis, and how many had vanished and are fresh ones. Fewer columns if the space is full."""
    d, out, broken = block.shape[0], basis, 0
    for k in range(block.shape[1]):
        if out.shape[1] == d:
            break
        v = block[:, k]
        for attempt in range(20):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            # What is left of an exact combination of the others is rounding alone.
            if left > 1e-12 * max(size, scale):
                # Of a direction that nearly vanished, rounding is a large part: once more.
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            broken += attempt == 0
            v, scale = fresh.standard_normal(d), 0.0
    return out[:, basis.shape[1] :], broken


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, tolerance: float = 1e-14, most: int = 256, passes: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, falling; eigenvectors; largest residual; passes) of the k largest pairs of the symmetric matrix that `times` multiplies by.

    A block is as wide as k at least: of an eigenvalue with more copies than a block has directions, some would be missed.
    """
    k, block = min(k, d), min(max(block, k), d)
    most = min(d, max(most, 2 * (k + block)))
    fresh = np.random.default_rng(seed)
    q, _ = _orthogonal(fresh.standard_normal((d, block)), np.zeros((d, 0)), 0.0, fresh)
    w, new, used, best, stuck = np.zeros((d, 0)), q, 0, np.inf, 0
    while True:
        w, used = np.column_stack([w, times(new)]), used + 1
        h = q.T @ w
        values, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, y = values[order], y[:, order]
        ritz, image = q @ y, w @ y
        rest = image - ritz * values
        sizes = np.linalg.norm(rest[:, :k], axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(sizes.max(initial=0.0)) / top
        stuck = 0 if worst < 0.5 * best else stuck + 1
        best = min(best, worst)
        whole = q.shape[1] >= d
        # Residuals that rounding keeps from falling further are as good as they get.
        if q.shape[1] >= k and (worst <= tolerance or whole or (worst <= 1e-12 and stuck >= 5)):
            return values[:k], ritz[:, :k], worst, used
        if used >= passes:
            raise RuntimeError(f"no convergence after {passes} passes: residual {worst:.1e}")
        if q.shape[1] + block > most and most < d:
            kept = min(k + block, q.shape[1])
            q, _ = np.linalg.qr(ritz[:, :kept])
            # Their products anew: rounding doesn't add up over restarts. The next block starts from the largest residuals.
            w, used, ahead = times(q), used + 1, rest[:, np.argsort(-sizes, kind="stable")[:block]]
        else:
            ahead = w[:, -new.shape[1] :]
        new, _ = _orthogonal(ahead, q, float(np.linalg.norm(ahead, axis=0).max(initial=0.0)), fresh)
        q = np.column_stack([q, new])


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once. rows: with x, all of one length."""
    return stage(rows.select("x").distinct(), "whitening-fit")


def _exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and sums of their dimensions: longs are added in halves, halves of tasks as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d + 1, np.int64), np.zeros(d + 1, np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                high[:d] += (x >> 31).sum(axis=0)
                low[:d] += (x & (2**31 - 1)).sum(axis=0)
                low[d] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(high), pa.array(low)], ["pos", "high", "low"])

    parts = vectors.select("x").mapInArrow(run, "pos int, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = {r["pos"]: int(r["high"]) * 2**31 + int(r["low"]) for r in parts.groupBy("pos").agg(wide("high"), wide("low")).collect()}  # one row a dimension
    return got.get(d, 0), [got.get(i, 0) for i in range(d)]


def fit(vectors: DataFrame, components: int = 16, block: int | None = None, **options) -> Whitening | None:
    """The whitening of a fit list (x: distinct vectors of one length); None if it has no vector. block: directions per pass, as many as components at least."""
    ensure_importable(vectors.sparkSession)
    d = usual_length(vectors)
    if not d:
        return None
    n, sums = _exact_sums(vectors, d)
    centre = _Centre(n, sums)

    def deviations(matrices: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([sum(float((centre(x) ** 2).sum()) for x in matrices)])

    # Sum of (n x - S)^2 is n^2 times that of (x - S / n)^2.
    trace = float(_added(vectors, deviations)[0]) / n
    if trace <= 0:
        return Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    values, found, residual, used = block_lanczos(_products(vectors, centre, n), d, components, block or components, **options)
    real = values > d * _EPS * trace
    return Whitening(n, tuple(sums), found[:, real], values[real], trace, residual, used)


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centre, weights = _Centre(model.n, list(model.sums)), model.components / np.sqrt(model.values)
    return lambda x: centre(x) @ weights


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k, project = len(model.values), _projection(model)

    def part(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in matrices:
            z = project(x)
            made = np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])
            total = made if total is None else total + made
        return total

    got = _added(vectors, part)
    means = got[k * k :] / model.n
    return float(np.abs(got[: k * k].reshape(k, k) / model.n - np.outer(means, means) - np.eye(k)).max())


def deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None where it doesn't fit a long."""
    s = np.array([float(v) for v in sums])
    rough = ((x * float(n) - s) ** 2).sum(axis=1)
    reach = float(np.abs(x).max(initial=0)) * n + float(np.abs(s).max(initial=0.0))
    if reach < 2.0**62 and (rough < 2.0**62).all():
        return (((x * n) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = [sum((n * v - t) ** 2 for v, t in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in out]


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row for each row and component. rows: vec_id, x."""
    k, project, shares = len(model.values), _projection(model), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Each row becomes k: slices bound what a batch turns into.
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                m, x = batch.num_rows, _matrix(batch.column(1))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                away = pa.array(deviation(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), away,
                        pa.array(project(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, OUTPUT)


def whitened_vectors(table: DataFrame, components: int = 16, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, **options) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: `components` rows, or as many as there are, for each row with a usable vector."""
    rows = stage(integers(table, id_col, vector_col, scale, shift), "whitening-rows")
    d = usual_length(rows)
    rows = rows.filter(F.size("x") == d)
    vectors = fit_list(rows)
    model = fit(vectors, components, block, **options)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], OUTPUT)
    return whiten(rows, model, identity_error(vectors, model))
