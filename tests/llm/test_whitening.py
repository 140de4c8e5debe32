"""Operator 12 against dense linear algebra."""

import math

import numpy as np
import pytest

from candela.llm import queries, whitening as W


def dense(rows, components=16):
    """n, deviations, whitened, shares by numpy and exact integers. rows: (id, vector)."""
    sound = [(d, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for d, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > len(e) * 2.0**-52 * e.sum()).sum()))
    x = np.array([r for _, r in sound], dtype=object)
    return n, [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x], ((x * n - s).astype(float) / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), [d for d, _ in sound]


def check(spark, rows, tolerance=1e-7, **options):
    df = spark.createDataFrame([(d, v, 1.0) for d, v in rows], "vec_id long, embedding array<float>, whitened double").repartition(3)
    n, away, white, shares, ids = dense(rows, options.get("components", 16))
    got = W.whitened_vectors(df, **options).collect()
    k = len(shares)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1
    assert sorted(r.deviation for r in got) == sorted(a for a in away for _ in range(k))
    assert all(abs(r.explained / shares[r.component - 1] - 1) < 1e-10 for r in got)
    mine = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(k):
        a = np.array([mine[i, c + 1] for i in ids])
        sign = np.sign(a @ white[:, c])
        assert np.abs(a - sign * white[:, c]).max() < tolerance


def vectors(r, n, scales):
    return [(i, (r.normal(size=len(scales)) * scales).tolist()) for i in range(n)]


def test_whitening_equals_dense(spark):
    r = np.random.default_rng(1)
    rows = vectors(r, 300, np.geomspace(3, 0.1, 24))
    rows += [(1000 + i, rows[5][1]) for i in range(100)] + [(2000, None), (2001, []), (2002, [1.0] * 23 + [None]), (2003, [float("nan")] + [0.0] * 23), (2004, [float("inf")] * 24)]
    check(spark, rows)


@pytest.mark.parametrize("block, most", [(6, 20), (10, 40), (16, 256)])
def test_restarts_and_blocks(spark, block, most):
    r = np.random.default_rng(2)
    check(spark, vectors(r, 400, 5.0 * 0.9 ** np.arange(90)), components=6, block=block, most=most)


def test_low_rank_and_few_dimensions(spark):
    r = np.random.default_rng(3)
    # Exact rank 3 of integers: breakdown of the first block.
    basis = r.integers(-3, 4, (3, 12))
    rows = [(i, (r.integers(-5, 6, 3) @ basis / 4.0).tolist()) for i in range(200)]
    check(spark, rows)
    check(spark, vectors(r, 50, np.array([2.0, 1.0])))


def test_no_vectors_and_one(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whitened_vectors(spark.createDataFrame(rows, schema)).count() == 0
    # The usual length wins; ids may be null.
    got = W.whitened_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (2, [0.0, 2.5]), (3, [9.0])], schema)).collect()
    assert [(r.vec_id, r.component) for r in sorted(got, key=lambda r: r.vec_id or 0)] == [(None, 1), (2, 1)] and {r.explained for r in got} == {1.0}


def test_lanczos_breaks_down_and_restarts():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(120, 120)))
    for values in (np.r_[np.ones(5) * 7, np.zeros(115)], np.r_[3.0, 2.0, np.zeros(118)], 2.0 ** -np.arange(120), np.r_[np.full(20, 4.0), np.linspace(1, 0, 100)]):
        a = (q * values) @ q.T
        e, v, residual, _ = W.block_lanczos(lambda x: a @ x, 120, 8, 8, most=40)  # noqa: B023
        assert np.allclose(e, np.sort(values)[::-1][:8], atol=1e-12 * values.max()) and residual < 1e-11
        assert np.allclose(v.T @ v, np.eye(8), atol=1e-12) and np.abs(a @ v - v * e).max() < 1e-11 * values.max()


def test_deviations_stay_exact():
    sums = (3 * 10**15, -5)
    x = np.array([[10**6, 7], [2**61, -(2**61)]], np.int64)
    n = 3 * 10**9
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert W.deviation(x, n, sums) == [v if v < 2**63 else None for v in exact]
    assert W.deviation(x[:1], 1000, (10**9, 7000)) == [0]


def test_query_on_its_own_table(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = vectors(r, 200, np.geomspace(1, 0.2, 20))
    spark.createDataFrame([(d, v, 0) for d, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).collect()
    n, away, white, shares, ids = dense(rows)
    assert len(got) == 200 * 16 and {r.n for r in got} == {n}
    byid = dict(zip(ids, away))
    assert all(r.deviation == byid[r.vec_id] and abs(r.explained - shares[r.component - 1]) < 1e-12 for r in got)
