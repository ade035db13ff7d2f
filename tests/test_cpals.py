from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorspark.functions import dense
from tensorspark.functions.factors import from_dense, to_dense
from tensorspark.operators import linalg, validate
from tensorspark.operators.cpals import CpOptions, cpals
from tensorspark.sources.synthetic import cp_tensor, cp_truth, uniform_tensor
from tensorspark.sources.tns import read_tns
from tensorspark.tensor import SparseTensor

DATA = os.path.join(os.path.dirname(__file__), "data")


@pytest.fixture(scope="module")
def cube(spark):
    t = read_tns(spark, os.path.join(DATA, "dense_rank5.tns"))
    return t.with_frame(t.df.persist())


def starts(tensor, rank, seed):
    rng = np.random.default_rng(seed)
    return [rng.standard_normal((s, rank)) for s in tensor.mode_sizes]


def test_recovers_a_rank5_tensor(spark, cube):
    assert cube.mode_sizes == (20, 25, 30)
    assert np.sqrt(cube.norm_sq) == pytest.approx(205.819423, abs=1e-6)
    result = cpals(cube, CpOptions(rank=5, tol=1e-7, max_iters=60, init=starts(cube, 5, 1)))
    assert result.final_fit > 0.9999
    assert result.fit_history[-1] == result.final_fit
    assert len(result.iter_time_s) == result.iters_done
    for f in result.factors:
        assert np.allclose(dense.col_norms(f), 1.0)
    true = validate.true_fit(cube, result.factors, result.lam)
    # The difference of three nearly equal sums limits a fit close to one.
    assert true == pytest.approx(result.final_fit, abs=1e-5)
    truth, _ = cp_truth((20, 25, 30), 5, 7)
    similarity = validate.factor_similarity(
        [from_dense(spark, f) for f in truth], result.factor_frames(spark), 5
    )
    assert similarity > 0.999


def test_local_minimum_is_reported_honestly(cube):
    result = cpals(cube, CpOptions(rank=5, tol=1e-4, max_iters=30, init=starts(cube, 5, 9)))
    assert result.final_fit < 0.75
    assert validate.true_fit(cube, result.factors, result.lam) == pytest.approx(
        result.final_fit, abs=1e-9
    )


def test_jacobi_fit_is_exact(cube):
    opt = CpOptions(rank=5, tol=1e-7, max_iters=8, kernel="jacobi", init=starts(cube, 5, 1))
    result = cpals(cube, opt)
    assert result.iters_done == 8
    assert validate.true_fit(cube, result.factors, result.lam) == pytest.approx(
        result.final_fit, abs=1e-9
    )


def test_jacobi_converges(cube):
    opt = CpOptions(rank=5, tol=1e-7, max_iters=80, kernel="jacobi", init=starts(cube, 5, 1))
    assert cpals(cube, opt).final_fit > 0.999


@pytest.mark.parametrize("kernel", ["gauss-seidel", "jacobi"])
def test_frames_equal_driver(spark, kernel):
    t = uniform_tensor(spark, (12, 10, 8), 300, seed=1)
    opts = [
        CpOptions(rank=2, max_iters=2, tol=0, kernel=kernel, factors=f, seed=5)
        for f in ("driver", "frames")
    ]
    a, b = (cpals(t, o) for o in opts)
    assert np.allclose(a.fit_history, b.fit_history, atol=1e-10)
    assert np.allclose(a.lam, b.lam)
    for n, size in enumerate(t.mode_sizes):
        assert np.allclose(to_dense(b.factors[n], size, 2), a.factors[n], atol=1e-9)


def test_duplicates_count_separately_in_the_norm(spark):
    rows = [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0)]
    t = SparseTensor.from_frame(spark.createDataFrame(rows, "i0 int, i1 int, val double"))
    assert t.norm_sq == 14.0
    result = cpals(t, CpOptions(rank=2, max_iters=3, tol=0))
    assert result.tensor_norm == pytest.approx(np.sqrt(14.0))


def test_rank_above_tensor_rank(spark):
    t = cp_tensor(spark, (6, 5, 4), 1, seed=3)
    result = cpals(t, CpOptions(rank=3, max_iters=15))
    assert result.final_fit > 0.99
    assert all(np.isfinite(f).all() for f in result.factors)


def test_untouched_rows_become_zero(spark):
    rows = [(0, 0, 1.0), (2, 1, 2.0)]
    t = SparseTensor.from_frame(
        spark.createDataFrame(rows, "i0 int, i1 int, val double"), mode_sizes=(5, 2)
    )
    result = cpals(t, CpOptions(rank=1, max_iters=2))
    assert (result.factors[0][[1, 3, 4]] == 0).all()


def test_options_are_checked(spark):
    rows = spark.createDataFrame([(0, 0, 1.0)], "i0 int, i1 int, val double")
    t = SparseTensor.from_frame(rows)
    for opt in (CpOptions(rank=0), CpOptions(kernel="other")):
        with pytest.raises(ValueError):
            cpals(t, opt)
    one = SparseTensor.from_frame(rows.select("i0", "val"))
    with pytest.raises(ValueError):
        cpals(one)
    assert cpals(t, CpOptions(rank=1, max_iters=0)).iters_done == 0
    assert cpals(t, CpOptions(rank=1, max_iters=0, kernel="jacobi")).iters_done == 0


def test_init_hook_and_history(spark):
    t = uniform_tensor(spark, (6, 5), 20)
    seen = []
    result = cpals(t, CpOptions(rank=2, max_iters=2, tol=0, on_init=seen.extend))
    assert [f.shape for f in seen] == [(6, 2), (5, 2)]
    assert result.history_frame(spark).count() == 2
    assert result.lambda_frame(spark).count() == 2


# ---- dense algebra -----------------------------------------------------------


def test_cholesky_and_solve():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 6))
    v = a.T @ a
    lower = dense.cholesky_lower(v, 0.0)
    assert np.allclose(lower @ lower.T, v) and np.allclose(lower, np.tril(lower))
    rows = rng.standard_normal((9, 6))
    assert np.allclose(dense.right_solve(lower, rows) @ v, rows)
    ridged = dense.cholesky_lower(v, 0.1)
    assert np.allclose(ridged @ ridged.T, v + 0.1 * v.diagonal().max() * np.eye(6))


def test_singular_matrix_gives_zero_components():
    v = np.array([[4.0, 0.0, 2.0], [0.0, 0.0, 0.0], [2.0, 0.0, 5.0]])
    lower = dense.cholesky_lower(v, 0.0)
    assert lower[1, 1] == 0
    out = dense.right_solve(lower, np.ones((2, 3)))
    assert (out[:, 1] == 0).all()
    assert np.allclose(out[:, [0, 2]] @ v[np.ix_([0, 2], [0, 2])], 1.0)
    assert (dense.right_solve(dense.cholesky_lower(np.zeros((2, 2)), 0), np.ones((1, 2))) == 0).all()


def test_small_helpers():
    a, b = np.arange(4.0).reshape(2, 2), np.ones((2, 2)) * 2
    assert dense.sum_diag_product(a, b) == 6.0
    assert dense.frob_norm_sq(a) == 14.0
    assert (dense.hadamard([], 3) == 1).all()
    assert (dense.hadamard([a, b], 2) == 2 * a).all()
    y = np.array([[3.0, 0.0], [4.0, 1e-30]])
    scaled = dense.col_scale_inv(y, dense.col_norms(y))
    assert np.allclose(scaled[:, 0], [0.6, 0.8]) and (scaled[:, 1] == 0).all()
    assert dense.weighted_col_dot(a, b, np.array([1.0, 10.0])) == 2 * 2 + 10 * 8
    lam = np.array([2.0, 3.0])
    assert dense.model_norm_sq([np.eye(2)], lam) == 13.0


def test_distributed_algebra_equals_dense(spark):
    rng = np.random.default_rng(1)
    y, z = rng.standard_normal((500, 4)), rng.standard_normal((500, 4))
    fy, fz = from_dense(spark, y), from_dense(spark, z)
    assert np.allclose(linalg.gram(fy, 4), y.T @ y)
    got = np.zeros((4, 4))
    for r, s, g in linalg.gram_frame(fy, 4).collect():
        got[r, s] = g
    assert np.allclose(got, y.T @ y)
    norms = dict(linalg.col_norms_frame(fy, 4).collect())
    assert np.allclose([norms[r] for r in range(4)], np.linalg.norm(y, axis=0))
    lam = [1.0, 2.0, 3.0, 4.0]
    inner = linalg.weighted_col_dot(fy, fz, lam, 4).first()[0]
    assert inner == pytest.approx(dense.weighted_col_dot(y, z, np.array(lam)))
    scaled = linalg.col_scale_inv(fy, linalg.col_norms_frame(fy, 4), 4)
    assert np.allclose(to_dense(scaled, 500, 4), y / np.linalg.norm(y, axis=0))
    lower = dense.cholesky_lower(z.T @ z, 0.0)
    solved = linalg.right_solve(fy, lower, ["f0", "f1", "f2", "f3"])
    assert np.allclose(to_dense(solved, 500, 4), dense.right_solve(lower, y))
    assert linalg.frob_norm_sq(fy, 4).first()[0] == pytest.approx((y * y).sum())


def test_model_with_factors_above_the_broadcast_limit(spark, monkeypatch):
    from tensorspark.operators import mttkrp as mt

    rows = [(k % 3 and 1, k % 7, 1.0) for k in range(60)]
    t = SparseTensor.from_frame(spark.createDataFrame(rows, "i0 int, i1 int, val double"))
    factors = [from_dense(spark, f).where("i <> 2") for f in starts(t, 2, 0)]
    small = sorted(map(tuple, validate.model_at_nonzeros(t, factors, [1.0, 2.0]).collect()))
    monkeypatch.setattr(mt, "BROADCAST_BYTES", 0)
    large = sorted(map(tuple, validate.model_at_nonzeros(t, factors, [1.0, 2.0]).collect()))
    assert large == small and len(small) == 14
    assert sum(r[2] for r in small) == 60.0


def test_compare_factors(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    want = from_dense(spark, a)
    got = from_dense(spark, a + [[0, 0], [0, 1.0]])
    row = validate.compare_factors(got, want, 2, "f").first()
    assert row["frob_rel"] == pytest.approx(1 / np.sqrt(30))
    assert (row["max_abs"], row["max_rel"]) == (1.0, 0.25)
    zero = from_dense(spark, a * 0)
    row = validate.compare_factors(want, zero, 2, "f").first()
    assert row["frob_rel"] == pytest.approx(np.sqrt(30))
    short = want.where(F.col("i") == 0)
    assert validate.compare_factors(short, want, 2, "f").first()["max_abs"] == 4.0


def test_default_rank_fit_runs_to_its_stop(spark):
    t = cp_tensor(spark, (12, 11, 10), 3, seed=3)
    result = cpals(t, CpOptions())
    assert 1 < result.iters_done < 50
    assert abs(result.fit_history[-1] - result.fit_history[-2]) < 1e-4
    assert result.final_fit > 0.99


def test_driver_factors_must_fit(spark, monkeypatch):
    from tensorspark.plans import strategy

    monkeypatch.setattr(strategy, "DRIVER_FACTOR_BYTES", 8)
    t = cp_tensor(spark, (4, 4, 4), 1, seed=1)
    with pytest.raises(ValueError, match="too large"):
        cpals(t, CpOptions(rank=1, factors="driver"))


def test_noise_is_relative_to_the_model(spark):
    clean = cp_tensor(spark, (20, 20, 20), 3, seed=3)
    noisy = cp_tensor(spark, (20, 20, 20), 3, seed=3, noise=0.5)
    assert noisy.norm_sq == pytest.approx(clean.norm_sq * 1.25, rel=0.05)
    again = cp_tensor(spark, (20, 20, 20), 3, seed=3, noise=0.5)
    assert again.norm_sq == pytest.approx(noisy.norm_sq)


def test_shapes_are_compared():
    validate.check_shapes((3, 4), (3, 4))
    with pytest.raises(ValueError):
        validate.check_shapes((3, 4), (3, 5))


def test_gram_by_mode(spark):
    rng = np.random.default_rng(1)
    mats = [rng.integers(-4, 5, (n, 3)).astype(float) for n in (5, 40)]
    frames = [from_dense(spark, m).withColumn("mode", F.lit(n)) for n, m in enumerate(mats)]
    grams = linalg.gram_frame(frames[0].unionByName(frames[1]), 3, by="mode")
    got = np.zeros((3, 3))
    for r, s, g in linalg.hadamard_by_mode(grams, [0, 1]).collect():
        got[r, s] = g
    assert (got == (mats[0].T @ mats[0]) * (mats[1].T @ mats[1])).all()


@pytest.mark.parametrize("kernel", ["gauss-seidel", "jacobi"])
def test_layouts_give_the_same_fit(spark, kernel):
    rng = np.random.default_rng(8)
    idx = rng.integers(0, (30, 12, 5), (2000, 3))
    idx[:700, 0] = 3  # a third of the nonzeros
    rows = [(*map(int, i), float(v)) for i, v in zip(idx, rng.integers(1, 5, 2000))]
    t = SparseTensor.from_frame(spark.createDataFrame(rows, "i0 long, i1 long, i2 long, val double"))
    fits = {}
    for layout in ("auto", "ncopy", "morton"):
        opt = CpOptions(rank=3, max_iters=4, tol=0.0, kernel=kernel, layout=layout)
        fits[layout] = cpals(t, opt).fit_history
    assert np.allclose(fits["auto"], fits["ncopy"], rtol=1e-9)
    assert np.allclose(fits["auto"], fits["morton"], rtol=1e-9)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("tensorspark_mode")]
