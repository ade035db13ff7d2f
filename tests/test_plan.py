"""The plan from the measured shape, and tensors of the rows that occur."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorspark.functions.factors import from_dense, to_dense
from tensorspark.functions.products import TaskSums, read_pieces
from tensorspark.operators import compact
from tensorspark.operators import mttkrp as mt
from tensorspark.operators.compact import CompactTensor, dictionary, measure
from tensorspark.plans.strategy import Shape, choose_by_shape, choose_passes, compact_modes
from tensorspark.tensor import SparseTensor

SCHEMA = "i0 long, i1 long, i2 long, val double"


@pytest.fixture(scope="module")
def sparse(spark):
    """Few of the declared rows occur; index 5 million of mode 0 holds a third."""
    rng = np.random.default_rng(6)
    rows = np.stack([rng.choice([3, 70_000, 5_000_000, 9], 3000, p=[0.3, 0.3, 1 / 3, 1 / 15]),
                     rng.integers(0, 40, 3000) * 1000, rng.integers(0, 6, 3000)], axis=1)
    data = [(*map(int, r), float(1 + k % 3)) for k, r in enumerate(rows)]
    return SparseTensor.from_frame(spark.createDataFrame(data, SCHEMA), (1 << 28, 1 << 27, 6))


def test_measured_shape(sparse):
    shape = measure(sparse)
    assert shape.touched == (4, 40, 6) and shape.nnz == 3000
    assert shape.hot_share[0] == pytest.approx(1 / 3, abs=0.04)
    assert compact_modes(shape) == [0, 1]


def test_dictionaries_number_indices_in_their_order(spark, sparse):
    got = {r.i: r.k for r in dictionary(sparse, 0).collect()}
    assert got == {3: 0, 9: 1, 70_000: 2, 5_000_000: 3}
    many = SparseTensor.from_frame(
        spark.range(0, 50_000, 7).select(F.col("id").alias("i0"), F.lit(0).alias("i1"), F.lit(1.0).alias("val"))
    )
    got = sorted((r.i, r.k) for r in dictionary(many, 0).collect())
    assert got == [(7 * k, k) for k in range(len(got))]


def shape_of(touched, sizes=(1 << 30,) * 3, nnz=10_000_000, hot=0.0):
    return Shape(sizes, nnz, touched, (hot,) * len(sizes))


def test_choices():
    small, rare, large = (2000,) * 3, shape_of((2000,) * 3), shape_of((1 << 28,) * 3)
    assert choose_by_shape(shape_of(small, small), 16).name == "arrow"
    assert choose_by_shape(rare, 16).name == "compact"
    assert choose_by_shape(large, 16).name == "blocked"
    one = shape_of((1 << 28, 2000, 2000))
    assert choose_by_shape(one, 16).name == "blocked"
    assert choose_by_shape(one, 16, mode=0).name == "compact"
    assert compact_modes(large) == [0, 1, 2]
    assert compact_modes(shape_of((600, 400, 1000), (1000,) * 3)) == [1]


def test_workers_hold_little_beside_their_nonzeros():
    """Factor rows of 96 MB go by demand; sums leave a task without a second copy of them."""
    assert choose_by_shape(shape_of((1 << 20,) * 3), 3).name == "blocked"
    rows = 1 << 20
    sums = TaskSums([rows], 4, [0])
    sums.kept[0] += np.arange(rows)
    sums.touched[0][5:] = True
    next(sums.finish())  # what Arrow imports at its first array doesn't count
    tracemalloc.start()
    seen = 0
    for batch in sums.finish():
        for mode, piece, i, y in read_pieces([batch], 4):
            assert (mode, i[0] >> 12, i[-1] >> 12) == (0, piece, piece) and (y == i[:, None]).all()
            seen += len(i)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == rows - 5 and peak < sums.kept[0].nbytes / 4


def test_choice_of_passes():
    small = shape_of((20_000,) * 3, (20_000,) * 3)
    for rank in (16, 32, 64):
        assert choose_passes(small, rank, 8) == [[0, 1, 2]]
    # Outputs that fit a task one by one, but not together, would be sent on by every chunk.
    sizes = (200_000,) * 4
    big = Shape(sizes, 10**9, sizes, (0.0,) * 4)
    assert choose_passes(big, 32, 1000) == [[0], [1], [2], [3]]
    hot = Shape(sizes, 10**9, sizes, (0.999,) * 4)
    assert choose_passes(hot, 32, 1000) == [[0, 1, 2, 3]]


@pytest.mark.parametrize("broadcast", [True, False])
def test_compact_mttkrp(spark, sparse, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(compact, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(7)
    rows = [np.sort(rng.choice(50_000, 300, replace=False)) for _ in range(2)]
    rows = [np.union1d(rows[0], [3, 9]), np.union1d(rows[1], np.arange(0, 40_000, 1000)), np.arange(6)]
    factors = [
        spark.createDataFrame([(int(i), *map(float, rng.integers(-3, 4, 2))) for i in r], "i long, f0 double, f1 double")
        for r in rows
    ]
    built = CompactTensor.build(sparse)
    assert built.tensor.mode_sizes == (4, 40, 6)
    everything = built.mttkrp_all(factors, 2)
    for n in range(3):
        # Factor rows that are missing are zero, so outputs without any are zero, or absent.
        want = {r.i: (r.y0, r.y1) for r in mt.mttkrp(sparse, factors, n, 2, "blocked").collect()}
        for out in (built.mttkrp(factors, n, 2), everything.where(F.col("mode") == n)):
            got = {r.i: (r.y0, r.y1) for r in out.collect()}
            assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in want.items() if any(v)}


def test_auto_measures_wide_modes(spark, sparse, monkeypatch):
    called = []
    build = CompactTensor.build.__func__
    monkeypatch.setattr(CompactTensor, "build", classmethod(lambda cls, *a: called.append(1) or build(cls, *a)))
    factors = [from_dense(spark, np.ones((s, 1))) for s in (10, 40_000, 6)]
    factors[0] = spark.createDataFrame([(i, 1.0) for i in (3, 9, 70_000, 5_000_000)], "i long, f0 double")
    out = mt.mttkrp(sparse, factors, 2, 1)
    assert called and to_dense(out, 6, 1, "y").sum() == sparse.df.agg(F.sum("val")).first()[0]
