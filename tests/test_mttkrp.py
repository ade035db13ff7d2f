from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorspark.functions import products
from tensorspark.functions.factors import (
    from_dense,
    integer_factor_array,
    integer_factors,
    random_factor,
    random_factor_array,
    to_dense,
)
from tensorspark.operators import mttkrp as mt
from tensorspark.operators.blocked import BlockedTensor, mttkrp_all_blocked, mttkrp_blocked
from tensorspark.operators.mttkrp import PackedTensor, hot_indices, mttkrp, mttkrp_all
from tensorspark.plans import strategy as plan
from tensorspark.sources.synthetic import uniform_tensor
from tensorspark.sources.tns import read_tns
from tensorspark.tensor import SparseTensor

DATA = os.path.join(os.path.dirname(__file__), "data")
STRATEGIES = ["long", "wide", "arrow", "shuffle", "blocked"]

# Mode-wise outputs for the tiny tensor and the integer factors of rank 2.
TINY_R2 = [
    [[-20, -153], [16, -57], [-14, -27], [10, 15]],
    [[-5, -120], [-26, -126], [-24, -66], [30, -30]],
    [[-68, 157], [-16, -45], [0, 6]],
]
TINY_ONES = [[13, 21, 7, 5], [16, 10, 10, 10], [31, 12, 3]]


def brute(nonzeros: np.ndarray, factors: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros_like(factors[n])
    for *idx, val in nonzeros:
        row = np.full(out.shape[1], val)
        for w, i in enumerate(idx):
            if w != n:
                row = row * factors[w][int(i)]
        out[int(idx[n])] += row
    return out


def dense_rows(tensor: SparseTensor) -> np.ndarray:
    return tensor.df.toPandas().to_numpy(dtype=float)


@pytest.fixture(scope="module")
def tiny(spark):
    return read_tns(spark, os.path.join(DATA, "tiny_3mode.tns"))


@pytest.mark.parametrize("name", STRATEGIES)
def test_tiny_goldens(spark, tiny, name):
    factors = integer_factors(spark, tiny.mode_sizes, 2)
    ones = [np.ones((s, 1)) for s in tiny.mode_sizes]
    for n, size in enumerate(tiny.mode_sizes):
        got = to_dense(mttkrp(tiny, factors, n, 2, name), size, 2, "y")
        assert got.tolist() == TINY_R2[n]
        got = to_dense(mttkrp(tiny, ones, n, 1, name), size, 1, "y")
        assert got[:, 0].tolist() == TINY_ONES[n]


@pytest.mark.parametrize("name", ["arrow", "blocked"])
def test_all_modes_goldens(spark, tiny, name):
    out = mttkrp_all(tiny, integer_factors(spark, tiny.mode_sizes, 2), 2, name)
    for n, size in enumerate(tiny.mode_sizes):
        got = to_dense(out.where(F.col("mode") == n), size, 2, "y")
        assert got.tolist() == TINY_R2[n]


@pytest.mark.parametrize("sizes", [(30, 20), (9, 8, 7), (6, 5, 4, 3, 2), (2,) * 8])
def test_strategies_agree_with_brute_force(spark, sizes):
    t = uniform_tensor(spark, sizes, 300, seed=len(sizes))  # with repeated coordinates
    factors = [random_factor_array(s, n, 3, seed=1) for n, s in enumerate(sizes)]
    nonzeros = dense_rows(t)
    everything = {s: mttkrp_all(t, factors, 3, s).persist() for s in ("arrow", "blocked")}
    for n in {0, len(sizes) - 1}:
        want = brute(nonzeros, factors, n)
        for name in STRATEGIES:
            got = to_dense(mttkrp(t, factors, n, 3, name), sizes[n], 3, "y")
            assert np.allclose(got, want, atol=1e-10), (name, n)
        for name, out in everything.items():
            got = to_dense(out.where(F.col("mode") == n), sizes[n], 3, "y")
            assert np.allclose(got, want, atol=1e-10), (name, n)


def test_dense_tensor_against_einsum(spark):
    t = read_tns(spark, os.path.join(DATA, "dense_rank5.tns"))
    cube = np.zeros(t.mode_sizes)
    nz = dense_rows(t)
    cube[tuple(nz[:, k].astype(int) for k in range(3))] = nz[:, 3]
    a, b, c = factors = [random_factor_array(s, n, 8, seed=3) for n, s in enumerate(t.mode_sizes)]
    want = [
        np.einsum("abc,br,cr->ar", cube, b, c),
        np.einsum("abc,ar,cr->br", cube, a, c),
        np.einsum("abc,ar,br->cr", cube, a, b),
    ]
    for n in range(3):
        got = to_dense(mttkrp(t, factors, n, 8), t.mode_sizes[n], 8, "y")
        assert np.allclose(got, want[n], atol=1e-8)


def skewed(spark, n: int = 6000) -> SparseTensor:
    """A third of all rows share one index; another third are copies of one coordinate."""
    k = F.col("id") % 3
    df = spark.range(n).select(
        F.when(k < 2, 5).otherwise(F.col("id") % 40).cast("int").alias("i0"),
        F.when(k == 1, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(300))).cast("int").alias("i1"),
        F.when(k == 1, 2).otherwise(F.col("id") % 11).cast("int").alias("i2"),
        F.lit(1.0).alias("val"),
    )
    return SparseTensor.from_frame(df)


@pytest.mark.parametrize("name", ["shuffle", "blocked", "arrow"])
def test_skew_and_copies(spark, name):
    t = skewed(spark)
    factors = [integer_factor_array(s, n, 2) for n, s in enumerate(t.mode_sizes)]
    for n in range(3):
        got = to_dense(mttkrp(t, factors, n, 2, name), t.mode_sizes[n], 2, "y")
        assert (got == brute(dense_rows(t), factors, n)).all()


def test_hot_indices_are_bounded(spark):
    hot = hot_indices(skewed(spark), [0, 1, 2], 4)
    assert hot == {0: {5: 3}, 1: {7: 2}, 2: {2: 2}}


def test_cells_are_bounded_and_cover_everything(spark):
    t = skewed(spark)
    blocked = BlockedTensor.build(t, 2, cell_nnz=100)
    sizes = [r["n"] for r in blocked.cells.select("n").collect()]
    assert max(sizes) <= 100
    assert sum(sizes) == t.combined().nnz
    demand = [
        d.rows.groupBy("cell", "i").count().agg(F.max("count")).first()[0] for d in map(blocked.demand, range(3))
    ]
    assert demand == [1, 1, 1]
    factors = integer_factors(spark, t.mode_sizes, 2)
    arrays = [integer_factor_array(s, n, 2) for n, s in enumerate(t.mode_sizes)]
    for n in range(3):
        for limit in (0, 700, 1 << 20):  # by demand, mixed, all broadcast
            out = mttkrp_blocked(blocked, factors, n, 2, broadcast_bytes=limit)
            got = to_dense(out, t.mode_sizes[n], 2, "y")
            assert (got == brute(dense_rows(t), arrays, n)).all()


def test_demand_does_not_grow_with_declared_sizes(spark):
    """Keys that can't hold all index bits still order by Z-curve."""
    t = uniform_tensor(spark, (1 << 12,) * 3, 40000)
    wide = [t.with_frame(t.df.select(*[F.shiftleft(F.col(f"i{n}"), s - 12).alias(f"i{n}") for n in range(3)], "val")) for s in (21, 24)]
    rows = []
    for tensor, bits in zip(wide, (21, 24)):
        sized = SparseTensor.from_frame(tensor.df, (1 << bits,) * 3)
        blocked = BlockedTensor.build(sized, 2, cell_nnz=500)
        rows.append(sum(d.rows.count() for d in map(blocked.demand, range(3))))
    assert rows[1] <= rows[0] * 1.05


def test_hot_demand_is_dealt_over_partitions(spark):
    """Every cell wants the one row of a mode; no partition gets much more than its share."""
    k = F.col("id")
    df = spark.range(60000).select(
        F.pmod(F.xxhash64(k), F.lit(4000)).alias("i0"),
        F.pmod(F.xxhash64(k, F.lit(1)), F.lit(4000)).alias("i1"),
        F.lit(0).cast("bigint").alias("i2"),
        F.lit(1.0).alias("val"),
    )
    t = SparseTensor.from_frame(df)
    blocked = BlockedTensor.build(t, 2, cell_nnz=64)
    rows = blocked.demand(2).rows
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.select("salt").distinct().count() >= blocked.parts
    assert max(parts) <= 2 * (sum(parts) / blocked.parts) + 64


def test_layout_partitions_follow_size():
    from tensorspark.operators.blocked import PART_BYTES, layout_partitions

    assert layout_partitions(1000, 3, 8, 200) == 8
    nnz = 10**12
    assert layout_partitions(nnz, 3, 1000, 200) == -(-nnz * 20 // PART_BYTES)


@pytest.mark.parametrize("width", ["4", "64"])
def test_blocked_does_not_reshuffle_the_tensor(spark, width):
    t = uniform_tensor(spark, (40, 30, 20), 2000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        blocked = BlockedTensor.build(t, 2)
        factors = integer_factors(spark, t.mode_sizes, 2)
        out = mttkrp_all_blocked(blocked, factors, 2, broadcast_bytes=0)
        text = out._jdf.queryExecution().toString()
        got = to_dense(out.where("mode = 0"), 40, 2, "y")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    arrays = [integer_factor_array(s, n, 2) for n, s in enumerate(t.mode_sizes)]
    assert np.allclose(got, brute(dense_rows(t), arrays, 0))
    physical = text[text.index("== Physical Plan ==") :]
    left = physical[physical.index("FlatMapCoGroupsInArrow") :].split("Scan ExistingRDD")[0]
    assert "Exchange" not in left


def test_absent_factor_rows_are_zero(spark):
    t = uniform_tensor(spark, (10, 10, 10), 500)
    arrays = [integer_factor_array(10, n, 2) for n in range(3)]
    arrays[1][4:] = 0.0
    frames = [from_dense(spark, a) for a in arrays]
    frames[1] = frames[1].where("i < 4")
    blocked = BlockedTensor.build(t, 2, cell_nnz=64)
    want = brute(dense_rows(t), arrays, 0)
    demanded = mttkrp_blocked(blocked, frames, 0, 2, broadcast_bytes=0)
    for got in (demanded, mttkrp_blocked(blocked, frames, 0, 2), mt.mttkrp_arrow(t, frames, 0, 2)):
        assert np.allclose(to_dense(got, 10, 2, "y"), want)


def test_partition_count_does_not_matter(spark):
    t = uniform_tensor(spark, (50, 40, 30), 3000)
    ints = t.with_frame(t.df.withColumn("val", F.round(F.col("val") * 10)))
    factors = [integer_factor_array(s, n, 3) for n, s in enumerate(t.mode_sizes)]
    outs = [
        to_dense(mttkrp(ints.with_frame(ints.df.repartition(p)), factors, 1, 3), 40, 3, "y")
        for p in (1, 7)
    ]
    assert (outs[0] == outs[1]).all()


def test_linearity_and_mode_permutation(spark):
    t = uniform_tensor(spark, (12, 10, 8), 400)
    factors = [random_factor_array(s, n, 2, seed=2) for n, s in enumerate(t.mode_sizes)]
    base = to_dense(mttkrp(t, factors, 0, 2), 12, 2, "y")
    doubled = t.with_frame(t.df.withColumn("val", F.col("val") * 2))
    assert np.allclose(to_dense(mttkrp(doubled, factors, 0, 2), 12, 2, "y"), 2 * base)
    swapped = SparseTensor.from_frame(
        t.df.select(
            F.col("i2").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), "val"
        ),
        (8, 12, 10),
    )
    turned = [factors[2], factors[0], factors[1]]
    assert np.allclose(to_dense(mttkrp(swapped, turned, 1, 2), 12, 2, "y"), base)


def test_high_rank(spark):
    t = uniform_tensor(spark, (15, 10, 8), 300)
    factors = [random_factor_array(s, n, 130, seed=2) for n, s in enumerate(t.mode_sizes)]
    got = to_dense(mttkrp(t, factors, 0, 130), 15, 130, "y")
    assert np.allclose(got, brute(dense_rows(t), factors, 0))


def test_chunks_larger_than_one_block(spark):
    t = uniform_tensor(spark, (5000, 40, 30), 40000)
    factors = [random_factor_array(s, n, 64, seed=2) for n, s in enumerate(t.mode_sizes)]
    packed = PackedTensor.spread(t)
    nz = dense_rows(t)
    i, j, k = (nz[:, c].astype(int) for c in range(3))
    want = np.zeros((5000, 64))
    np.add.at(want, i, nz[:, 3:4] * factors[1][j] * factors[2][k])
    assert np.allclose(to_dense(mt.mttkrp_arrow(packed, factors, 0, 64), 5000, 64, "y"), want)
    everything = mt.mttkrp_all_arrow(packed, factors, 64)
    assert np.allclose(to_dense(everything.where("mode = 0"), 5000, 64, "y"), want)


@pytest.mark.parametrize("num_modes", [2, 3, 4, 5])
def test_shared_products(num_modes):
    rng = np.random.default_rng(num_modes)
    sizes, rank, nnz = (7, 40, 3, 11, 5)[:num_modes], 3, 20_000
    idx = [rng.integers(0, s, nnz).astype("<u4") for s in sizes]
    val = rng.integers(-3, 4, nnz).astype(float)
    tables = [rng.integers(-2, 3, (rank, s)).astype(float) for s in sizes]

    def want(n):
        out = np.zeros((rank, sizes[n]))
        for r in range(rank):
            term = val.copy()
            for w in range(num_modes):
                term *= 1.0 if w == n else tables[w][r][idx[w]]
            np.add.at(out[r], idx[n], term)
        return out

    for modes in [[n] for n in range(num_modes)] + [list(range(num_modes)), [0, num_modes - 1]]:
        given = [None if modes == [w] else t for w, t in enumerate(tables)]
        sums = {n: np.zeros((rank, sizes[n])) for n in modes}
        count = products.add_products(idx, val, given, sums)
        for n in modes:
            assert (sums[n] == want(n)).all()
        if len(modes) == num_modes:
            assert count == max(2, 3 * num_modes - 4)


def test_outputs_that_no_task_keeps(spark, monkeypatch):
    monkeypatch.setattr(products, "SUM_BYTES", 0)
    monkeypatch.setattr(products, "PIECE_BITS", 1)
    out = products.TaskSums((4, 4), 2, [0])
    idx, val = [np.array([1, 3, 1], "<u4"), np.array([0, 1, 2], "<u4")], np.ones(3)
    batches = list(out.add(idx, val, [None, np.ones((2, 4))]))
    assert [b.column("piece").to_pylist() for b in batches] == [[0], [1]]
    assert list(out.finish()) == []
    rows = pa.Table.from_batches(products.add_pieces(iter([*batches, *batches][::2] + [batches[1]]), 2))
    assert rows.to_pydict() == {"mode": [0, 0], "i": [1, 3], "y0": [4.0, 1.0], "y1": [4.0, 1.0]}
    t = uniform_tensor(spark, (50, 10, 8), 500)
    factors = [integer_factor_array(s, n, 3) for n, s in enumerate(t.mode_sizes)]
    everything = mt.mttkrp_all_arrow(t, factors, 3)
    for n, s in enumerate(t.mode_sizes):
        got = to_dense(everything.where(F.col("mode") == n), s, 3, "y")
        assert np.allclose(got, brute(dense_rows(t), factors, n))


def test_random_factor_same_on_driver_and_executors(spark):
    frame = to_dense(random_factor(spark, 9000, 1, 3, seed=4), 9000, 3)
    assert (frame == random_factor_array(9000, 1, 3, seed=4)).all()


def test_large_factors_are_not_broadcast():
    assert plan.choose_strategy((100, 100), 16).name == "arrow"
    assert plan.choose_strategy((10**8, 100), 16).name == "blocked"
    assert plan.choose_strategy((10**8, 100), 16, mode=0).name == "arrow"


def test_oversized_factor_is_refused_by_the_broadcast_strategy(spark, tiny, monkeypatch):
    monkeypatch.setattr(mt, "BROADCAST_BYTES", 8)
    with pytest.raises(ValueError, match="broadcast limit"):
        mt.mttkrp_arrow(tiny, integer_factors(spark, tiny.mode_sizes, 2), 0, 2)
    wide = mt.mttkrp_wide(tiny, integer_factors(spark, tiny.mode_sizes, 2), 0, 2)
    assert to_dense(wide, 4, 2, "y").tolist() == TINY_R2[0]


def test_bad_arguments(spark, tiny):
    ones = [np.ones((s, 1)) for s in tiny.mode_sizes]
    for call in (
        lambda: mttkrp(tiny, ones, 3, 1),
        lambda: mttkrp(tiny, ones[:2], 0, 1),
        lambda: mttkrp(tiny, ones, 0, 0),
        lambda: mttkrp(tiny, ones, 0, 1, "nope"),
    ):
        with pytest.raises(ValueError):
            call()
