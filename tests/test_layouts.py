"""Copies of a tensor for one mode, key chunks, bitmaps and marginals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorspark.functions import factors
from tensorspark.functions.factors import integer_factor_array, integer_factors, to_dense
from tensorspark.functions.morton import MortonPlan
from tensorspark.operators import blocked, copies, keyed, stats
from tensorspark.operators import mttkrp as mt
from tensorspark.operators.copies import BucketedCopy, FiberTree, fiber_runs, fiber_sums
from tensorspark.operators.keyed import KeyChunks, KeyTables, pack_keys, unpack_keys
from tensorspark.plans import queries
from tensorspark.sources.synthetic import uniform_tensor
from tensorspark.tensor import SparseTensor


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, size, rank):
    return to_dense(df, size, rank, "y")


@pytest.fixture(scope="module")
def tensor(spark):
    t = uniform_tensor(spark, (60, 25, 9), 4000)
    whole = t.df.withColumn("val", F.ceil(F.col("val") * 5).cast("double"))
    return SparseTensor.from_frame(whole, t.mode_sizes)


def skewed(spark, modes=3, n=3000):
    """Index 7 of mode 0 holds a third of the nonzeros; one coordinate repeats often."""
    rng = np.random.default_rng(1)
    idx = rng.integers(0, (40, 30, 11, 6)[:modes], (n, modes))
    idx[: n // 3, 0] = 7
    idx[: n // 20] = 7, *[2] * (modes - 1)
    val = rng.integers(1, 5, n).astype(float)
    schema = ", ".join([*[f"i{k} bigint" for k in range(modes)], "val double"])
    frame = spark.createDataFrame([(*map(int, i), float(v)) for i, v in zip(idx, val)], schema)
    return SparseTensor.from_frame(frame)


def arrays(t, rank):
    return [integer_factor_array(s, n, rank) for n, s in enumerate(t.mode_sizes)]


# ---- buckets -----------------------------------------------------------------


def test_bucketed_sum_has_no_exchange(spark, tensor):
    before = dict(spark.conf.getAll)
    copy = tensor.bucketed(0, 4)
    assert copy.hot is None
    out = copy.mttkrp(integer_factors(spark, tensor.mode_sizes, 3), 3)
    plan = plan_of(out)
    assert "SortAggregate" in plan and "HashAggregate" not in plan
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Sort [" not in plan
    want = mt.mttkrp(tensor, arrays(tensor, 3), 0, 3, "wide")
    assert (rows(out, 60, 3) == rows(want, 60, 3)).all()
    assert dict(spark.conf.getAll) == before
    copy.drop()
    assert copy.table not in [t.name for t in spark.catalog.listTables()]


def test_bucketed_chunks_have_no_exchange(tensor):
    for n in range(3):
        out = tensor.bucketed(n, 3).mttkrp(arrays(tensor, 20), 20)
        assert "Exchange" not in plan_of(out)
        want = mt.mttkrp(tensor, arrays(tensor, 20), n, 20, "arrow")
        size = tensor.mode_sizes[n]
        assert (rows(out, size, 20) == rows(want, size, 20)).all()
        assert out.count() == want.count()


@pytest.mark.parametrize("rank", [2, 12])
def test_hot_values_stay_outside_the_buckets(spark, rank):
    t = skewed(spark)
    copy = BucketedCopy.build(t, 0, 8)
    assert copy.hot is not None and copy.cold.where("i0 = 7").isEmpty()
    per_task = copy.hot.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert copy.hot.count() >= 1000 and per_task < 1000
    got, want = copy.mttkrp(arrays(t, rank), rank), mt.mttkrp(t, arrays(t, rank), 0, rank, "arrow")
    assert (rows(got, 40, rank) == rows(want, 40, rank)).all()


def test_large_factors_leave_the_buckets(spark, tensor, monkeypatch):
    monkeypatch.setattr(mt, "BROADCAST_BYTES", 8)
    copy = tensor.bucketed(1, 2)
    factors = integer_factors(spark, tensor.mode_sizes, 2)
    got = copy.mttkrp(factors, 2)
    want = mt.mttkrp(tensor, factors, 1, 2, "shuffle")
    assert (rows(got, 25, 2) == rows(want, 25, 2)).all()


@pytest.mark.parametrize("limit", [1 << 20, 2500])
def test_the_sweep_sends_no_large_factor_to_the_driver(spark, tensor, monkeypatch, limit):
    """Beyond the limit of what is collected, factor rows travel by demand."""
    monkeypatch.setattr(copies, "COLLECT_BYTES", limit)
    monkeypatch.setattr(blocked.mttkrp_blocked, "__defaults__", (limit,))
    got, to_dense = [], factors.to_dense

    def counted(df, rows, rank, *more):
        got.append(factors.factor_bytes(rows, rank))
        return to_dense(df, rows, rank, *more)

    for module in (mt, blocked):
        monkeypatch.setattr(module, "to_dense", counted)
    frames = integer_factors(spark, tensor.mode_sizes, 12)
    want = mt.mttkrp(tensor, frames, 1, 12, "shuffle")
    out = tensor.bucketed(1, 2).mttkrp(frames, 12)
    assert (rows(out, 25, 12) == rows(want, 25, 12)).all()
    assert sum(got) == {1 << 20: (60 + 9) * 104, 2500: 9 * 104}[limit]


def test_the_sweep_holds_no_factors_on_the_driver(monkeypatch):
    monkeypatch.setattr(queries, "_arrays", None)  # would grow with the modes
    kept = []

    class Tensor:
        mode_sizes, num_modes = (3, 4, 5), 3

        def bucketed(self, n):
            return self

        def mttkrp(self, factors, rank):
            kept.append(factors)
            raise KeyError

    monkeypatch.setattr(queries, "supply", lambda *_: Tensor())
    monkeypatch.setattr(queries, "integer_factors", lambda spark, sizes, rank: [*sizes, rank])
    with pytest.raises(KeyError):
        queries.mttkrp_bucketed_sweep(None, "")
    assert kept == [[3, 4, 5, 16]]


# ---- fibers ------------------------------------------------------------------


def test_fiber_runs():
    outer, inner = np.array([1, 1, 1, 2, 2, 5]), np.array([3, 3, 4, 4, 4, 4])
    ids, first, second, at = fiber_runs(outer, inner)
    assert ids.tolist() == [1, 2, 5] and first.tolist() == [0, 2, 3]
    assert second.tolist() == [3, 4, 4, 4] and at.tolist() == [0, 2, 3, 5]


def test_a_fiber_is_multiplied_once():
    rng = np.random.default_rng(2)
    nz = np.unique(rng.integers(0, (6, 4, 50), (900, 3)), axis=0)
    val = rng.integers(1, 4, len(nz)).astype(float)
    a, b, c = nz.T
    tables = [rng.integers(-2, 3, (5, s)).astype(float) for s in (4, 50)]
    runs = fiber_runs(a, b)
    got, count = fiber_sums(runs, [c], val, tables[0], [tables[1]])
    want = np.zeros((5, 6))
    for r in range(5):
        np.add.at(want[r], a, val * tables[0][r][b] * tables[1][r][c])
    assert (got == want[:, runs[0]]).all()
    fibers = len({(x, y) for x, y, _ in nz.tolist()})
    assert count == len(nz) + fibers < 2 * len(nz)


@pytest.mark.parametrize("modes", [2, 3, 4])
def test_fiber_trees_of_skewed_tensors(spark, modes):
    t = skewed(spark, modes)
    for n in range(modes):
        tree = FiberTree.build(t, n, chunk_nnz=100, parts=5)
        size = t.mode_sizes[n]
        want = mt.mttkrp(t, arrays(t, 3), n, 3, "wide")
        assert (rows(tree.mttkrp(arrays(t, 3), 3), size, 3) == rows(want, size, 3)).all()
    chunks = FiberTree.build(t, 0, chunk_nnz=100, parts=5).df
    lengths = chunks.select(F.octet_length("val") / 8, F.spark_partition_id()).collect()
    assert max(x for x, _ in lengths) <= 100
    if modes > 2:  # merged pairs are few
        assert len({p for _, p in lengths}) == 5


def test_second_mode_has_the_longest_fibers(spark):
    rng = np.random.default_rng(3)
    nz = np.unique(rng.integers(0, (30, 400, 5), (3000, 3)), axis=0).tolist()
    t = SparseTensor.from_frame(spark.createDataFrame([(*x, 1.0) for x in nz], "i0 long, i1 long, i2 long, val double"))
    assert copies.second_mode(t, 0) == 2 and copies.second_mode(t, 1) == 2


# ---- key chunks --------------------------------------------------------------


def test_keys_round_trip():
    rng = np.random.default_rng(4)
    for top in (10, 300, 2**20, 2**40, 2**64 - 1):
        keys = np.sort(rng.integers(0, top, 2000, dtype=np.uint64, endpoint=True))
        val = rng.random(2000)
        back = list(pack_keys(keys, val))
        assert sum(n for n, *_ in back) == 2000
        found = np.concatenate([unpack_keys(f, w, s) for _, f, w, s, _ in back])
        assert (found == keys).all()
        assert b"".join(v for *_, v in back) == val.tobytes()
    gap = np.array([*range(400), *range(2**50, 2**50 + 400)], np.uint64)
    assert [(n, w) for n, _, w, *_ in pack_keys(gap, np.ones(800))] == [(400, 1), (400, 1)]


def test_byte_tables_gather_indices(spark):
    sizes = (2**22, 300, 2**20, 2**13 - 5)
    plan = MortonPlan.of(sizes)
    rng = np.random.default_rng(5)
    idx = [rng.integers(0, s, 500) for s in sizes]
    keys = np.zeros(500, np.uint64)
    for i, places in zip(idx, plan.positions):
        for b, place in enumerate(places):
            keys |= (i.astype(np.uint64) >> np.uint64(b) & np.uint64(1)) << np.uint64(place)
    for got, want in zip(KeyTables(plan).indices(keys), idx):
        assert (got == want).all()
    with pytest.raises(ValueError, match="whole indices"):
        KeyTables(MortonPlan.leading((2**40, 2**40), 60))


def test_key_chunks(spark, tensor):
    stored = KeyChunks.build(tensor, chunk_nnz=500)
    for modes in ([0, 1, 2], [1]):
        got = stored.mttkrp_all(arrays(tensor, 3), 3, modes)
        for n in modes:
            want = rows(mt.mttkrp(tensor, arrays(tensor, 3), n, 3, "wide"), tensor.mode_sizes[n], 3)
            assert (rows(got.where(F.col("mode") == n), tensor.mode_sizes[n], 3) == want).all()
    size = stored.stored_bytes().first()
    assert size["nnz"] == tensor.nnz and size["bytes"] <= 12 * tensor.nnz


@pytest.mark.parametrize("cell_nnz", [300, 1200])
def test_large_factors_travel_to_key_chunks(spark, monkeypatch, cell_nnz):
    """Beyond the limits, chunks become cells; one cell may hold several, or a part of one."""
    t = skewed(spark)
    frames = integer_factors(spark, t.mode_sizes, 3)
    frames[1] = frames[1].where("i % 4 > 0")  # an absent row is zero
    want = {n: rows(mt.mttkrp(t, frames, n, 3, "wide"), s, 3) for n, s in enumerate(t.mode_sizes)}
    monkeypatch.setattr(mt, "BROADCAST_BYTES", 8)  # none could be sent whole before
    monkeypatch.setattr(keyed, "COLLECT_BYTES", 8, raising=False)
    monkeypatch.setattr(keyed, "default_cell_nnz", lambda *_: cell_nnz, raising=False)
    for limit in (0, 1500):  # all by demand, or only the largest
        for f in (blocked.mttkrp_blocked, blocked.mttkrp_all_blocked):
            monkeypatch.setattr(f, "__defaults__", (limit,))
        stored = KeyChunks.build(t, chunk_nnz=500)
        for modes in ([0, 1, 2], [0, 2], [1]):
            got = stored.mttkrp_all(frames, 3, modes)
            assert got.columns == ["mode", "i", "y0", "y1", "y2"]
            assert {r["mode"] for r in got.select("mode").distinct().collect()} == set(modes)
            for n in modes:
                out = rows(got.where(F.col("mode") == n), t.mode_sizes[n], 3)
                assert (out == want[n]).all()
    cells = stored.cells(3).cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    assert len(cells) > 2 and max(r.n for r in cells) <= cell_nnz
    assert sum(r.n for r in cells) == t.nnz


# ---- statistics --------------------------------------------------------------


def test_touched_rows_by_bitmaps(spark):
    n = 5000
    frame = spark.range(n).select(
        F.col("id").alias("i0"), (F.col("id") % 3 * 32768).alias("i1"), F.lit(1.0).alias("val")
    )
    t = SparseTensor.from_frame(frame, (40_000, 70_000))
    got = {r.mode: r.touched for r in stats.touched_counts(t, [0, 1]).collect()}
    assert got == {0: n, 1: 3}
    assert {r.mode: (r.touched, r.untouched) for r in stats.touched_rows(t).collect()} == {
        0: (n, 35_000), 1: (3, 69_997)
    }
    dense = SparseTensor.from_frame(frame, distinct=True)
    assert "bitmap" in plan_of(stats.touched_rows(dense))


def test_marginals_are_the_mttkrp_of_ones(spark, tensor):
    got = stats.mode_marginals(tensor.df)
    for n, size in enumerate(tensor.mode_sizes):
        ones = [np.ones((s, 1)) for s in tensor.mode_sizes]
        want = mt.mttkrp(tensor, ones, n, 1)
        mine = got.where(F.col("mode") == n).select("i", F.col("total").alias("y0"))
        assert np.allclose(rows(mine, size, 1), rows(want, size, 1))
    assert got.agg(F.sum("nnz")).first()[0] == 3 * tensor.nnz
