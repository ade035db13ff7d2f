from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorspark.functions.morton import MortonPlan
from tensorspark.operators import stats
from tensorspark.sources.synthetic import uniform_tensor
from tensorspark.sources.tns import read_tns
from tensorspark.tensor import SparseTensor

TINY = os.path.join(os.path.dirname(__file__), "data", "tiny_3mode.tns")


@pytest.fixture(scope="module")
def tiny(spark):
    return read_tns(spark, TINY)


def test_fiber_stats(tiny):
    rows = [tuple(r) for r in stats.fiber_stats(tiny.df).orderBy("mode").collect()]
    assert rows == [(0, 4, 9, 2.25), (1, 4, 9, 2.25), (2, 3, 9, 3.0)]


def test_touched_rows(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (4, 1, 1.0)], "i0 int, i1 int, val double")
    t = SparseTensor.from_frame(df)
    assert [tuple(r) for r in stats.touched_rows(t).orderBy("mode").collect()] == [
        (0, 5, 2, 3),
        (1, 2, 1, 1),
    ]


@pytest.mark.parametrize("size,bits", [(1, 0), (64, 0), (65, 1), (3000, 6), (2**32, 26)])
def test_ranges_of_rows(size, bits):
    assert stats.range_bits(size) == bits
    assert (size - 1) >> bits < stats.RANGES


def test_ranges_and_row_pointers(spark):
    t = uniform_tensor(spark, (3000, 40, 5), 5000)
    counts = stats.range_counts(t)
    for mode, total in counts.groupBy("mode").agg(F.sum("nnz")).collect():
        assert total == 5000, mode
    offsets = stats.range_offsets(counts).where("mode = 0").orderBy("shard").collect()
    assert offsets[0]["shard_begin"] == 0 and offsets[-1]["shard_end"] == 5000
    assert all(a["shard_end"] == b["shard_begin"] for a, b in zip(offsets, offsets[1:]))
    pointers = stats.csr_rowptr(t, 0).orderBy("i").collect()
    assert pointers[0]["row_begin"] == 0 and pointers[-1]["row_end"] == 5000
    assert all(a["row_end"] == b["row_begin"] for a, b in zip(pointers, pointers[1:]))


def test_mode_sorted_keeps_everything_and_orders(spark):
    t = uniform_tensor(spark, (30, 40, 5), 2000)
    s = stats.mode_sorted(t, 1, 4)
    assert sorted(map(tuple, s.df.collect())) == sorted(map(tuple, t.df.collect()))
    parts = s.df.select(F.spark_partition_id().alias("p"), "i1").collect()
    assert parts == sorted(parts)


def test_tensor_construction_is_checked(spark):
    for rows, schema in (
        ([(None, 1, 1.0)], "i0 int, i1 int, val double"),
        ([(-1, 1, 1.0)], "i0 int, i1 int, val double"),
        ([(1, 1, None)], "i0 int, i1 int, val double"),
        ([], "i0 int, i1 int, val double"),
        ([(2**32, 1, 1.0)], "i0 bigint, i1 int, val double"),
    ):
        with pytest.raises(ValueError):
            SparseTensor.from_frame(spark.createDataFrame(rows, schema))


def test_table_indices_are_whole_and_wide(spark):
    table = spark.createDataFrame([(3_000_000_000, 1.0, 2.0), (5, 7.0, 1.0)], "k bigint, x double, v double")
    t = SparseTensor.from_table(table, ["k", "x"], "v")
    assert t.mode_sizes == (3_000_000_001, 8)
    bad = spark.createDataFrame([(1.9, 1.0), (1.2, 1.0)], "x double, v double")
    with pytest.raises(Exception, match="not a whole index"):
        SparseTensor.from_table(bad, ["x", "x"], "v")


def test_morton_golden(tiny):
    plan = MortonPlan.of(tiny.mode_sizes)
    assert plan.bits == (2, 2, 2)
    assert plan.masks == (0b001001, 0b010010, 0b100100)
    keyed = tiny.df.select(plan.encode([F.col(c) for c in tiny.index_columns]).alias("k"), "val")
    assert [tuple(r) for r in keyed.orderBy("k").collect()] == [
        (0, 1.0), (2, 2.0), (3, 8.0), (5, 7.0), (13, 5.0), (17, 6.0), (18, 10.0), (24, 4.0),
        (40, 3.0),
    ]


def test_morton_uneven_sizes():
    plan = MortonPlan.of((16, 16, 4096, 16))
    assert plan.bits == (4, 4, 12, 4) and plan.total_bits == 24
    assert sum(plan.masks) == 2**24 - 1
    assert MortonPlan.of((1, 2)).bits == (1, 1)
    assert MortonPlan.of((2**32, 2**32)).total_bits == 64
    with pytest.raises(ValueError):
        MortonPlan.of((2**32, 2**32, 2))
    leading = MortonPlan.leading((2**28, 2**28, 2**10), 63)
    assert leading.total_bits == 63 and leading.shifts == (2, 1, 0)
    with pytest.raises(ValueError):
        leading.decode(F.lit(0))


def test_morton_keys_of_64_bits(spark):
    plan = MortonPlan.of((2**32, 2**32))
    rows = [(0, 0), (2**32 - 1, 2**32 - 1), (0, 2**31), (2**31, 0), (5, 2**32 - 2)]
    df = spark.createDataFrame(rows, "i0 bigint, i1 bigint")
    key = plan.encode([F.col("i0"), F.col("i1")])
    got = df.select("i0", "i1", plan.order(key).alias("place"), *plan.decode(key)).orderBy("place")
    found = [tuple(r) for r in got.collect()]
    assert all(r[:2] == r[3:] for r in found)

    def unsigned(r):
        return sum((r[n] >> b & 1) << (2 * b + n) for n in (0, 1) for b in range(32))

    assert [r[:2] for r in found] == sorted(rows, key=unsigned)
    assert [r[2] for r in found] == [unsigned(r) - 2**63 for r in found]


@settings(max_examples=8, deadline=None)
@given(data=st.data())
def test_morton_round_trip(spark, data):
    sizes = data.draw(st.lists(st.integers(1, 2**20), min_size=2, max_size=3))
    rows = data.draw(
        st.lists(st.tuples(*[st.integers(0, s - 1) for s in sizes]), min_size=1, max_size=8)
    )
    names = [f"i{n}" for n in range(len(sizes))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    plan = MortonPlan.of(sizes)
    key = plan.encode([F.col(c) for c in names])
    back = df.select(*[c.alias(n) for c, n in zip(plan.decode(key), names)])
    assert [tuple(r) for r in back.collect()] == rows
