"""MTTKRP over the rows that occur: index dictionaries, and a plan from the measured shape.

Declared mode sizes say little about what a tensor holds.  :func:`measure` counts the rows
that occur in each mode; a mode with few of them gets a dictionary ``[i, k]`` of dense
numbers, in the order of the indices, and the tensor is stored with numbers in place of
indices.  Factors are then sent as rows that occur, and outputs translated back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorspark.functions.factors import factor_columns
from tensorspark.operators import stats
from tensorspark.operators.mttkrp import (
    Factor,
    PackedTensor,
    factor_frame,
    mttkrp_all_arrow,
    mttkrp_arrow,
)
from tensorspark.plans.strategy import (
    BROADCAST_BYTES,
    Shape,
    choose_passes,
    compact_modes,
)
from tensorspark.session import scratch_path
from tensorspark.tensor import SparseTensor

# Bytes of a row of a dictionary in a hash table.
ENTRY_BYTES = 64


def measure(tensor: SparseTensor) -> Shape:
    """Rows that occur and the share of the hottest, from one combined aggregate."""
    sizes, n_modes = tensor.mode_sizes, tensor.num_modes
    found = {
        r["mode"]: (r["touched"], r["most"])
        for r in stats.row_counts(tensor)
        .groupBy("mode")
        .agg(F.count(F.lit(1)).alias("touched"), F.max("nnz").alias("most"))
        .collect()
    }
    return Shape(
        sizes,
        tensor.nnz,
        tuple(found[n][0] for n in range(n_modes)),
        tuple(found[n][1] / tensor.nnz for n in range(n_modes)),
    )


def dictionary(tensor: SparseTensor, n: int) -> DataFrame:
    """``[i, k]``: the indices of mode ``n`` that occur, and their places in their order.

    Numbers are places inside ranges of the sorted indices plus the sizes of the ranges
    before; only one count for each range is summed up in one place.
    """
    spark, path = tensor.spark, scratch_path(tensor.spark, f"dictionary{n}")
    index = tensor.df.select(F.col(f"i{n}").cast("bigint").alias("i")).distinct()
    ranged = index.repartitionByRange("i").sortWithinPartitions("i")
    # The id is the number of the partition in its upper bits and the place in it below.
    split = ranged.withColumn("id", F.monotonically_increasing_id())
    part, at = F.shiftright("id", 33).alias("part"), (F.col("id") % (1 << 33)).alias("at")
    split.select("i", part, at).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").select("i", (F.col("start") + F.col("at")).alias("k"))


@dataclass(frozen=True)
class CompactTensor:
    """A tensor whose modes in ``dictionaries`` hold numbers of rows that occur."""

    tensor: SparseTensor
    dictionaries: dict[int, DataFrame]
    shape: Shape

    @classmethod
    def build(cls, tensor: SparseTensor, shape: Shape | None = None) -> CompactTensor:
        shape = shape or measure(tensor)
        names = tensor.index_columns
        found = {n: dictionary(tensor, n) for n in compact_modes(shape)}
        df = tensor.df
        for n, entries in found.items():
            entries = entries.withColumnRenamed("i", f"i{n}")
            if shape.touched[n] * ENTRY_BYTES <= BROADCAST_BYTES // len(found):
                entries = F.broadcast(entries)
            df = df.join(entries, f"i{n}").drop(f"i{n}").withColumnRenamed("k", f"i{n}")
        path = scratch_path(tensor.spark, "compact")
        df.select(*names, "val").write.parquet(path)
        sizes = tuple(
            shape.touched[n] if n in found else s for n, s in enumerate(tensor.mode_sizes)
        )
        stored = SparseTensor(
            tensor.spark.read.parquet(path), sizes, tensor.nnz, tensor.norm_sq, tensor.distinct
        )
        return cls(stored, found, shape)

    def factors(self, factors: Sequence[Factor], rank: int, skip: int | None = None) -> list[Factor]:
        """Rows that occur, by number; the target mode's factor is not read."""
        out: list[Factor] = []
        for n, f in enumerate(factors):
            if n == skip:
                f = np.zeros((0, rank))
            elif n in self.dictionaries:
                rows = factor_frame(self.tensor, f).join(self.dictionaries[n], "i")
                f = rows.select(F.col("k").alias("i"), *factor_columns(rank))
            out.append(f)
        return out

    def translated(self, out: DataFrame, n: int) -> DataFrame:
        if n not in self.dictionaries:
            return out
        back = self.dictionaries[n].withColumnRenamed("i", "row")
        return out.join(back, out["i"] == back["k"]).drop("i", "k").withColumnRenamed("row", "i")

    def mttkrp(self, factors: Sequence[Factor], n: int, rank: int) -> DataFrame:
        out = mttkrp_arrow(self.tensor, self.factors(factors, rank, n), n, rank)
        return self.translated(out, n).select("i", *factor_columns(rank, "y"))

    def mttkrp_all(self, factors: Sequence[Factor], rank: int) -> DataFrame:
        """``[mode, i, y0 ..]`` in as many passes as the shape calls for."""
        tasks = self.tensor.spark.sparkContext.defaultParallelism
        own, out = self.factors(factors, rank), None
        packed = PackedTensor.of(self.tensor)
        shape = replace(self.shape, mode_sizes=self.tensor.mode_sizes)
        for modes in choose_passes(shape, rank, tasks):
            if len(modes) == 1:
                sums = mttkrp_arrow(packed, own, modes[0], rank)
                sums = sums.select(F.lit(modes[0]).alias("mode"), "*")
            else:
                sums = mttkrp_all_arrow(packed, own, rank)
            for n in modes:
                rows = self.translated(sums.where(F.col("mode") == n), n)
                rows = rows.select("mode", "i", *factor_columns(rank, "y"))
                out = rows if out is None else out.unionByName(rows)
        return out
