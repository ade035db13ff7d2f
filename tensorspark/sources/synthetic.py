"""Generated tensors for tests and trials."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.functions import dense
from tensorspark.functions.factors import factor_columns, from_dense
from tensorspark.tensor import SparseTensor


def uniform_tensor(
    spark: SparkSession, mode_sizes: Sequence[int], nnz: int, seed: int = 42
) -> SparseTensor:
    """``nnz`` uniform coordinates with values in (-1, 1); repeats are possible."""
    unit = [
        (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53))
        for k in range(len(mode_sizes) + 1)
    ]
    df = spark.range(nnz).select(
        *[F.floor(u * s).cast("bigint").alias(f"i{n}") for n, (u, s) in enumerate(zip(unit, mode_sizes))],
        (unit[-1] * 2 - 1).alias("val"),
    )
    return SparseTensor.from_frame(df, mode_sizes)


def _uniform(number: Column, *salts: int) -> Column:
    """In (0, 1), from a hash."""
    bits = F.pmod(F.xxhash64(number, *[F.lit(s) for s in salts]), F.lit(1 << 53))
    return (bits + 0.5) / float(1 << 53)


def _normal(number: Column, seed: int) -> Column:
    """Standard normal by the Box-Muller transform."""
    radius = F.sqrt(-2.0 * F.log(_uniform(number, seed, 1)))
    return radius * F.cos(2.0 * np.pi * _uniform(number, seed, 2))


def cp_truth(
    mode_sizes: Sequence[int], rank: int, seed: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Normal factors and weights in (0.5, 1.5)."""
    rng = np.random.default_rng(seed)
    factors = [rng.standard_normal((s, rank)).astype(np.float32) for s in mode_sizes]
    lam = rng.uniform(0.5, 1.5, rank).astype(np.float32)
    return [f.astype(np.float64) for f in factors], lam.astype(np.float64)


def cp_tensor(
    spark: SparkSession, mode_sizes: Sequence[int], rank: int, seed: int, noise: float = 0.0
) -> SparseTensor:
    """Every cell of a rank-``rank`` model, optionally with normal noise.

    ``noise`` is the noise's share of the model: its standard deviation is that fraction of
    the root mean square of the model's cells.  Cells are numbered and decoded, so no
    product of tables is formed, and noise follows the cell's number, not its partition.
    """
    factors, lam = cp_truth(mode_sizes, rank, seed)
    total = int(np.prod([int(s) for s in mode_sizes]))
    cell = spark.range(total)
    rest = F.col("id")
    columns = []
    for n in reversed(range(len(mode_sizes))):
        columns.append((rest % mode_sizes[n]).cast("bigint").alias(f"i{n}"))
        rest = F.call_function("div", rest, F.lit(mode_sizes[n]))
    df: DataFrame = cell.select("id", *reversed(columns))
    terms = [F.lit(float(v)) for v in lam]
    for n, f in enumerate(factors):
        names = [f"g{n}_{r}" for r in range(rank)]
        rows = from_dense(spark, f).select(
            F.col("i").cast("bigint").alias(f"i{n}"),
            *[F.col(c).alias(g) for c, g in zip(factor_columns(rank), names)],
        )
        df = df.join(F.broadcast(rows), f"i{n}")
        terms = [t * F.col(g) for t, g in zip(terms, names)]
    value = reduce(lambda a, b: a + b, terms)
    if noise:
        norm_sq = dense.model_norm_sq([dense.gram(f) for f in factors], lam)
        value = value + noise * float(np.sqrt(norm_sq / total)) * _normal(F.col("id"), seed)
    idx = [f"i{n}" for n in range(len(mode_sizes))]
    return SparseTensor.from_frame(df.select(*idx, value.alias("val")), mode_sizes, distinct=True)
