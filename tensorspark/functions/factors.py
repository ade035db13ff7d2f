"""Factor matrices as DataFrames ``[i, f0 .. f{R-1}]`` and as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per random block.  A block draws from its own seeded stream, so a factor has the
# same entries however many tasks generate it.
RANDOM_BLOCK_ROWS = 4096


def factor_columns(rank: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{r}" for r in range(rank)]


def factor_schema(rank: int, prefix: str = "f") -> str:
    return ", ".join(["i bigint", *[f"{c} double" for c in factor_columns(rank, prefix)]])


def factor_bytes(rows: int, rank: int) -> int:
    return rows * (rank + 1) * 8


# ---- deterministic integer factors (exact sums in any order) -----------------


def integer_entry(i: Column, mode: int, r: int) -> Column:
    """Small integers in ``[-5, 5]``; every sum over them is exact in a double."""
    return ((i * (7 + 2 * mode) + (r + 1) * (13 + mode)) % 11 - 5).cast("double")


def integer_factor(spark: SparkSession, rows: int, mode: int, rank: int) -> DataFrame:
    i = F.col("id")
    cols = [integer_entry(i, mode, r).alias(c) for r, c in enumerate(factor_columns(rank))]
    return spark.range(rows).select(i.alias("i"), *cols)


def integer_factors(spark: SparkSession, sizes: Sequence[int], rank: int) -> list[DataFrame]:
    return [integer_factor(spark, s, n, rank) for n, s in enumerate(sizes)]


def integer_factor_array(rows: int, mode: int, rank: int) -> np.ndarray:
    i = np.arange(rows, dtype=np.int64)[:, None]
    r = np.arange(1, rank + 1, dtype=np.int64)[None, :]
    return ((i * (7 + 2 * mode) + r * (13 + mode)) % 11 - 5).astype(np.float64)


# ---- seeded random factors ---------------------------------------------------


def _random_block(seed: int, mode: int, block: int, rows: int, rank: int, dist: str) -> np.ndarray:
    rng = np.random.default_rng([seed, mode, block])
    if dist == "uniform":
        return rng.random((rows, rank))
    return rng.standard_normal((rows, rank))


def random_factor_array(
    rows: int, mode: int, rank: int, seed: int, dist: str = "normal"
) -> np.ndarray:
    """N(0,1) entries (ALS start) or U[0,1) entries (MTTKRP runs)."""
    out = np.empty((rows, rank))
    for block, lo in enumerate(range(0, rows, RANDOM_BLOCK_ROWS)):
        hi = min(rows, lo + RANDOM_BLOCK_ROWS)
        out[lo:hi] = _random_block(seed, mode, block, hi - lo, rank, dist)
    return out


def random_factor(
    spark: SparkSession, rows: int, mode: int, rank: int, seed: int, dist: str = "normal"
) -> DataFrame:
    """The same entries as :func:`random_factor_array`, generated on the executors."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                lo = block * RANDOM_BLOCK_ROWS
                n = min(rows - lo, RANDOM_BLOCK_ROWS)
                values = _random_block(seed, mode, block, n, rank, dist)
                yield factor_batch(np.arange(lo, lo + n, dtype=np.int64), values)

    blocks = -(-rows // RANDOM_BLOCK_ROWS)
    return spark.range(blocks).mapInArrow(generate, factor_schema(rank))


# ---- conversions -------------------------------------------------------------


def factor_batch(i: np.ndarray, values: np.ndarray, prefix: str = "f") -> pa.RecordBatch:
    """An Arrow batch ``[i, f0 ..]`` from row ids and a row-major matrix."""
    columns = np.ascontiguousarray(values.T)
    return pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int64, copy=False)), *[pa.array(c) for c in columns]],
        names=["i", *factor_columns(values.shape[1], prefix)],
    )


def matrix_of(table: pa.Table | pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Row-major matrix of the named double columns."""
    out = np.empty((table.num_rows, len(columns)))
    for k, c in enumerate(columns):
        out[:, k] = table.column(c)
    return out


def to_dense(df: DataFrame, rows: int, rank: int, prefix: str = "f") -> np.ndarray:
    """Collect a factor of a checked size; absent rows are exact zeros."""
    table = df.select("i", *factor_columns(rank, prefix)).toArrow()
    out = np.zeros((rows, rank))
    if table.num_rows:
        out[table.column("i").to_numpy()] = matrix_of(table, factor_columns(rank, prefix))
    return out


def from_dense(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """A driver-held (hence small) matrix as a factor DataFrame."""
    batch = factor_batch(np.arange(len(values)), np.asarray(values, dtype=np.float64))
    return spark.createDataFrame(pa.Table.from_batches([batch]))


def to_long(df: DataFrame, rank: int, prefix: str = "f") -> DataFrame:
    """``[i, f0 ..]`` to ``[i, r, v]``."""
    cells = ", ".join(f"{r}, {c}" for r, c in enumerate(factor_columns(rank, prefix)))
    return df.selectExpr("i", f"stack({rank}, {cells}) AS (r, v)")
