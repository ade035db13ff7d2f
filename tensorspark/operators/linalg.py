"""Factor algebra over DataFrames ``[i, f0 ..]``: one aggregation each, R x R results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorspark.functions import dense
from tensorspark.functions.factors import factor_batch, factor_columns, matrix_of


def product_frame(
    df: DataFrame,
    pairs: dict[str, tuple[Sequence[str], Sequence[str]]],
    by: str | None = None,
) -> DataFrame:
    """Products ``A^T B`` of column groups as ``[by, k, r, s, v]``, in one pass.

    ``k`` numbers the pairs.  ``by`` names an integer column of few values; each gets
    products of its own rows.  Every task sums its rows into R x R matrices and Spark adds
    those up.
    """
    used = sorted({c for a, b in pairs.values() for c in (*a, *b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            group = batch.column("by").to_numpy()
            for value in np.unique(group).tolist():
                own = batch.filter(pa.array(group == value))
                for k, (a, b) in enumerate(pairs.values()):
                    found = np.einsum("ir,is->rs", matrix_of(own, a), matrix_of(own, b))
                    total[value, k] = total.get((value, k), 0) + found
        for (value, k), m in total.items():
            r, s = np.indices(m.shape)
            head = [np.full(m.size, x, np.int32) for x in (value, k)]
            cells = [r.ravel().astype(np.int32), s.ravel().astype(np.int32), m.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*head, *cells)], names=["by", "k", "r", "s", "v"]
            )

    group = (F.col(by) if by else F.lit(0)).cast("int").alias("by")
    return (
        df.select(group, *used)
        .mapInArrow(run, "by int, k int, r int, s int, v double")
        .groupBy("by", "k", "r", "s")
        .agg(F.sum("v").alias("v"))
    )


def products(
    df: DataFrame, pairs: dict[str, tuple[Sequence[str], Sequence[str]]]
) -> dict[str, np.ndarray]:
    """The products as arrays: R*R numbers each reach the driver, however many tasks ran."""
    rows = product_frame(df, pairs).toArrow()
    out = {k: np.zeros((len(a), len(b))) for k, (a, b) in pairs.items()}
    k, r, s, v = (rows.column(c).to_numpy() for c in ("k", "r", "s", "v"))
    for at, name in enumerate(pairs):
        pick = k == at
        out[name][r[pick], s[pick]] = v[pick]
    return out


def gram(factor: DataFrame, rank: int) -> np.ndarray:
    columns = factor_columns(rank)
    return products(factor, {"g": (columns, columns)})["g"]


def gram_frame(factor: DataFrame, rank: int, by: str | None = None) -> DataFrame:
    """Gram matrix as ``[r, s, g]``, or one for each value of ``by`` as ``[by, r, s, g]``."""
    columns = factor_columns(rank)
    rows = product_frame(factor, {"g": (columns, columns)}, by)
    head = [F.col("by").alias(by)] if by else []
    return rows.select(*head, "r", "s", F.col("v").alias("g"))


def hadamard_by_mode(grams: DataFrame, modes: Sequence[int]) -> DataFrame:
    """Elementwise product of the Gram matrices ``[mode, r, s, g]`` of the given modes."""
    chosen = grams.where(F.col("mode").isin(list(modes)))
    return chosen.groupBy("r", "s").agg(F.product("g").alias("g"))


def model_norm_sq_frame(product: DataFrame, lam: DataFrame) -> DataFrame:
    """``sum_rs lambda_r lambda_s G[r, s]`` of a product of Gram matrices, R*R rows."""
    left = lam.select("r", F.col("lambda").alias("lr"))
    right = lam.select(F.col("r").alias("s"), F.col("lambda").alias("ls"))
    return (
        product.join(F.broadcast(left), "r")
        .join(F.broadcast(right), "s")
        .agg(F.greatest(F.lit(0.0), F.sum(F.col("lr") * F.col("ls") * F.col("g"))).alias("model_sq"))
    )


def col_norms_frame(factor: DataFrame, rank: int) -> DataFrame:
    """L2 norm of every column as ``[r, norm]``."""
    sums = factor.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in factor_columns(rank)])
    return sums.selectExpr(f"stack({rank}, {_stacked(rank)}) AS (r, norm)")


def frob_norm_sq(factor: DataFrame, rank: int) -> DataFrame:
    squares = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in factor_columns(rank)])
    return factor.agg(F.sum(squares).alias("norm_sq"))


def col_scale_inv(factor: DataFrame, norms: DataFrame, rank: int) -> DataFrame:
    """Divide columns by their norms ``[r, norm]``; an empty column becomes zero."""
    by_r = {row["r"]: row["norm"] for row in norms.collect()}

    def scaled(r: int, c: str) -> Column:
        empty = (by_r.get(r) or 0.0) <= dense.TINY_NORM
        return (F.lit(0.0) if empty else F.col(c) / F.lit(float(by_r[r]))).alias(c)

    return factor.select("i", *[scaled(r, c) for r, c in enumerate(factor_columns(rank))])


def weighted_col_dot(
    a: DataFrame, b: DataFrame, lam: Sequence[float], rank: int
) -> DataFrame:
    """``sum_r lambda_r <A_r, B_r>`` for factors sharing row ids."""
    right = b.select("i", *[F.col(c).alias(f"b{r}") for r, c in enumerate(factor_columns(rank))])
    dot = reduce(
        lambda x, y: x + y,
        [F.lit(float(lam[r])) * F.col(f"f{r}") * F.col(f"b{r}") for r in range(rank)],
    )
    return a.join(right, "i").agg(F.sum(dot).alias("inner"))


def right_solve(
    rows: DataFrame, lower: np.ndarray, source: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``B inv(L Lt)`` per batch of rows: ``[i, f0 ..]``, plus any kept columns."""
    rank = len(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = dense.right_solve(lower, matrix_of(batch, source))
            out = factor_batch(batch.column("i").to_numpy(), solved)
            for c in keep:
                out = out.append_column(c, batch.column(c))
            yield out

    schema = ", ".join(
        ["i bigint", *[f"{c} double" for c in (*factor_columns(rank), *keep)]]
    )
    return rows.select("i", *source).mapInArrow(run, schema)


def tensor_norm_sq(nonzeros: DataFrame) -> DataFrame:
    return nonzeros.agg(F.sum(F.col("val") * F.col("val")).alias("norm_sq"))


def _stacked(rank: int) -> str:
    return ", ".join(f"{r}, {c}" for r, c in enumerate(factor_columns(rank)))
