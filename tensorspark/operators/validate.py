"""Checks of factors and fits against the tensor itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorspark.functions import dense
from tensorspark.functions.factors import factor_columns
from tensorspark.operators import linalg
from tensorspark.operators.mttkrp import (
    Factor,
    factor_frame,
    fits_broadcast,
    hot_indices,
    mttkrp,
    salted_join,
)
from tensorspark.session import parallelism
from tensorspark.tensor import SparseTensor


def check_shapes(got: Sequence[int], want: Sequence[int]) -> None:
    """Fails where two sets of factors differ in their numbers of rows."""
    if list(got) != list(want):
        raise ValueError(f"factors have {list(got)} rows, expected {list(want)}")


def compare_factors(got: DataFrame, want: DataFrame, rank: int, prefix: str = "y") -> DataFrame:
    """Frobenius-relative, largest absolute and largest relative difference.

    Rows present on one side only count as zeros on the other.  Against an all-zero
    reference the relative numbers are the absolute ones.
    """
    names = factor_columns(rank, prefix)
    left = got.select("i", *[F.col(c).alias(f"a{r}") for r, c in enumerate(names)])
    right = want.select("i", *[F.col(c).alias(f"b{r}") for r, c in enumerate(names)])
    both = left.join(right, "i", "full_outer").na.fill(0.0)
    diffs = [F.abs(F.col(f"a{r}") - F.col(f"b{r}")) for r in range(rank)]
    wants = [F.abs(F.col(f"b{r}")) for r in range(rank)]
    sums = both.agg(
        F.sum(reduce(lambda x, y: x + y, [d * d for d in diffs])).alias("diff_sq"),
        F.sum(reduce(lambda x, y: x + y, [w * w for w in wants])).alias("want_sq"),
        *[F.max(d).alias(f"d{r}") for r, d in enumerate(diffs)],
        *[
            F.max(F.when(w > 0, d / w).otherwise(d)).alias(f"q{r}")
            for r, (d, w) in enumerate(zip(diffs, wants))
        ],
    )

    def largest(name: str):
        columns = [F.col(f"{name}{r}") for r in range(rank)]
        return columns[0] if rank == 1 else F.greatest(*columns)

    norm = F.when(F.col("want_sq") > 0, F.sqrt("want_sq")).otherwise(1.0)
    return sums.select(
        (F.sqrt("diff_sq") / norm).alias("frob_rel"),
        largest("d").alias("max_abs"),
        largest("q").alias("max_rel"),
    )


def model_at_nonzeros(
    tensor: SparseTensor, factors: Sequence[Factor], lam: Sequence[float]
) -> DataFrame:
    """Value and model value per coordinate: ``[i0 .., val, model]``.

    Repeated coordinates are summed.  Factors are broadcast while small and otherwise
    joined by shuffle with hot indices salted; a row absent from a factor is zero.
    """
    rank, modes = len(lam), range(tensor.num_modes)
    large = [w for w in modes if not fits_broadcast(tensor, w, rank, tensor.num_modes)]
    hot = hot_indices(tensor, large, 2 * parallelism(tensor.spark)) if large else {}
    df = tensor.merged_frame().withColumn("h", F.xxhash64(*tensor.index_columns))
    terms = [F.lit(float(v)) for v in lam]
    for w in modes:
        f = factor_frame(tensor, factors[w])
        if w in hot:
            df = salted_join(df, f, w, rank, hot[w], "left")
        else:
            rows = f.select(
                F.col("i").cast(df.schema[f"i{w}"].dataType).alias(f"i{w}"),
                *[F.col(c).alias(f"g{r}") for r, c in enumerate(factor_columns(rank))],
            )
            df = df.join(F.broadcast(rows), f"i{w}", "left")
        grown = [
            (t * F.coalesce(F.col(f"g{r}"), F.lit(0.0))).alias(f"p{r}")
            for r, t in enumerate(terms)
        ]
        df = df.select(*tensor.index_columns, "val", "h", *grown)
        terms = [F.col(f"p{r}") for r in range(rank)]
    return df.select(
        *tensor.index_columns, "val", reduce(lambda x, y: x + y, terms).alias("model")
    )


def exact_residual(
    tensor: SparseTensor, factors: Sequence[Factor], lam: Sequence[float]
) -> DataFrame:
    """``[norm_sq, inner, model_sq, resid_sq]`` in float64, without forming the model.

    ``inner`` is the weighted dot of one factor with its MTTKRP, which holds for any
    factors; ``model_sq`` needs only the Gram matrices.
    """
    rank = len(lam)
    frames = [factor_frame(tensor, f) for f in factors]
    grams = [linalg.gram(f, rank) for f in frames]
    model_sq = dense.model_norm_sq(grams, np.asarray(lam, dtype=np.float64))
    names = dict(zip(factor_columns(rank, "y"), factor_columns(rank)))
    yhat = mttkrp(tensor, factors, 0, rank).withColumnsRenamed(names)
    inner = F.coalesce(F.col("inner"), F.lit(0.0))
    return linalg.weighted_col_dot(frames[0], yhat, lam, rank).select(
        F.lit(tensor.norm_sq).alias("norm_sq"),
        inner.alias("inner"),
        F.lit(model_sq).alias("model_sq"),
        (F.lit(tensor.norm_sq) - 2 * inner + F.lit(model_sq)).alias("resid_sq"),
    )


def true_fit(tensor: SparseTensor, factors: Sequence[Factor], lam: Sequence[float]) -> float:
    row = exact_residual(tensor, factors, lam).first()
    return dense.residual_and_fit(row["norm_sq"], row["inner"], row["model_sq"])[1]


def fits_agree(fit: float, reference: float) -> bool:
    """Fixed tolerances: 1e-3 absolute, or one percent of the reference fit."""
    change = abs(fit - reference)
    return change < 1e-3 or change < 0.01 * max(abs(reference), 1e-6)


def factor_similarity(truth: Sequence[DataFrame], found: Sequence[DataFrame], rank: int) -> float:
    """Mean absolute cosine of matched columns; 1.0 means equal up to order, sign, scale.

    Columns are matched on the first mode: each true column takes the most similar
    column still free.
    """
    cosines = [_cosines(a, b, rank) for a, b in zip(truth, found, strict=True)]
    match: list[int] = []
    for r in range(rank):
        ranked = np.argsort(-np.abs(cosines[0][r]), kind="stable")
        match.append(next(int(j) for j in ranked if j not in match))
    return float(np.mean([np.abs(c[np.arange(rank), match]).mean() for c in cosines]))


def _cosines(a: DataFrame, b: DataFrame, rank: int) -> np.ndarray:
    """Cosine of every column of ``a`` with every column of ``b``."""
    left, right = factor_columns(rank), factor_columns(rank, "b")
    both = (
        a.select("i", *left)
        .join(b.select("i", *[F.col(c).alias(d) for c, d in zip(left, right)]), "i", "full_outer")
        .na.fill(0.0)
    )
    sums = linalg.products(
        both, {"aa": (left, left), "bb": (right, right), "ab": (left, right)}
    )
    norms = np.outer(np.sqrt(sums["aa"].diagonal()), np.sqrt(sums["bb"].diagonal()))
    return sums["ab"] / np.maximum(norms, 1e-30)
