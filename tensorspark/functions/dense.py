"""Algebra on R x R matrices and on row blocks of factors, in float64.

Products over many rows use ``einsum`` rather than BLAS: tasks already keep every core
busy, and a threaded BLAS inside them only oversubscribes the machine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# A column with a smaller L2 norm is treated as empty and set to zero (fixed value).
TINY_NORM = 1e-20


def gram(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ir,is->rs", rows, rows)


def hadamard(matrices: Sequence[np.ndarray], rank: int) -> np.ndarray:
    """Elementwise product; the empty product is all ones, not the identity."""
    out = np.ones((rank, rank))
    for m in matrices:
        out *= m
    return out


def sum_diag_product(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("ii,ii->", a, b))


def frob_norm_sq(rows: np.ndarray) -> float:
    return float(np.einsum("ir,ir->", rows, rows))


def cholesky_lower(v: np.ndarray, ridge: float) -> np.ndarray:
    """Lower factor of ``v + ridge * max(diag v) * I``.

    A matrix that is not positive definite does not fail: a non-positive pivot becomes
    zero together with its column, and :func:`right_solve` leaves that component zero.
    """
    rest = v + max(ridge * v.diagonal().max(initial=0.0), 0.0) * np.eye(len(v))
    lower = np.zeros_like(rest)
    for j in range(len(v)):
        pivot = rest[j, j]
        if pivot > 0:
            lower[j:, j] = rest[j:, j] / np.sqrt(pivot)
            rest -= np.multiply.outer(lower[:, j], lower[:, j])
    return lower


def _lower_inverse(lower: np.ndarray) -> np.ndarray:
    out = np.zeros_like(lower)
    for r in range(len(lower)):
        out[r] = -np.einsum("k,kc->c", lower[r, :r], out[:r])
        out[r, r] += 1.0
        out[r] /= lower[r, r]
    return out


def right_solve(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row-wise ``rows @ inv(L Lt)``; components with a zero pivot come out zero."""
    live = np.flatnonzero(lower.diagonal() > 0)
    out = np.zeros_like(rows)
    if len(live):
        inverse = _lower_inverse(lower[np.ix_(live, live)])
        half = np.einsum("ir,sr->is", rows[:, live], inverse)
        out[:, live] = np.einsum("is,sr->ir", half, inverse)
    return out


def col_norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ir,ir->r", rows, rows))


def inverse_norms(norms: np.ndarray) -> np.ndarray:
    """Reciprocals, zero for an empty column."""
    live = norms > TINY_NORM
    return np.where(live, 1.0 / np.where(live, norms, 1.0), 0.0)


def col_scale_inv(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return rows * inverse_norms(norms)


def weighted_col_dot(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    return float(np.einsum("ir,ir,r->", a, b, weights))


def model_norm_sq(grams: Sequence[np.ndarray], lam: np.ndarray) -> float:
    """``|| [[lambda; Y]] ||^2`` from the Gram matrices alone."""
    return max(0.0, float(np.einsum("r,rs,s->", lam, hadamard(grams, len(lam)), lam)))


def residual_and_fit(norm_sq: float, inner: float, model_sq: float) -> tuple[float, float]:
    residual = float(np.sqrt(max(0.0, norm_sq - 2.0 * inner + model_sq)))
    return residual, 1.0 - residual / max(float(np.sqrt(norm_sq)), 1e-30)
