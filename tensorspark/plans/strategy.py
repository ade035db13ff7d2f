"""Which MTTKRP strategy, passes and storage level a given tensor and rank call for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.storagelevel import StorageLevel

from tensorspark.functions.factors import factor_bytes

# All factor rows one task needs, as float64.  Every Python worker of an executor maps
# its own copy, so this stays well below executor memory divided by cores.
BROADCAST_BYTES = 256 << 20
# Factor rows that are collected and sent whole where another way is open: what passes the
# driver for one output, and what each Python worker holds besides its sums.
COLLECT_BYTES = 64 << 20
# Factors and MTTKRP outputs the ALS driver may hold at once.
DRIVER_FACTOR_BYTES = 256 << 20
# Sums that a task keeps until its end (see functions.products).
SUM_BYTES = 64 << 20

# Nanoseconds of one core, measured on 10 M nonzeros: a nonzero read by a task; a gather, a
# multiplication and a sum of one component of a nonzero; a byte of output sent on.
READ_NS, GATHER_NS, MULTIPLY_NS, ADD_NS, SEND_NS = 350.0, 1.7, 0.6, 2.6, 5.0
CHUNK_NNZ = 1 << 16


@dataclass(frozen=True)
class Strategy:
    name: str
    reason: str


@dataclass(frozen=True)
class Shape:
    """What was measured of a tensor: rows that occur, and the share of the hottest one."""

    mode_sizes: tuple[int, ...]
    nnz: int
    touched: tuple[int, ...]
    hot_share: tuple[float, ...]


def choose_strategy(mode_sizes: Sequence[int], rank: int, mode: int | None = None) -> Strategy:
    """Broadcast the factors while they are small; otherwise ship only needed rows."""
    need = sum(factor_bytes(s, rank) for w, s in enumerate(mode_sizes) if w != mode)
    if need <= BROADCAST_BYTES:
        return Strategy("arrow", f"factors take {need} bytes, within the broadcast limit")
    return Strategy("blocked", f"factors take {need} bytes, above the broadcast limit")


def choose_by_shape(shape: Shape, rank: int, mode: int | None = None) -> Strategy:
    """Like :func:`choose_strategy`, but only rows that occur count.

    ``compact`` numbers the rows that occur, so that a mode declared far larger than what it
    holds doesn't need the blocked layout.
    """
    declared = choose_strategy(shape.mode_sizes, rank, mode)
    if declared.name == "arrow":
        return declared
    need = sum(factor_bytes(s, rank) for w, s in enumerate(shape.touched) if w != mode)
    if need <= COLLECT_BYTES:
        return Strategy("compact", f"factor rows that occur take {need} bytes, within the limit")
    return Strategy("blocked", f"factor rows that occur take {need} bytes, above the limit")


def compact_modes(shape: Shape) -> list[int]:
    """Modes worth an index dictionary: fewer than half of their rows occur."""
    return [n for n, (s, t) in enumerate(zip(shape.mode_sizes, shape.touched)) if 2 * t < s]


def _sent_bytes(shape: Shape, rank: int, modes: Sequence[int], tasks: int) -> float:
    """Bytes of partial sums that tasks send on for the given modes of one pass."""
    budget, total = SUM_BYTES, 0.0
    for n in modes:
        rows = shape.touched[n]
        if factor_bytes(shape.mode_sizes[n], rank) <= budget:
            budget -= factor_bytes(shape.mode_sizes[n], rank)
            total += tasks * min(rows, shape.nnz / tasks) * rank * 8
        else:  # once for each chunk: its rows, where the hottest one counts once
            chunks = max(1, shape.nnz // CHUNK_NNZ)
            distinct = min(rows, CHUNK_NNZ * (1 - shape.hot_share[n]) + 1)
            total += chunks * distinct * rank * 8
    return total


def pass_cost(shape: Shape, rank: int, modes: Sequence[int], tasks: int) -> float:
    """Seconds of one core for one pass that gives the outputs of ``modes``."""
    n = len(shape.mode_sizes)
    if len(modes) == 1:
        gathers, products = n - 1, n - 1
    else:
        gathers, products = n, 3 * n - 4
    each = gathers * GATHER_NS + products * MULTIPLY_NS + len(modes) * ADD_NS
    work = shape.nnz * (READ_NS + rank * each)
    return (work + SEND_NS * _sent_bytes(shape, rank, modes, tasks)) * 1e-9


def choose_passes(shape: Shape, rank: int, tasks: int) -> list[list[int]]:
    """Modes of each pass of a sweep: all at once, or one after the other.

    One pass reads the tensor once and shares products; but where the outputs of all modes
    don't fit a task together, each chunk sends its sums on, and passes of one mode may be
    cheaper.
    """
    every = list(range(len(shape.mode_sizes)))
    apart = sum(pass_cost(shape, rank, [n], tasks) for n in every)
    return [every] if pass_cost(shape, rank, every, tasks) <= apart else [[n] for n in every]


def factors_fit_driver(mode_sizes: Sequence[int], rank: int) -> bool:
    """Whether ALS may keep factors as arrays: inputs plus outputs within the limit."""
    total = 2 * sum(factor_bytes(s, rank) for s in mode_sizes)
    return total <= DRIVER_FACTOR_BYTES


def storage_level(layout: str = "auto") -> StorageLevel:
    """``ooc`` keeps the working tensor on disk only; anything else may use memory."""
    return StorageLevel.DISK_ONLY if layout == "ooc" else StorageLevel.MEMORY_AND_DISK
