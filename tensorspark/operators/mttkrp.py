"""MTTKRP: ``Yhat[i, r] = sum over nonzeros with i_n = i of val * prod_{w != n} F_w[i_w, r]``.

In relational terms: N-1 many-to-one joins of the nonzeros with factor tables, a product,
and a GROUP BY sum.  The strategies differ only in how factor rows reach the nonzeros:

``long``     one output cell per (row, component); plain SQL, for cross-checks
``wide``     factor tables joined on the JVM, all R sums in one aggregate
``arrow``    factors broadcast as arrays, chunk arithmetic in NumPy; the default
``shuffle``  ``wide`` by sort-merge join, hot index values salted
``compact``  ``arrow`` on numbers of the rows that occur; for modes declared far larger
             than what they hold (see :mod:`tensorspark.operators.compact`)
``blocked``  tensor stays where it is, needed factor rows travel to it; for factors
             too large to broadcast (see :mod:`tensorspark.operators.blocked`)

All return touched rows only: ``[i, y0 .. y{R-1}]``; an absent row is an exact zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tensorspark.functions.chunks import (
    chunk_schema,
    pack_chunks,
    unpack,
)
from tensorspark.functions.factors import (
    factor_bytes,
    factor_columns,
    from_dense,
    to_dense,
    to_long,
)
from tensorspark.functions.products import PIECES, TaskSums, add_pieces, rows_schema
from tensorspark.plans.strategy import BROADCAST_BYTES, CHUNK_NNZ, choose_by_shape, choose_strategy
from tensorspark.session import parallelism
from tensorspark.tensor import SparseTensor, index_columns

Factor = DataFrame | np.ndarray


class Stored(Protocol):
    """Any layout of a tensor as chunk rows."""

    df: DataFrame
    mode_sizes: tuple[int, ...]

    def partials(self, shared: Broadcast, modes: Sequence[int], rank: int) -> DataFrame:
        """Each task's sums as pieces."""



# ---- packed tensors ----------------------------------------------------------


@dataclass(frozen=True)
class PackedTensor:
    """A tensor as chunk rows (see :mod:`tensorspark.functions.chunks`)."""

    df: DataFrame
    mode_sizes: tuple[int, ...]

    @classmethod
    def of(cls, tensor: SparseTensor, chunk_nnz: int = CHUNK_NNZ) -> PackedTensor:
        """Packs in place: no shuffle, one chunk of memory per task."""
        return cls.pack(tensor.df, tensor.mode_sizes, chunk_nnz)

    @classmethod
    def pack(
        cls, nonzeros: DataFrame, mode_sizes: Sequence[int], chunk_nnz: int = CHUNK_NNZ
    ) -> PackedTensor:
        """The same for rows whose numbers aren't known, such as a batch of a stream."""
        num_modes = len(mode_sizes)
        df = nonzeros.select(*index_columns(num_modes), "val").mapInArrow(
            pack_chunks(num_modes, chunk_nnz), chunk_schema(num_modes)
        )
        return cls(df, tuple(mode_sizes))

    @classmethod
    def spread(cls, tensor: SparseTensor) -> PackedTensor:
        """For repeated use: chunks dealt evenly over at least the session's parallelism.

        Only a tensor read from few splits pays for the exchange.
        """
        tasks = tensor.spark.sparkContext.defaultParallelism
        chunk_nnz = min(CHUNK_NNZ, max(1024, -(-tensor.nnz // (2 * tasks))))
        packed = cls.of(tensor, chunk_nnz)
        small = tensor.nnz <= CHUNK_NNZ * tasks * 4
        if small or packed.df.rdd.getNumPartitions() < tasks:
            return cls(packed.df.repartition(tasks), packed.mode_sizes)
        return packed

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PackedTensor:
        self.df.persist(level)
        return self

    def unpersist(self) -> None:
        self.df.unpersist()

    def partials(self, shared: Broadcast, modes: Sequence[int], rank: int) -> DataFrame:
        return arrow_partials(self, shared, modes, rank)

    def unpacked(self) -> DataFrame:
        """Back to nonzero rows."""
        num_modes = len(self.mode_sizes)
        names = [f"i{n}" for n in range(num_modes)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    idx, val = unpack(batch, row, num_modes)
                    arrays = [pa.array(a.astype(np.int64)) for a in idx] + [pa.array(val)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*names, "val"])

        schema = ", ".join([*[f"{c} bigint" for c in names], "val double"])
        return self.df.mapInArrow(run, schema)


# ---- JVM strategies ----------------------------------------------------------


def factor_frame(tensor: SparseTensor, factor: Factor) -> DataFrame:
    return factor if isinstance(factor, DataFrame) else from_dense(tensor.spark, factor)


def fits_broadcast(tensor: SparseTensor, w: int, rank: int, others: int) -> bool:
    return factor_bytes(tensor.mode_sizes[w], rank) <= BROADCAST_BYTES // max(1, others)


def mttkrp_long(tensor: SparseTensor, factors: Sequence[Factor], n: int, rank: int) -> DataFrame:
    """Long form ``[i, r, y]``: factor tables ``[i, r, v]``, one row per cell throughout."""
    others = [w for w in range(tensor.num_modes) if w != n]
    df = tensor.df
    product = F.col("val")
    for k, w in enumerate(others):
        f = to_long(factor_frame(tensor, factors[w]), rank).select(
            F.col("i").cast(df.schema[f"i{w}"].dataType).alias(f"i{w}"),
            F.col("r") if k == 0 else F.col("r").alias("r_join"),
            F.col("v").alias(f"v{w}"),
        )
        # A row of the long form takes about five times the eight bytes of its value.
        if fits_broadcast(tensor, w, rank, 5 * len(others)):
            f = F.broadcast(f)
        if k == 0:
            df = df.join(f, f"i{w}")
        else:
            on = (df[f"i{w}"] == f[f"i{w}"]) & (df["r"] == f["r_join"])
            df = df.join(f, on).drop(f[f"i{w}"], f["r_join"])
        product = product * F.col(f"v{w}")
    return df.groupBy(F.col(f"i{n}").cast("bigint").alias("i"), "r").agg(
        F.sum(product).alias("y")
    )


def _sum_products(df: DataFrame, n: int, products: list) -> DataFrame:
    return df.groupBy(F.col(f"i{n}").cast("bigint").alias("i")).agg(
        *[F.sum(p).alias(c) for p, c in zip(products, factor_columns(len(products), "y"))]
    )


def mttkrp_wide(tensor: SparseTensor, factors: Sequence[Factor], n: int, rank: int) -> DataFrame:
    """Broadcast hash joins and one partial/final aggregate, all in generated code.

    Falls through to the blocked form when a factor is too large to broadcast.
    """
    others = [w for w in range(tensor.num_modes) if w != n]
    if not all(fits_broadcast(tensor, w, rank, len(others)) for w in others):
        return mttkrp(tensor, factors, n, rank, "blocked")
    df = tensor.df
    products = [F.col("val")] * rank
    for w in others:
        names = [f"g{w}_{r}" for r in range(rank)]
        f = factor_frame(tensor, factors[w]).select(
            F.col("i").cast(df.schema[f"i{w}"].dataType).alias(f"i{w}"),
            *[F.col(c).alias(g) for c, g in zip(factor_columns(rank), names)],
        )
        df = df.join(F.broadcast(f), f"i{w}")
        products = [p * F.col(g) for p, g in zip(products, names)]
    return _sum_products(df, n, products)


def hot_indices(
    tensor: SparseTensor, modes: Sequence[int], shares: int
) -> dict[int, dict[int, int]]:
    """Per mode, the index values that hold more than ``1/shares`` of all nonzeros.

    With each comes its number of such shares, rounded up.  One pass for all modes.  At most
    ``shares`` values per mode can qualify, and their numbers add up to at most twice that,
    so what is collected is bounded whatever the data.
    """
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(w).alias("w"), F.col(f"i{w}").cast("bigint").alias("i")) for w in modes]
        )
    ).alias("p")
    rows = (
        tensor.df.select(pairs)
        .groupBy("p.w", "p.i")
        .count()
        .where(F.col("count") > tensor.nnz / shares)
        .collect()
    )
    each = tensor.nnz / shares
    return {w: {r["i"]: -int(-r["count"] // each) for r in rows if r["w"] == w} for w in modes}


def salted_join(
    df: DataFrame, factor: DataFrame, w: int, rank: int, hot: dict[int, int], how: str = "inner"
) -> DataFrame:
    """Sort-merge join of nonzeros with factor ``w``, whose columns become ``g0 ..``.

    ``df`` carries a hash ``h`` of the (distinct) coordinates.  Rows with a hot index are
    spread over salts by that hash, as many as its share asks for, and the factor row is
    replicated once per salt.
    """
    f = factor.select(
        F.col("i").cast(df.schema[f"i{w}"].dataType).alias(f"i{w}"),
        *[F.col(c).alias(f"g{r}") for r, c in enumerate(factor_columns(rank))],
    )
    if not hot:
        return df.join(f.hint("merge"), f"i{w}", how)
    spread = df.sparkSession.createDataFrame(list(hot.items()), f"i{w} bigint, salts int")
    spread = F.broadcast(spread.withColumn(f"i{w}", F.col(f"i{w}").cast(df.schema[f"i{w}"].dataType)))
    salts = F.coalesce("salts", F.lit(1))
    f = f.join(spread, f"i{w}", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    salted = df.join(spread, f"i{w}", "left").withColumn("salt", F.pmod("h", salts).cast("int"))
    joined = salted.drop("salts").join(f.drop("salts").hint("merge"), [f"i{w}", "salt"], how)
    return joined.drop("salt")


def mttkrp_shuffle(
    tensor: SparseTensor,
    factors: Sequence[Factor],
    n: int,
    rank: int,
    hot_shares: int | None = None,
) -> DataFrame:
    """Sort-merge joins with hot index values spread over salts.

    Repeated coordinates are merged first, so hashing the coordinates spreads any hot
    value.  After each join a row carries only the running products.
    """
    others = [w for w in range(tensor.num_modes) if w != n]
    hot = hot_indices(tensor, others, hot_shares or 2 * parallelism(tensor.spark))
    df = tensor.merged_frame().withColumn("h", F.xxhash64(*tensor.index_columns))
    products = ["val"] * rank
    for w in others:
        df = salted_join(df, factor_frame(tensor, factors[w]), w, rank, hot[w])
        ahead = [f"i{m}" for m in range(tensor.num_modes) if m == n or m > w]
        df = df.select(
            *ahead, "h", *[(F.col(p) * F.col(f"g{r}")).alias(f"p{r}") for r, p in enumerate(products)]
        )
        products = [f"p{r}" for r in range(rank)]
    return _sum_products(df, n, [F.col(p) for p in products])


# ---- Arrow strategies --------------------------------------------------------


def _dense_factors(
    tensor_sizes: Sequence[int], factors: Sequence[Factor], rank: int, needed: Sequence[int]
) -> list[np.ndarray | None]:
    total = sum(factor_bytes(tensor_sizes[w], rank) for w in needed)
    if total > BROADCAST_BYTES:
        raise ValueError(
            f"factors take {total} bytes, above the broadcast limit of {BROADCAST_BYTES}; "
            "use the 'blocked' or 'shuffle' strategy"
        )
    return [
        None
        if w not in needed
        else (f if isinstance(f, np.ndarray) else to_dense(f, tensor_sizes[w], rank))
        for w, f in enumerate(factors)
    ]


def share_factors(
    packed: Stored, factors: Sequence[Factor], modes: Sequence[int], rank: int
) -> Broadcast:
    """Broadcast the factors the given target modes read, by component, after a check."""
    sizes = packed.mode_sizes
    needed = [w for w in range(len(sizes)) if len(modes) > 1 or w != modes[0]]
    dense = _dense_factors(sizes, factors, rank, needed)
    tables = [None if f is None else np.ascontiguousarray(f.T) for f in dense]
    return packed.df.sparkSession.sparkContext.broadcast(tables)


def arrow_partials(
    packed: PackedTensor, shared: Broadcast, modes: Sequence[int], rank: int
) -> DataFrame:
    """Each task's sums for one mode or for several: pieces ``[mode, piece, i, y]``."""
    sizes = packed.mode_sizes
    num_modes = len(sizes)
    modes = list(modes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        out = TaskSums(sizes, rank, modes)
        for batch in batches:
            for row in range(batch.num_rows):
                yield from out.add(*unpack(batch, row, num_modes), tables)
        yield from out.finish()

    return packed.df.mapInArrow(run, PIECES)


def final_sums(partials: DataFrame, rank: int) -> DataFrame:
    """Rows ``[mode, i, y0 ..]``: pieces meet as buffers, so only final rows become rows."""
    dealt = partials.repartition("mode", "piece").sortWithinPartitions("mode", "piece")
    return dealt.mapInArrow(partial(add_pieces, rank=rank), rows_schema(rank))


def mttkrp_arrow(
    tensor: SparseTensor | PackedTensor, factors: Sequence[Factor], n: int, rank: int
) -> DataFrame:
    packed = tensor if isinstance(tensor, PackedTensor) else PackedTensor.of(tensor)
    shared = share_factors(packed, factors, [n], rank)
    return final_sums(arrow_partials(packed, shared, [n], rank), rank).drop("mode")


def mttkrp_all_arrow(
    tensor: SparseTensor | PackedTensor, factors: Sequence[Factor], rank: int
) -> DataFrame:
    """Every mode from one pass over the tensor: ``[mode, i, y0 ..]``."""
    packed = tensor if isinstance(tensor, PackedTensor) else PackedTensor.of(tensor)
    modes = range(len(packed.mode_sizes))
    shared = share_factors(packed, factors, modes, rank)
    return final_sums(arrow_partials(packed, shared, modes, rank), rank)


# ---- entry points ------------------------------------------------------------


def _choose(tensor: SparseTensor, rank: int, n: int | None) -> str:
    """By declared sizes where those are small, else by the rows that occur."""
    from tensorspark.operators.compact import measure

    name = choose_strategy(tensor.mode_sizes, rank, n).name
    return name if name == "arrow" else choose_by_shape(measure(tensor), rank, n).name


def mttkrp(
    tensor: SparseTensor,
    factors: Sequence[Factor],
    n: int,
    rank: int,
    strategy: str = "auto",
) -> DataFrame:
    """Mode-``n`` MTTKRP as ``[i, y0 .. y{R-1}]``."""
    from tensorspark.operators.blocked import BlockedTensor, mttkrp_blocked
    from tensorspark.operators.compact import CompactTensor

    _check(tensor, factors, rank)
    if not 0 <= n < tensor.num_modes:
        raise ValueError(f"mode {n} outside 0..{tensor.num_modes - 1}")
    if strategy == "auto":
        strategy = _choose(tensor, rank, n)
    if strategy == "wide":
        return mttkrp_wide(tensor, factors, n, rank)
    if strategy == "arrow":
        return mttkrp_arrow(tensor, factors, n, rank)
    if strategy == "shuffle":
        return mttkrp_shuffle(tensor, factors, n, rank)
    if strategy == "compact":
        return CompactTensor.build(tensor).mttkrp(factors, n, rank)
    if strategy == "blocked":
        frames = [factor_frame(tensor, f) for f in factors]
        return mttkrp_blocked(BlockedTensor.build(tensor, rank), frames, n, rank)
    if strategy == "long":
        wide = mttkrp_long(tensor, factors, n, rank).groupBy("i")
        return wide.agg(
            *[
                F.sum(F.when(F.col("r") == r, F.col("y"))).alias(c)
                for r, c in enumerate(factor_columns(rank, "y"))
            ]
        )
    raise ValueError(f"unknown strategy {strategy!r}")


def mttkrp_all(
    tensor: SparseTensor, factors: Sequence[Factor], rank: int, strategy: str = "auto"
) -> DataFrame:
    """MTTKRP of every mode from one pass: ``[mode, i, y0 .. y{R-1}]``."""
    from tensorspark.operators.blocked import BlockedTensor, mttkrp_all_blocked
    from tensorspark.operators.compact import CompactTensor

    _check(tensor, factors, rank)
    if strategy == "auto":
        strategy = _choose(tensor, rank, None)
    if strategy == "arrow":
        return mttkrp_all_arrow(tensor, factors, rank)
    if strategy == "compact":
        return CompactTensor.build(tensor).mttkrp_all(factors, rank)
    if strategy == "blocked":
        frames = [factor_frame(tensor, f) for f in factors]
        return mttkrp_all_blocked(BlockedTensor.build(tensor, rank), frames, rank)
    raise ValueError(f"no all-modes form of strategy {strategy!r}")


def _check(tensor: SparseTensor, factors: Sequence[Factor], rank: int) -> None:
    if rank < 1:
        raise ValueError("rank must be at least 1")
    if tensor.num_modes < 2:
        raise ValueError("MTTKRP needs at least two modes")
    if len(factors) != tensor.num_modes:
        raise ValueError(f"{tensor.num_modes} factors expected, got {len(factors)}")
