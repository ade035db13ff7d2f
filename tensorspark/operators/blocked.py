"""MTTKRP for factors too large to broadcast.

A join per factor would push every nonzero, widened by R doubles, through N-1 shuffles.
Here the tensor is laid out once and never moves again:

* nonzeros are ordered along a Z-order curve (of the leading index bits, where a key can't
  hold them all) and cut into cells of at most ``cell_nnz`` nonzeros, so that a cell touches
  few distinct rows of each factor;
* a demand table per mode lists the (cell, row) pairs that occur;
* each MTTKRP broadcasts the factors that fit, smallest first, joins demand with the others,
  sends their rows to the cells, and co-groups: only rows of large factors and per-cell
  partial sums are shuffled.

Cells are cut by count, so a hot index or a dense corner becomes more cells, not a
larger one.  A hot row appears in the demand table at most once per cell, and is dealt over
as many salts as its share of the demand asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorspark.functions.chunks import (
    chunk_schema,
    pack_chunks,
    partial_batch,
    partial_schema,
    unpack,
)
from tensorspark.functions.factors import factor_bytes, factor_columns, matrix_of, to_dense
from tensorspark.functions.morton import KEY_BITS, MortonPlan
from tensorspark.functions.products import add_products
from tensorspark.plans.strategy import COLLECT_BYTES
from tensorspark.session import materialize, materialize_partitioned, parallelism
from tensorspark.tensor import SparseTensor

# Memory one co-grouped cell may take: its nonzeros plus the factor rows it needs.
CELL_BYTES = 64 << 20
# A small tensor does not need as many partitions as the session would give it, and a large
# one gets more: a partition of the layout holds about this much packed data at most.
MIN_PART_NNZ = 1 << 16
PART_BYTES = 128 << 20


def default_cell_nnz(num_modes: int, rank: int) -> int:
    per_nnz = 4 * num_modes + 8 + num_modes * (rank + 2) * 8
    return max(1024, CELL_BYTES // per_nnz)


def layout_partitions(nnz: int, num_modes: int, cores: int, session: int) -> int:
    """Partitions of the layout: by size, and for small tensors by the session's width."""
    by_size = -(-nnz * (4 * num_modes + 8) // PART_BYTES)
    return max(by_size, min(session, max(cores, nnz // MIN_PART_NNZ)))


@dataclass(frozen=True)
class Demand:
    """Which cells need which rows: ``[cell, i, salt]``, hash-partitioned by row and salt.

    ``hot`` lists rows with more than one salt, ``[i, salts]``; as each takes more than a
    partition's share of the demand, there are fewer of them than partitions.
    """

    rows: DataFrame
    hot: DataFrame

    @classmethod
    def build(cls, wanted: DataFrame, parts: int) -> Demand:
        wanted = materialize(wanted)
        share = max(1, wanted.count() // parts)
        counts = wanted.groupBy("i").count().where(F.col("count") > share)
        hot = materialize(counts.select("i", F.ceil(F.col("count") / share).cast("int").alias("salts")))
        salt = F.pmod(F.xxhash64("cell"), F.coalesce("salts", F.lit(1))).cast("int")
        salted = wanted.join(F.broadcast(hot), "i", "left").select("cell", "i", salt.alias("salt"))
        dealt = salted.repartition(parts, "i", "salt").sortWithinPartitions("i", "salt")
        return cls(materialize_partitioned(dealt), hot)

    def rows_of(self, factor: DataFrame, rank: int) -> DataFrame:
        """The factor's rows addressed to the cells that need them: ``[cell, i, f0 ..]``."""
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        copies = factor.join(F.broadcast(self.hot), "i", "left").select(
            "i", F.explode(salts).alias("salt"), *factor_columns(rank)
        )
        return self.rows.join(copies, ["i", "salt"]).select("cell", "i", *factor_columns(rank))


class CellRows(Protocol):
    """How the rows of a cell hold its nonzeros."""

    def columns_of(self, n: int) -> list[str]:
        """The columns that :meth:`index` reads."""

    def index(self, rows: pa.RecordBatch, row: int, n: int) -> np.ndarray:
        """The indices of mode ``n``."""

    def nonzeros(self, rows: pa.Table, row: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Indices of all modes, and values."""


@dataclass(frozen=True)
class ChunkRows:
    """Chunk rows ``[n, i0 .. val]``."""

    num_modes: int

    def columns_of(self, n: int) -> list[str]:
        return [f"i{n}"]

    def index(self, rows: pa.RecordBatch, row: int, n: int) -> np.ndarray:
        return np.frombuffer(rows.column(f"i{n}")[row].as_buffer(), "<u4")

    def nonzeros(self, rows: pa.Table, row: int) -> tuple[list[np.ndarray], np.ndarray]:
        return unpack(rows, row, self.num_modes)


@dataclass(frozen=True)
class BlockedTensor:
    cells: DataFrame  # [cell, ..]: rows as ``layout`` reads them, hash-partitioned by cell
    mode_sizes: tuple[int, ...]
    parts: int
    layout: CellRows
    built: dict[int, Demand] = field(default_factory=dict)

    def demand(self, n: int) -> Demand:
        """Which cells need which rows of factor ``n``; laid out when first asked for."""
        if n not in self.built:
            self.built[n] = Demand.build(_demand(self, n), self.parts)
        return self.built[n]

    @classmethod
    def build(
        cls, tensor: SparseTensor, rank: int, cell_nnz: int | None = None
    ) -> BlockedTensor:
        """Lay the tensor out and checkpoint it; the layout serves any number of MTTKRPs.

        The layout job is planned without AQE.  A tensor whose frame is itself a join
        should be kept first (``from_frame(.., keep=True)``), so that AQE can split its
        skewed partitions.
        """
        tensor = tensor.with_frame(tensor.merged_frame())
        num_modes = tensor.num_modes
        cores = tensor.spark.sparkContext.defaultParallelism
        parts = layout_partitions(tensor.nnz, num_modes, cores, parallelism(tensor.spark))
        # Coordinates are distinct here, so the curve order is total and a retried task
        # cuts the same cells; the checkpoint then fixes their ids for good.
        packed = _curve_order(tensor, parts).mapInArrow(
            pack_chunks(num_modes, cell_nnz or default_cell_nnz(num_modes, rank), True),
            chunk_schema(num_modes, True),
        )
        return cls.deal(packed, tensor.mode_sizes, parts, ChunkRows(num_modes))

    @classmethod
    def deal(
        cls, rows: DataFrame, mode_sizes: tuple[int, ...], parts: int, layout: CellRows
    ) -> BlockedTensor:
        """Rows with their cells, dealt out by cell and checkpointed."""
        dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell")
        return cls(materialize_partitioned(dealt), mode_sizes, parts, layout)


def _curve_order(tensor: SparseTensor, parts: int) -> DataFrame:
    idx = tensor.index_columns
    plan = MortonPlan.leading(tensor.mode_sizes, KEY_BITS - 1)
    keyed = tensor.df.select(*idx, "val", plan.encode([F.col(c) for c in idx]).alias("key"))
    # The indices after the key: the order is total also where the key lacks low bits.
    return keyed.repartitionByRange(parts, "key", *idx).sortWithinPartitions("key", *idx).drop("key")


def _demand(blocked: BlockedTensor, n: int) -> DataFrame:
    layout = blocked.layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of their cells, so all but the last cell of a batch are whole.
        of, held = None, []

        def wanted() -> pa.RecordBatch:
            i = np.unique(np.concatenate(held)).astype(np.int64)
            cell = np.full(len(i), of, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(i)], names=["cell", "i"])

        for batch in batches:
            for row, cell in enumerate(batch.column("cell").to_pylist()):
                if held and cell != of:
                    yield wanted()
                    held = []
                of = cell
                held.append(layout.index(batch, row, n))
        if held:
            yield wanted()

    return blocked.cells.select("cell", *layout.columns_of(n)).mapInArrow(run, "cell bigint, i bigint")


def _split_modes(
    mode_sizes: Sequence[int], needed: Sequence[int], rank: int, limit: int
) -> tuple[list[int], list[int]]:
    """Modes whose factors together fit the broadcast limit, smallest first; and the rest."""
    small, large, total = [], [], 0
    for w in sorted(needed, key=lambda w: mode_sizes[w]):
        total += factor_bytes(mode_sizes[w], rank)
        (small if total <= limit else large).append(w)
    return small, large


def _cell_kernel(
    num_modes: int, layout: CellRows, modes: Sequence[int], rank: int, shared: Broadcast
):
    columns = factor_columns(rank)

    def nonzeros(cell: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        found = [layout.nonzeros(cell, row) for row in range(cell.num_rows)]
        if len(found) == 1:
            return found[0]
        idx = [np.concatenate(parts) for parts in zip(*[idx for idx, _ in found])]
        return idx, np.concatenate([val for _, val in found])

    def run(cell: pa.Table, rows: pa.Table | None = None) -> pa.Table:
        if rows is not None:
            which = rows.column("w").to_numpy()
            ids = rows.column("i").to_numpy()
            values = matrix_of(rows, columns)
        small = shared.value
        out = [partial_batch(modes[0], np.zeros(0, np.int64), np.zeros((0, rank)))]
        if cell.num_rows:
            idx, val = nonzeros(cell)
            tables, at = [], []
            for w in range(num_modes):
                if w in small:
                    tables.append(small[w])
                    at.append(idx[w])
                    continue
                if rows is None:  # the target mode's own factor, which no product reads
                    tables.append(None)
                    at.append(idx[w])
                    continue
                pick = np.flatnonzero(which == w)
                pick = pick[np.argsort(ids[pick])]
                keys = ids[pick]
                # A row absent from a factor is zero: it points to the extra last place.
                tables.append(np.hstack([values[pick].T, np.zeros((rank, 1))]))
                pos = np.searchsorted(keys, idx[w])
                hit = np.append(keys, -1)[pos] == idx[w]
                at.append(np.where(hit, pos, len(keys)))
            ids, to, sums = {}, {}, {}
            for n in modes:
                ids[n], to[n] = np.unique(idx[n], return_inverse=True)
                sums[n] = np.zeros((rank, len(ids[n])))
            add_products(at, val, tables, sums, to)
            out += [partial_batch(n, ids[n], sums[n].T) for n in modes]
        return pa.Table.from_batches(out)

    return run


def _run(
    blocked: BlockedTensor,
    factors: Sequence[DataFrame],
    modes: Sequence[int],
    rank: int,
    broadcast_bytes: int,
) -> DataFrame:
    num_modes = len(blocked.mode_sizes)
    needed = [w for w in range(num_modes) if len(modes) > 1 or w != modes[0]]
    small, large = _split_modes(blocked.mode_sizes, needed, rank, broadcast_bytes)
    dense = {
        w: np.ascontiguousarray(to_dense(factors[w], blocked.mode_sizes[w], rank).T) for w in small
    }
    shared = blocked.cells.sparkSession.sparkContext.broadcast(dense)
    kernel = _cell_kernel(num_modes, blocked.layout, modes, rank, shared)
    if large:
        slices = reduce(
            DataFrame.unionAll,
            [
                blocked.demand(w)
                .rows_of(factors[w], rank)
                .select("cell", F.lit(w).alias("w"), "i", *factor_columns(rank))
                for w in large
            ],
        )
        cells = blocked.cells.groupBy("cell").cogroup(slices.groupBy("cell"))
        partials = cells.applyInArrow(kernel, partial_schema(rank))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from kernel(pa.Table.from_batches([batch.slice(row, 1)])).to_batches()

        partials = blocked.cells.mapInArrow(run, partial_schema(rank))
    sums = [F.sum(c).alias(c) for c in factor_columns(rank, "y")]
    return partials.groupBy(*(["i"] if len(modes) == 1 else ["mode", "i"])).agg(*sums)


def mttkrp_blocked(
    blocked: BlockedTensor,
    factors: Sequence[DataFrame],
    n: int,
    rank: int,
    broadcast_bytes: int = COLLECT_BYTES,
) -> DataFrame:
    """Mode-``n`` MTTKRP; factors beyond ``broadcast_bytes`` together travel by demand."""
    return _run(blocked, factors, [n], rank, broadcast_bytes)


def mttkrp_all_blocked(
    blocked: BlockedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    broadcast_bytes: int = COLLECT_BYTES,
) -> DataFrame:
    return _run(blocked, factors, list(range(len(blocked.mode_sizes))), rank, broadcast_bytes)
