"""MTTKRP on Z-order keys: chunks of sorted keys, stored as differences.

A chunk holds its first key, the differences between neighbours in as few whole bytes as
the largest needs, and the values.  A gap of more than four bytes ends a chunk, while chunks
of a reasonable length are left; so most tensors take 12 bytes a nonzero or fewer, however
many modes they have.  Indices are gathered from the keys by tables of 256 entries, one for
each byte of the key and mode.

Where the factors are too large to be sent whole, runs of chunks become cells of the blocked
layout, still as keys, and factor rows travel to the cells that want them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tensorspark.functions.factors import factor_bytes, from_dense
from tensorspark.functions.morton import MortonPlan
from tensorspark.functions.products import PIECES, TaskSums
from tensorspark.operators.blocked import (
    BlockedTensor,
    default_cell_nnz,
    layout_partitions,
    mttkrp_all_blocked,
    mttkrp_blocked,
)
from tensorspark.operators.mttkrp import CHUNK_NNZ, Factor, final_sums, share_factors
from tensorspark.plans.strategy import COLLECT_BYTES
from tensorspark.session import parallelism
from tensorspark.tensor import SparseTensor, sorted_by_key

KEYS = "n int, first bigint, width int, steps binary, val binary"
# A wide gap starts a new chunk where the chunk so far has at least so many nonzeros.
LEAST_NNZ = 256


def pack_keys(keys: np.ndarray, val: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Chunk rows of ascending unsigned keys."""
    steps = np.diff(keys, prepend=keys[:1])
    wide = np.flatnonzero(steps >> np.uint64(32))
    cuts = [0]
    for at in wide.tolist():
        if at - cuts[-1] >= LEAST_NNZ:
            cuts.append(at)
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        inner = steps[lo + 1 : hi]
        largest = int(inner.max()) if len(inner) else 0
        width = next(b for b in (1, 2, 4, 8) if largest < 1 << 8 * b)
        first = int(keys[lo].astype(np.int64))
        packed = inner.astype(f"<u{width}").tobytes()
        yield hi - lo, first, width, packed, val[lo:hi].astype("<f8").tobytes()


def unpack_keys(first: int, width: int, steps: bytes) -> np.ndarray:
    """The keys of a chunk."""
    start = np.array([first], np.int64).view(np.uint64)
    inner = np.frombuffer(steps, f"<u{width}").astype(np.uint64)
    return np.cumsum(np.concatenate((start, inner)), dtype=np.uint64)


def key_rows(rows: Sequence[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ["n", "first", "width", "steps", "val"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class KeyTables:
    """Byte tables of a plan: for each mode, the key bytes it has bits in and their parts."""

    def __init__(self, plan: MortonPlan):
        if any(plan.shifts):
            raise ValueError("the key does not hold whole indices")
        byte = np.arange(256, dtype=np.uint32)
        self.tables: list[list[tuple[int, np.ndarray]]] = []
        for places in plan.positions:
            parts: dict[int, np.ndarray] = {}
            for b, place in enumerate(places):
                at, bit = divmod(place, 8)
                part = parts.setdefault(at, np.zeros(256, np.uint32))
                part |= (byte >> np.uint32(bit) & np.uint32(1)) << np.uint32(b)
            self.tables.append(list(parts.items()))

    def index(self, keys: np.ndarray, n: int) -> np.ndarray:
        columns = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(keys), np.uint32)
        for at, table in self.tables[n]:
            out |= table[columns[:, at]]
        return out

    def indices(self, keys: np.ndarray) -> list[np.ndarray]:
        return [self.index(keys, n) for n in range(len(self.tables))]


@dataclass(frozen=True)
class KeyRows:
    """Key chunks as rows of cells."""

    tables: KeyTables

    def columns_of(self, n: int) -> list[str]:
        return ["first", "width", "steps"]

    def index(self, rows: pa.RecordBatch, row: int, n: int) -> np.ndarray:
        return self.tables.index(self._keys(rows, row), n)

    def nonzeros(self, rows: pa.Table, row: int) -> tuple[list[np.ndarray], np.ndarray]:
        val = np.frombuffer(rows.column("val")[row].as_buffer(), "<f8")
        return self.tables.indices(self._keys(rows, row)), val

    def _keys(self, rows: pa.RecordBatch | pa.Table, row: int) -> np.ndarray:
        return unpack_keys(*[rows.column(c)[row].as_py() for c in ("first", "width", "steps")])


def cut_cells(
    batches: Iterator[pa.RecordBatch], task: int, cell_nnz: int
) -> Iterator[pa.RecordBatch]:
    """Chunks with their cells: as many neighbours as have ``cell_nnz`` nonzeros at most."""
    cell, held = task << 32, 0
    for batch in batches:
        for chunk in batch.to_pylist():
            rows = [tuple(chunk.values())]
            if chunk["n"] > cell_nnz:
                keys = unpack_keys(chunk["first"], chunk["width"], chunk["steps"])
                val = np.frombuffer(chunk["val"], "<f8")
                cuts = [slice(lo, lo + cell_nnz) for lo in range(0, len(keys), cell_nnz)]
                rows = [row for cut in cuts for row in pack_keys(keys[cut], val[cut])]
            for row in rows:
                if held and held + row[0] > cell_nnz:
                    cell, held = cell + 1, 0
                held += row[0]
                yield key_rows([row]).add_column(0, "cell", pa.array([cell], pa.int64()))


@dataclass(frozen=True)
class KeyChunks:
    """A tensor as chunks of keys and values, in key order over all partitions."""

    df: DataFrame
    mode_sizes: tuple[int, ...]
    plan: MortonPlan
    nnz: int
    built: dict[int, BlockedTensor] = field(default_factory=dict)

    @classmethod
    def build(cls, tensor: SparseTensor, chunk_nnz: int = CHUNK_NNZ) -> KeyChunks:
        """Sorts the nonzeros by key once; fails where keys need more than 64 bits."""
        rows, plan = sorted_by_key(tensor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def rows_of(keys: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
                return key_rows(list(pack_keys(keys, val)))

            for batch in batches:
                keys = batch.column("key").to_numpy().view(np.uint64)
                val = batch.column("val").to_numpy()
                at = 0
                while at < len(keys):
                    take = min(len(keys) - at, chunk_nnz - size)
                    held.append((keys[at : at + take], val[at : at + take]))
                    size, at = size + take, at + take
                    if size == chunk_nnz:
                        yield rows_of(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
            if size:
                yield rows_of(*map(np.concatenate, zip(*held)))

        return cls(rows.mapInArrow(run, KEYS), tensor.mode_sizes, plan, tensor.nnz)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> KeyChunks:
        self.df.persist(level)
        return self

    def stored_bytes(self) -> DataFrame:
        """``nnz, bytes``: how much the chunks hold, and in how many bytes."""
        buffers = F.octet_length("steps") + F.octet_length("val") + 16
        return self.df.agg(F.sum("n").alias("nnz"), F.sum(buffers).alias("bytes"))

    def unpersist(self) -> None:
        self.df.unpersist()

    def partials(self, shared: Broadcast, modes: Sequence[int], rank: int) -> DataFrame:
        sizes, tables, modes = self.mode_sizes, KeyTables(self.plan), list(modes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = TaskSums(sizes, rank, modes)
            for batch in batches:
                for row in batch.to_pylist():
                    keys = unpack_keys(row["first"], row["width"], row["steps"])
                    val = np.frombuffer(row["val"], "<f8")
                    yield from out.add(tables.indices(keys), val, shared.value)
            yield from out.finish()

        return self.df.mapInArrow(run, PIECES)

    def cells(self, rank: int) -> BlockedTensor:
        """The chunks as cells, laid out when first asked for."""
        if rank not in self.built:
            num_modes, spark = len(self.mode_sizes), self.df.sparkSession
            cell_nnz = default_cell_nnz(num_modes, rank)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                yield from cut_cells(batches, TaskContext.get().partitionId(), cell_nnz)

            cores = spark.sparkContext.defaultParallelism
            parts = layout_partitions(self.nnz, num_modes, cores, parallelism(spark))
            rows = self.df.mapInArrow(run, f"cell bigint, {KEYS}")
            layout = KeyRows(KeyTables(self.plan))
            self.built[rank] = BlockedTensor.deal(rows, self.mode_sizes, parts, layout)
        return self.built[rank]

    def mttkrp_all(
        self, factors: Sequence[Factor], rank: int, modes: Sequence[int] | None = None
    ) -> DataFrame:
        """``[mode, i, y0 ..]`` of all modes, or of ``modes``, from one pass over the keys.

        Factors too large to pass the driver travel by demand, row by row.
        """
        every = range(len(self.mode_sizes))
        modes = list(every if modes is None else modes)
        needed = [w for w in every if len(modes) > 1 or w != modes[0]]
        if sum(factor_bytes(self.mode_sizes[w], rank) for w in needed) <= COLLECT_BYTES:
            shared = share_factors(self, factors, modes, rank)
            return final_sums(self.partials(shared, modes, rank), rank)
        spark, cells = self.df.sparkSession, self.cells(rank)
        frames = [f if isinstance(f, DataFrame) else from_dense(spark, f) for f in factors]
        if len(modes) == 1:
            out = mttkrp_blocked(cells, frames, modes[0], rank)
            return out.select(F.lit(modes[0]).alias("mode"), "*")
        return mttkrp_all_blocked(cells, frames, rank).where(F.col("mode").isin(modes))
