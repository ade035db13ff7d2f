"""Nonzeros packed into binary chunk rows, and rows of their partial sums.

A chunk row is ``[n INT, i0 BINARY .. i{N-1} BINARY, val BINARY]``: the index and value
columns of up to ``chunk_nnz`` nonzeros as raw little-endian buffers.  Iterative work
re-reads the tensor many times; shipping a few large buffers to the Python workers costs
far less than converting every nonzero from rows to Arrow each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from tensorspark.functions.factors import factor_columns
from tensorspark.tensor import index_columns

INDEX_DTYPE = np.dtype("<u4")
VALUE_DTYPE = np.dtype("<f8")


def chunk_schema(num_modes: int, with_cell: bool = False) -> str:
    head = "cell bigint, n int" if with_cell else "n int"
    return ", ".join([head, *[f"{c} binary" for c in index_columns(num_modes)], "val binary"])


def pack_chunks(
    num_modes: int, chunk_nnz: int, with_cell: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` body: nonzero rows in, chunk rows out, one chunk in memory at a time."""
    names = [*index_columns(num_modes), "val"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        emitted = 0

        def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal emitted
            arrays = [pa.array([len(columns[0])], pa.int32())]
            arrays += [pa.array([c.tobytes()], pa.binary()) for c in columns]
            head = ["n"]
            if with_cell:
                arrays.insert(0, pa.array([(task << 32) + emitted], pa.int64()))
                head = ["cell", "n"]
            emitted += 1
            return pa.RecordBatch.from_arrays(arrays, names=[*head, *names])

        held: list[list[np.ndarray]] = []
        held_rows = 0
        for batch in batches:
            columns = [
                batch.column(c).to_numpy(zero_copy_only=False).astype(INDEX_DTYPE)
                for c in names[:-1]
            ]
            columns.append(batch.column("val").to_numpy(zero_copy_only=False).astype(VALUE_DTYPE))
            start = 0
            while start < batch.num_rows:
                take = min(batch.num_rows - start, chunk_nnz - held_rows)
                held.append([c[start : start + take] for c in columns])
                held_rows += take
                start += take
                if held_rows == chunk_nnz:
                    yield emit([np.concatenate(parts) for parts in zip(*held)])
                    held, held_rows = [], 0
        if held_rows:
            yield emit([np.concatenate(parts) for parts in zip(*held)])

    return run


def unpack(
    batch: pa.RecordBatch | pa.Table, row: int, num_modes: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Index arrays and values of one chunk row, without copying."""

    def buffer(name: str, dtype: np.dtype) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=dtype)

    return (
        [buffer(c, INDEX_DTYPE) for c in index_columns(num_modes)],
        buffer("val", VALUE_DTYPE),
    )


def partial_batch(mode: int, i: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = np.ascontiguousarray(sums.T)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(i), mode, dtype=np.int32)),
            pa.array(i.astype(np.int64)),
            *[pa.array(c) for c in columns],
        ],
        names=["mode", "i", *factor_columns(sums.shape[1], "y")],
    )


def partial_schema(rank: int) -> str:
    return ", ".join(
        ["mode int", "i bigint", *[f"{c} double" for c in factor_columns(rank, "y")]]
    )
