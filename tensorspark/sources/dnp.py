"""Saved states in the sectioned ``.dnp`` binary, opened as tensors.

A state is a header, the sections of its layout, and the nonzeros: as Z-order keys with
values, as one slab of columns, or as one slab for each mode.  Only the nonzeros are of use
here; sections about shards and threads are stepped over, and of several copies the first is
read.  Tasks read ranges of nonzeros straight from their places in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tensorspark.functions.morton import KEY_BITS, MortonPlan
from tensorspark.operators.keyed import KeyTables
from tensorspark.sources import files
from tensorspark.sources.dnb import CHUNK_BYTES, READ_NNZ, dnb_schema
from tensorspark.tensor import MAX_MODES, SparseTensor, index_columns

# Fixed values of the file format, little-endian and without gaps: magic, version, widths of
# values and indices, layout, number of modes; nonzeros; eight mode sizes, threads; squared
# norm; fourteen reserved words.
HEADER = "<4s5IQ9Id14I"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"DNP1"
VERSION = 1
WIDTH = 4
KEYS, COPIES, TWO_BUFFERS, ONE_BUFFER = range(4)
# Key layout: eight masks, eight numbers of bits; then keys and values.
KEY_HEAD = "<8Q8B"
# Slab layouts: shards, rows in a shard and their shifts for each mode; shard size; fiber
# lengths and kernel classes; sorted mode with seven bytes to fill up; length of remap rows.
SLAB_HEAD = "<8I8I8iI8d8Ib7xQ"
# Copies: for each mode whether its copy is sorted by fibers, and whether row starts follow.
COPY_FLAGS = "<8B8B"


class _Cursor:
    """Reads lengths one after the other, and steps over what they count."""

    def __init__(self, f: pa.NativeFile, at: int, size: int, path: str):
        self.f, self.at, self.size, self.path = f, at, size, path

    def take(self, layout: str) -> tuple:
        raw = self.f.read_at(struct.calcsize(layout), self.at)
        self.skip(struct.calcsize(layout))
        return struct.unpack(layout, raw)

    def skip(self, count: int) -> int:
        """Steps on; returns the place before."""
        before, self.at = self.at, self.at + count
        if self.at > self.size:
            raise ValueError(f"{self.path}: truncated")
        return before


@dataclass(frozen=True)
class DnpState:
    """Where the nonzeros of a state lie."""

    num_modes: int
    nnz: int
    mode_sizes: tuple[int, ...]
    layout: int
    norm_sq: float
    values: int  # place of the first value
    columns: tuple[int, ...]  # places of the index columns, or of the keys alone
    masks: tuple[int, ...]  # key bits of each mode, for the key layout

    @classmethod
    def read(cls, path: str) -> DnpState:
        """Checks the header and finds the columns; nonzeros are not read."""
        filesystem, place = files.open_fs(path)
        size = files.size_of(filesystem, place)
        with filesystem.open_input_file(place) as f:
            cursor = _Cursor(f, 0, size, path)
            magic, version, value_bytes, index_bytes, layout, modes, nnz, *rest = cursor.take(HEADER)
            if magic != MAGIC:
                raise ValueError(f"{path}: bad magic {magic!r}")
            if version != VERSION:
                raise ValueError(f"{path}: version {version}, expected {VERSION}")
            if (value_bytes, index_bytes) != (WIDTH, WIDTH):
                raise ValueError(f"{path}: values of {value_bytes} and indices of {index_bytes} bytes")
            if not 1 <= modes <= MAX_MODES or nnz == 0:
                raise ValueError(f"{path}: {modes} modes and {nnz} nonzeros")
            if layout > ONE_BUFFER:
                raise ValueError(f"{path}: unknown layout {layout}")
            sizes, norm_sq = tuple(rest[:modes]), rest[9]
            masks: tuple[int, ...] = ()
            if layout == KEYS:
                masks = cursor.take(KEY_HEAD)[:modes]
                columns = (cursor.skip(8 * nnz),)
                values = cursor.skip(WIDTH * nnz)
                used = 0
                for mask, s in zip(masks, sizes):
                    if mask & used or mask.bit_count() < (s - 1).bit_length():
                        raise ValueError(f"{path}: key masks don't hold the indices")
                    used |= mask
            else:
                _skip_schedule(cursor, modes)
                flags = cursor.take(COPY_FLAGS) if layout == COPIES else (0,) * 16
                values = cursor.skip(WIDTH * nnz)
                columns = tuple(cursor.skip(WIDTH * nnz) for _ in range(modes))
                if layout == COPIES:  # the other copies only have to be there
                    for k in range(modes):
                        cursor.skip(WIDTH * nnz * (modes + 1) if k else 0)
                        cursor.skip(8 * (sizes[k] + 1) if flags[8 + k] else 0)
        return cls(modes, nnz, sizes, layout, norm_sq, values, columns, masks)

    def indices(self, f: pa.NativeFile, first: int, count: int) -> list[np.ndarray]:
        if self.layout != KEYS:
            return [
                np.frombuffer(f.read_at(WIDTH * count, c + WIDTH * first), "<u4")
                for c in self.columns
            ]
        keys = np.frombuffer(f.read_at(8 * count, self.columns[0] + 8 * first), "<u8")
        places = [tuple(b for b in range(KEY_BITS) if m >> b & 1) for m in self.masks]
        return KeyTables(MortonPlan(tuple(places), (0,) * self.num_modes)).indices(keys)


def _skip_schedule(cursor: _Cursor, modes: int) -> None:
    """Steps over touched bitmaps, shard bounds, shards of threads, and thread offsets."""
    cursor.take(SLAB_HEAD)
    for _ in range(modes):
        _, count = cursor.take("<QQ")
        cursor.skip(count)
    for _ in range(modes):
        (shards,) = cursor.take("<Q")
        cursor.skip(16 * shards)
    for _ in range(modes):
        (threads,) = cursor.take("<Q")
        for _ in range(threads):
            (length,) = cursor.take("<Q")
            cursor.skip(8 * length)
    for _ in range(modes):
        (length,) = cursor.take("<Q")
        cursor.skip(8 * length)


@dataclass
class _Range(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, chunk_nnz: int | None):
        self.path, self.state = path, DnpState.read(path)
        self.chunk_nnz = chunk_nnz or max(1, CHUNK_BYTES // (WIDTH * (self.state.num_modes + 1)))

    def partitions(self) -> Sequence[InputPartition]:
        nnz, step = self.state.nnz, self.chunk_nnz
        return [_Range(first, min(step, nnz - first)) for first in range(0, nnz, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        state = self.state
        names = [*index_columns(state.num_modes), "val"]
        filesystem, place = files.open_fs(self.path)
        with filesystem.open_input_file(place) as f:
            end = partition.first + partition.count
            for lo in range(partition.first, end, READ_NNZ):
                n = min(READ_NNZ, end - lo)
                arrays = [i.astype(np.int64) for i in state.indices(f, lo, n)]
                raw = f.read_at(WIDTH * n, state.values + WIDTH * lo)
                arrays.append(np.frombuffer(raw, "<f4").astype(np.float64))
                yield pa.record_batch([pa.array(a) for a in arrays], names=names)


class DnpDataSource(DataSource):
    """``spark.read.format("dnp").load(path)``; option ``chunk_nnz``."""

    @classmethod
    def name(cls) -> str:
        return "dnp"

    def schema(self) -> str:
        return dnb_schema(DnpState.read(self.options["path"]).mode_sizes)

    def reader(self, schema: StructType) -> DataSourceReader:
        chunk = self.options.get("chunk_nnz")
        return _Reader(self.options["path"], int(chunk) if chunk else None)


def read_dnp(spark: SparkSession, path: str, chunk_nnz: int | None = None) -> SparseTensor:
    """Open a saved state of any layout; the norm comes from one pass."""
    spark.dataSource.register(DnpDataSource)
    reader = spark.read.format("dnp")
    if chunk_nnz:
        reader = reader.option("chunk_nnz", str(chunk_nnz))
    return SparseTensor.from_frame(reader.load(path), DnpState.read(path).mode_sizes)
