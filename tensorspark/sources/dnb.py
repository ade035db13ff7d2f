"""The ``.dnb`` coordinate binary as a Spark data source.

One file: an 88-byte header, then the values as f32 and each index column as u32, all
little-endian, zero-based.  Spark writes a folder of such files plus a manifest, and reads
either a single file or a folder, on any file system that Arrow knows (see
:mod:`tensorspark.sources.files`).  ``export_file`` joins a folder into one file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tensorspark.sources import files
from tensorspark.tensor import MAX_MODES, SparseTensor, index_columns

# Fixed values of the file format: magic, version, widths of values and indices, then the
# number of modes, the nonzero count, eight mode sizes and seven reserved words.
HEADER = "<4s4IQ8I7I"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"DNB1"
VERSION = 1
WIDTH = 4

# Nonzeros a writer task holds before it closes a part file.
PART_NNZ = 1 << 22
# Nonzeros of a batch that is read.
READ_NNZ = 1 << 17
# Bytes of a file that one read task takes.
CHUNK_BYTES = 128 << 20


@dataclass(frozen=True)
class DnbHeader:
    num_modes: int
    nnz: int
    mode_sizes: tuple[int, ...]

    @classmethod
    def read(cls, path: str) -> DnbHeader:
        filesystem, place = files.open_fs(path)
        size = files.size_of(filesystem, place)
        with filesystem.open_input_file(place) as f:
            raw = f.read_at(min(size, HEADER_BYTES), 0)
        if len(raw) < HEADER_BYTES:
            raise ValueError(f"{path}: shorter than a header")
        magic, version, value_bytes, index_bytes, modes, nnz, *rest = struct.unpack(HEADER, raw)
        if magic != MAGIC:
            raise ValueError(f"{path}: bad magic {magic!r}")
        if (version, value_bytes, index_bytes) != (VERSION, WIDTH, WIDTH):
            raise ValueError(f"{path}: unsupported version or widths")
        if not 1 <= modes <= MAX_MODES or nnz == 0:
            raise ValueError(f"{path}: {modes} modes and {nnz} nonzeros")
        if size < HEADER_BYTES + nnz * WIDTH * (1 + modes):
            raise ValueError(f"{path}: truncated")
        return cls(modes, nnz, tuple(rest[:modes]))

    def pack(self) -> bytes:
        sizes = [*self.mode_sizes, *[0] * (MAX_MODES - self.num_modes)]
        return struct.pack(
            HEADER, MAGIC, VERSION, WIDTH, WIDTH, self.num_modes, self.nnz, *sizes, *[0] * 7
        )

    def offset(self, column: int, first: int = 0) -> int:
        """Byte position of an entry; column 0 holds the values, 1 .. N the indices."""
        return HEADER_BYTES + WIDTH * (column * self.nnz + first)


def read_parts(path: str) -> tuple[list[tuple[str, int]], tuple[int, ...]]:
    """The files of a tensor with their nonzero counts, and the overall mode sizes."""
    filesystem, place = files.open_fs(path)
    if not files.is_folder(filesystem, place):
        head = DnbHeader.read(path)
        return [(path, head.nnz)], head.mode_sizes
    meta = files.read_manifest(filesystem, place)
    if meta is not None:
        return [(files.join(path, p), nnz) for p, nnz in meta["parts"]], tuple(meta["mode_sizes"])
    names = [n for n in files.names(filesystem, place) if n.endswith(".dnb")]
    if not names:
        raise ValueError(f"{path}: no .dnb files")
    heads = [(files.join(path, n), DnbHeader.read(files.join(path, n))) for n in names]
    if len({h.num_modes for _, h in heads}) > 1:
        raise ValueError(f"{path}: files differ in their number of modes")
    sizes = tuple(max(s) for s in zip(*[h.mode_sizes for _, h in heads]))
    return [(p, h.nnz) for p, h in heads], sizes


def dnb_schema(mode_sizes: Sequence[int]) -> str:
    columns = [f"{c} bigint" for c in index_columns(len(mode_sizes))]
    return ", ".join([*columns, "val double"])


@dataclass
class Chunk(InputPartition):
    path: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, chunk_nnz: int | None):
        self.path = path
        self.chunk_nnz = chunk_nnz or max(1, CHUNK_BYTES // (WIDTH * len(schema.fields)))

    def partitions(self) -> Sequence[InputPartition]:
        parts, _ = read_parts(self.path)
        return [
            Chunk(path, first, min(self.chunk_nnz, nnz - first))
            for path, nnz in parts
            for first in range(0, nnz, self.chunk_nnz)
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_chunk(partition.path, partition.first, partition.count)


def read_chunk(path: str, first: int, count: int) -> Iterator[pa.RecordBatch]:
    """A range of nonzeros of one file, in batches."""
    head = DnbHeader.read(path)
    names = [*index_columns(head.num_modes), "val"]
    filesystem, place = files.open_fs(path)
    with filesystem.open_input_file(place) as f:

        def column(number: int, dtype: str, lo: int, n: int) -> np.ndarray:
            return np.frombuffer(f.read_at(n * WIDTH, head.offset(number, lo)), dtype)

        for lo in range(first, first + count, READ_NNZ):
            n = min(READ_NNZ, first + count - lo)
            arrays = [column(k + 1, "<u4", lo, n).astype(np.int64) for k in range(head.num_modes)]
            arrays.append(column(0, "<f4", lo, n).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]
    sizes: list[int]


class _Writer(DataSourceArrowWriter):
    """Tasks write part files under names of their own; the commit names those that count."""

    def __init__(self, path: str, num_modes: int, sizes: list[int], overwrite: bool):
        self.path, self.num_modes, self.sizes = path, num_modes, sizes
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        filesystem, place = files.open_fs(path)
        filesystem.create_dir(place, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, place = files.open_fs(self.path)
        written: list[tuple[str, int]] = []
        sizes = [0] * self.num_modes
        held: list[list[np.ndarray]] = []

        def flush() -> None:
            columns = [np.concatenate(parts) for parts in zip(*held)]
            held.clear()
            own = tuple(int(c.max()) + 1 for c in columns[1:])
            sizes[:] = map(max, sizes, own)
            head = DnbHeader(self.num_modes, len(columns[0]), own)
            name = f"part-{self.job}-{uuid.uuid4().hex}.dnb"
            with filesystem.open_output_stream(files.join(place, name)) as f:
                f.write(head.pack())
                for c in columns:
                    f.write(c.tobytes())
            written.append((name, head.nnz))

        rows = 0
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            columns = [batch.column("val").to_numpy(zero_copy_only=False).astype("<f4")]
            columns += [
                batch.column(c).to_numpy(zero_copy_only=False).astype("<u4")
                for c in index_columns(self.num_modes)
            ]
            held.append(columns)
            rows += batch.num_rows
            if rows >= PART_NNZ:
                flush()
                rows = 0
        if held:
            flush()
        return _Written(written, sizes)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        parts = [p for m in done for p in m.files]
        sizes = [max(s) for s in zip(self.sizes, *[m.sizes for m in done])]
        filesystem, place = files.open_fs(self.path)
        if not self.overwrite:
            before = files.read_manifest(filesystem, place)
            if before is not None:
                parts = [*map(tuple, before["parts"]), *parts]
                sizes = list(map(max, sizes, before["mode_sizes"]))
        name = files.write_manifest(filesystem, place, {"parts": parts, "mode_sizes": sizes})
        # What no manifest names any more: attempts that failed, and what was overwritten.
        keep = {p for p, _ in parts} | {name}
        stale = [n for n in files.names(filesystem, place) if n not in keep]
        own = [n for n in stale if n.startswith((f"part-{self.job}-", files.MANIFEST))]
        old = [n for n in stale if n.endswith(".dnb")] if self.overwrite else []
        files.remove(filesystem, place, {*own, *old})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, place = files.open_fs(self.path)
        mine = [n for n in files.names(filesystem, place) if n.startswith(f"part-{self.job}-")]
        files.remove(filesystem, place, mine)


class DnbDataSource(DataSource):
    """``spark.read.format("dnb").load(path)`` and ``df.write.format("dnb").save(path)``.

    Options: ``chunk_nnz`` (reader), ``mode_sizes`` as comma-separated numbers (writer).
    Paths are URIs of a file system that Arrow knows, or paths on a mounted one.
    """

    @classmethod
    def name(cls) -> str:
        return "dnb"

    def schema(self) -> str:
        return dnb_schema(read_parts(self.options["path"])[1])

    def reader(self, schema: StructType) -> DataSourceReader:
        chunk = self.options.get("chunk_nnz")
        return _Reader(self.options["path"], schema, int(chunk) if chunk else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        modes = len(schema.fields) - 1
        given = self.options.get("mode_sizes")
        sizes = [int(s) for s in given.split(",")] if given else [0] * modes
        return _Writer(self.options["path"], modes, sizes, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DnbDataSource)


def read_dnb(spark: SparkSession, path: str, chunk_nnz: int | None = None) -> SparseTensor:
    """Open a binary tensor; sizes come from the header, the norm from one pass."""
    register(spark)
    reader = spark.read.format("dnb")
    if chunk_nnz:
        reader = reader.option("chunk_nnz", str(chunk_nnz))
    return SparseTensor.from_frame(reader.load(path), read_parts(path)[1])


def write_frame(df: DataFrame, num_modes: int, path: str, sizes: Sequence[int] | None) -> None:
    """Write nonzero rows as a folder of part files; sizes may exceed the largest index."""
    register(df.sparkSession)
    writer = df.select(*index_columns(num_modes), "val").write.format("dnb").mode("overwrite")
    if sizes:
        writer = writer.option("mode_sizes", ",".join(map(str, sizes)))
    writer.save(path)


def append_frame(df: DataFrame, num_modes: int, path: str) -> None:
    """Add nonzero rows to a folder, as parts after those it has."""
    register(df.sparkSession)
    df.select(*index_columns(num_modes), "val").write.format("dnb").mode("append").save(path)


def write_dnb(tensor: SparseTensor, path: str) -> None:
    """Write a folder of part files in parallel; values become f32."""
    write_frame(tensor.df, tensor.num_modes, path, tensor.mode_sizes)


def export_file(spark: SparkSession, folder: str, target: str) -> DnbHeader:
    """Join a folder of parts into one file.

    The format wants each column of all nonzeros in one run, and object stores write a file
    from front to end, so one task copies the columns of the parts in turn, a bounded piece
    at a time.  For tensors that are too large for that, the folder is the format to keep.
    """
    parts, sizes = read_parts(folder)
    total = DnbHeader(len(sizes), sum(n for _, n in parts), sizes)
    jobs = spark.createDataFrame([(p, n) for p, n in parts], "part string, nnz bigint")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [row for batch in batches for row in batch.to_pylist()]
        filesystem, place = files.open_fs(target)
        with filesystem.open_output_stream(place) as out:
            out.write(total.pack())
            for column in range(total.num_modes + 1):
                for row in todo:
                    head = DnbHeader.read(row["part"])
                    source, at = files.open_fs(row["part"])
                    with source.open_input_file(at) as f:
                        files.copy_range(f, head.offset(column), row["nnz"] * WIDTH, out)
        yield pa.RecordBatch.from_arrays([pa.array([len(todo)])], names=["copied"])

    done = jobs.coalesce(1).mapInArrow(copy, "copied bigint").first()
    if done is None or done["copied"] != len(parts):
        raise RuntimeError(f"{target}: not all of {len(parts)} parts were copied")
    return total
