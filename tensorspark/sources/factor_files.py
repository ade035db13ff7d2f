"""Factor matrices on disk: text, binary, and the raw lambda file.

A factor is written by its rows' owners, on any file system that Arrow knows.  Rows must be
complete and in order, so a DataFrame is first filled up with zero rows for untouched
indices.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.functions.factors import (
    factor_batch,
    factor_columns,
    factor_schema,
    from_dense,
    matrix_of,
)
from tensorspark.sources import files

# Fixed values of the binary format: magic, version, value width, rank, rows; then f32
# entries row by row.
HEADER = "<4s3IQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"DYFM"
VERSION = 1
WIDTH = 4
# Rows a task writes at a time.
_BLOCK_ROWS = 1 << 14


def _complete(factor: DataFrame, rows: int, rank: int, prefix: str) -> DataFrame:
    """All rows ``0 .. rows-1``; a missing one is zero."""
    names = factor_columns(rank, prefix)
    spark = factor.sparkSession
    return (
        spark.range(rows)
        .withColumnRenamed("id", "i")
        .join(factor.select("i", *names), "i", "left")
        .na.fill(0.0, names)
    )


def write_binary(
    factor: DataFrame | np.ndarray, path: str, rows: int, rank: int, prefix: str = "f"
) -> None:
    """Tasks write ranges of rows as parts, and one task joins those into the file.

    The parts' folder is beside the file, ``<path>.parts``; it is left empty.
    """
    head = struct.pack(HEADER, MAGIC, VERSION, WIDTH, rank, rows)
    filesystem, place = files.open_fs(path)
    if isinstance(factor, np.ndarray):
        with filesystem.open_output_stream(place) as f:
            f.write(head + factor.astype("<f4").tobytes())
        return
    names, folder, job = factor_columns(rank, prefix), f"{path}.parts", uuid.uuid4().hex
    filesystem.create_dir(f"{place}.parts", recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = files.open_fs(folder)
        name, first, count, out = f"{job}-{uuid.uuid4().hex}", 0, 0, None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    out = fs.open_output_stream(files.join(at, name))
                    first = batch.column("i")[0].as_py()
                out.write(matrix_of(batch, names).astype("<f4").tobytes())
                count += batch.num_rows
        if out is not None:
            out.close()
            columns = [[name], [first], [count]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["name", "first", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["first"])
        (fs, at), done = files.open_fs(folder), 0
        target, target_at = files.open_fs(path)
        with target.open_output_stream(target_at) as out:
            out.write(head)
            for part in parts:
                if part["first"] != done:
                    raise ValueError(f"{path}: rows {done} to {part['first']} are missing")
                with fs.open_input_file(files.join(at, part["name"])) as f:
                    files.copy_range(f, 0, part["n"] * rank * WIDTH, out)
                done += part["n"]
        yield pa.record_batch([pa.array([done], pa.int64())], names=["rows"])

    # Which attempts count is settled before the parts are joined.
    ranges = _complete(factor, rows, rank, prefix).repartitionByRange("i")
    parts = ranges.sortWithinPartitions("i").mapInArrow(put, "name string, first bigint, n bigint")
    spark = factor.sparkSession
    counted = spark.createDataFrame(parts.collect(), parts.schema)
    done = counted.coalesce(1).mapInArrow(join, "rows bigint").first()
    stale = [n for n in files.names(filesystem, f"{place}.parts") if n.startswith(job)]
    files.remove(filesystem, f"{place}.parts", stale)
    if (done["rows"] if done else 0) != rows:
        raise RuntimeError(f"{path}: {done} of {rows} rows were written")


def read_header(path: str) -> tuple[int, int]:
    """``(rows, rank)``."""
    filesystem, place = files.open_fs(path)
    size = files.size_of(filesystem, place)
    with filesystem.open_input_file(place) as f:
        raw = f.read_at(min(size, HEADER_BYTES), 0)
    if len(raw) < HEADER_BYTES:
        raise ValueError(f"{path}: shorter than a header")
    magic, version, width, rank, rows = struct.unpack(HEADER, raw)
    if magic != MAGIC or version != VERSION or width != WIDTH:
        raise ValueError(f"{path}: not a factor file of version {VERSION}")
    if size != HEADER_BYTES + rows * rank * WIDTH:
        raise ValueError(f"{path}: wrong size for {rows} x {rank}")
    return rows, rank


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """A factor file as ``[i, f0 ..]``, read by row ranges."""
    rows, rank = read_header(path)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, place = files.open_fs(path)
        with filesystem.open_input_file(place) as f:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    lo = block * _BLOCK_ROWS
                    n = min(_BLOCK_ROWS, rows - lo)
                    raw = f.read_at(n * rank * WIDTH, HEADER_BYTES + lo * rank * WIDTH)
                    values = np.frombuffer(raw, "<f4").reshape(n, rank)
                    yield factor_batch(np.arange(lo, lo + n), values.astype(np.float64))

    return spark.range(-(-rows // _BLOCK_ROWS)).mapInArrow(load, factor_schema(rank))


def write_text(
    factor: DataFrame | np.ndarray, path: str, rows: int, rank: int, prefix: str = "f"
) -> None:
    """One row per line, seven significant digits: a folder of parts in row order."""
    names = factor_columns(rank, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.char.mod("%.7g", matrix_of(batch, names).astype(np.float32))
            lines = [" ".join(row) for row in cells]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    if isinstance(factor, np.ndarray):
        factor = from_dense(SparkSession.active(), factor).withColumnsRenamed(
            dict(zip(factor_columns(rank), names))
        )
    ordered = _complete(factor, rows, rank, prefix).orderBy("i")
    ordered.mapInArrow(run, "line string").write.mode("overwrite").text(path)


def write_lambda(lam: np.ndarray, path: str) -> None:
    filesystem, place = files.open_fs(path)
    with filesystem.open_output_stream(place) as f:
        f.write(np.asarray(lam).astype("<f4").tobytes())


def read_lambda(path: str) -> np.ndarray:
    filesystem, place = files.open_fs(path)
    with filesystem.open_input_stream(place) as f:
        return np.frombuffer(f.read(), "<f4").astype(np.float64)
