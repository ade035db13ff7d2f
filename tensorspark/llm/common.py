"""Helpers of the operators: inputs, shared files, and word hashing on Arrow text."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.session import scratch_path

#: Bytes of text that a kernel handles at a time.
BLOCK_BYTES = 1 << 20
#: A set of rows up to this many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


#: Bytes of an Arrow batch, where the session doesn't set its own.  A task holds a batch in
#: the JVM and in its Python worker, several times over while it is converted.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows that a Parquet scan decodes at a time, where the session doesn't set its own.  Texts of
#: that many rows lie in one array, which doubles as it grows.
SCAN_ROWS = 512
_SCAN_SETTING, _DEFAULT_SCAN = "spark.sql.parquet.columnarReaderBatchSize", "4096"
#: What tasks leave in a worker for its next task: names in a library's module.
_LEFT = {
    "tokenizers": ("_encoders_by_path", "_chat_tokenizers_by_path"),
    "sentencepiece": ("_pairs_by_path",),
}


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes: the usual limit, by rows, is no bound for long texts.

    A scan's batches can only be limited by rows.
    """
    for setting, default, own in (
        (_BATCH_SETTING, _DEFAULT_BATCH, f"{BATCH_BYTES}b"),
        (_SCAN_SETTING, _DEFAULT_SCAN, str(SCAN_ROWS)),
    ):
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, own)


def rows_frame(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A small table of the driver as a DataFrame, by Arrow.

    A list of rows would go through Python workers of its own kind, which stay in the
    executors' memory beside those of the queries.
    """
    return spark.createDataFrame(table)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns can't clash with an operator's own."""
    bound_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(df: DataFrame) -> int:
    """Partitions for a shuffle of the rows of ``df``: as many as its scan has, or more.

    The scan's number follows the bytes of the input, so partitions keep their size when
    the input grows and ``spark.sql.shuffle.partitions`` stays as it is.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, df.rdd.getNumPartitions())


def through_files(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors lose no work."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, now counted, are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, empty folder below the shared one, as a URI."""
    uri = scratch_path(spark, label)
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path, recursive=True)
    return uri


# ---- text in Arrow batches -------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the ``n + 1`` bounds of its rows; null rows are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def forget_left() -> None:
    """Drops what tasks that encode left in this worker, at the start of one that doesn't."""
    for module, names in _LEFT.items():
        for name in names if module in sys.modules else ():
            vars(sys.modules[module]).pop(name, None)


def free_memory() -> None:
    """Gives back what the last task of this worker held.

    Functions of this package travel to the workers by value, so their globals end in
    cycles that only the collector frees; then the allocators hand free pages back.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text, or one row."""
    free_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    batch = None
    free_memory()


#: Bytes that end a word: blank, tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters and digits: ASCII without them.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
#: ASCII letters in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_PRIME = np.uint64(2**61 - 1)
#: Where word hashes are taken: a fixed number below the prime, drawn at random.
_POINT = 0x12D5A4B77C0E93F1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_bounds(
    data: np.ndarray, bounds: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def leading_bytes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number in byte order; bytes after ``left`` are zero.

    ``data`` goes on for seven bytes after the last of them.
    """
    windows = np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))
    past = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
    value = windows[np.minimum(at, max(len(windows) - 1, 0))].astype(np.uint64)
    part = np.minimum(past, np.uint64(63))
    return np.where(past > 63, np.uint64(0), value >> part << part)


def _times_point(x: np.ndarray) -> np.ndarray:
    """``x`` times the point modulo the prime, by halves of 31 and 30 bits."""
    low, high = np.uint64(_POINT & (2**31 - 1)), np.uint64(_POINT >> 31)
    x_low, x_high = x & np.uint64(2**31 - 1), x >> np.uint64(31)
    middle = x_high * low + x_low * high
    total = (x_high * high << np.uint64(1)) + (middle >> np.uint64(30)) + x_low * low
    total += (middle & np.uint64(2**30 - 1)) << np.uint64(31)
    total = (total & _PRIME) + (total >> np.uint64(61))
    return np.where(total >= _PRIME, total - _PRIME, total)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z.

    The word's bytes, seven at a time, are the coefficients of a polynomial modulo the prime
    2^61 - 1, after its length; two words of n bytes agree at no more than n / 7 + 1 points.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    data = np.append(LOWER[data[first : ends[-1]]], np.zeros(7, np.uint8))
    at, left = starts - first, ends - starts
    out = left.astype(np.uint64)
    live = np.arange(len(starts))
    while len(live):
        part = leading_bytes(data, at[live], np.minimum(left[live], 7)) >> np.uint64(8)
        value = _times_point(out[live]) + part
        out[live] = np.where(value >= _PRIME, value - _PRIME, value)
        live = live[left[live] > 7]
        at[live] += 7
        left[live] -= 7
    return mix(out)
