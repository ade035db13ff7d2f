"""Token files: ids of documents in patched frame-of-reference blocks, in document order.

One file per partition of a range partitioning by ``doc_id``::

    "PFORTOK1" | blocks | block starts i64.. | doc ids i64.. | doc present u8.. | doc sizes i64..
    | footer: first of those four u64 | blocks u64 | documents u64 | values u64 | "PFORTOK1"

Tasks write files under names of their own and report them; the manifest (Parquet, beside
the files) lists those of the attempts that counted, so a repeated task does no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorspark.llm import pfor
from tensorspark.llm.common import blocks, id_text, open_fs, shared_folder, width
from tensorspark.llm.tokens import END_ID, WORD_BPE, encoder

MAGIC = b"PFORTOK1"
_FOOT = "<QQQQ8s"
#: Values that a reader decodes at a time, rounded up to whole documents.
READ_VALUES = 1 << 19
MANIFEST = "shard long, file string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, ids binary"


class _Writer:
    """Writes one file; holds a bounded part of the ids and 17 bytes for each document."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream
        self.stream.write(MAGIC)
        self.at = len(MAGIC)
        self.waiting: list[bytes] = []
        self.size = 0
        self.values = 0
        self.starts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.present: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _put(self, values: np.ndarray) -> None:
        data, starts = pfor.encode(values)
        self.stream.write(data)
        self.starts.append(starts + self.at)
        self.at += len(data)
        self.values += len(values)

    def add(self, docs: np.ndarray, present: np.ndarray, ids: list[bytes]) -> None:
        self.docs.append(docs)
        self.present.append(present)
        self.sizes.append(np.array([len(i) // 4 for i in ids], np.int64))
        self.waiting += ids
        self.size += sum(map(len, ids))
        if self.size >= 4 * READ_VALUES:
            values = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(values) // pfor.BLOCK * pfor.BLOCK
            self._put(values[:whole])
            self.waiting = [values[whole:].tobytes()]
            self.size = len(self.waiting[0])

    def close(self) -> tuple[int, int]:
        self._put(np.frombuffer(b"".join(self.waiting), "<u4"))
        foot = self.at
        starts = np.concatenate(self.starts)
        docs, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        self.stream.write(starts.astype("<i8").tobytes() + docs.astype("<i8").tobytes())
        self.stream.write(np.concatenate(self.present).astype(np.uint8).tobytes())
        self.stream.write(sizes.astype("<i8").tobytes())
        self.stream.write(struct.pack(_FOOT, foot, len(starts), len(docs), self.values, MAGIC))
        self.stream.close()
        return len(docs), self.values


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int
) -> Iterator[pa.RecordBatch]:
    filesystem, path = open_fs(folder)
    name = f"{uuid.uuid4().hex}.tok"
    writer = None
    end = np.array([end_id], "<u4").tobytes()
    for batch in blocks(batches):
        if writer is None:
            writer = _Writer(filesystem.open_output_stream(f"{path}/{name}"))
        docs = batch.column("doc_id")
        ids = [i + end for i in encoder(tokenizer).encode(batch.column("text"))]
        writer.add(
            docs.fill_null(0).to_numpy(zero_copy_only=False),
            docs.is_valid().to_numpy(zero_copy_only=False),
            ids,
        )
    if writer is not None:
        n_docs, n_tokens = writer.close()
        shard = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}
        )


def write_token_files(
    docs: DataFrame, folder: str | None = None, tokenizer: str = WORD_BPE, end_id: int = END_ID
) -> str:
    """Encodes ``docs`` (doc_id, text) and writes the files; returns their folder.

    Order is by doc_id, nulls first, then by a hash of the text; rows alike in both keep no
    order among themselves, as none could be told.  A null text is empty, so has only the
    end id.  Other columns are ignored.  An empty table gives a folder without token files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(width(docs), "doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie"
    )
    write = partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id)
    found = ranged.drop("tie").mapInArrow(write, MANIFEST)
    found.write.parquet(f"{folder}/manifest")
    return folder


def _documents(stream: pa.NativeFile, first: int) -> Iterator[pa.RecordBatch]:
    """Documents of one file, a bounded number of values at a time."""
    size = stream.size()
    end = size - struct.calcsize(_FOOT)
    foot, n_blocks, n_docs, n_values, magic = struct.unpack(_FOOT, stream.read_at(size - end, end))
    if magic != MAGIC or stream.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a token file")
    tail = stream.read_at(end - foot, foot)
    if len(tail) != 8 * n_blocks + 17 * n_docs:
        raise ValueError("token file is damaged: its footer has another length")
    starts = np.frombuffer(tail, "<i8", n_blocks)
    docs = np.frombuffer(tail, "<i8", n_docs, 8 * n_blocks)
    present = np.frombuffer(tail, np.uint8, n_docs, 8 * (n_blocks + n_docs))
    sizes = np.frombuffer(tail, "<i8", n_docs, 8 * (n_blocks + n_docs) + n_docs)
    ends = np.cumsum(sizes)
    if n_docs and ends[-1] != n_values or n_blocks != -(-n_values // pfor.BLOCK):
        raise ValueError("token file is damaged: its counts disagree")
    bounds = np.append(starts, foot)
    at = 0
    while at < n_docs:
        begin = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + READ_VALUES, side="right")))
        b0, b1 = begin // pfor.BLOCK, -(-int(ends[stop - 1]) // pfor.BLOCK)
        lo = int(bounds[b0])
        data = np.frombuffer(stream.read_at(int(bounds[b1]) - lo, lo), np.uint8)
        values = pfor.decode(data, bounds[b0:b1] - lo)[begin - b0 * pfor.BLOCK :]
        cuts = np.append(0, ends[at:stop] - begin)
        raw = pa.py_buffer(values[: cuts[-1]].astype("<u4").tobytes())
        ids = pa.Array.from_buffers(
            pa.large_binary(), stop - at, [None, pa.py_buffer((4 * cuts).tobytes()), raw]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs[at:stop], mask=present[at:stop] == 0),
                pa.array(first + ends[at:stop] - sizes[at:stop]),
                ids.cast(pa.binary()),
            ],
            ["doc_id", "start", "ids"],
        )
        at = stop


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    filesystem, path = open_fs(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with filesystem.open_input_file(f"{path}/{row['file']}") as stream:
                yield from _documents(stream, row["first"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files), ids.

    ``ids`` holds little-endian unsigned 32-bit integers.  The running sum is over files,
    of which there are as many as there were partitions; each file is read by a task.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first")
    files = manifest.select("file", first).repartition(max(1, manifest.count()))
    return files.mapInArrow(partial(_read, folder=folder), DOCUMENTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the documents table through token files; see :func:`write_token_files`."""
    folder = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(spark, folder).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
