"""Packing along a space-filling curve.

A document's hashed vector is projected to few dimensions; the Hilbert key of that point
orders the documents, so neighbours in a sequence are alike.  Partitions of that order are
concatenated and cut into full sequences.  What is left at a partition's end is cut into
sequences whose lengths are powers of two, so nothing is padded at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import blocks, id_text, mix, through_files, width
from tensorspark.llm.tokens import END_ID, WORD_BPE, encoder

LENGTH = 2048
DIMS = 4
BITS = 8
BUCKETS = 1024
SEED = 7
ENCODED = "doc_id long, curve long, ids binary"
PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequences of a partition are numbered from its own multiple of this.
PER_PARTITION = 1 << 40


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid points (rows) with ``bits`` bits a coordinate.

    Gray-code the corner of each level and undo the turns of the levels above it; at most
    62 bits in all.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(dims):
            turned = (x[d] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level) & 1
    return key


def curve_keys(ids: list[np.ndarray], dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents given by their token ids.

    Root counts of hashed ids, brought to unit length, times a fixed random matrix; a
    logistic curve spreads each coordinate over the grid.
    """
    matrix = np.random.default_rng(SEED).normal(size=(BUCKETS, dims))
    points = np.empty((len(ids), dims))
    for point, one in zip(points, ids, strict=True):
        at = mix(one.astype(np.uint64)) % np.uint64(BUCKETS)
        vector = np.sqrt(np.bincount(at.astype(np.int64), minlength=BUCKETS))
        point[:] = vector @ matrix / max(np.linalg.norm(vector), 1e-9)
    share = 1 / (1 + np.exp(-1.702 * points))
    return hilbert(np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _encode(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, kept: str
) -> Iterator[pa.RecordBatch]:
    """Ids in type ``kept`` until they are packed."""
    end = np.array([end_id], "<u4").tobytes()
    for batch in blocks(batches):
        ids = [i + end for i in encoder(tokenizer).encode(batch.column("text"))]
        ids = [np.frombuffer(i, "<u4") for i in ids]
        keys = curve_keys(ids)
        ids = [i.astype(kept).tobytes() for i in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys), pa.array(ids, pa.binary())],
            ["doc_id", "curve", "ids"],
        )


class _Packer:
    """Cuts a run of documents into sequences; holds the pieces of one open sequence."""

    def __init__(self, length: int, first: int):
        self.length = length
        self.sequence = first
        self.filled = 0
        self.open: list[tuple[int | None, int, int, bytes]] = []
        self.out: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc, start, total, ids in self.open:
            self.out.append((doc, start, total, self.sequence, offset, ids))
            offset += len(ids) // 4
        self.open, self.filled = [], 0
        self.sequence += 1

    def add(self, doc: int | None, start: int, total: int, ids: bytes, length: int) -> None:
        at = 0
        while at < len(ids):
            piece = ids[at : at + 4 * (length - self.filled)]
            self.open.append((doc, start + at // 4, total, piece))
            self.filled += len(piece) // 4
            at += len(piece)
            if self.filled == length:
                self._close()

    def finish(self) -> None:
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        lengths = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        for doc, start, total, ids in rest:
            at = 0
            while at < len(ids):
                take = min(len(ids) - at, 4 * (lengths[0] - self.filled))
                self.add(doc, start + at // 4, total, ids[at : at + take], lengths[0])
                at += take
                if not self.filled:
                    lengths.pop(0)


def _pack(
    batches: Iterator[pa.RecordBatch], length: int, kept: str
) -> Iterator[pa.RecordBatch]:
    packer = _Packer(length, TaskContext.get().partitionId() * PER_PARTITION)
    names = [field.split()[0] for field in PIECES.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary()]

    def flush() -> pa.RecordBatch:
        rows, packer.out = packer.out, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in blocks(batches, "ids"):
        for doc, ids in zip(
            batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True
        ):
            ids = np.frombuffer(ids, kept).astype("<u4").tobytes()
            packer.add(doc, 0, len(ids) // 4, ids, length)
        yield flush()
    packer.finish()
    yield flush()


def pack(
    docs: DataFrame, length: int = LENGTH, tokenizer: str = WORD_BPE, end_id: int = END_ID
) -> DataFrame:
    """Pieces of sequences: doc_id, start, doc_tokens, sequence_id, offset, ids (binary).

    ``length`` must be a power of two.  A null text counts as empty and gives the end id
    alone; a null or repeated doc_id is packed like any other; other columns are ignored; an
    empty table gives no pieces.  Sequence ids have gaps between partitions.  Documents at
    the same point of the curve are ordered by doc_id, so copies are spread over partitions.
    Ids are encoded once and written to the shared folder before they are dealt out.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    largest = max(end_id, *encoder(tokenizer).tokenizer.get_vocab().values())
    kept = "<u2" if largest < 1 << 16 else "<u4"
    encode = partial(_encode, tokenizer=tokenizer, end_id=end_id, kept=kept)
    encoded = through_files(id_text(docs).mapInArrow(encode, ENCODED), "encoded")
    ranged = encoded.repartitionByRange(width(docs), "curve", "doc_id")
    ordered = ranged.sortWithinPartitions("curve", "doc_id").select("doc_id", "ids")
    return ordered.mapInArrow(partial(_pack, length=length, kept=kept), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with length and crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents packed; a row for each piece."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
