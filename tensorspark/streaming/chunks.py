"""MTTKRP over a growing ``.dnb`` folder, chunk by chunk, restartable from its checkpoint.

The source's offset is a number of nonzeros in the order of the manifest, so it doesn't
depend on the chunk size.  Each batch adds its sums to those of the batch before and writes
them under its own number: a batch that runs twice, after a failure between its output and
its commit, writes the same table again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tensorspark.functions.factors import factor_bytes, factor_columns, from_dense
from tensorspark.operators.blocked import BlockedTensor, layout_partitions, mttkrp_all_blocked
from tensorspark.operators.mttkrp import (
    Factor,
    PackedTensor,
    arrow_partials,
    final_sums,
    share_factors,
)
from tensorspark.plans.strategy import COLLECT_BYTES
from tensorspark.session import parallelism
from tensorspark.sources import files
from tensorspark.sources.dnb import CHUNK_BYTES, WIDTH, Chunk, dnb_schema, read_chunk, read_parts
from tensorspark.tensor import SparseTensor

# Tasks that read a batch; where it has more chunks, a task reads several in turn.
TASKS = 256
_STATE = re.compile(r"batch-(\d{12})\Z")


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, chunk_nnz: int | None):
        self.path = path
        self.most = max(1, CHUNK_BYTES // (WIDTH * len(schema.fields)))
        self.chunk_nnz = chunk_nnz or self.most

    def initialOffset(self) -> dict:
        return {"nnz": 0}

    def latestOffset(self) -> dict:
        return {"nnz": sum(n for _, n in read_parts(self.path)[0])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Chunks of the nonzeros from ``start`` to ``end``; parts keep their order.

        A partition costs a task some 80 ms, so many small chunks of a part share one.
        """
        out, at = [], 0
        chunks = -(-(end["nnz"] - start["nnz"]) // self.chunk_nnz)
        each = self.chunk_nnz * max(1, min(-(-chunks // TASKS), self.most // self.chunk_nnz))
        for path, nnz in read_parts(self.path)[0]:
            lo, hi = max(start["nnz"], at) - at, min(end["nnz"], at + nnz) - at
            for first in range(lo, hi, each):
                out.append(Chunk(path, first, min(each, hi - first)))
            at += nnz
        if at < end["nnz"]:
            raise ValueError(f"{self.path}: holds {at} nonzeros, not the {end['nnz']} seen before")
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        end = partition.first + partition.count
        for first in range(partition.first, end, self.chunk_nnz):
            yield from read_chunk(partition.path, first, min(self.chunk_nnz, end - first))


class DnbStream(DataSource):
    """``spark.readStream.format("dnb-chunks").load(folder)``; option ``chunk_nnz``."""

    @classmethod
    def name(cls) -> str:
        return "dnb-chunks"

    def schema(self) -> str:
        return dnb_schema(read_parts(self.options["path"])[1])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        chunk = self.options.get("chunk_nnz")
        return _StreamReader(self.options["path"], schema, int(chunk) if chunk else None)


def stream_chunks(spark: SparkSession, path: str, chunk_nnz: int | None = None) -> DataFrame:
    """The nonzeros of a ``.dnb`` folder as a stream; parts appended later follow."""
    spark.dataSource.register(DnbStream)
    reader = spark.readStream.format("dnb-chunks")
    if chunk_nnz:
        reader = reader.option("chunk_nnz", str(chunk_nnz))
    return reader.load(path)


class StreamedSums:
    """MTTKRP sums of all modes, kept below ``folder`` from batch to batch.

    ``folder/sums/batch-<number>`` holds the sums up to a batch, ``folder/checkpoint`` what
    the stream has read.  Factors must be the same in every run; their number of rows bounds
    the indices that may come.  Factors too large to pass the driver are given as DataFrames;
    their rows travel by demand to the cells of a batch.
    """

    def __init__(self, path: str, factors: Sequence[Factor], rank: int, folder: str):
        self.path, self.factors, self.rank, self.folder = path, factors, rank, folder

    def _numbers(self) -> list[int]:
        """Batches whose sums are complete."""
        filesystem, place = files.open_fs(files.join(self.folder, "sums"))
        found = []
        for name in files.folders(filesystem, place):
            match = _STATE.match(name)
            if match and "_SUCCESS" in files.names(filesystem, files.join(place, name)):
                found.append(int(match[1]))
        return sorted(found)

    def _table(self, number: int) -> str:
        return files.join(self.folder, "sums", f"batch-{number:012d}")

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds one batch; the same number gives the same table, however often it runs."""
        parts, sizes = read_parts(self.path)
        modes, shared = list(range(len(sizes))), None
        if sum(factor_bytes(s, self.rank) for s in sizes) <= COLLECT_BYTES:
            packed = PackedTensor.pack(batch, sizes)
            shared = share_factors(packed, self.factors, modes, self.rank)
            sums = final_sums(arrow_partials(packed, shared, modes, self.rank), self.rank)
        else:
            sums = self._by_demand(batch, sizes, sum(n for _, n in parts))
        before = [n for n in self._numbers() if n < number]
        if before:
            known = batch.sparkSession.read.parquet(self._table(before[-1]))
            columns = factor_columns(self.rank, "y")
            both = known.unionByName(sums).groupBy("mode", "i")
            sums = both.agg(*[F.sum(c).alias(c) for c in columns])
        sums.write.mode("overwrite").parquet(self._table(number))
        if shared is not None:
            shared.destroy()
        # The last two stay: the one before is read again if this batch is repeated.
        filesystem, place = files.open_fs(files.join(self.folder, "sums"))
        for old in before[:-1]:
            filesystem.delete_dir(files.join(place, f"batch-{old:012d}"))

    def _by_demand(self, batch: DataFrame, sizes: tuple[int, ...], most: int) -> DataFrame:
        """Sums of a batch of up to ``most`` nonzeros, laid out for large factors."""
        spark = batch.sparkSession
        cores = spark.sparkContext.defaultParallelism
        # One task reads many chunks: a shuffle has a block for each pair of tasks.
        tasks = layout_partitions(most, len(sizes), cores, parallelism(spark))
        tensor = SparseTensor(batch.coalesce(tasks), sizes, most, norm_sq=0.0)
        frames = [f if isinstance(f, DataFrame) else from_dense(spark, f) for f in self.factors]
        return mttkrp_all_blocked(BlockedTensor.build(tensor, self.rank), frames, self.rank)

    def run(self, spark: SparkSession, chunk_nnz: int | None = None) -> DataFrame | None:
        """Reads what is new, then stops; ``[mode, i, y0 ..]`` of all read so far."""
        stream = stream_chunks(spark, self.path, chunk_nnz).writeStream
        stream = stream.foreachBatch(self.add).trigger(availableNow=True)
        checkpoint = files.join(self.folder, "checkpoint")
        stream.option("checkpointLocation", checkpoint).start().awaitTermination()
        numbers = self._numbers()
        return spark.read.parquet(self._table(numbers[-1])) if numbers else None
