"""Copies of a tensor for one mode each, stored so that an MTTKRP needs no exchange.

:class:`BucketedCopy` is a table bucketed and sorted by the mode's index.  Spark reads the
buckets as a hash partitioning, so the sum by index runs where the rows are.  Index values
with more than a bucket's share of the nonzeros would make one bucket as large as they are;
they are stored beside the buckets, dealt evenly, and only their sums are exchanged.

:class:`FiberTree` holds runs: all nonzeros of an index of the mode, inside them all of an
index of a second mode.  The factor row of the second mode is the same along its run, so the
rest of the product is summed first and multiplied by it once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tensorspark.functions.chunks import pack_chunks, unpack
from tensorspark.functions.factors import factor_bytes, factor_columns
from tensorspark.functions.products import PIECES, add_pieces, add_products, pieces_of, rows_schema
from tensorspark.operators.mttkrp import (
    CHUNK_NNZ,
    Factor,
    PackedTensor,
    factor_frame,
    final_sums,
    fits_broadcast,
    hot_indices,
    mttkrp,
    share_factors,
)
from tensorspark.plans.strategy import COLLECT_BYTES
from tensorspark.session import parallelism, scratch_path, side_session
from tensorspark.tensor import SparseTensor

# Bytes of nonzeros in a bucket.
BUCKET_BYTES = 128 << 20
# Ranks up to this are summed by generated code, larger ones by chunk kernels.
SQL_RANK = 8


@dataclass(frozen=True)
class BucketedCopy:
    """A table bucketed by ``i<mode>``, and the rows of its hot values (or none)."""

    tensor: SparseTensor
    mode: int
    cold: DataFrame
    hot: DataFrame | None
    table: str

    @classmethod
    def build(cls, tensor: SparseTensor, n: int, buckets: int | None = None) -> BucketedCopy:
        """Writes the copy below the shared folder and opens it in a session of its own.

        That session sums sorted buckets in order; the caller's settings don't change.
        """
        spark, names = tensor.spark, [*tensor.index_columns, "val"]
        bytes_ = tensor.nnz * (8 * tensor.num_modes + 8)
        buckets = buckets or max(parallelism(spark), -(-bytes_ // BUCKET_BYTES))
        key = f"i{n}"
        df = tensor.df.select(*[F.col(c).cast("bigint") for c in names[:-1]], "val")
        hot_values = sorted(hot_indices(tensor, [n], buckets)[n])
        hot = None
        if hot_values:
            path = scratch_path(spark, f"hot-mode{n}")
            is_hot = F.col(key).isin(hot_values)
            df.where(is_hot).repartition(buckets, F.xxhash64(*names)).write.parquet(path)
            hot, df = spark.read.parquet(path), df.where(~is_hot)
        name = f"tensorspark_mode{n}_{uuid.uuid4().hex}"
        # One file a bucket, so that its rows are in order as a whole.
        dealt = df.repartition(buckets, key).sortWithinPartitions(key)
        writer = dealt.write.bucketBy(buckets, key).sortBy(key)
        writer.option("path", scratch_path(spark, name)).saveAsTable(name)
        session = side_session(
            spark,
            {
                "spark.sql.sources.bucketing.enabled": "true",
                "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
                "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
                "spark.sql.execution.replaceHashWithSortAgg": "true",
            },
        )
        return cls(tensor, n, session.table(name), hot, name)

    def packed(self) -> PackedTensor:
        """The buckets as chunks; every index of the mode lies in one partition."""
        return PackedTensor.of(self.tensor.with_frame(self.cold))

    def packed_whole(self) -> PackedTensor:
        """All nonzeros as chunks: only hot indices lie in several partitions."""
        rows = self.cold if self.hot is None else self.cold.unionByName(self.hot)
        return PackedTensor.of(self.tensor.with_frame(rows))

    def drop(self) -> None:
        """Forgets the table; its files stay in the shared folder."""
        self.cold.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    def mttkrp(self, factors: Sequence[Factor], rank: int) -> DataFrame:
        """``[i, y0 ..]``: joins with broadcast factors, and sums in the order of the scan.

        Ranks above ``SQL_RANK`` are summed by the chunk kernel, also without exchange.
        Factors too large to send whole call for the blocked layout instead; so do those too
        large to pass the driver, where the chunk kernel would collect them.
        """
        n, tensor = self.mode, self.tensor.with_frame(self.cold)
        others = [w for w in range(tensor.num_modes) if w != n]
        sent = sum(factor_bytes(tensor.mode_sizes[w], rank) for w in others)
        fit = all(fits_broadcast(tensor, w, rank, len(others)) for w in others)
        if not fit or rank > SQL_RANK and sent > COLLECT_BYTES:
            return mttkrp(self.tensor, factors, n, rank, "blocked")
        out = (self._chunks if rank > SQL_RANK else self._joined)(factors, rank)
        if self.hot is None:
            return out
        hot = self.tensor.with_frame(self.hot)
        return out.unionByName(mttkrp(hot, factors, n, rank, "arrow"))

    def _joined(self, factors: Sequence[Factor], rank: int) -> DataFrame:
        n, df, products = self.mode, self.cold, [F.col("val")] * rank
        for w in range(self.tensor.num_modes):
            if w == n:
                continue
            names = [f"g{w}_{r}" for r in range(rank)]
            rows = factor_frame(self.tensor, factors[w]).select(
                F.col("i").cast("bigint").alias(f"i{w}"),
                *[F.col(c).alias(g) for c, g in zip(factor_columns(rank), names)],
            )
            df = df.join(F.broadcast(rows), f"i{w}")
            products = [p * F.col(g) for p, g in zip(products, names)]
        sums = [F.sum(p).alias(c) for p, c in zip(products, factor_columns(rank, "y"))]
        return df.groupBy(f"i{n}").agg(*sums).withColumnRenamed(f"i{n}", "i")

    def _chunks(self, factors: Sequence[Factor], rank: int) -> DataFrame:
        """Sums of whole buckets: each index is in one of them, so they are final."""
        packed, sizes, n = self.packed(), self.tensor.mode_sizes, self.mode
        shared = share_factors(packed, factors, [n], rank)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, num_modes = shared.value, len(sizes)

            def pieces() -> Iterator[pa.RecordBatch]:
                # The scan is in order of the index, so chunk after chunk its pieces are too.
                for batch in batches:
                    for row in range(batch.num_rows):
                        idx, val = unpack(batch, row, num_modes)
                        ids, to = np.unique(idx[n], return_inverse=True)
                        sums = np.zeros((rank, len(ids)))
                        add_products(idx, val, tables, {n: sums}, {n: to})
                        yield from pieces_of(n, ids, sums)

            yield from add_pieces(pieces(), rank)

        return packed.df.mapInArrow(run, rows_schema(rank)).drop("mode")


# ---- fibers with two keys ----------------------------------------------------


def second_mode(tensor: SparseTensor, n: int) -> int:
    """The mode that has fewest different indices together with mode ``n`` (estimated)."""
    others = [w for w in range(tensor.num_modes) if w != n]
    counts = [
        F.approx_count_distinct(F.xxhash64(f"i{n}", f"i{w}"), 0.02).alias(f"p{w}") for w in others
    ]
    row = tensor.df.agg(*counts).first()
    return min(others, key=lambda w: row[f"p{w}"])


def fiber_runs(outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids and first places of the runs of sorted nonzeros.

    Ids of the outer runs, their first inner runs; ids of the inner runs, their first
    nonzeros.
    """
    new = np.ones(len(outer), bool)
    new[1:] = (outer[1:] != outer[:-1]) | (inner[1:] != inner[:-1])
    at = np.flatnonzero(new)
    top = outer[at]
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else at
    return top[first], first, inner[at], at


def fiber_sums(
    runs: Sequence[np.ndarray],
    rest: Sequence[np.ndarray],
    val: np.ndarray,
    inner_table: np.ndarray,
    tables: Sequence[np.ndarray],
) -> tuple[np.ndarray, int]:
    """Sums of each outer run, by component, and the multiplications for a component.

    ``tables[k]`` is read at ``rest[k]`` for every nonzero, ``inner_table`` once for a fiber.
    """
    outer, outer_at, inner, inner_at = runs
    rank = len(inner_table)
    out = np.empty((rank, len(outer)))
    rest, inner = [x.astype(np.intp) for x in rest], inner.astype(np.intp)
    product, row = np.empty(len(val)), np.empty(len(val))
    for r in range(rank):
        leaf = val
        for place, table in zip(rest, tables):
            np.take(table[r], place, out=row, mode="clip")
            leaf = np.multiply(leaf, row, out=product)
        fibers = np.add.reduceat(leaf, inner_at)
        fibers *= inner_table[r][inner]
        out[r] = np.add.reduceat(fibers, outer_at)
    return out, len(val) * len(rest) + len(inner)


@dataclass(frozen=True)
class FiberTree:
    """Chunks of nonzeros as two levels of runs, in order of mode ``n`` and a second mode.

    ``[outer, outer_at, inner, inner_at, i<rest> .., val]`` as raw buffers.  Chunks are cut
    by count along all coordinates, so a long fiber becomes several runs in several chunks,
    and repeated coordinates, which can't be cut apart by range, still leave one chunk after
    another.
    """

    df: DataFrame
    mode: int
    second: int
    mode_sizes: tuple[int, ...]

    @classmethod
    def build(
        cls,
        tensor: SparseTensor,
        n: int,
        second: int | None = None,
        chunk_nnz: int = CHUNK_NNZ,
        parts: int | None = None,
    ) -> FiberTree:
        w = second_mode(tensor, n) if second is None else second
        rest = [k for k in range(tensor.num_modes) if k not in (n, w)]
        order = [f"i{k}" for k in (n, w, *rest)]
        # Merged map-side first: a repeated coordinate is one nonzero of a range.
        ranged = tensor.merged_frame().repartitionByRange(*([parts] if parts else []), *order)
        sorted_ = ranged.sortWithinPartitions(*order).select(*tensor.index_columns, "val")
        pack = pack_chunks(tensor.num_modes, chunk_nnz)
        names = ["outer", "outer_at", "inner", "inner_at", *[f"i{k}" for k in rest], "val"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in pack(batches):
                idx, val = unpack(chunk, 0, len(order))
                runs = [x.astype("<u4") for x in fiber_runs(idx[n], idx[w])]
                columns = [*runs, *[idx[k] for k in rest], val]
                yield pa.record_batch(
                    [pa.array([c.tobytes()], pa.binary()) for c in columns], names=names
                )

        schema = ", ".join(f"{c} binary" for c in names)
        return cls(sorted_.mapInArrow(run, schema), n, w, tensor.mode_sizes)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> FiberTree:
        self.df.persist(level)
        return self

    def mttkrp(self, factors: Sequence[Factor], rank: int) -> DataFrame:
        """``[i, y0 ..]``; the size of the factors is checked before they are sent."""
        n, w, names = self.mode, self.second, self.df.columns
        packed = PackedTensor(self.df, self.mode_sizes)
        shared = share_factors(packed, factors, [n], rank)
        rest = [int(c[1:]) for c in names[4:-1]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    buffers = [batch.column(c)[row].as_buffer() for c in names]
                    columns = [np.frombuffer(b, "<u4") for b in buffers[:-1]]
                    val = np.frombuffer(buffers[-1], "<f8")
                    sums, _ = fiber_sums(
                        columns[:4], columns[4:], val, tables[w], [tables[k] for k in rest]
                    )
                    yield from pieces_of(n, columns[0], sums)

        return final_sums(self.df.mapInArrow(run, PIECES), rank).drop("mode")
