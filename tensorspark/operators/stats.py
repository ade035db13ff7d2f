"""Shape and layout statistics of a tensor.

All modes come from one pass: each nonzero contributes one ``(mode, index)`` pair per
mode, and the counts are combined map-side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorspark.session import materialize
from tensorspark.tensor import SparseTensor

# Rows of a mode are counted in at most this many ranges.
RANGES = 64
# Rows of a range inside which one task takes running sums.
RANGE_ROWS = 1 << 14


def _pairs(tensor: SparseTensor, index: list[Column] | None = None) -> DataFrame:
    """``(mode, i)`` for every nonzero and mode."""
    index = index or [F.col(c) for c in tensor.index_columns]
    structs = [
        F.struct(F.lit(n).alias("mode"), c.cast("bigint").alias("i")) for n, c in enumerate(index)
    ]
    return tensor.df.select(F.inline(F.array(*structs)))


def mode_sizes(nonzeros: DataFrame) -> DataFrame:
    """``[mode, size, nnz]`` of a frame ``i0 .. val``, from one aggregate."""
    index = [c for c in nonzeros.columns if c != "val"]
    sums = nonzeros.agg(
        F.count(F.lit(1)).alias("nnz"),
        *[(F.max(c).cast("bigint") + 1).alias(c) for c in index],
    )
    rows = [
        F.struct(F.lit(n).alias("mode"), F.col(c).alias("size"), F.col("nnz"))
        for n, c in enumerate(index)
    ]
    return sums.select(F.inline(F.array(*rows)))


def fiber_stats(nonzeros: DataFrame) -> DataFrame:
    """Average nonzeros per row of each mode."""
    length = (F.col("nnz").cast("double") / F.col("size")).alias("avg_fiber_len")
    return mode_sizes(nonzeros).select("mode", "size", "nnz", length)


def row_counts(tensor: SparseTensor) -> DataFrame:
    """Nonzeros per touched row: ``[mode, i, nnz]``."""
    return _pairs(tensor).groupBy("mode", "i").agg(F.count(F.lit(1)).alias("nnz"))


def touched_counts(tensor: SparseTensor, modes: list[int]) -> DataFrame:
    """``[mode, touched]`` by bitmaps: each task sends one for each 2^15 rows that it meets.

    A shuffled bitmap takes 4 kB, whatever the number of its rows.
    """
    pairs = _pairs(tensor).where(F.col("mode").isin(modes))
    place = F.col("i") + 1  # bitmaps start at one
    bitmaps = pairs.select(
        "mode",
        F.bitmap_bucket_number(place).alias("bucket"),
        F.bitmap_bit_position(place).alias("bit"),
    )
    bitmaps = bitmaps.groupBy("mode", "bucket").agg(F.bitmap_construct_agg("bit").alias("rows"))
    return bitmaps.groupBy("mode").agg(F.sum(F.bitmap_count("rows")).alias("touched"))


def touched_rows(tensor: SparseTensor) -> DataFrame:
    """Rows holding at least one nonzero, per mode.

    Modes with fewer nonzeros than rows have bitmaps that are mostly empty; their pairs are
    made distinct instead.
    """
    dense = [n for n, s in enumerate(tensor.mode_sizes) if tensor.nnz >= s]
    sparse = [n for n in range(tensor.num_modes) if n not in dense]
    touched = touched_counts(tensor, dense) if dense else None
    if sparse:
        pairs = _pairs(tensor).where(F.col("mode").isin(sparse)).distinct()
        rest = pairs.groupBy("mode").agg(F.count(F.lit(1)).alias("touched"))
        touched = touched.unionByName(rest) if touched else rest
    sizes = F.array(*[F.lit(s).cast("bigint") for s in tensor.mode_sizes])
    return touched.withColumn("size", F.get(sizes, F.col("mode"))).select(
        "mode", "size", "touched", (F.col("size") - F.col("touched")).alias("untouched")
    )


def mode_marginals(nonzeros: DataFrame) -> DataFrame:
    """Count and sum of the nonzeros of each row of each mode: ``[mode, i, nnz, total]``.

    One statement over all modes: grouping sets of one index each.  The sums are the MTTKRP
    with factors of ones.
    """
    index = [c for c in nonzeros.columns if c != "val"]
    sets = nonzeros.groupingSets([[c] for c in index], *index).agg(
        F.grouping_id().alias("set"),
        F.count(F.lit(1)).alias("nnz"),
        F.sum("val").alias("total"),
    )
    # The bit of each index that is left out of a set is one, from the first index down.
    every = (1 << len(index)) - 1
    mode, row = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for n, c in enumerate(index):
        own = F.col("set") == every - (1 << (len(index) - 1 - n))
        mode, row = F.when(own, n).otherwise(mode), F.when(own, F.col(c).cast("bigint")).otherwise(row)
    return sets.select(mode.alias("mode"), row.alias("i"), "nnz", "total")


def range_bits(mode_size: int, ranges: int = RANGES) -> int:
    """Low index bits to drop so that a mode has at most ``ranges`` (a power of two) ranges."""
    return max(0, (mode_size - 1).bit_length() - (ranges.bit_length() - 1))


def range_counts(tensor: SparseTensor, ranges: int = RANGES) -> DataFrame:
    """Nonzeros in equal ranges of rows: ``[mode, shard, nnz]``, non-empty ranges only."""
    place = [
        F.shiftright(F.col(f"i{n}").cast("bigint"), range_bits(s, ranges))
        for n, s in enumerate(tensor.mode_sizes)
    ]
    return (
        _pairs(tensor, place)
        .groupBy("mode", F.col("i").alias("shard"))
        .agg(F.count(F.lit(1)).alias("nnz"))
    )


def range_offsets(counts: DataFrame) -> DataFrame:
    """Positions of each range in a mode-sorted tensor; the window runs over ranges."""
    before = Window.partitionBy("mode").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("nnz").over(before), F.lit(0).cast("bigint"))
    return counts.select(
        "mode",
        "shard",
        start.alias("shard_begin"),
        (start + F.col("nnz")).alias("shard_end"),
    )


def csr_rowptr(tensor: SparseTensor, n: int) -> DataFrame:
    """Begin and end of every touched row in a mode-``n``-sorted tensor.

    A running sum over a whole mode would put it into one task.  Counts per row are taken
    once and kept; offsets are taken per range of ``RANGE_ROWS`` rows first (at most 2^18
    of them, as indices have 32 bits) and completed by a running sum inside each range.
    """
    rows = materialize(
        tensor.df.groupBy(F.col(f"i{n}").cast("bigint").alias("i"))
        .agg(F.count(F.lit(1)).alias("nnz"))
        .withColumn("shard", F.shiftright("i", RANGE_ROWS.bit_length() - 1))
    )
    per_range = rows.groupBy("shard").agg(F.sum("nnz").alias("nnz"))
    starts = range_offsets(per_range.withColumn("mode", F.lit(n))).select("shard", "shard_begin")
    inside = Window.partitionBy("shard").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("nnz").over(inside), F.lit(0).cast("bigint"))
    located = rows.withColumn("local", local).join(starts, "shard")
    begin = F.col("shard_begin") + F.col("local")
    return located.select("i", begin.alias("row_begin"), (begin + F.col("nnz")).alias("row_end"))


def mode_sorted(tensor: SparseTensor, n: int, parts: int | None = None) -> SparseTensor:
    """A copy of the tensor ordered by mode ``n``, then by the other modes.

    Ranges are cut over all coordinates, so a row that holds much of the tensor is spread
    over several partitions; partial aggregation then collapses the sorted runs.
    """
    order = [f"i{n}", *[c for c in tensor.index_columns if c != f"i{n}"]]
    df = tensor.df.repartitionByRange(*([parts] if parts else []), *order)
    return tensor.with_frame(df.sortWithinPartitions(*order))
