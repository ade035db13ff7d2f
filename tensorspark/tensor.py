"""The sparse tensor: a DataFrame of nonzeros plus a few driver-side numbers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorspark.functions.morton import MortonPlan
from tensorspark.session import materialize, scratch_path

MAX_MODES = 8
MAX_MODE_SIZE = 2**32  # indices are unsigned 32-bit in the binary format


def index_columns(num_modes: int) -> list[str]:
    return [f"i{n}" for n in range(num_modes)]


def _as_column(expr: Column | str) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


@dataclass(frozen=True)
class SparseTensor:
    """Nonzeros ``(i0 .. i{N-1}, val)``, zero-based, in any order.

    ``distinct`` records whether every coordinate is known to occur once.  Repeated
    coordinates are legal and kept; they are merged only by :meth:`combined`.
    """

    df: DataFrame
    mode_sizes: tuple[int, ...]
    nnz: int
    norm_sq: float
    distinct: bool = False

    # ---- construction ------------------------------------------------------

    @classmethod
    def from_frame(
        cls,
        df: DataFrame,
        mode_sizes: Sequence[int] | None = None,
        distinct: bool = False,
        keep: bool = False,
    ) -> SparseTensor:
        """Wrap a frame that already has columns ``i0 .. i{N-1}, val``.

        One aggregation finds the sizes, the count and the squared norm and checks every
        index.  With ``keep=True`` the frame is written to the checkpoint folder in the
        same pass; use it when the frame is costly to compute, such as a join.
        """
        num_modes = sum(1 for c in df.columns if c != "val")
        if not 1 <= num_modes <= MAX_MODES:
            raise ValueError(f"tensor needs 1 to {MAX_MODES} modes, got {num_modes}")
        idx = index_columns(num_modes)
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*idx, "val"]])
        measures = [
            F.count(F.lit(1)).alias("nnz"),
            F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("norm_sq"),
            F.count(F.when(any_null, 1)).alias("nulls"),
            *[F.max(c).cast("bigint").alias(f"max_{c}") for c in idx],
            *[F.min(c).cast("bigint").alias(f"min_{c}") for c in idx],
        ]
        if keep:
            seen = Observation()
            df = materialize(df.observe(seen, *measures))
            row = seen.get
        else:
            row = df.agg(*measures).first().asDict()
        if row["nnz"] == 0:
            raise ValueError("tensor has no nonzeros")
        if row["nulls"]:
            raise ValueError(f"{row['nulls']} rows have a NULL index or value")
        if min(row[f"min_{c}"] for c in idx) < 0:
            raise ValueError("negative index")
        sizes = [row[f"max_{c}"] + 1 for c in idx]
        if mode_sizes is not None:
            sizes = [max(a, int(b)) for a, b in zip(sizes, mode_sizes, strict=True)]
        if max(sizes) > MAX_MODE_SIZE:
            raise ValueError("index does not fit into unsigned 32 bits")
        return cls(df, tuple(sizes), row["nnz"], float(row["norm_sq"]), distinct)

    @classmethod
    def from_table(
        cls,
        table: DataFrame,
        dims: Sequence[Column | str],
        value: Column | str,
        combine: bool = True,
        mode_sizes: Sequence[int] | None = None,
        keep: bool | None = None,
    ) -> SparseTensor:
        """Build a tensor from any table (see :func:`tensor_frame`) and measure it.

        A combined tensor is kept by default, so its GROUP BY runs once.
        """
        df = tensor_frame(table, dims, value, combine)
        keep = combine if keep is None else keep
        return cls.from_frame(df, mode_sizes, distinct=combine, keep=keep)

    # ---- simple views ------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def num_modes(self) -> int:
        return len(self.mode_sizes)

    @property
    def index_columns(self) -> list[str]:
        return index_columns(self.num_modes)

    def merged_frame(self) -> DataFrame:
        """The nonzeros with repeated coordinates summed.

        The sum runs map-side first, so a coordinate that holds a large share of all
        rows reaches the shuffle as one row per map task.
        """
        return self.df if self.distinct else combine_coordinates(self.df)

    def combined(self) -> SparseTensor:
        """The tensor of :meth:`merged_frame`, measured again: merging changes the norm."""
        if self.distinct:
            return self
        return SparseTensor.from_frame(
            self.merged_frame(), self.mode_sizes, distinct=True, keep=True
        )

    def with_frame(self, df: DataFrame) -> SparseTensor:
        return replace(self, df=df)

    def bucketed(self, n: int, buckets: int | None = None):
        """A copy bucketed and sorted by mode ``n``: its MTTKRP needs no exchange."""
        from tensorspark.operators.copies import BucketedCopy

        return BucketedCopy.build(self, n, buckets)

    # ---- saved state -------------------------------------------------------

    def save(self, path: str, source: str = "") -> None:
        """Write the analysed tensor: Parquet plus its measured numbers.

        ``source`` identifies what it was made from; see :meth:`load`.
        """
        self.df.write.mode("overwrite").parquet(f"{path}/nonzeros")
        meta = {
            "mode_sizes": list(self.mode_sizes),
            "nnz": self.nnz,
            "norm_sq": self.norm_sq,
            "distinct": self.distinct,
            "source": source,
        }
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, source: str | None = None) -> SparseTensor:
        """Open a saved tensor without scanning its nonzeros.

        Fails if it was made from something else than ``source``, where that is given.
        """
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        if source is not None and meta.get("source") != source:
            raise ValueError(f"{path}: saved from another source")
        return cls(
            spark.read.parquet(f"{path}/nonzeros"),
            tuple(meta["mode_sizes"]),
            meta["nnz"],
            meta["norm_sq"],
            meta["distinct"],
        )


def tensor_frame(
    table: DataFrame, dims: Sequence[Column | str], value: Column | str, combine: bool = True
) -> DataFrame:
    """Nonzeros of a table: one integer expression per mode, and a measure.

    ``combine=True`` sums the measure per coordinate.  MTTKRP is linear in the values, so
    callers that only need it pass ``combine=False`` and save that shuffle.  Indices are
    BIGINT; an expression that gives a fraction is an error.
    """
    names = index_columns(len(dims))
    raw = table.select(*[_as_column(d).alias(c) for d, c in zip(dims, names)])
    index = []
    for d, c in zip(dims, names):
        column, whole = _as_column(d), _as_column(d).cast("bigint")
        if not isinstance(raw.schema[c].dataType, T.IntegralType):
            wrong = F.raise_error(F.concat(F.lit("not a whole index: "), column.cast("string")))
            whole = F.when(column.isNull() | (column == whole), whole).otherwise(wrong.cast("bigint"))
        index.append(whole.alias(c))
    df = table.select(*index, _as_column(value).cast("double").alias("val"))
    return combine_coordinates(df) if combine else df


def combine_coordinates(df: DataFrame) -> DataFrame:
    """``GROUP BY`` all index columns, summing ``val``."""
    idx = [c for c in df.columns if c != "val"]
    return df.groupBy(*idx).agg(F.sum("val").alias("val"))


def sorted_by_key(tensor: SparseTensor) -> tuple[DataFrame, MortonPlan]:
    """``[key, val]`` in Z-order of its keys."""
    plan = MortonPlan.of(tensor.mode_sizes)
    key = plan.encode([F.col(c) for c in tensor.index_columns]).alias("key")
    order = plan.order(F.col("key"))
    keyed = tensor.df.select(key, "val")
    # The value last: a retried task repeats the order also where a coordinate is repeated.
    return keyed.repartitionByRange(order).sortWithinPartitions(order, "val"), plan


def write_by_key(tensor: SparseTensor) -> tuple[DataFrame, MortonPlan]:
    """``[key, val]`` written in Z-order of its keys, and opened again."""
    keyed, plan = sorted_by_key(tensor)
    path = scratch_path(tensor.spark, "morton")
    keyed.write.parquet(path)
    return tensor.spark.read.parquet(path), plan


def by_indices(stored: DataFrame, plan: MortonPlan) -> DataFrame:
    """Nonzeros of stored keys."""
    return stored.select(*[c.alias(f"i{n}") for n, c in enumerate(plan.decode(F.col("key")))], "val")


def morton_stored(tensor: SparseTensor) -> SparseTensor:
    """The tensor kept as keys and values only; indices are decoded as it is read."""
    return tensor.with_frame(by_indices(*write_by_key(tensor)))
