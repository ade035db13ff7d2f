"""Named queries over the standard tables, one per operator.

Three tensors come from the tables:

``supply``   supplier x part x month of shipment, summed quantity (very sparse)
``market``   customer nation x order priority x return flag x line number (dense)
``activity`` user x event type x day, number of events (in between)

Measures and factors are integers, so sums are exact in any order and results can be
compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.functions import dense
from tensorspark.functions.factors import (
    factor_bytes,
    factor_columns,
    integer_factor_array,
    integer_factors,
)
from tensorspark.functions.morton import MortonPlan
from tensorspark.operators import linalg, mttkrp as mt, stats, validate
from tensorspark.operators.blocked import BlockedTensor, mttkrp_all_blocked, mttkrp_blocked
from tensorspark.operators.copies import FiberTree
from tensorspark.operators.cpals import CpOptions, cpals
from tensorspark.operators.keyed import KeyChunks
from tensorspark.session import scratch_path
from tensorspark.sources import factor_files
from tensorspark.sources.dnb import append_frame, read_dnb, write_dnb, write_frame
from tensorspark.sources.reader import read_tensor
from tensorspark.sources.tns import format_lines, parse_lines, read_tns, write_tns
from tensorspark.streaming.chunks import StreamedSums
from tensorspark.tensor import SparseTensor, morton_stored, tensor_frame, write_by_key

RANK = 4

Query = Callable[[SparkSession, str], DataFrame]

SUPPLY_DIMS = ["l_suppkey", "l_partkey", "year(l_shipdate) * 12 + month(l_shipdate) - 23941"]


def _code(found: str, column: str) -> str:
    """A code from 0 for a position found from 1; values not in the list fail the query."""
    unknown = f"raise_error(concat('unknown {column}: ', coalesce({column}, 'NULL')))"
    return f"coalesce(nullif({found}, 0), {unknown}) - 1"


MARKET_DIMS = [
    "c_nationkey",
    "cast(substring(o_orderpriority, 1, 1) as int) - 1",
    _code("instr('ANR', l_returnflag)", "l_returnflag"),
    "l_linenumber - 1",
]
EVENT_TYPES = "array('click', 'error', 'purchase', 'signup', 'view')"
ACTIVITY_DIMS = [
    "user_id",
    _code(f"array_position({EVENT_TYPES}, event_type)", "event_type"),
    "datediff(ts, date'2024-01-01')",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_frame(
    spark: SparkSession, sf_dir: str, combine: bool = True, modes: int = 3
) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return tensor_frame(lineitem, SUPPLY_DIMS[:modes], "l_quantity", combine)


def supply(spark: SparkSession, sf_dir: str, combine: bool = False, modes: int = 3) -> SparseTensor:
    frame = supply_frame(spark, sf_dir, combine, modes)
    return SparseTensor.from_frame(frame, distinct=combine, keep=combine)


def supply5(spark: SparkSession, sf_dir: str) -> SparseTensor:
    lineitem = _table(spark, sf_dir, "lineitem")
    dims = [*SUPPLY_DIMS, MARKET_DIMS[2], MARKET_DIMS[3]]
    return SparseTensor.from_table(lineitem, dims, "l_quantity", combine=False)


def market_frame(spark: SparkSession, sf_dir: str, combine: bool = True) -> DataFrame:
    """Lineitem joined with orders and customers; customers are joined to orders first,
    so the larger join carries only three narrow columns."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = (
        _table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_orderpriority", "c_nationkey")
    )
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_quantity"
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return tensor_frame(joined, MARKET_DIMS, "l_quantity", combine)


def market(spark: SparkSession, sf_dir: str, combine: bool = False) -> SparseTensor:
    frame = market_frame(spark, sf_dir, combine)
    return SparseTensor.from_frame(frame, distinct=combine, keep=True)


def activity_frame(spark: SparkSession, sf_dir: str, combine: bool = True) -> DataFrame:
    return tensor_frame(_table(spark, sf_dir, "events"), ACTIVITY_DIMS, "1", combine)


def activity(spark: SparkSession, sf_dir: str, combine: bool = False) -> SparseTensor:
    frame = activity_frame(spark, sf_dir, combine)
    return SparseTensor.from_frame(frame, distinct=combine, keep=combine)


def _arrays(tensor: SparseTensor, rank: int) -> list[np.ndarray]:
    return [integer_factor_array(s, n, rank) for n, s in enumerate(tensor.mode_sizes)]


def _supply_mttkrp(strategy: Callable, n: int, rank: int = RANK) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = supply(spark, sf_dir)
        return strategy(t, integer_factors(spark, t.mode_sizes, rank), n, rank)

    return query


# ---- tensor construction and statistics --------------------------------------


def tensor_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_frame(spark, sf_dir)


def events_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_frame(spark, sf_dir)


def market_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_frame(spark, sf_dir)


def coalesce_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_frame(spark, sf_dir, modes=2)


def mode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode_sizes(supply_frame(spark, sf_dir))


def tensor_norm_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.tensor_norm_sq(supply_frame(spark, sf_dir))


def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.touched_rows(supply(spark, sf_dir))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.row_counts(supply(spark, sf_dir, combine=True))


def fiber_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fiber_stats(supply_frame(spark, sf_dir))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonzeros per range of rows."""
    return stats.range_counts(supply(spark, sf_dir))


def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.range_offsets(stats.range_counts(supply(spark, sf_dir)))


def csr_rowptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.csr_rowptr(supply(spark, sf_dir), 1)


# ---- MTTKRP ------------------------------------------------------------------


def mttkrp_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    return mt.mttkrp_long(t, integer_factors(spark, t.mode_sizes, RANK), 0, RANK)


def mttkrp_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    return mt.mttkrp_arrow(t, _arrays(t, 16), 1, 16)


def mttkrp_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    return mt.mttkrp_all_arrow(t, _arrays(t, RANK), RANK)


def mttkrp_blocked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    blocked = BlockedTensor.build(t, RANK)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return mttkrp_blocked(blocked, factors, 2, RANK, broadcast_bytes=0)


def mttkrp_blocked_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest factor travels by demand, the others are broadcast."""
    t = supply(spark, sf_dir)
    sizes = sorted(t.mode_sizes)
    limit = sum(factor_bytes(s, RANK) for s in sizes[:-1])
    blocked = BlockedTensor.build(t, RANK)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return mttkrp_all_blocked(blocked, factors, RANK, broadcast_bytes=limit)


def mttkrp_blocked_wide_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared mode sizes whose full Z-order key would need 84 bits."""
    t = supply(spark, sf_dir)
    wide = SparseTensor.from_frame(t.df, [1 << 28] * 3)
    blocked = BlockedTensor.build(wide, RANK, cell_nnz=1024)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return mttkrp_blocked(blocked, factors, 0, RANK, broadcast_bytes=0)


def mttkrp_all_modes_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    blocked = BlockedTensor.build(t, RANK)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return mttkrp_all_blocked(blocked, factors, RANK, broadcast_bytes=0)


def mttkrp_mode_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.mode_sorted(supply(spark, sf_dir), 1)
    return mt.mttkrp_wide(t, integer_factors(spark, t.mode_sizes, RANK), 1, RANK)


def mttkrp_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    return t.bucketed(1).mttkrp(integer_factors(spark, t.mode_sizes, RANK), RANK)


def mttkrp_bucketed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy for each mode, summed by the chunk kernel."""
    t = supply(spark, sf_dir)
    factors = integer_factors(spark, t.mode_sizes, 16)
    outs = [
        t.bucketed(n).mttkrp(factors, 16).select(F.lit(n).alias("mode"), "*")
        for n in range(t.num_modes)
    ]
    return reduce(DataFrame.unionByName, outs)


def mttkrp_fiber_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir)
    return FiberTree.build(t, 0).mttkrp(_arrays(t, RANK), RANK)


def _declared_wide(spark: SparkSession, sf_dir: str) -> tuple[SparseTensor, list[DataFrame]]:
    """Modes declared with 2^28 rows, of which few occur."""
    t = supply(spark, sf_dir)
    wide = SparseTensor.from_frame(t.df, [1 << 28] * t.num_modes)
    return wide, integer_factors(spark, t.mode_sizes, RANK)


def mttkrp_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy is chosen by the rows that occur."""
    wide, factors = _declared_wide(spark, sf_dir)
    return mt.mttkrp(wide, factors, 0, RANK)


def mttkrp_compact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, factors = _declared_wide(spark, sf_dir)
    return mt.mttkrp_all(wide, factors, RANK)


def mode_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode_marginals(supply_frame(spark, sf_dir, combine=False))


def mttkrp_2mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir, modes=2)
    return mt.mttkrp(t, integer_factors(spark, t.mode_sizes, RANK), 0, RANK)


def mttkrp_4mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    return mt.mttkrp(t, _arrays(t, RANK), 0, RANK)


def mttkrp_5mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply5(spark, sf_dir)
    return mt.mttkrp_all(t, _arrays(t, 2), 2)


def events_mttkrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = activity(spark, sf_dir)
    return mt.mttkrp(t, _arrays(t, RANK), 0, RANK)


def compare_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the MTTKRP moves when returned lines are left out."""
    lineitem = _table(spark, sf_dir, "lineitem")
    full = supply(spark, sf_dir)
    kept = SparseTensor.from_table(
        lineitem.where("l_returnflag <> 'R'"),
        SUPPLY_DIMS,
        "l_quantity",
        combine=False,
        mode_sizes=full.mode_sizes,
    )
    factors = integer_factors(spark, full.mode_sizes, RANK)
    got, want = (mt.mttkrp_wide(t, factors, 0, RANK) for t in (kept, full))
    return validate.compare_factors(got, want, RANK).select(
        *[F.round(c, 6).alias(c) for c in ("frob_rel", "max_abs", "max_rel")]
    )


# ---- factor algebra on MTTKRP outputs ----------------------------------------


def _outputs(spark: SparkSession, sf_dir: str, rank: int = RANK) -> DataFrame:
    """MTTKRP outputs of all modes from one pass: ``[mode, i, f0 ..]``."""
    t = supply(spark, sf_dir)
    rename = dict(zip(factor_columns(rank, "y"), factor_columns(rank)))
    return mt.mttkrp_all_arrow(t, _arrays(t, rank), rank).withColumnsRenamed(rename)


def _output(spark: SparkSession, sf_dir: str, n: int, rank: int = RANK) -> DataFrame:
    t = supply(spark, sf_dir)
    rename = dict(zip(factor_columns(rank, "y"), factor_columns(rank)))
    factors = integer_factors(spark, t.mode_sizes, rank)
    return mt.mttkrp_wide(t, factors, n, rank).withColumnsRenamed(rename)


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.gram_frame(_output(spark, sf_dir, 0), RANK)


def hadamard_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = linalg.gram_frame(_outputs(spark, sf_dir), RANK, by="mode")
    return linalg.hadamard_by_mode(grams, [1, 2])


def sum_diag_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = linalg.gram_frame(_outputs(spark, sf_dir), RANK, by="mode")
    both = linalg.hadamard_by_mode(grams, [0, 1])
    return both.where("r = s").agg(F.round(F.sum("g") / 1e12, 3).alias("total"))


def col_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.col_norms_frame(_output(spark, sf_dir, 0), RANK).select(
        "r", F.round("norm", 6).alias("norm")
    )


def col_scale_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _output(spark, sf_dir, 0)
    scaled = linalg.col_scale_inv(out, linalg.col_norms_frame(out, RANK), RANK)
    return _rounded(scaled, factor_columns(RANK))


def frob_norm_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.frob_norm_sq(_output(spark, sf_dir, 1), RANK)


def weighted_col_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return linalg.weighted_col_dot(
        factors[0], _output(spark, sf_dir, 0), [1.0, 2.0, 3.0, 4.0], RANK
    )


def model_norm_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norm of the model whose factors are the MTTKRP outputs, weights 1 to R."""
    grams = linalg.gram_frame(_outputs(spark, sf_dir), RANK, by="mode")
    lam = spark.range(RANK).select(
        F.col("id").cast("int").alias("r"), (F.col("id") + 1).cast("double").alias("lambda")
    )
    total = linalg.model_norm_sq_frame(linalg.hadamard_by_mode(grams, [0, 1, 2]), lam)
    return total.select(F.round(F.log10("model_sq"), 9).alias("log10_model_sq"))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.select("i", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


def _als_update(spark: SparkSession, sf_dir: str, rank: int) -> DataFrame:
    t = supply(spark, sf_dir)
    factors = integer_factors(spark, t.mode_sizes, rank)
    v = dense.hadamard([linalg.gram(f, rank) for f in factors[1:]], rank)
    yhat = mt.mttkrp_wide(t, factors, 0, rank)
    solved = linalg.right_solve(yhat, dense.cholesky_lower(v, 0.0), factor_columns(rank, "y"))
    return _rounded(solved, factor_columns(rank))


def als_rank1_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _als_update(spark, sf_dir, 1)


def als_rank2_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _als_update(spark, sf_dir, 2)


# ---- CP-ALS ------------------------------------------------------------------


def _history(spark: SparkSession, tensor: SparseTensor, opt: CpOptions) -> DataFrame:
    frame = cpals(tensor, opt).history_frame(spark)
    return frame.select("iter", F.round("fit", 6).alias("fit"))


def _rank1_start(tensor: SparseTensor) -> list[np.ndarray]:
    return [np.ones((s, 1)) for s in tensor.mode_sizes]


def als_rank1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    return _history(spark, t, CpOptions(rank=1, max_iters=2, tol=0.0, init=_rank1_start(t)))


def als_rank1_fit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit with factors kept as DataFrames throughout."""
    t = market(spark, sf_dir, combine=True)
    opt = CpOptions(rank=1, max_iters=2, tol=0.0, init=_rank1_start(t), factors="frames")
    return _history(spark, t, opt)


def _rank2(spark: SparkSession, sf_dir: str) -> tuple[SparseTensor, CpOptions]:
    t = market(spark, sf_dir, combine=True)
    return t, CpOptions(rank=2, max_iters=2, tol=0.0, ridge=0.0, init=_arrays(t, 2))


def als_rank2_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, *_rank2(spark, sf_dir))


def als_rank2_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = cpals(*_rank2(spark, sf_dir)).factor_frames(spark)
    return reduce(
        DataFrame.unionAll,
        [
            _rounded(f, factor_columns(2)).select(F.lit(n).alias("mode"), "i", *factor_columns(2))
            for n, f in enumerate(frames)
        ],
    )


def jacobi_rank1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    opt = CpOptions(rank=1, max_iters=1, tol=0.0, init=_rank1_start(t), kernel="jacobi")
    return _history(spark, t, opt)


def _fitted(t: SparseTensor, rank: int, sweeps: int, kernel: str = "gauss-seidel") -> CpOptions:
    """From whole-number factors, without ridge: SQL can repeat the same sweeps."""
    start = _arrays(t, rank)
    return CpOptions(rank=rank, max_iters=sweeps, tol=0.0, ridge=0.0, init=start, kernel=kernel)


def cpals_gauss_seidel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    return _history(spark, t, _fitted(t, 3, 2))


def cpals_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    return _history(spark, t, _fitted(t, 2, 2, "jacobi"))


def cpals_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factor rows of a rank-3 model after two sweeps."""
    t = market(spark, sf_dir, combine=True)
    frames = cpals(t, _fitted(t, 3, 2)).factor_frames(spark)
    return reduce(
        DataFrame.unionAll,
        [
            _rounded(f, factor_columns(3)).select(F.lit(n).alias("mode"), "i", *factor_columns(3))
            for n, f in enumerate(frames)
        ],
    )


def factor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the two kernels' rank-1 models of the same tensor after two sweeps."""
    t = market(spark, sf_dir, combine=True)
    models = []
    for kernel in ("gauss-seidel", "jacobi"):
        opt = CpOptions(rank=1, max_iters=2, tol=0.0, ridge=0.0, init=_rank1_start(t), kernel=kernel)
        models.append(cpals(t, opt).factor_frames(spark))
    value = validate.factor_similarity(*models, rank=1)
    return spark.createDataFrame([(round(value, 6),)], "similarity double")


def model_at_nonzeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir, combine=True)
    return validate.model_at_nonzeros(t, integer_factors(spark, t.mode_sizes, 2), [1.0, 2.0])


def residual_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, combine=True)
    return validate.exact_residual(t, integer_factors(spark, t.mode_sizes, 2), [1.0, 2.0])


# ---- Morton order ------------------------------------------------------------


def morton_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supply(spark, sf_dir, combine=True)
    key = MortonPlan.of(t.mode_sizes).encode([F.col(c) for c in t.index_columns])
    return t.df.withColumn("key", key)


def morton_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morton_stored(supply(spark, sf_dir, combine=True)).df


def morton_64bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that use all 64 bits: indices pushed to the top of modes of 2^22, 2^21, 2^21."""
    sizes = (1 << 22, 1 << 21, 1 << 21)
    t = supply(spark, sf_dir, combine=True, modes=3)
    top = [(F.lit(s - 1) - F.col(f"i{n}")).alias(f"i{n}") for n, s in enumerate(sizes)]
    t = SparseTensor.from_frame(t.df.select(*top, "val"), sizes, distinct=True)
    stored, plan = write_by_key(t)
    back = stored.select(
        "val",
        plan.order(F.col("key")).alias("place"),
        *[c.alias(f"i{n}") for n, c in enumerate(plan.decode(F.col("key")))],
    )
    return back.agg(
        F.count(F.lit(1)).alias("nnz"),
        *[F.sum(f"i{n}").alias(f"sum_i{n}") for n in range(3)],
        F.sum(F.col("i0") * F.col("val")).alias("weighted"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )


def mttkrp_morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes from linearised storage: keys and values only, decoded as they are read."""
    t = supply(spark, sf_dir)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    return KeyChunks.build(t).mttkrp_all(factors, RANK)


# ---- formats -----------------------------------------------------------------


def tns_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_lines(supply_frame(spark, sf_dir), 3)


def tns_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate lines made from the table, parsed back to nonzeros."""
    line = F.concat_ws(
        " ", *[(F.expr(d) + 1).cast("string") for d in SUPPLY_DIMS], F.col("l_quantity").cast("string")
    )
    lines = _table(spark, sf_dir, "lineitem").select(line.alias("line"))
    return parse_lines(lines, 3)


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of coordinate files: each begins with comments, a header and a blank line."""
    path = scratch_path(spark, "tns")
    t = supply(spark, sf_dir, combine=True)
    head = ["# supplier part month", "", "3", " ".join(map(str, t.mode_sizes)), "# nonzeros"]
    lines = format_lines(t.df, 3)

    def with_header(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("line").cast(pa.string())], ["line"])

    lines.mapInArrow(with_header, "line string").write.text(path)
    return path


def tns_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tns(spark, _written_lines(spark, sf_dir)).df


def cached_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that single precision would change, read through the cache twice."""
    path = scratch_path(spark, "cached")
    t = supply(spark, sf_dir, combine=True)
    odd = t.with_frame(t.df.withColumn("val", F.col("val") / 8 + 16777217))
    write_tns(odd, path)
    read_tensor(spark, path, cache=True)
    return read_tensor(spark, path, cache=True).df


def _factor_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """An MTTKRP output as a factor, and its number of rows."""
    t = supply(spark, sf_dir)
    factors = integer_factors(spark, t.mode_sizes, RANK)
    rename = dict(zip(factor_columns(RANK, "y"), factor_columns(RANK)))
    return mt.mttkrp_wide(t, factors, 0, RANK).withColumnsRenamed(rename), t.mode_sizes[0]


def _uri(spark: SparkSession, label: str) -> str:
    """A path below the shared folder as a URI, for Arrow's file systems."""
    path = scratch_path(spark, label)
    return path if ":" in path.split("/")[0] else f"file:{path}"


def factor_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, rows = _factor_rows(spark, sf_dir)
    path = _uri(spark, "factor")
    factor_files.write_binary(frame, path, rows, RANK)
    return factor_files.read_binary(spark, path)


def factor_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text dump, read back in row order of a folder's parts."""
    frame, rows = _factor_rows(spark, sf_dir)
    path = scratch_path(spark, "factor-text")
    factor_files.write_text(frame, path, rows, RANK)
    cells = [F.split("value", " ")[r].cast("double").alias(c) for r, c in enumerate(factor_columns(RANK))]
    return spark.read.text(path).select(*cells)


def lambda_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column norms of an MTTKRP output through the file of weights."""
    norms = {r["r"]: r["norm"] for r in col_norms(spark, sf_dir).collect()}
    path = _uri(spark, "lambda")
    factor_files.write_lambda(np.array([norms[r] for r in range(RANK)]), path)
    lam = factor_files.read_lambda(path)
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(lam)], "r int, lambda double")


def dnb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _uri(spark, "supply") + ".dnb"
    write_dnb(supply(spark, sf_dir, combine=True), path)
    return read_dnb(spark, path).df


def mttkrp_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes from a stream of chunks; the second run reads what came after the first."""
    path, folder = _uri(spark, "streamed") + ".dnb", _uri(spark, "streamed-sums")
    t = supply(spark, sf_dir)
    later = F.col("i2") % 3 == 0
    write_frame(t.df.where(~later), t.num_modes, path, t.mode_sizes)
    sums = StreamedSums(path, integer_factors(spark, t.mode_sizes, RANK), RANK, folder)
    sums.run(spark, chunk_nnz=20_000)
    append_frame(t.df.where(later), t.num_modes, path)
    return sums.run(spark, chunk_nnz=7_000)


def saved_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "saved")
    supply(spark, sf_dir, combine=True).save(path)
    return SparseTensor.load(spark, path).df


def packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.PackedTensor.of(supply(spark, sf_dir, combine=True)).unpacked()


QUERIES: dict[str, Query] = {
    "tensor_build": tensor_build,
    "events_tensor": events_tensor,
    "market_tensor": market_tensor,
    "coalesce_duplicates": coalesce_duplicates,
    "mode_sizes": mode_sizes,
    "tensor_norm_sq": tensor_norm_sq,
    "touched_rows": touched_rows,
    "row_counts": row_counts,
    "fiber_stats": fiber_stats,
    "shard_counts": shard_counts,
    "shard_offsets": shard_offsets,
    "csr_rowptr": csr_rowptr,
    "mttkrp_mode0": _supply_mttkrp(mt.mttkrp_wide, 0),
    "mttkrp_mode1": _supply_mttkrp(mt.mttkrp_wide, 1),
    "mttkrp_mode2": _supply_mttkrp(mt.mttkrp_wide, 2),
    "mttkrp_long": mttkrp_long,
    "mttkrp_arrow": mttkrp_arrow,
    "mttkrp_all_modes": mttkrp_all_modes,
    "mttkrp_shuffle": _supply_mttkrp(mt.mttkrp_shuffle, 0),
    "mttkrp_blocked": mttkrp_blocked_query,
    "mttkrp_blocked_mixed": mttkrp_blocked_mixed,
    "mttkrp_blocked_wide_key": mttkrp_blocked_wide_key,
    "mttkrp_all_modes_blocked": mttkrp_all_modes_blocked,
    "mttkrp_mode_sorted": mttkrp_mode_sorted,
    "mttkrp_bucketed": mttkrp_bucketed,
    "mttkrp_bucketed_sweep": mttkrp_bucketed_sweep,
    "mttkrp_fiber_tree": mttkrp_fiber_tree,
    "mttkrp_compact": mttkrp_compact,
    "mttkrp_compact_all": mttkrp_compact_all,
    "mode_marginals": mode_marginals,
    "mttkrp_2mode": mttkrp_2mode,
    "mttkrp_4mode": mttkrp_4mode,
    "mttkrp_5mode": mttkrp_5mode,
    "events_mttkrp": events_mttkrp,
    "compare_factors": compare_factors,
    "gram": gram,
    "hadamard_v": hadamard_v,
    "sum_diag_product": sum_diag_product,
    "col_norms": col_norms,
    "col_scale_inv": col_scale_inv,
    "frob_norm_sq": frob_norm_sq,
    "weighted_col_dot": weighted_col_dot,
    "model_norm_sq": model_norm_sq,
    "als_rank1_update": als_rank1_update,
    "als_rank2_update": als_rank2_update,
    "als_rank1_fit": als_rank1_fit,
    "als_rank1_fit_frames": als_rank1_fit_frames,
    "als_rank2_fit": als_rank2_fit,
    "als_rank2_factors": als_rank2_factors,
    "jacobi_rank1_fit": jacobi_rank1_fit,
    "cpals_gauss_seidel": cpals_gauss_seidel,
    "cpals_jacobi": cpals_jacobi,
    "cpals_factors": cpals_factors,
    "factor_similarity": factor_similarity,
    "model_at_nonzeros": model_at_nonzeros,
    "residual_exact": residual_exact,
    "morton_encode": morton_encode,
    "morton_roundtrip": morton_roundtrip,
    "morton_64bit": morton_64bit,
    "mttkrp_morton": mttkrp_morton,
    "tns_lines": tns_lines,
    "tns_parse": tns_parse,
    "tns_file_read": tns_file_read,
    "cached_read": cached_read,
    "factor_binary_roundtrip": factor_binary_roundtrip,
    "factor_text_roundtrip": factor_text_roundtrip,
    "lambda_roundtrip": lambda_roundtrip,
    "dnb_roundtrip": dnb_roundtrip,
    "mttkrp_streamed": mttkrp_streamed,
    "saved_roundtrip": saved_roundtrip,
    "packed_roundtrip": packed_roundtrip,
}
