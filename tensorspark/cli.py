"""Command line: MTTKRP of a tensor file, or its CP decomposition.

``python -m tensorspark TENSOR [options]``

Exit codes: 0 done, 1 usage, 2 tensor not readable, 3 verification failed, 4 no iteration
ran, 5 unknown algorithm, 6 out-of-core without a decomposition, 7 options that exclude
each other, 8 tensor state not saved.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.functions.factors import (
    factor_columns,
    random_factor,
    random_factor_array,
)
from tensorspark.operators import mttkrp as mt, validate
from tensorspark.operators.blocked import BlockedTensor, mttkrp_all_blocked, mttkrp_blocked
from tensorspark.operators.cpals import CpOptions, cpals
from tensorspark.plans.strategy import choose_strategy, factors_fit_driver, storage_level
from tensorspark.session import materialize
from tensorspark.sources import factor_files
from tensorspark.sources.reader import read_tensor
from tensorspark.tensor import SparseTensor, morton_stored

LAYOUTS = ("auto", "pingpong", "ncopy", "inplace", "morton", "ooc")
# "auto" is Gauss-Seidel: it converges in fewer sweeps, and its fit needs no further pass.
KERNELS = {"auto": "gauss-seidel", "gauss-seidel": "gauss-seidel", "jacobi": "jacobi"}
VERIFY_TOL = 1e-4


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(f"error: {message}", file=sys.stderr)
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tensorspark", description="Sparse MTTKRP and CP decomposition on Spark")
    p.add_argument("tensor", help=".tns text, .dnb binary, or a folder from --save-processed")
    p.add_argument("--rank", type=int, default=16)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--verify", action="store_true", help="also run the plain SQL form and compare")
    p.add_argument("--dump", metavar="PREFIX", help="write MTTKRP outputs")
    p.add_argument("--dump-bin", action="store_true", help="write them as binary, not text")
    p.add_argument("--no-cache", action="store_true", help="neither read nor write the parsed copy")
    p.add_argument("--all-modes", action="store_true", help="all modes from one pass")
    p.add_argument("--layout", choices=LAYOUTS, default="auto")
    p.add_argument("--ooc", choices=("auto", "on", "off"), default="auto")
    p.add_argument("--ooc-chunk", type=int, default=0, metavar="NNZ")
    p.add_argument("--decompose", metavar="ALGORITHM")
    p.add_argument("--cp-iters", type=int, default=50)
    p.add_argument("--cp-tol", type=float, default=1e-4)
    p.add_argument("--cp-kernel", choices=sorted(KERNELS), default="auto")
    p.add_argument("--cp-ridge", type=float, default=1e-10)
    p.add_argument("--cp-dump", metavar="PREFIX", help="write factors and lambda")
    p.add_argument("--cp-dump-init", metavar="PREFIX", help="write the starting factors")
    p.add_argument("--save-processed", metavar="DIR", help="save the analysed tensor")
    p.add_argument("--runtime", action="store_true", help="TENSOR is a saved tensor folder")
    # Spark decides these; they are accepted so that existing command lines keep working.
    for name in ("--threads", "--shard-size"):
        p.add_argument(name, type=int, help=argparse.SUPPRESS)
    for name in ("--ncopy-fiber-sort", "--ncopy-csr", "--ncopy-csr-compact"):
        p.add_argument(name, choices=("auto", "on", "off"), help=argparse.SUPPRESS)
    p.add_argument("--jit", action="store_true", help=argparse.SUPPRESS)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    ooc = args.ooc == "on" or args.layout == "ooc"
    if args.rank < 1:
        print("[main] --rank must be at least 1", file=sys.stderr)
        return 1
    if args.runtime and (args.verify or ooc):
        print("[main] --runtime excludes --verify and --ooc on", file=sys.stderr)
        return 7
    if args.layout == "morton" and args.verify:
        print("[main] --layout morton excludes --verify", file=sys.stderr)
        return 7
    if args.decompose not in (None, "cpals"):
        print(f"[main] unknown algorithm {args.decompose!r} (supported: cpals)", file=sys.stderr)
        return 5
    if ooc and not args.decompose:
        print("[main] --ooc needs --decompose cpals", file=sys.stderr)
        return 6

    if spark is None:
        # Superseded factors of earlier iterations are removed from the checkpoint folder.
        clean = "spark.cleaner.referenceTracking.cleanCheckpoints"
        spark = SparkSession.builder.appName("tensorspark").config(clean, "true").getOrCreate()
    t0 = time.perf_counter()
    try:
        tensor = read_tensor(
            spark,
            args.tensor,
            format="saved" if args.runtime and not args.tensor.endswith(".dnp") else None,
            cache=not args.no_cache,
            chunk_nnz=args.ooc_chunk or None,
        )
    except Exception as error:
        print(f"[io] cannot load {args.tensor}: {error}", file=sys.stderr)
        return 2
    shape = " ".join(str(s) for s in tensor.mode_sizes)
    print(
        f"[io] loaded {tensor.nnz} nonzeros, {tensor.num_modes} modes, shape = {shape}"
        f"  ({time.perf_counter() - t0:.3f} s)"
    )
    _print_plan(tensor, args)
    if args.layout == "morton":
        # Only whole passes use keys: all modes at once, and the kernel that sweeps so.
        args.all_modes, args.cp_kernel = True, "jacobi"
        if not args.decompose:
            tensor = morton_stored(tensor)
    if args.save_processed:
        try:
            tensor.save(args.save_processed)
        except Exception as error:
            print(f"[io] cannot save {args.save_processed}: {error}", file=sys.stderr)
            return 8
        print(f"[io] saved analysed tensor to {args.save_processed}")
    if args.decompose:
        return _decompose(tensor, args, "ooc" if ooc else args.layout)
    return _mttkrp(tensor, args)


def _print_plan(tensor: SparseTensor, args: argparse.Namespace) -> None:
    strategy = choose_strategy(tensor.mode_sizes, args.rank)
    print(f"[plan] strategy = {strategy.name}  ({strategy.reason})")
    for n, size in enumerate(tensor.mode_sizes):
        length = tensor.nnz / size
        print(f"[plan] mode {n}: {size} rows, {length:.2f} nonzeros a row")
    if args.layout == "ncopy":
        print("[plan] decompositions keep a copy for each mode, bucketed by its index")
    if args.layout in ("pingpong", "inplace"):
        print(f"[plan] layout {args.layout} has no counterpart here; Spark places the nonzeros")


def _decompose(tensor: SparseTensor, args: argparse.Namespace, layout: str) -> int:
    rank, sizes = args.rank, tensor.mode_sizes

    def dump_init(factors) -> None:
        for n, f in enumerate(factors):
            factor_files.write_binary(f, f"{args.cp_dump_init}.cp_init_fm{n}.bin", sizes[n], rank)

    result = cpals(
        tensor,
        CpOptions(
            rank=rank,
            max_iters=args.cp_iters,
            tol=args.cp_tol,
            seed=args.seed,
            ridge=args.cp_ridge,
            kernel=KERNELS[args.cp_kernel],
            verbose=True,
            layout=layout,
            on_init=dump_init if args.cp_dump_init else None,
        ),
    )
    if args.cp_dump:
        for n, f in enumerate(result.factors):
            factor_files.write_binary(f, f"{args.cp_dump}.cp_fm{n}.bin", sizes[n], rank)
        lam = result.lam if len(result.lam) else np.ones(rank)
        factor_files.write_lambda(lam, f"{args.cp_dump}.cp_lambda.bin")
    print(
        f"[summary] {result.iters_done} sweeps: fit {result.final_fit:.6f}, residual "
        f"{result.final_residual:.3e}; {result.total_time_s:.3f} s, of it MTTKRP "
        f"{result.mttkrp_time_s:.3f} s and algebra {result.linalg_time_s:.3f} s"
    )
    return 0 if result.iters_done else 4


def _mttkrp(tensor: SparseTensor, args: argparse.Namespace) -> int:
    rank, sizes, modes = args.rank, tensor.mode_sizes, range(tensor.num_modes)
    small = factors_fit_driver(sizes, rank)
    if small:
        factors = [random_factor_array(s, n, rank, args.seed, "uniform") for n, s in enumerate(sizes)]
        packed = mt.PackedTensor.spread(tensor).persist(storage_level(args.layout))
        packed.df.count()
    else:
        factors = [
            random_factor(tensor.spark, s, n, rank, args.seed, "uniform")
            for n, s in enumerate(sizes)
        ]
        packed = BlockedTensor.build(tensor, rank)

    t0 = time.perf_counter()
    if args.all_modes:
        run = mt.mttkrp_all_arrow if small else mttkrp_all_blocked
        everything = materialize(run(packed, factors, rank))
        frames = [everything.where(F.col("mode") == n).drop("mode") for n in modes]
    else:
        run = mt.mttkrp_arrow if small else mttkrp_blocked
        frames = [materialize(run(packed, factors, n, rank)) for n in modes]
    seconds = time.perf_counter() - t0

    if args.dump:
        for n, frame in enumerate(frames):
            _dump(frame, f"{args.dump}.fm{n}_out", sizes[n], rank, args.dump_bin)
    code = 0
    if args.verify:
        code = _verify(tensor, factors, frames, rank)
    print(f"[summary] mttkrp = {seconds:.6f} s ({tensor.nnz / 1e6 / seconds:.3f} Mnnz/s)")
    return code


def _dump(frame: DataFrame, stem: str, rows: int, rank: int, binary: bool) -> None:
    if binary:
        factor_files.write_binary(frame, f"{stem}.bin", rows, rank, "y")
    else:
        factor_files.write_text(frame, f"{stem}.txt", rows, rank, "y")


def _verify(tensor: SparseTensor, factors: list, frames: list[DataFrame], rank: int) -> int:
    worst = 0.0
    for n, got in enumerate(frames):
        want = mt.mttkrp(tensor, factors, n, rank, "long")
        row = validate.compare_factors(
            got.select("i", *factor_columns(rank, "y")), want, rank
        ).first()
        print(
            f"[verify] mode {n}: frob_rel = {row['frob_rel']:.3e}  max_abs = {row['max_abs']:.3e}"
            f"  max_rel = {row['max_rel']:.3e}"
        )
        worst = max(worst, row["frob_rel"])
    passed = worst <= VERIFY_TOL
    print(f"{'PASS' if passed else 'FAIL'}: largest relative error {worst:.3e}, allowed {VERIFY_TOL}")
    return 0 if passed else 3
