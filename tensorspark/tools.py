"""Helpers around tensor files: ``python -m tensorspark.tools COMMAND ...``

``convert``   binary to text, or text to one binary file
``generate``  a uniform random tensor, or a full low-rank one with its factors
``check``     the exact fit of dumped factors
``compare``   two dumps of factors: fits and column similarity
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tensorspark.functions import dense
from tensorspark.operators import validate
from tensorspark.session import scratch_path
from tensorspark.sources import factor_files
from tensorspark.sources.dnb import export_file, write_dnb
from tensorspark.sources.reader import read_tensor
from tensorspark.sources.synthetic import cp_tensor, cp_truth, uniform_tensor
from tensorspark.sources.tns import write_tns
from tensorspark.tensor import SparseTensor


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tensorspark.tools", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target", help="a folder of text parts, or a .dnb file")
    base = c.add_mutually_exclusive_group()
    base.add_argument("--one-indexed", dest="one_indexed", action="store_true", default=True)
    base.add_argument("--zero-indexed", dest="one_indexed", action="store_false")

    g = commands.add_parser("generate")
    g.add_argument("target", help="a folder of text parts")
    g.add_argument("--sizes", type=int, nargs="+", required=True)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--nnz", type=int, help="number of uniform nonzeros")
    g.add_argument("--rank", type=int, help="rank of a full low-rank tensor")
    g.add_argument("--noise", type=float, default=0.0)
    g.add_argument("--truth", metavar="PREFIX", help="also write the true factors")

    for name in ("check", "compare"):
        k = commands.add_parser(name)
        k.add_argument("--tensor", required=True)
        k.add_argument("--cp-dump", required=True, metavar="PREFIX")
        if name == "compare":
            k.add_argument("--reference", required=True, metavar="PREFIX")
    return p


def read_dump(
    spark: SparkSession, prefix: str, num_modes: int
) -> tuple[list[DataFrame], np.ndarray]:
    """Factors and weights written by ``--cp-dump``."""
    factors = [
        factor_files.read_binary(spark, f"{prefix}.cp_fm{n}.bin") for n in range(num_modes)
    ]
    return factors, factor_files.read_lambda(f"{prefix}.cp_lambda.bin")


def dump_rows(prefix: str, num_modes: int) -> list[int]:
    return [factor_files.read_header(f"{prefix}.cp_fm{n}.bin")[0] for n in range(num_modes)]


def write_dump(factors: Sequence, lam: np.ndarray, sizes: Sequence[int], prefix: str) -> None:
    for n, (f, s) in enumerate(zip(factors, sizes, strict=True)):
        factor_files.write_binary(f, f"{prefix}.cp_fm{n}.bin", s, len(lam))
    factor_files.write_lambda(lam, f"{prefix}.cp_lambda.bin")


def _fit(tensor: SparseTensor, factors: Sequence, lam: np.ndarray) -> float:
    row = validate.exact_residual(tensor, factors, lam).first()
    residual, fit = dense.residual_and_fit(row["norm_sq"], row["inner"], row["model_sq"])
    print(
        f"[check] squared norms: tensor {row['norm_sq']:.6e}, model {row['model_sq']:.6e}; inner "
        f"product {row['inner']:.6e}; residual {residual:.6e}; fit {fit:.6f}"
    )
    return fit


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tensorspark-tools").getOrCreate()
    if args.command == "convert":
        tensor = read_tensor(spark, args.source)
        if args.target.endswith(".dnb"):
            parts = scratch_path(spark, "parts")
            write_dnb(tensor, parts)
            export_file(spark, parts, args.target)
        else:
            write_tns(tensor, args.target, args.one_indexed)
        return 0
    if args.command == "generate":
        if (args.nnz is None) == (args.rank is None):
            print("give either --nnz or --rank", file=sys.stderr)
            return 1
        if args.nnz is not None:
            tensor = uniform_tensor(spark, args.sizes, args.nnz, args.seed)
        else:
            tensor = cp_tensor(spark, args.sizes, args.rank, args.seed, args.noise)
            if args.truth:
                write_dump(*cp_truth(args.sizes, args.rank, args.seed), args.sizes, args.truth)
        write_tns(tensor, args.target)
        return 0
    tensor = read_tensor(spark, args.tensor)
    factors, lam = read_dump(spark, args.cp_dump, tensor.num_modes)
    validate.check_shapes(dump_rows(args.cp_dump, tensor.num_modes), tensor.mode_sizes)
    fit = _fit(tensor, factors, lam)
    if args.command == "check":
        return 0
    wanted, weights = read_dump(spark, args.reference, tensor.num_modes)
    validate.check_shapes(dump_rows(args.reference, tensor.num_modes), tensor.mode_sizes)
    reference = _fit(tensor, wanted, weights)
    similarity = validate.factor_similarity(wanted, factors, len(lam))
    passed = validate.fits_agree(fit, reference)
    print(
        f"{'PASS' if passed else 'FAIL'}: fit {fit:.6f}, reference {reference:.6f}, "
        f"factor similarity {similarity:.4f}"
    )
    return 0 if passed else 3


if __name__ == "__main__":
    sys.exit(main())
