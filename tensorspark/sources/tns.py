"""Coordinate text: ``i0 .. i{N-1} value`` per line, one-based, ``#`` comments.

An optional two-line header gives the number of modes and then the mode sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.tensor import MAX_MODES, SparseTensor, index_columns


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank, non-comment lines as ``[line]``."""
    text = spark.read.text(path).select(F.trim("value", F.lit(" \t\r\x0b\x0c")).alias("line"))
    return text.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _number(token: str) -> float:
    try:
        return float(token)
    except ValueError:
        raise ValueError(f"cannot parse token {token!r}") from None


def _peek(spark: SparkSession, path: str) -> tuple[int, list[int] | None]:
    """Number of modes and header sizes, if any, from the first file with nonzeros."""
    head: list[str] = []
    for name in sorted(spark.read.text(path).inputFiles()):
        head = [r["line"] for r in _lines(spark, name).limit(2).collect()]
        if head:
            break
    if not head:
        raise ValueError("tensor has no nonzeros")
    first = head[0].split()
    if len(first) == 1 and len(head) > 1:
        modes = _number(first[0])
        if modes == int(modes) and 2 <= modes <= MAX_MODES:
            second = head[1].split()
            sizes = [int(_number(t)) for t in second] if len(second) == modes else None
            return int(modes), sizes
    return len(first) - 1, None


def _numbers(tokens: pa.Array) -> np.ndarray:
    try:
        return pc.cast(tokens, pa.float64()).to_numpy()
    except pa.ArrowInvalid:
        # The usual parser takes no plus sign; anything else is an error.
        return pc.cast(pc.replace_substring_regex(tokens, r"^\+", ""), pa.float64()).to_numpy()


def parse_lines(
    lines: DataFrame, num_modes: int, header: list[int] | None = None
) -> DataFrame:
    """Column ``line`` to zero-based nonzeros; any malformed line fails the query.

    Arrow splits and converts a whole batch at a time, which is several times faster than
    one column expression per token.  Lines with a lone token are skipped, and so is the
    line of mode sizes that follows the number of modes in a file's header.  Where a split
    falls between those two lines, the second is known by its sizes, ``header``.
    """
    split_header = None if header is None else [str(s) for s in header]
    width = num_modes + 1
    names = [*index_columns(num_modes), "val"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after_modes, first = False, True
        for batch in batches:
            tokens = pc.utf8_split_whitespace(batch.column("line"))
            lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            modes = lengths == 1
            for at in np.flatnonzero(modes).tolist():
                modes[at] = tokens[at].as_py() == [str(num_modes)]
            follows = np.append(after_modes, modes[:-1]) if len(modes) else modes
            after_modes = bool(modes[-1]) if len(modes) else after_modes
            if first and len(modes):
                follows[0], first = tokens[0].as_py() == split_header, False
            sizes = follows & (lengths == num_modes)
            tokens = tokens.filter(pa.array((lengths > 1) & ~sizes))
            wrong = np.flatnonzero(pc.list_value_length(tokens).to_numpy() != width)
            if len(wrong):
                line = " ".join(tokens[int(wrong[0])].as_py())
                raise ValueError(f"expected {num_modes} indices and a value in line: {line}")
            values = _numbers(tokens.flatten()).reshape(-1, width)
            index = values[:, :num_modes]
            if not np.isfinite(values).all():
                at = int(np.flatnonzero(~np.isfinite(values).all(axis=1))[0])
                raise ValueError(f"not a finite number in line: {' '.join(tokens[at].as_py())}")
            if not (index >= 1).all():
                at = int(np.flatnonzero(~(index >= 1).all(axis=1))[0])
                raise ValueError(f"non-positive index in line: {' '.join(tokens[at].as_py())}")
            # Fractional indices are truncated.
            columns = [pa.array(index[:, n].astype(np.int64) - 1) for n in range(num_modes)]
            columns.append(pa.array(np.ascontiguousarray(values[:, num_modes])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([*[f"{c} bigint" for c in names[:-1]], "val double"])
    return lines.select("line").mapInArrow(run, schema)


def tns_frame(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[int] | None]:
    """Unmeasured nonzeros of a text tensor, its number of modes and its header sizes."""
    num_modes, sizes = _peek(spark, path)
    if not 1 <= num_modes <= MAX_MODES:
        raise ValueError(f"tensor needs 1 to {MAX_MODES} modes, got {num_modes}")
    return parse_lines(_lines(spark, path), num_modes, sizes), num_modes, sizes


def read_tns(spark: SparkSession, path: str) -> SparseTensor:
    """Read text coordinates; splits are parsed in parallel, and only once."""
    nonzeros, _, sizes = tns_frame(spark, path)
    return SparseTensor.from_frame(nonzeros, sizes, keep=True)


def format_lines(nonzeros: DataFrame, num_modes: int, one_indexed: bool = True) -> DataFrame:
    """Nonzeros to text lines; values with seventeen significant digits at most.

    Only values go through Python: a value's shortest text that reads back the same.
    """
    base = 1 if one_indexed else 0

    @F.arrow_udf("string")
    def shortest(values: pa.Array) -> pa.Array:
        return pa.array([f"{v:.17g}" if float(f"{v:.9g}") != v else f"{v:.9g}" for v in values.to_pylist()])

    index = [(F.col(c).cast("bigint") + base).cast("string") for c in index_columns(num_modes)]
    return nonzeros.select(F.concat_ws(" ", *index, shortest("val")).alias("line"))


def write_tns(tensor: SparseTensor, path: str, one_indexed: bool = True) -> None:
    """Write a folder of text parts, which :func:`read_tns` reads back."""
    format_lines(tensor.df, tensor.num_modes, one_indexed).write.mode("overwrite").text(path)
