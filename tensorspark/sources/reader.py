"""Open a tensor by path."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tensorspark.sources.dnb import read_dnb
from tensorspark.sources.dnp import read_dnp
from tensorspark.sources.tns import read_tns
from tensorspark.tensor import SparseTensor


def read_tensor(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    cache: bool = False,
    chunk_nnz: int | None = None,
) -> SparseTensor:
    """Read ``.tns`` text, ``.dnb`` binary, a ``.dnp`` state or a saved tensor folder.

    With ``cache=True`` text is read through ``<path>.cache``, a saved tensor that is used
    while the text files are those it was made from, and written after a parse.  It holds
    the parsed values as they are, so results don't depend on whether it can be written.
    """
    format = format or _guess(spark, path)
    if format == "dnb":
        return read_dnb(spark, path, chunk_nnz)
    if format == "dnp":
        return read_dnp(spark, path, chunk_nnz)
    if format == "saved":
        return SparseTensor.load(spark, path)
    if format != "tns":
        raise ValueError(f"unknown tensor format {format!r}")
    if not cache:
        return read_tns(spark, path)
    copy = path.rstrip("/") + ".cache"
    source = _files(spark, path)
    try:
        return SparseTensor.load(spark, copy, source)
    except (PySparkException, ValueError):
        pass  # none there, or of other files
    tensor = read_tns(spark, path)
    try:
        tensor.save(copy, source)
        return SparseTensor.load(spark, copy, source)
    except (PySparkException, Py4JJavaError) as failed:
        print(f"[io] no cache at {copy}: {str(failed).splitlines()[0]}")
        return tensor


def _files(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a path, as a digest; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    row = F.concat_ws(" ", "path", "length", F.unix_micros("modificationTime"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256)).first()[0]


def _guess(spark: SparkSession, path: str) -> str:
    plain = path.rstrip("/")
    if plain.endswith(".dnb"):
        return "dnb"
    if plain.endswith(".dnp"):
        return "dnp"
    try:
        spark.read.text(f"{plain}/meta").first()
        return "saved"
    except PySparkException:
        return "tns"
