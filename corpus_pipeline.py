"""A training corpus from the documents table, in five stages.

Each stage works on all rows that the one before it kept, and is written as Parquet and
read again in between.  SQL can't express it as a whole (language model, confirmed near
copies, packing); tests hold each stage against a plain version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorspark.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from tensorspark.llm.common import table, through_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known, by a model learnt from the rows themselves."""
    return langid.drop_unknown(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words, four fifths in common."""
    return near_dedup.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten words in a row of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last."""
    out = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = through_files(out, name) if k else out
        out = stage(spark, docs, sf_dir)
    return out
