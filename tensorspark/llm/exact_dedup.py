"""Exact duplicates through an extendible-hash index on shared files.

Texts are keyed by the first 60 bits of their SHA-256.  A directory of prefixes starts with
one bucket and doubles while a bucket holds more keys than its capacity; a bucket of local
depth ``d`` owns one prefix of ``d`` bits and several slots of the directory.  Neighbouring
buckets go to one owner task, so each owner has a range of keys.  It walks its entries in
key order, chains those whose keys collide, compares bytes along the chain, and writes
pages to the shared folder.

Copies are first merged inside each input partition, by comparing bytes, so a group that
holds a third of all rows sends one entry for each partition, not one for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import blocks, fresh, id_text, rows_frame, small, through_files, width
from tensorspark.session import scratch_path

KEY_BITS = 60
#: Keys that a bucket may hold before it is split, and the bound on the directory's depth.
#: Where 2^MAX_DEPTH buckets of that capacity can't hold all keys, the capacity is larger.
CAPACITY = 2048
MAX_DEPTH = 16
#: Text that the merging of copies inside a partition holds at most, beside the newest.
HELD_BYTES = 32 << 20
ENTRIES = "owner int, bucket int, key long, sha binary, body binary, low long, n long"
PAGES = "bucket int, key long, slot int, sha binary, low long, n long"


def normalized(text: Column) -> Column:
    """The text with each run of blanks and line ends as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_key(sha_hex: Column) -> Column:
    return F.conv(F.substring(sha_hex, 1, KEY_BITS // 4), 16, 10).cast("long")


def directory(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Directory slots (bucket of each prefix) and buckets (prefix, depth), by doubling.

    ``histogram`` counts keys by their first ``log2(len)`` bits.
    """
    finest = len(histogram).bit_length() - 1
    slots, buckets = np.zeros(1, np.int32), [(0, 0)]
    depth = 0

    def load(prefix: int, local: int) -> int:
        width = 1 << (finest - local)
        return int(histogram[prefix * width : (prefix + 1) * width].sum())

    while True:
        full = [b for b, (p, d) in enumerate(buckets) if d < finest and load(p, d) > capacity]
        if not full:
            return slots, buckets
        for b in full:
            prefix, local = buckets[b]
            if local == depth:
                slots, depth = np.repeat(slots, 2), depth + 1
            own = np.flatnonzero(slots == b)
            buckets[b] = (2 * prefix, local + 1)
            slots[own[len(own) // 2 :]] = len(buckets)
            buckets.append((2 * prefix + 1, local + 1))


def owners(slots: np.ndarray, histogram: np.ndarray, n: int) -> np.ndarray:
    """Owner of each slot: ranges of whole buckets with about the same number of keys."""
    weight = histogram.reshape(len(slots), -1).sum(axis=1)
    middle = np.cumsum(weight) - weight / 2
    owner = np.minimum(middle * n // max(1, weight.sum()), n - 1).astype(np.int32)
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    return np.repeat(owner[first], np.diff(np.append(first, len(slots))))


def _entries(
    batches: Iterator[pa.RecordBatch], slots: np.ndarray, owner: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Entries of a partition, copies merged; flushed when the texts held are too large."""
    shift = KEY_BITS - (len(slots).bit_length() - 1)
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        keys = np.array([e[0] for e in held.values()], np.int64)
        at = keys >> shift
        return pa.RecordBatch.from_pydict(
            {
                "owner": pa.array(owner[at]),
                "bucket": pa.array(slots[at]),
                "key": pa.array(keys),
                "sha": pa.array([e[1] for e in held.values()], pa.binary()),
                "body": pa.array(list(held), pa.binary()),
                "low": pa.array([e[2] for e in held.values()], pa.int64()),
                "n": pa.array([e[3] for e in held.values()], pa.int64()),
            }
        )

    for batch in blocks(batches, "body"):
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "body", "sha", "key"))
        for doc, body, sha, key in zip(*columns, strict=True):
            entry = held.get(body)
            if entry is None:
                held[body] = [key, sha, doc, 1]
                size += len(body) + 200
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
            else:
                entry[3] += 1
                if doc is not None and (entry[2] is None or doc < entry[2]):
                    entry[2] = doc
    if held:
        yield flush()


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of an owner's buckets from its entries in key order.  Holds one chain."""
    names = [field.split()[0] for field in PAGES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    chain: list[list] = []  # bucket, key, sha, body, low, n of each text under one key

    def close() -> None:
        if len({entry[2] for entry in chain}) < len(chain):
            raise ValueError("two different texts have one SHA-256")
        out.extend((b, k, slot, sha, low, n) for slot, (b, k, sha, _, low, n) in enumerate(chain))
        chain.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )

    order = ("bucket", "key", "sha", "body", "low", "n")
    for batch in blocks(batches, "body"):
        for row in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
            if chain and chain[0][1] != row[1]:
                close()
            for entry in chain:
                if entry[3] == row[3]:
                    lows = [x for x in (entry[4], row[4]) if x is not None]
                    entry[4], entry[5] = min(lows, default=None), entry[5] + row[5]
                    break
            else:
                chain.append(list(row))
        yield flush()
    close()
    yield flush()


def build_index(docs: DataFrame, hashed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pages of the index over ``docs``: bucket, key, slot, sha, low (smallest id), n.

    ``hashed`` has the key of every row.  The histogram that the driver sees has at most
    2^MAX_DEPTH numbers, whatever the number of rows.
    """
    spark = docs.sparkSession
    prefix = F.shiftright("key", KEY_BITS - MAX_DEPTH).cast("int").alias("prefix")
    counts = hashed.select("key").distinct().groupBy(prefix).count().collect()
    histogram = np.zeros(1 << MAX_DEPTH, np.int64)
    for row in counts:
        histogram[row["prefix"]] = row["count"]
    capacity = max(capacity, int(2 * histogram.sum() >> MAX_DEPTH))
    slots, buckets = directory(histogram, capacity)
    n = width(docs)
    owner = owners(slots, histogram, n)

    body = id_text(docs).select("doc_id", normalized(F.col("text")).alias("body"))
    sha = F.sha2("body", 256)
    body = body.select(
        "doc_id", F.encode("body", "UTF-8").alias("body"), F.unhex(sha).alias("sha"), text_key(sha).alias("key")
    )
    entries = body.mapInArrow(partial(_entries, slots=slots, owner=owner), ENTRIES)
    owned = entries.repartitionById(n, F.col("owner")).sortWithinPartitions("key")
    folder = scratch_path(spark, "hash-index")
    owned.drop("owner").mapInArrow(_pages, PAGES).write.parquet(f"{folder}/pages")
    prefixes, depths = zip(*buckets, strict=True)
    columns = {"bucket": range(len(buckets)), "prefix": prefixes, "depth": depths}
    rows = pa.table({name: pa.array(values, pa.int32()) for name, values in columns.items()})
    rows_frame(spark, rows).write.parquet(f"{folder}/directory")
    return spark.read.parquet(f"{folder}/pages")


def find_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as :func:`normalized` gives them; null counts as empty.  The smallest
    doc_id of a group stays; null ids count only where all are null.  Of rows that share
    that doc_id and text, one is ``kept``.  Other columns are ignored; an empty table gives
    no rows.
    """
    text_sha = F.sha2(normalized(F.col("text")), 256)
    light = id_text(docs).select("doc_id", text_sha.alias("hex"))
    light = through_files(
        light.select(
            "doc_id",
            F.unhex("hex").alias("sha"),
            text_key(F.col("hex")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "text-keys",
    )
    index = build_index(docs, light, capacity).select("sha", "low", "n")
    joined = light.drop("key").join(index, "sha")
    is_low = F.col("doc_id").eqNullSafe(F.col("low"))
    # Rows that share doc_id and text with the one that stays are few, as ids tell rows apart.
    ties = joined.where(is_low).groupBy("sha").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("same")
    )
    ties = small(through_files(ties.where("same > 1").drop("same"), "ties"), 60)
    stays = is_low & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return joined.join(ties, "sha", "left").select(
        "doc_id",
        F.col("low").alias("keep_id"),
        F.col("n").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that :func:`find_copies` keeps, with all their columns."""
    copies = through_files(find_copies(docs, capacity), "copies")
    pairs = copies.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")
    )
    name = fresh(docs, "text_sha256")
    keyed = docs.withColumn(name, F.sha2(normalized(docs["text"]), 256))

    def on(pair: DataFrame) -> Column:
        same_id = keyed["doc_id"].eqNullSafe(pair["doc_id"])
        return same_id & (keyed[name] == pair["text_sha256"])

    gone = small(pairs.where("not stays"), 80)
    out = keyed.join(gone, on(gone), "left_anti")
    again = pairs.where("stays and n > 1")
    if not again.isEmpty():
        again = small(again, 80)
        once = keyed.join(again, on(again), "left_semi").dropDuplicates(["doc_id", name])
        out = out.join(again, on(again), "left_anti").unionByName(once)
    return out.drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: exact copies in the documents table."""
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha
    FROM documents
), g AS (
    SELECT *, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
