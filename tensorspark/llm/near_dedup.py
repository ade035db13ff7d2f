"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A signature has ``4 m`` symbols of 14 bits, each from one MinHash of the shingles; two
signatures differ in as many symbols as their Hamming distance.  They are split into ``m``
chunks of four symbols.  If the distance is at most ``2 m - 1``, some chunk differs in at
most one symbol (pigeonhole), so both documents have the same key for that chunk with that
symbol left out: every pair within the distance shares one of the ``4 m`` keys.  ``m`` is
the smallest number for which a pair just at the similarity threshold is farther than
``2 m - 1`` with a probability of at most ``MISS``.

Equal word sequences form one class first.  Then, so that a bucket of n alike documents
costs about n and not n^2 pairs:

1. each member of a bucket is tried with the bucket's leader; links are confirmed on the
   full shingle sets, and give components;
2. a bucket that still holds several components is brought together with its members' sets,
   in blocks of bounded size.  There members of different components are compared, ruled out
   by size and by a sketch that bounds the sets' difference from below, else counted out; a
   link joins two components, so a block of n members reports less than n links.  Buckets of
   up to ``FEW`` members give their pairs to the first kind of confirmation instead.

A pair that is not tried is in one component already, so no component is missed.  Texts that
are alike but not linked are compared, but their pairs are never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import (
    SPACES,
    blocks,
    id_text,
    mix,
    small,
    through_files,
    utf8,
    width,
    word_bounds,
    word_hashes,
)
from tensorspark.llm.components import components

WORDS = 5
PERCENT = 80
#: Probability that a pair at the threshold is outside the signature distance.
MISS = 5e-6
CHUNK = 4
SEED = 11
#: Members of a bucket whose pairs are rows of a join.
FEW = 12
#: Bytes of sets and members of a block of a larger bucket.
BLOCK_BYTES, BLOCK_NODES = 4 << 20, 1500
#: Shingles that a comparison counts at a time.
COUNTED = 1 << 17
#: Pairs of a node for which its set travels once.
PAIRS = 500
#: Bits of the sketch that bounds from below how many shingles two sets don't share.
SKETCH_BITS = 1024
SIGNED = "doc_id long, class binary, n long, chunks array<long>, sketch array<long>"


def chunks_for(percent: int, miss: float = MISS) -> int:
    """Chunks of four symbols that keep pairs at the threshold within the distance."""
    differ = 1 - percent / 100
    m = 1
    while True:
        k = CHUNK * m
        tail = sum(
            comb(k, d) * differ**d * (1 - differ) ** (k - d) for d in range(2 * m, k + 1)
        )
        if tail <= miss:
            return m
        m += 1


# ---- shingles and signatures -----------------------------------------------


def shingles(hashes: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and their bounds; ``at`` bounds the rows' words.

    A row of fewer words has one shingle, its whole sequence; a row without words none.
    """
    factors = mix(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    count = np.diff(at)
    bounds = np.append(0, np.cumsum(np.where(count >= words, count - words + 1, np.minimum(count, 1))))
    out = np.zeros(bounds[-1], np.uint64)
    if len(hashes) >= words:
        run = reduce(
            np.add, (hashes[j : len(hashes) - words + 1 + j] * factors[j] for j in range(words))
        )
        row = np.repeat(np.arange(len(count)), count)[: len(run)]
        inside = np.flatnonzero(np.arange(len(run)) + words <= at[row + 1])
        out[bounds[row[inside]] + inside - at[row[inside]]] = mix(run[inside])
    for r in np.flatnonzero((count > 0) & (count < words)):
        own = hashes[at[r] : at[r + 1]]
        whole = (own * factors[: len(own)]).sum(keepdims=True) + factors[-1:] * np.uint64(len(own))
        out[bounds[r]] = mix(whole)[0]
    return out, bounds


def signatures(values: np.ndarray, bounds: np.ndarray, symbols: int) -> np.ndarray:
    """14-bit MinHash symbols, a row for each non-empty run of shingles."""
    rng = np.random.default_rng(SEED)
    flips = rng.integers(0, 2**63, symbols).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    factors = rng.integers(0, 2**63, symbols).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), symbols), np.uint16)
    for j in range(symbols if len(starts) else 0):
        low = np.minimum.reduceat((values ^ flips[j]) * factors[j], starts)
        out[:, j] = mix(low) & np.uint64(0x3FFF)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parities of the numbers of shingles in ``SKETCH_BITS`` cells, as rows of 64-bit words.

    A shingle that only one of two sets has changes one bit, so two sketches differ in no
    more bits than their sets in shingles.
    """
    out = np.empty((len(sets), SKETCH_BITS // 8), np.uint8)
    for row, one in zip(out, sets, strict=True):
        cells = (mix(one) % np.uint64(SKETCH_BITS)).astype(np.int64)
        row[:] = np.packbits(np.bincount(cells, minlength=SKETCH_BITS) & 1)
    return out.view("<i8")


def _rows(batch: pa.RecordBatch, words: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Classes and sets of distinct shingles of the rows; all shingles and their bounds."""
    data, bounds = utf8(batch.column("text"))
    starts, ends, at = word_bounds(data, bounds, SPACES)
    hashes = word_hashes(data, starts, ends)
    values, cuts = shingles(hashes, at, words)
    classes = [
        hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(at[:-1], at[1:], strict=True)
    ]
    sets = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return classes, sets, values, cuts


def _sign(batches: Iterator[pa.RecordBatch], words: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        classes, sets, values, cuts = _rows(batch, words)
        sizes = np.array([len(s) for s in sets], np.int64)
        chunks = np.zeros((len(sets), m), np.int64)
        chunks[sizes > 0] = signatures(values, cuts, CHUNK * m).view("<i8")
        longs = [
            pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            for x in (chunks, sketches(sets))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(sizes), *longs],
            ["doc_id", "class", "n", "chunks", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        classes, sets, _, _ = _rows(batch, words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["class", "set"],
        )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Linked pairs of rows in order: the set of ``a`` comes first, with null ``b``."""
    own, of = np.zeros(0, np.uint64), None
    for batch in blocks(batches, "set"):
        linked = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "set")))
        for a, salt, b, one in rows:
            one = np.frombuffer(one, np.uint64)
            if b is None:
                own, of = one, (a, salt)
                linked.append(False)
                continue
            if (a, salt) != of:
                raise ValueError(f"no set of {a} before its pairs")
            both = len(np.intersect1d(own, one, assume_unique=True))
            linked.append(100 * both >= percent * (len(own) + len(one) - both))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def forest(
    roots: np.ndarray, first: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Pairs of members whose links join all components that links of the block join.

    ``first`` tells the members, at the front, that are compared with the others, or with
    each other if there are no others; members of one root are joined already.
    """
    roots = roots.copy()
    behind = 0 if first.all() else int(first.sum())
    sizes = np.array([len(x) for x in sets])
    bounds = np.append(0, np.cumsum(sizes))
    values = np.concatenate(sets)
    order = np.argsort(values)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(np.append(False, np.diff(values[order]) != 0))
    del values, order
    mark = np.zeros(len(number), bool)
    sketch = sketches(sets).view(np.uint64)
    found = []
    for x in np.flatnonzero(first).tolist():
        start = max(x + 1, behind)
        others = np.flatnonzero(roots[start:] != roots[x]) + start
        least, most = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[100 * least >= percent * most]
        apart = np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        alike = apart * (100 + percent) <= (sizes[others] + sizes[x]) * (100 - percent)
        others = others[alike]
        if not len(others):
            continue
        own = number[bounds[x] : bounds[x + 1]]
        mark[own] = True
        ahead = np.cumsum(sizes[others]) // COUNTED
        for some in np.split(others, np.flatnonzero(np.diff(ahead)) + 1):
            many = sizes[some]
            runs = np.cumsum(many) - many
            at = np.repeat(bounds[some] - runs, many) + np.arange(int(many.sum()))
            both = np.add.reduceat(mark[number[at]], runs, dtype=np.int64)
            for y in some[100 * both >= percent * (sizes[x] + many - both)].tolist():
                if roots[x] != roots[y]:
                    found.append((x, y))
                    roots[roots == roots[y]] = roots[x]
        mark[own] = False
    return found


def _join_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each block of a bucket; rows are in order of key and blocks."""
    names = ["key", "block_a", "block_b"]
    held: list[tuple] = []
    of = None

    def links() -> pa.RecordBatch:
        block = of[1]
        rows = sorted(held, key=lambda r: (r[0] != block, r[1]))
        # Inside one block all are compared, else those of the first with the second's.
        first = np.array([r[0] == block for r in rows], bool)
        roots = np.array([r[2] for r in rows], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        nodes = [r[1] for r in rows]
        pairs = forest(roots, first, sets, percent)
        return pa.record_batch(
            [pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    for batch in blocks(batches, "set"):
        keys = zip(*(batch.column(c).to_pylist() for c in names))
        rows = zip(*(batch.column(c).to_pylist() for c in ("block", "node", "root", "set")))
        for key, row in zip(keys, rows):
            if key != of and held:
                yield links()
                held = []
            of = key
            held.append(row)
    if held:
        yield links()


# ---- the join --------------------------------------------------------------


def _keys(classes: DataFrame, m: int) -> DataFrame:
    """``key, node``: for each chunk and each symbol left out, where and what is left."""
    keys = []
    for chunk in range(m):
        x = F.get("chunks", F.lit(chunk))
        for p in range(CHUNK):
            low = x.bitwiseAND(F.lit((1 << 16 * p) - 1))
            high = F.shiftleft(F.shiftrightunsigned(x, 16 * (p + 1)), 16 * p) if p + 1 < CHUNK else F.lit(0)
            keys.append(low.bitwiseOR(high.cast("long")).bitwiseOR(F.lit((chunk * CHUNK + p) << 48)))
    return classes.select("node", F.explode(F.array(*keys)).alias("key"))


def _distance(a: str, b: str, m: int) -> Column:
    """Symbols in which two signatures differ.

    A symbol has 14 bits of a 16-bit lane: adding 2^14 - 1 sets the bit above them exactly
    where the lane is not zero, and never carries.
    """
    total = F.lit(0)
    for chunk in range(m):
        x = F.get(a, F.lit(chunk)).bitwiseXOR(F.get(b, F.lit(chunk)))
        lanes = (x + F.lit(0x3FFF3FFF3FFF3FFF)).bitwiseAND(F.lit(0x4000400040004000))
        total = total + F.bit_count(lanes)
    return total


def _near(m: int, percent: int) -> Column:
    """Within the signature distance, and of sizes and sketches that allow the similarity.

    With s shingles in both sets together and x of them in one only, the similarity is
    (s - x) / (s + x); the sketches differ in at most x bits.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    # Few pairs come this far, so one small expression over the words does.
    differ = F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    alike = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return sizes & (_distance("chunks_a", "chunks_b", m) <= 2 * m - 1) & alike


def _signed(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """Columns that :func:`_near` needs, and ``more``, named for one side of a join."""
    names = ["n", "chunks", "sketch", *more]
    return rows.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``node, set``: full sets of shingles of the classes, written once."""
    needed = classes.join(nodes, "node", "left_semi").select("node", "class", "low")
    needed = through_files(needed, "needed")
    lows = small(needed.select("low").distinct(), 16)
    same = docs["doc_id"].eqNullSafe(lows["low"])
    texts = docs.join(lows, same, "left_semi").select("text")
    sets = texts.mapInArrow(partial(_sets, words=words), "class binary, set binary")
    sets = needed.join(sets, "class").groupBy("node").agg(F.first("set").alias("set"))
    return through_files(sets, "sets")


def _links(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int
) -> DataFrame:
    """The pairs ``a, b`` that are linked, confirmed on the full sets of shingles.

    The set of ``a`` travels once for each ``PAIRS`` pairs of it.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(nodes, docs, classes, words)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("b") / PAIRS).alias("salts"))
    own = salts.join(sets.withColumnRenamed("node", "a"), "a")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    own = own.select("a", number.alias("salt"), F.lit(None).cast("long").alias("b"), "set")
    others = pairs.join(sets.withColumnRenamed("node", "b"), "b").join(salts, "a")
    others = others.select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", "set")
    rows = own.union(others).repartition(width(pairs), "a", "salt")
    rows = rows.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return through_files(
        rows.mapInArrow(partial(_confirm, percent=percent), "a long, b long"), "links"
    )


def _block_links(
    members: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links inside buckets, ``members`` being ``key, node, root_node, n``.

    A bucket is cut into blocks by a hash of the node, so that two blocks fit in a task;
    every pair of its blocks is one piece of work.
    """
    bytes_, count = F.sum("n") * 8 / BLOCK_BYTES, F.count("node") / BLOCK_NODES
    cuts = members.groupBy("key").agg(F.ceil(F.greatest(bytes_, count)).alias("cuts"))
    rows = members.join(cuts, "key")
    block, last = F.pmod(F.xxhash64("node"), "cuts"), F.col("cuts") - 1
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select(
        "key",
        F.least("block", "other").alias("block_a"),
        F.greatest("block", "other").alias("block_b"),
        "block",
        "node",
        F.col("root_node").alias("root"),
    )
    sets = _sets_of(members.select("node").distinct(), docs, classes, words)
    key = ["key", "block_a", "block_b"]
    rows = rows.join(sets, "node").repartition(width(members), *key).sortWithinPartitions(*key)
    return through_files(
        rows.mapInArrow(partial(_join_blocks, percent=percent), "a long, b long"), "links"
    )


def _roots(links: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the root of each node column of ``names``, as ``root_<name>``."""
    found = components(links)
    for name in names:
        rows = rows.join(found.toDF(name, f"root_{name}"), name, "left")
        rows = rows.withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
    return rows


def find_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but blanks and line ends, A-Z taken as a-z.  Two texts are
    linked if their sets of shingles have at least ``percent`` of their union in common.
    A text without words, or null, is linked with nothing.  ``component_id`` is the smallest
    doc_id reachable; null ids count only where a component has no other.  Rows that share
    doc_id and text are alike in every column.  Other columns are ignored; an empty table
    gives no rows.
    """
    m = chunks_for(percent, miss)
    docs = id_text(docs)
    signed = through_files(docs.mapInArrow(partial(_sign, words=words, m=m), SIGNED), "signed")
    with_words = signed.where(F.col("class").isNotNull())
    classes = with_words.groupBy("class").agg(
        F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "chunks", "sketch")]
    )
    classes = through_files(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = _keys(classes, m)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = through_files(keys.join(sizes, "key"), "shared-keys")
    # The text that others are copies of shares more keys with them than they do with each
    # other; as the leader of its buckets it links them all.
    fame = shared.groupBy("node").agg(F.sum("size").alias("fame"))
    famed = through_files(shared.select("key", "node").join(fame, "node"), "shared-keys")
    leader = F.max(F.struct("fame", "node"))["node"].alias("leader")
    leaders = famed.groupBy("key").agg(leader)
    buckets = through_files(famed.select("key", "node").join(leaders, "key"), "buckets")

    stars = buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(_signed(classes, "a"), "a").join(_signed(classes, "b"), "b")
    stars = through_files(stars.where(_near(m, percent)).select("a", "b"), "pairs")
    # One leader for each member first: what that links needs no further confirmation.
    famous = F.max(F.struct("fame", "a"))["a"].alias("a")
    first = stars.join(fame.withColumnRenamed("node", "a"), "a").groupBy("b").agg(famous).select("a", "b")
    links = _links(first, docs, classes, words, percent)
    rest = _roots(links, stars.join(first, ["a", "b"], "left_anti"), "a", "b")
    rest = through_files(rest.where("root_a != root_b").select("a", "b"), "pairs")
    links = links.union(_links(rest, docs, classes, words, percent))

    members = _roots(links, buckets, "node", "leader")
    mixed = members.groupBy("key").agg(
        F.bool_or(F.col("root_node") != F.col("root_leader")).alias("mixed"),
        F.count("node").alias("size"),
    )
    members = members.join(mixed.where("mixed"), "key").drop("mixed", "fame")
    signs = classes.select("node", "n", "chunks", "sketch")
    members = through_files(members.join(signs, "node"), "members")
    many = members.where(F.col("size") > FEW).select("key", "node", "root_node", "n")
    links = links.union(_block_links(many, docs, classes, words, percent))

    few = members.where(F.col("size") <= FEW)
    others = _signed(few, "a", "key", "root_node", "root_leader")
    others = others.where("root_node_a != root_leader_a")
    every = _signed(few, "b", "key", "root_node", "root_leader")
    apart = F.col("root_node_a") != F.col("root_node_b")
    once = (F.col("root_node_b") == F.col("root_leader_b")) | (F.col("a") < F.col("b"))
    pairs = others.join(every, F.col("key_a") == F.col("key_b")).where(apart & once)
    pairs = pairs.where(_near(m, percent)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = through_files(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(_links(pairs, docs, classes, words, percent))

    rooted = through_files(_roots(links, classes.select("node", "class", "low"), "node"), "rooted")
    lowest = rooted.groupBy("root_node").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root_node").select("class", "component_id")
    without = signed.where(F.col("class").isNull()).withColumn("component_id", F.col("doc_id"))
    found = with_words.join(named, "class").unionByName(without.select(*with_words.columns, "component_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one doc_id of each group.

    Rows without doc_id stay; a repeated doc_id stays if :func:`find_groups` keeps any of
    its rows.
    """
    found = find_groups(docs, words, percent).groupBy("doc_id").agg(F.max("kept").alias("stays"))
    gone = through_files(found.where("not stays").select(F.col("doc_id").alias("gone_id")), "near-copies")
    gone = small(gone, 16)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: groups of near copies in the documents table, by shingles of three words."""
    return find_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
