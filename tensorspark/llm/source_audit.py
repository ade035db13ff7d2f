"""How far the words of each source lie from those of its language and of other sources.

A shard is a few megabytes of text in one Arrow buffer.  Its words are pointers to their
first bytes; :func:`sort_words` sorts them by multikey quicksort, eight bytes of the words at
a time: what is equal in one slice goes on with the next, what differs is settled.  A run of
equal words then tells how many documents have the word, and how often each source has it.
Only these counts are shuffled.

Shares are whole numbers of a billionth: ``p = 1 + floor(10^9 (count + 1) / (N + V))``, and a
divergence is ``floor((p - q)^2 / q)``, all in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorspark.llm.common import (
    LOWER,
    bound_batches,
    free_memory,
    leading_bytes,
    small,
    table,
    through_files,
    utf8,
    word_bounds,
)

#: Documents of its language that a term must be in.
LEAST_DOCS = 3
#: Terms that a source reports.
TOP = 200
#: Bytes of text in a shard; a longer document is handled in windows of that size.
SHARD_BYTES = 8 << 20
#: Counts that a task holds when it compares sources, and sources that it compares with all.
CELLS, TILE = 1 << 18, 128
COUNTS = "lang string, source string, term string, n long, docs long"

#: Bytes outside terms: ASCII without its letters.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = True
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def sort_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by their bytes, and where runs of equal words begin in it."""
    n = len(starts)
    key = leading_bytes(data, starts, ends - starts)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    depth, live = 8, np.arange(n)
    while True:
        # Runs of two or more with a word that goes on, all their words.
        first = np.flatnonzero(new[live])
        size = np.diff(np.append(first, len(live)))
        longer = (ends - starts)[order[live]] > depth
        some = np.add.reduceat(longer, first) if len(first) else first
        goes_on = np.repeat((size > 1) & (some > 0), size)
        live = live[goes_on]
        if not len(live):
            return order, np.flatnonzero(new)
        words = order[live]
        run = np.cumsum(new[live])
        key = leading_bytes(data, starts[words] + depth, (ends - starts)[words] - depth)
        inner = np.lexsort((key, run))
        order[live], key = words[inner], key[inner]
        new[live[1:]] |= key[1:] != key[:-1]
        depth += 8


def shard_counts(
    data: np.ndarray, bounds: np.ndarray, group: np.ndarray, n_groups: int
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, groups, occurrences and documents of all (term, group) in a shard.

    ``group`` is the group of each document.
    """
    data = np.append(LOWER[data], np.zeros(7, np.uint8))
    starts, ends, at = word_bounds(data[:-7], bounds, NO_LETTER)
    order, runs = sort_words(data, starts, ends)
    doc = np.repeat(np.arange(len(group)), np.diff(at))[order]
    run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    key = np.sort(run * max(len(group), 1) + doc)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.diff(np.append(first, len(key)))
    run, doc = np.divmod(key[first], max(len(group), 1))
    key = run * max(n_groups, 1) + group[doc]
    by = np.argsort(key, kind="stable")
    key, times = key[by], times[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    docs = np.diff(np.append(first, len(key)))
    n = np.add.reduceat(times, first) if len(first) else first
    run, of = np.divmod(key[first], max(n_groups, 1))
    word = order[runs[run]]
    size = (ends - starts)[word]
    to = np.append(0, np.cumsum(size))
    raw = data[np.repeat(starts[word] - to[:-1], size) + np.arange(to[-1])]
    terms = pa.Array.from_buffers(
        pa.large_string(), len(size), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)]
    )
    return terms.cast(pa.string()), of, n, docs


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end outside words."""
    at = 0
    while at < len(data):
        end = min(at + SHARD_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(NO_LETTER[data[end : end + SHARD_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + SHARD_BYTES, len(data))
        yield data[at:end]
        at = end


def _count_shard(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
    numbers = {name: k for k, name in enumerate(dict.fromkeys(names))}
    group = np.array([numbers[name] for name in names], np.int64)
    langs, sources = (pa.array(x, pa.string()) for x in zip(*numbers))

    def rows(terms: pa.Array, of: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        at = pa.array(of)
        return pa.record_batch(
            [langs.take(at), sources.take(at), terms, pa.array(n), pa.array(docs)],
            names=["lang", "source", "term", "n", "docs"],
        )

    # Every group has a row, also without terms.
    nothing = np.zeros(len(numbers), np.int64)
    yield rows(pa.array([""] * len(numbers)), np.arange(len(numbers)), nothing, nothing)
    data, bounds = utf8(batch.column("text"))
    if batch.num_rows > 1 or len(data) <= SHARD_BYTES:
        yield rows(*shard_counts(data, bounds, group, len(numbers)))
        return
    terms: set[str] = set()
    for part in _windows(data):
        found, of, n, docs = shard_counts(part, np.array([0, len(part)]), group, 1)
        terms.update(found.to_pylist())
        yield rows(found, of, n, 0 * docs)
    one = np.ones(len(terms), np.int64)
    yield rows(pa.array(list(terms), pa.string()), 0 * one, 0 * one, one)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``SHARD_BYTES`` of text, or one row."""
    free_memory()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, bounds = utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + SHARD_BYTES - size, side="right")) - 1
            end = min(max(end, at), batch.num_rows)
            if end == at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(bounds[end] - bounds[at])
            if end < batch.num_rows or size >= SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        yield from _count_shard(shard)
        free_memory()


def _quotient(count: Column, all_: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (all + terms))`` by long division in base 1000."""
    whole = all_ + terms
    div = lambda x: F.call_function("div", x, whole)
    rest = count + 1
    out = div(rest) * 10**9
    for power in (10**6, 10**3, 1):
        rest = (rest % whole) * 1000
        out = out + div(rest) * power
    return out + 1


def shares(count: np.ndarray, all_: np.ndarray, terms: int) -> np.ndarray:
    """The same for arrays."""
    whole = all_ + terms
    digit, rest = np.divmod(count + 1, whole)
    out = digit
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _compare(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Divergence of a tile's sources from all others, over the terms of one bucket."""
    names = sources.column("source").to_pylist()
    number = {s: k for k, s in enumerate(names)}
    words = terms.column("term").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    counts = np.zeros((len(names), len(words.dictionary)), np.int64)
    at = np.array([number[s] for s in terms.column("source").to_pylist()], np.int64)
    counts[at, words.indices.to_numpy()] = terms.column("n").to_numpy()
    totals = sources.column("total").to_numpy()[:, None]
    lang, _, tile = (k.as_py() for k in key)
    own = np.flatnonzero(sources.column("own_tile").to_numpy() == tile)
    v = sources.column("n_terms")[0].as_py() if len(names) else 0
    p = shares(counts, totals, v) if counts.shape[1] else counts
    out: list[list] = [[], [], []]
    for g in own.tolist():
        apart = p[g] - p
        value = (apart * apart // p).sum(axis=1) if p.shape[1] else np.zeros(len(names), np.int64)
        others = [h for h in range(len(names)) if h != g]
        out[0] += [names[g]] * len(others)
        out[1] += [names[h] for h in others]
        out[2] += value[others].tolist()
    return pa.table(
        {
            "lang": pa.array([lang] * len(out[0]), pa.string()),
            "source": pa.array(out[0], pa.string()),
            "item": pa.array(out[1], pa.string()),
            "value": pa.array(out[2], pa.int64()),
        }
    )


def kept_terms(docs: DataFrame) -> DataFrame:
    """Counts of the terms in ``LEAST_DOCS`` documents of their language, written once.

    ``lang, source, term, n, n_lang, leads``: occurrences in the source and in the language;
    one row of each term of a language ``leads``.  Every group also has a row for the term
    ``''``, with ``n`` zero, so that none is missing.
    """
    bound_batches(docs.sparkSession)
    given = [docs[c].cast("string") for c in ("lang", "source", "text")]
    texts = docs.select([F.coalesce(c, F.lit("")) for c in given]).toDF("lang", "source", "text")
    counts = texts.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("docs").over(of_term).alias("docs"),
        F.sum("n").over(of_term).alias("n_lang"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("leads"),
    )
    kept = counts.filter((F.col("docs") >= LEAST_DOCS) | (F.col("term") == "")).drop("docs")
    return through_files(kept, "term-counts")


def audit_sources(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``lang`` and ``source``.

    Part ``pair``: every other source of the language by its divergence; part ``term``: the
    ``TOP`` terms that the group has more of than its language.  Null text, lang and source
    are ``''``; empty texts are documents without terms, repeated rows are documents of their
    own; a group without terms has shares of its own (those of zero counts) in part ``pair``
    and no rows in part ``term``; equal values are in byte order of the item.  A source alone
    in its language has no pairs.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    counts = kept_terms(docs)
    terms = counts.filter(F.col("term") != "")
    leads = F.when(F.col("leads") & (F.col("term") != ""), 1)
    langs = counts.groupBy("lang").agg(
        F.count(leads).alias("n_terms"),
        F.sum("n").alias("lang_total"),
        F.count(F.when(F.col("term") == "", 1)).alias("n_sources"),
    )
    tiles = F.ceil(F.col("n_sources") / TILE)
    buckets = F.greatest(F.ceil(F.col("n_terms") * F.col("n_sources") / CELLS), F.lit(1))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    groups = groups.withColumn("tiles", tiles).withColumn("buckets", buckets)
    groups = through_files(groups.drop("n_sources"), "source-totals")
    totals = small(groups, 200)

    rows = terms.join(totals, ["lang", "source"])
    p = _quotient(F.col("n"), F.col("total"), F.col("n_terms"))
    q = _quotient(F.col("n_lang"), F.col("lang_total"), F.col("n_terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    rows = rows.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = rows.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= TOP)

    of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    key, row = ["lang", "bucket", "tile"], ["lang", "source", "term", "n"]
    left = terms.select(row).join(totals.select("lang", "source", "tiles", "buckets"), row[:2])
    left = left.select(*row, spread("term", "buckets").alias("bucket"), of("tiles").alias("tile"))
    right = groups.withColumn("own_tile", spread("source", "tiles"))
    right = right.withColumn("tile", of("tiles")).withColumn("bucket", of("buckets"))
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key))
    pairs = pairs.applyInArrow(_compare, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    part = lambda df, name: df.select(
        "lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int")
    )
    return part(pairs, "pair").unionByName(part(top, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n_lang FROM words GROUP BY lang, term
  HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
occurs AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, n_lang
  FROM groups g JOIN kept k USING (lang) LEFT JOIN occurs h
    ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT lang, source, sum(n) AS all_n FROM counts GROUP BY lang, source),
p AS (
  SELECT c.lang, c.source, c.term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // (all_n + v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (n_lang + 1)) // (total + v)::HUGEINT AS q
  FROM counts c JOIN sums USING (lang, source) JOIN langs USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER
  AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
