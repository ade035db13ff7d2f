"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a run of documents, as a sequence of words.  Its index is a Burrows-Wheeler
transform with a wavelet matrix for ranks, and suffix positions at every ``SAMPLE``-th
place and at the documents' beginnings.  Windows of benchmark items are matched word by
word from their last to their first; occurrences are located from the sampled positions,
and the words they cover are merged to spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import (
    NOT_ALNUM,
    blocks,
    bound_batches,
    id_text,
    open_fs,
    shared_folder,
    table,
    utf8,
    word_bounds,
    word_hashes,
)

WINDOW = 10
SAMPLE = 8
#: Words of a shard; a longer document is indexed in parts that overlap by a window.
SHARD_WORDS = 1 << 19
#: Windows that a task searches at a time, and the size of their files.
WINDOWS_IN_BLOCK = 100_000
FOUND = (
    "doc_id long, n_words long, n_hit long, items array<string>, "
    "spans array<struct<begin: long, end: long>>, clean string"
)


# ---- the index -------------------------------------------------------------


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling that sorts only what is still tied.

    Ties must end before the sequence does, as they do where unique symbols end each part.
    """
    order = np.argsort(ranks, kind="stable")
    n = len(order)
    first = np.append(True, ranks[order][1:] != ranks[order][:-1])
    group = np.empty(n, np.int64)
    group[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    step = 1
    while len(tied):
        at = order[tied]
        key = group[at] * n + group[at + step]
        by_key = np.argsort(key, kind="stable")
        at, key = at[by_key], key[by_key]
        order[tied] = at
        first = np.append(True, key[1:] != key[:-1])
        group[at] = tied[np.flatnonzero(first)[np.cumsum(first) - 1]]
        tied = tied[~(first & np.append(first[1:], True))]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level) & 1
            counts = np.append(0, np.cumsum(ones)).astype(np.int32)
            self.levels.append((level, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of its places."""
        at = [np.zeros(len(symbols), np.int64), *places]
        for level, counts, zeros in self.levels:
            one = (symbols >> level) & 1 == 1
            for k, x in enumerate(at):
                ones = counts[x].astype(np.int64)
                at[k] = np.where(one, zeros + ones, x - ones)
        return [x - at[0] for x in at[1:]]


class FMIndex:
    """Index of documents' words (hashes); ``bounds`` are the documents' in ``words``."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, sample: int = SAMPLE):
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        docs = len(bounds) - 1
        # Each document ends with symbol 0; for the order of suffixes these ends differ.
        ends = bounds[1:] + np.arange(docs)
        n = len(words) + docs
        inner = np.ones(n, bool)
        inner[ends] = False
        text = np.zeros(n, np.int64)
        text[inner] = codes + 1
        ranks = text + docs
        ranks[ends] = np.arange(docs)
        order = suffix_array(ranks)
        self.bwt = text[order - 1].astype(np.int32)
        self.bwt[order == 0] = 0
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.before = np.append(0, np.cumsum(counts)).astype(np.int64)
        self.matrix = WaveletMatrix(self.bwt, max(1, int(len(self.vocabulary)).bit_length()))
        # Walks back end at a sampled place, at the latest where a document begins.
        sampled = (order % sample == 0) | (self.bwt == 0)
        self.sampled = np.append(0, np.cumsum(sampled))
        self.positions = order[sampled]
        self.n = n

    def _back(self, symbols: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        base = self.before[symbols]
        return [base + r for r in self.matrix.rank(symbols, *rows)]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``lo .. hi - 1`` of the phrases (rows of equal length) that occur; which."""
        code = np.searchsorted(self.vocabulary, phrases)
        code = np.minimum(code, len(self.vocabulary) - 1)
        which = np.flatnonzero((self.vocabulary[code] == phrases).all(axis=1))
        code = code[which] + 1
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            lo, hi = self._back(code[:, k], lo, hi)
            live = lo < hi
            which, code, lo, hi = which[live], code[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions (documents' ends counted) of rows, by walking back to sampled ones."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows + 1] > self.sampled[rows]
            out[left[done]] = self.positions[self.sampled[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            (rows,) = self._back(self.bwt[rows], rows)
            steps += 1
        return out


# ---- windows of the benchmark ----------------------------------------------


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, bounds = utf8(batch.column("text"))
        starts, ends, at = word_bounds(data, bounds, NOT_ALNUM)
        hashes = word_hashes(data, starts, ends)
        items, phrases = [], []
        for item, a, b in zip(batch.column("item_id").to_pylist(), at[:-1], at[1:], strict=True):
            size = min(window, b - a)
            for k in range(a, b - size + 1 if size else a):
                items.append(item)
                phrases.append(hashes[k : k + size].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array(phrases, pa.binary())], ["item_id", "phrase"]
        )


def _window_file(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Windows of a partition in files of a bounded size."""
    filesystem, path = open_fs(folder)
    for batch in batches:
        for at in range(0, batch.num_rows, WINDOWS_IN_BLOCK):
            part = batch.slice(at, WINDOWS_IN_BLOCK)
            name = f"{uuid.uuid4().hex}.arrow"
            with filesystem.open_output_stream(f"{path}/{name}") as sink:
                with pa.ipc.new_file(sink, part.schema) as writer:
                    writer.write_batch(part)
            yield pa.RecordBatch.from_pydict({"file": [name]})


def write_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[str, list[str]]:
    """Distinct windows with their items, in files of the shared folder.

    The driver sees the files' names, one for each ``WINDOWS_IN_BLOCK`` windows or partition.
    """
    items = benchmark.select(
        benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text")
    )
    found = items.mapInArrow(partial(_windows, window=window), "item_id string, phrase binary")
    found = found.groupBy("phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    folder = shared_folder(benchmark.sparkSession, "windows")
    names = found.mapInArrow(partial(_window_file, folder=folder), "file string")
    return folder, sorted(r.file for r in names.collect())


def _load_windows(folder: str, name: str) -> tuple[list[bytes], list[list[str]]]:
    filesystem, path = open_fs(folder)
    with filesystem.open_input_file(f"{path}/{name}") as source:
        found = pa.ipc.open_file(source).read_all()
    return found.column("phrase").to_pylist(), found.column("items").to_pylist()


class Windows:
    """Window files; the windows of one file are held at a time."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names
        self.held: tuple[str, list] | None = None

    def __iter__(self) -> Iterator[list[tuple[np.ndarray, list[list[str]]]]]:
        for name in self.names:
            if self.held is None or self.held[0] != name:
                phrases, items = _load_windows(self.folder, name)
                by_size: dict[int, list[int]] = {}
                for k, phrase in enumerate(phrases):
                    by_size.setdefault(len(phrase) // 8, []).append(k)
                groups = [
                    (
                        np.frombuffer(b"".join(phrases[k] for k in own), np.uint64).reshape(-1, size),
                        [items[k] for k in own],
                    )
                    for size, own in sorted(by_size.items())
                ]
                self.held = name, groups
            yield self.held[1]


# ---- documents -------------------------------------------------------------


def _find(
    hashes: np.ndarray, at: np.ndarray, windows: Windows, longest: int
) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are inside a window, and the items found in each document (row)."""
    change = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for a in range(0, len(hashes), SHARD_WORDS):
        b = min(len(hashes), a + SHARD_WORDS + longest - 1)
        rows = np.flatnonzero((at[:-1] < b) & (at[1:] > a))
        bounds = np.clip(np.append(at[rows], at[rows[-1] + 1]), a, b) - a
        index = FMIndex(hashes[a:b], bounds)
        for groups in windows:
            for phrases, owners in groups:
                which, lo, hi = index.search(phrases)
                if not len(which):
                    continue
                many = hi - lo
                rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found = index.locate(np.repeat(lo, many) + rank)
                # Positions count the documents' ends; those before a position go off.
                doc = np.searchsorted(bounds[1:] + np.arange(len(rows)), found)
                begin = found - doc + a
                np.add.at(change, begin, 1)
                np.add.at(change, begin + phrases.shape[1], -1)
                pairs = np.unique(rows[doc] * len(owners) + np.repeat(which, many))
                for pair in pairs.tolist():
                    row, phrase = divmod(pair, len(owners))
                    items.setdefault(row, set()).update(owners[phrase])
    return np.cumsum(change[:-1]) > 0, items


def _scan(
    text: pa.Array, windows: Windows, window: int
) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], dict[int, tuple[list, str]]]:
    """Words and hit words of each row, items by row, and spans and clean text by row."""
    data, bounds = utf8(text)
    starts, ends, at = word_bounds(data, bounds, NOT_ALNUM)
    hit, items = _find(word_hashes(data, starts, ends), at, windows, window)
    sums = np.append(0, np.cumsum(hit))
    n_hit = sums[at[1:]] - sums[at[:-1]]
    cut = {}
    for row in np.flatnonzero(n_hit).tolist():
        own = hit[at[row] : at[row + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        raw = data[bounds[row] : bounds[row + 1]]
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        begins = starts[at[row] + edges[::2]] - bounds[row]
        stops = ends[at[row] + edges[1::2] - 1] - bounds[row]
        spans = [
            {"begin": int(b), "end": int(e)}
            for b, e in zip(chars[begins], chars[stops], strict=True)
        ]
        kept, last = [], 0
        for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
            kept.append(raw[last:b].tobytes())
            last = e
        cut[row] = spans, b"".join([*kept, raw[last:].tobytes()]).decode()
    return np.diff(at), n_hit, items, cut


def _search(
    batches: Iterator[pa.RecordBatch], windows: Windows, window: int
) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in blocks(batches):
        n_words, n_hit, items, cut = _scan(batch.column("text"), windows, window)
        rows = range(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words),
                pa.array(n_hit),
                pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string())),
                pa.array([cut[r][0] if r in cut else [] for r in rows], spans_type),
                pa.array([cut[r][1] if r in cut else None for r in rows], pa.string()),
            ],
            ["doc_id", "n_words", "n_hit", "items", "spans", "clean"],
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, items, spans, clean.

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z taken as a-z.
    Windows are all runs of ``window`` words of an item of ``benchmark`` (item_id, text), or
    all words of a shorter item; an item without words has none.  ``items`` are the ids, as
    strings and in their order, of items with a window in the text; an item without id is
    found but not named.  ``spans`` are the merged stretches of found words (code points,
    end exclusive), ``clean`` the text without them, null where nothing was found.  A null
    text has no words.  Rows are independent, so repeated rows and ids do no harm; other
    columns are ignored; empty tables give no rows or no finds.
    """
    windows = Windows(*write_windows(benchmark, window))
    return id_text(docs).mapInArrow(partial(_search, windows=windows, window=window), FOUND)


def leaks(text: Column, benchmark: DataFrame, window: int = WINDOW) -> Column:
    """Whether any window of the benchmark is in the text."""
    bound_batches(benchmark.sparkSession)
    windows = Windows(*write_windows(benchmark, window))

    @F.arrow_udf("boolean")
    def has_leak(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        found = [_scan(b.column("text"), windows, window)[1] > 0 for b in blocks(iter([batch]))]
        return pa.array(np.concatenate([np.zeros(0, bool), *found]))

    return has_leak(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns."""
    return docs.where(~leaks(docs["text"], benchmark, window))


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: benchmark passages in the documents table."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
