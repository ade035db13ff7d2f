"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens; where tokens of both end at the same byte,
a group of tokens of one stands for a group of the other.  :func:`groups` finds the groups
in the two arrays of token ends.  It holds a shift between the positions in both; a probe
compares the arrays at that shift over a width that doubles while all ends agree, and so
jumps over a stretch of one-to-one tokens.  Where ends differ, the irregular group is walked
to its common end, and the shift is updated.  Many stretches of a block are walked at once.

Counting needs a table of id pairs over the whole corpus: each document's distinct pairs are
written once, counted by an aggregate, and the counts then come back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import compress, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorspark.llm.common import (
    BROADCAST_BYTES,
    blocks,
    free_memory,
    id_text,
    table,
    through_files,
)
from tensorspark.llm.token_counts import token_bytes
from tensorspark.llm.tokens import BYTE_BPE

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Stretches of about so many units of a text are walked beside each other.
STRETCH = 48
#: First width of a probe.
WIDTH = 8
#: Units that a task remembers, and the longest of them in characters.
KEPT, LONGEST = 400_000, 100
#: Characters of a text from which on it is aligned in parts.
LONG_CHARS = 1 << 20
#: Bits of the second id in a key of two.
SHIFT = 15
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<int>, times array<int>"
)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

# A unit is cut off before a space, not the last, after one of these characters.
_CUT = re.compile(" (?<=[!-~À-ÖØ-öø-ÿ] )(?!\\Z)")
_FIRM = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)])) - {"×", "÷"}
#: Units that are encoded together.
TOGETHER = 500


def _is_long(unit: str) -> bool:
    return len(unit) > LONGEST


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of ``start, start + 1 ..`` of each size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def groups(
    a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, width: int = WIDTH
) -> np.ndarray:
    """Irregular groups of two arrays of ends, as rows (first, last of ``a``; of ``b``).

    ``at_a`` and ``at_b`` bound stretches that end at the same byte in both; all other
    tokens are one-to-one.
    """
    i, j = at_a[:-1].copy(), at_b[:-1].copy()
    end_a, end_b = at_a[1:], at_b[1:]
    live = np.flatnonzero(i < end_a)
    found = []
    while len(live):
        # Probe at the current shift, with twice the width while everything agrees.
        probing, w = live, width
        while len(probing):
            step = np.arange(w)
            left = np.minimum(end_a[probing] - i[probing], end_b[probing] - j[probing])
            x = np.minimum(i[probing, None] + step, len(a) - 1)
            y = np.minimum(j[probing, None] + step, len(b) - 1)
            same = (a[x] == b[y]) & (step < left[:, None])
            run = np.where(same.all(axis=1), w, same.argmin(axis=1))
            i[probing] += run
            j[probing] += run
            probing, w = probing[run == w], 2 * w
        live = live[i[live] < end_a[live]]
        # Walk to the common end of the irregular group.
        x, y = i[live], j[live]
        walking = np.arange(len(live))
        while len(walking):
            ends_x, ends_y = a[x[walking]], b[y[walking]]
            x[walking] += ends_x < ends_y
            y[walking] += ends_y < ends_x
            walking = walking[ends_x != ends_y]
        found.append(np.stack([i[live], x, j[live], y], axis=1))
        i[live], j[live] = x + 1, y + 1
        live = live[i[live] < end_a[live]]
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return out[np.argsort(out[:, 0])]


def links(a: np.ndarray, b: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens that share bytes, in order of those bytes."""
    inside_a, inside_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    many_a = ranges(odd[:, 0], odd[:, 1] - odd[:, 0] + 1)
    many_b = ranges(odd[:, 2], odd[:, 3] - odd[:, 2] + 1)
    inside_a[many_a], inside_b[many_b] = True, True
    # Inside a group each byte range between two ends of either belongs to one pair.
    ends = np.sort(np.concatenate((a[many_a], b[many_b])))
    ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
    x = many_a[np.searchsorted(a[many_a], ends)]
    y = many_b[np.searchsorted(b[many_b], ends)]
    x = np.concatenate((np.flatnonzero(~inside_a), x))
    y = np.concatenate((np.flatnonzero(~inside_b), y))
    order = np.argsort(x, kind="stable")
    return x[order], y[order]


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size - 1, left-aligned with one more column, and lengths."""
    wide = len(str(max(size - 1, 0)))
    numbers = np.arange(size)
    length = np.searchsorted(10 ** np.arange(1, wide + 1), numbers, side="right") + 1
    out = np.zeros((size, wide + 1), np.uint8)
    for place in range(wide):
        power = 10 ** np.maximum(length - 1 - place, 0)
        out[:, place] = 0x30 + numbers // power % 10
    return out, length


class Pair:
    """Tokens of both tokenizers, as ids and ends, through units that are encoded once.

    A unit is a text without its leading space, and ends where no token of either goes on:
    before a space that follows a sign, digit or letter.  That holds if the first tokenizer
    splits words with the space before them, and no piece of the second has a space after
    anything else; texts of other tokenizers are one unit each.
    """

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = tokenizers.Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        tokens = sorted(self.a.get_vocab().items(), key=lambda t: t[1])
        self.bytes_a = [b""] * (tokens[-1][1] + 1)
        for token, token_id in tokens:
            try:
                self.bytes_a[token_id] = token_bytes(token)
            except KeyError:  # a special token with letters of its own
                self.bytes_a[token_id] = token.encode()
        size = self.b.get_piece_size()
        raw = [self.b.id_to_piece(k) for k in range(size)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(raw)
        ]
        if size > 1 << SHIFT or len(self.bytes_a) > 1 << (31 - SHIFT):
            raise ValueError("vocabularies too large for a pair of ids in 31 bits")
        splitter = spec["pre_tokenizer"] or {}
        self.cuts = (
            splitter.get("type") == "ByteLevel"
            and splitter["use_regex"]
            and not splitter["add_prefix_space"]
            and spec["normalizer"] is None
            and not any("▁" in p.lstrip("▁") for p in raw)
        )
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.digits_a, self.length_a = _digits(len(self.bytes_a))
        self.digits_b, self.length_b = _digits(size)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.long: list[str] = []
        self.same = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        return [e.ids for e in found], self.b.encode(texts, num_threads=1)

    def _learn(self, units: list[str]) -> None:
        """Adds new units; those with an end that allows it first, encoded in runs.

        A run is taken apart where its units end; if tokens of either don't have the bytes of
        the run, each of its units is encoded alone.
        """
        firm = [self.cuts and u[-1:] in _FIRM and len(u) <= LONGEST for u in units]
        rest = sorted((u for u, f in zip(units, firm) if not f), key=_is_long)
        firm = list(compress(units, firm))
        self.known.update(zip([*firm, *rest], range(len(self.same), len(self.same) + len(units))))
        runs = [firm[k : k + TOGETHER] for k in range(0, len(firm), TOGETHER)]
        runs += [[u] for u in rest]
        same: list[np.ndarray] = []
        sizes: tuple[list[np.ndarray], ...] = ([], [])
        flat: tuple[list[np.ndarray], ...] = ([], [])

        def add(run: list[str], both: tuple[list[int], list[int]]) -> None:
            raw = " ".join(["", *run]).encode()
            good = all(
                b"".join(map(names.__getitem__, ids)) == raw
                for names, ids in zip((self.bytes_a, self.bytes_b), both)
            )
            if not good and len(run) > 1:
                for unit, *alone in zip(run, *self._ids(run)):
                    add([unit], alone)
                return
            same.append(np.full(len(run), good))
            for side, (ids, length) in enumerate(zip(both, (self.size_a, self.size_b))):
                ids = np.array(ids, np.int32)
                size = np.array([len(ids)])
                if len(run) > 1:
                    stops = np.cumsum([len(u.encode()) + 1 for u in run])
                    size = np.diff(np.searchsorted(np.cumsum(length[ids]), stops) + 1, prepend=0)
                flat[side].append(ids)
                sizes[side].append(size)

        for at in range(0, len(runs), 100):
            some = runs[at : at + 100]
            for run, *both in zip(some, *self._ids([" ".join(run) for run in some])):
                add(run, both)
        self.same = np.concatenate((self.same, *same))
        for side in (0, 1):
            more = self.starts[side][-1] + np.cumsum(np.concatenate(sizes[side]))
            self.starts[side] = np.concatenate((self.starts[side], more))
            self.flat[side] = np.concatenate((self.flat[side], *flat[side]))

    def _drop_long(self) -> None:
        """Forgets the long units that were learnt last."""
        for unit in self.long:
            del self.known[unit]
        keep, self.long = len(self.known), []
        if keep < len(self.same):
            self.same = self.same[:keep]
            for side in (0, 1):
                self.starts[side] = self.starts[side][: keep + 1]
                self.flat[side] = self.flat[side][: self.starts[side][-1]].copy()

    def _rows(self, units: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(filterfalse(self.known.__contains__, units)))
        if new:
            self._learn(new)
            self.long = list(filter(_is_long, new))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def tokens(
        self, texts: list[str | None]
    ) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids of both, bounds of texts in both, and bounds of units in both.

        A text that has no tokens by rule has none here.
        """
        if len(self.known) > KEPT:
            self.forget()
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        rows = self._rows([u for some in cut for u in some])
        counts = np.array([len(u) for u in cut], np.int64)
        bounds = np.append(0, np.cumsum(counts))
        odd = np.append(0, np.cumsum(~self.same[rows]))
        good = odd[bounds[1:]] == odd[bounds[:-1]]
        rows = rows[np.repeat(good, counts)]
        counts = np.where(good, counts, 0)
        bounds = np.append(0, np.cumsum(counts))
        ids, docs, cuts = [], [], []
        for side in (0, 1):
            start, size = self.starts[side][rows], np.diff(self.starts[side])[rows]
            ids.append(self.flat[side][ranges(start, size)])
            cuts.append(np.append(0, np.cumsum(size)))
            docs.append(cuts[side][bounds])
        self._drop_long()
        return ids, docs, cuts

    def text_of_groups(
        self, ids: list[np.ndarray], odd: np.ndarray, docs: list[np.ndarray]
    ) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each text, without its last semicolon."""
        last, group = [], []
        for side, first in ((0, 0), (1, 2)):
            ends = np.ones(len(ids[side]), bool)
            ends[ranges(odd[:, first], odd[:, first + 1] - odd[:, first])] = False
            last.append(ends)
            group.append(np.cumsum(ends) - ends)
        stops = [np.append(0, np.flatnonzero(x) + 1) for x in last]
        place_a = np.arange(len(ids[0])) + stops[1][group[0]]
        place_b = np.arange(len(ids[1])) + stops[0][group[1] + 1]
        n = len(ids[0]) + len(ids[1])
        wide = max(self.digits_a.shape[1], self.digits_b.shape[1])
        signs, length = np.zeros((n, wide), np.uint8), np.zeros(n, np.int64)
        for place, side, digits, sizes, mark in (
            (place_a, 0, self.digits_a, self.length_a, b"|"),
            (place_b, 1, self.digits_b, self.length_b, b";"),
        ):
            signs[place, : digits.shape[1]] = digits[ids[side]]
            length[place] = sizes[ids[side]]
            signs[place, length[place]] = np.where(last[side], mark[0], 0x2C)
        raw = signs[np.arange(wide) <= length[:, None]].tobytes()
        at = np.append(0, np.cumsum(length + 1))[docs[0] + docs[1]].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(at, at[1:])]

    def aligned(
        self, texts: list[str | None]
    ) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of each text, its pairs (after ``text << 31``) and their times, its groups."""
        ids, docs, cuts = self.tokens(texts)
        a = np.cumsum(self.size_a[ids[0]])
        b = np.cumsum(self.size_b[ids[1]])
        units = np.unique(np.append(np.arange(0, len(cuts[0]), STRETCH), len(cuts[0]) - 1))
        odd = groups(a, b, cuts[0][units], cuts[1][units])
        x, y = links(a, b, odd)
        n_a, n_b = np.diff(docs[0]), np.diff(docs[1])
        inner = np.append(0, np.cumsum(odd[:, 1] - odd[:, 0]))
        n_groups = n_a - np.diff(inner[np.searchsorted(odd[:, 0], docs[0])])
        n_links = np.diff(np.searchsorted(x, docs[0]))
        key = (ids[0][x].astype(np.int64) << SHIFT) | ids[1][y]
        doc = np.repeat(np.arange(len(texts)), n_links)
        pairs, times = np.unique((doc << 31) | key, return_counts=True)
        found = self.text_of_groups(ids, odd, docs)
        return [n_a, n_b, n_groups, n_links], pairs, times, found

    def long_text(self, text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, str]:
        """The same of one long text, in parts that end where a unit ends.

        Each part is a text like any other; if one has no tokens by rule, the text has none.
        """
        total, digest = np.zeros(4, np.int64), hashlib.sha256()
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + LONG_CHARS) if self.cuts else None
            end = cut.start() if cut else len(text)
            numbers, own, many, found = self.aligned([text[at:end]])
            if not found[0]:
                return [np.zeros(1, np.int64)] * 4, pairs[:0], times[:0], ""
            digest.update(b";" * (at > 0) + found[0])
            total += np.concatenate(numbers)
            pairs, place = np.unique(np.concatenate((pairs, own)), return_inverse=True)
            times = np.bincount(place, np.concatenate((times, many))).astype(np.int64)
            at = cut.end() if cut else len(text)
        return [total[k : k + 1] for k in range(4)], pairs, times, digest.hexdigest()

    def rows(self, texts: list[str | None]) -> tuple[list[pa.Array], list[pa.Array]]:
        """Columns of :data:`ALIGNED` from ``n_a`` on."""
        if len(texts) == 1 and len(texts[0] or "") > LONG_CHARS:
            numbers, pairs, times, digest = self.long_text(texts[0])
            digests = [digest]
        else:
            numbers, pairs, times, found = self.aligned(texts)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found]
        offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) << 31).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)))
            for v in (pairs & (2**31 - 1), times)
        ]
        first = [pa.array(v, pa.int64()) for v in numbers]
        return first + [pa.array(digests, pa.string())], lists


def pair(byte_bpe: str, pieces: str) -> Pair:
    """One pair for each worker, kept with the library's module between tasks."""
    kept = vars(sentencepiece).setdefault("_pairs_by_path", {})
    if (byte_bpe, pieces) not in kept:
        kept[byte_bpe, pieces] = Pair(byte_bpe, pieces)
    return kept[byte_bpe, pieces]


def _align(
    batches: Iterator[pa.RecordBatch], byte_bpe: str, pieces: str
) -> Iterator[pa.RecordBatch]:
    both = pair(byte_bpe, pieces)
    row = TaskContext.get().partitionId() << 36
    for batch in blocks(batches):
        first, lists = both.rows(batch.column("text").to_pylist())
        keys = pa.array(np.arange(row, row + batch.num_rows))
        row += batch.num_rows
        names = [c.strip().split(" ")[0] for c in ALIGNED.split(", ")]
        yield pa.record_batch([keys, batch.column("doc_id"), *first, *lists], names=names)
    both.forget()
    free_memory()


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECE_BPE) -> DataFrame:
    """Counts and groups of each text, and its distinct id pairs with their numbers.

    ``pairs`` holds ``(a << SHIFT) | b`` in order.  Null and empty texts, and texts whose
    tokens' bytes are not a space and the text, have no tokens: zeros, no pairs, and ``''``.
    """
    return id_text(docs).mapInArrow(partial(_align, byte_bpe=byte_bpe, pieces=pieces), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: documents with the pair, and whether no pair of that ``a`` has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair")
    counts = counts.agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def _look_up(batches: Iterator[pa.RecordBatch], counts: Broadcast) -> Iterator[pa.RecordBatch]:
    pairs, n, best = counts.value
    for batch in batches:
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        at = np.searchsorted(pairs, lists.flatten().to_numpy())
        row = lists.value_parent_indices().to_numpy()
        sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        np.add.at(sums[0], row, times * best[at])
        np.add.at(sums[1], row, times * n[at])
        names = [c for c in batch.schema.names if c not in ("pairs", "times", "row")]
        yield pa.record_batch(
            [batch.column(c) for c in names] + [pa.array(s) for s in sums],
            names=[*names, "n_best", "count_sum"],
        )


def count_links(aligned: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The written rows of :func:`align` with ``n_best`` and ``count_sum``.

    The table of pairs is sent to the tasks if it takes at most ``limit`` bytes; otherwise
    the documents' pairs are joined with it, both dealt out by pair, and summed by document.
    """
    spark = aligned.sparkSession
    counts = through_files(pair_counts(aligned), "id-pairs")
    if counts.count() * 13 <= limit:
        found = counts.orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast(
            tuple(found.column(c).to_numpy() for c in ("pair", "n", "best"))
        )
        schema = aligned.drop("row", "pairs", "times").schema
        schema = schema.add("n_best", "long").add("count_sum", "long")
        return aligned.mapInArrow(partial(_look_up, counts=sent), schema).select(COLUMNS)
    rows = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rows = rows.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = rows.join(counts.hint("merge"), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    out = aligned.drop("pairs", "times").join(sums.hint("merge"), "row", "left")
    return out.fillna(0, ["n_best", "count_sum"]).select(COLUMNS)


def align_tokenizers(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECE_BPE
) -> DataFrame:
    """Aligned tokens of all texts, with counts over the corpus.

    One row per row of ``docs``; other columns are not read.  Null ids stay null; repeated
    rows and ids are documents of their own and count each; ties for the highest count of an
    id are all best.  An empty table gives no rows.  The rows of :func:`align` are written to
    the shared folder, so each text is encoded once.
    """
    return count_links(through_files(align(docs, byte_bpe, pieces), "aligned"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
