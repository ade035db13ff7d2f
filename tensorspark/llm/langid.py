"""Language by segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all ways to cut it into pieces of a
fixed public vocabulary, of the product of the pieces' probabilities: a forward algorithm
gives it in one pass over the word.  Probabilities are fitted by expectation maximisation on
a sample of labelled rows; expected counts come from the same lattices.  Words are runs of
letters, in lower case, and each begins with the vocabulary's word mark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import (
    blocks,
    bound_batches,
    forget_left,
    mix,
    rows_frame,
    table,
    through_files,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN = "und"
#: Labelled rows that the model is fitted on, about; their whole texts are used.
TRAIN_DOCS = 10_000
#: Labelled rows of a language that are used at least, if it has so many.
LEAST_DOCS = 100
ROUNDS = 3
#: Pseudo-count of each piece.
SMOOTHING = 0.1
#: Probability, in every language, of a character that is no piece of its own.
UNSEEN = 1e-8
#: Characters of a word, with its mark, up to which products stay above the smallest double;
#: longer words are summed in logarithms, one by one.
PLAIN = 36
#: Words whose probabilities a task keeps.
KEPT = 150_000
#: The pipeline rejects a text whose best language has a lower posterior ...
LEAST_SCORE = 0.5
#: ... or gives its characters a lower mean log-probability than this share of the labelled
#: rows of that language have, less an allowance: ``SLACK``, more if the language has few
#: rows (twice for ``FEW_DOCS``), and ``SHORT`` over the root of the text's characters.
LOW_SHARE = 0.01
SLACK, FEW_DOCS, SHORT = 1.0, 10, 5.0
#: ... or is so much less probable (logarithm) than if all pieces were equally likely, and
#: its best language has ``FEW_DOCS`` labelled rows.
ODDS = -5.0

_MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 18


def words_of(text: str) -> list[str]:
    """Runs of letters (category L alone: no numerals, which a word pattern lets through)."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()


class Pieces:
    """The vocabulary: ids of pieces by a hash of their characters."""

    def __init__(self, path: str = PIECES):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.names = sorted(set(normal))
        self.longest = max(map(len, self.names))
        self.hashes = np.array([self.hash(p) for p in self.names], np.uint64)
        self.table = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for i, slot in enumerate(self._slot(self.hashes).tolist()):
            probe = 0
            while self.table[(slot + probe) % len(self.table)] >= 0:
                probe += 1
            self.table[(slot + probe) % len(self.table)] = i
            self.probes = max(self.probes, probe + 1)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % 2**64
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and those pieces' ids."""
        ids = np.full(len(hashes), -1, np.int32)
        slot, left = self._slot(hashes), np.arange(len(hashes))
        for _ in range(self.probes):
            found = self.table[slot]
            same = (found >= 0) & (self.hashes[found] == hashes[left])
            ids[left[same]] = found[same]
            more = ~same & (found >= 0)
            slot, left = (slot[more] + 1) % len(self.table), left[more]
            if not len(left):
                break
        at = np.flatnonzero(ids >= 0)
        return at, ids[at]

    def lattice(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, to and id of all pieces of one word, in order of their ends."""
        size = len(word)
        sums, total = np.zeros(size + 1, np.uint64), 0
        for i, c in enumerate(word):
            total = (total * int(_BASE) + ord(c)) % 2**64
            sums[i + 1] = total
        begins, ends, ids, power = [], [], [], 1
        for length in range(1, min(self.longest, size) + 1):
            power = power * int(_BASE) % 2**64
            at, found = self.find(sums[length:] - sums[:-length] * np.uint64(power))
            if length == 1:
                every = np.full(size, -1, np.int32)
                every[at] = found
                at, found = np.arange(size), every
            begins.append(at)
            ends.append(at + length)
            ids.append(found)
        order = np.argsort(np.concatenate(ends), kind="stable")
        return tuple(np.concatenate(x)[order] for x in (begins, ends, ids))

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Pieces inside words of one length: from, to, which words, and the pieces' ids.

        Ends come in order.  ``-1`` stands for a character that is no piece.
        """
        size = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars = np.ascontiguousarray(chars.reshape(-1, size).T).astype(np.uint64)
        sums = np.zeros((size + 1, len(words)), np.uint64)
        power = [np.uint64(1)]
        for i in range(size):
            sums[i + 1] = sums[i] * _BASE + chars[i]
            power.append(np.uint64(int(power[-1]) * int(_BASE) % 2**64))
        for end in range(1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                at, ids = self.find(sums[end] - sums[begin] * power[end - begin])
                if end - begin == 1 and len(at) < len(words):
                    unseen = np.full(len(words), -1, np.int32)
                    unseen[at] = ids
                    at, ids = np.arange(len(words)), unseen
                if len(at):
                    yield begin, end, at, ids


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length each, without those above ``PLAIN``."""
    groups: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        if len(word) <= PLAIN:
            groups.setdefault(len(word), []).append(k)
    for own in groups.values():
        for a in range(0, len(own), 20_000):
            yield own[a : a + 20_000]


@dataclass
class Model:
    """Languages, and the probability of each piece (and of an unseen character, last).

    ``floors`` has, for each language, the lowest mean log-probability of a character in a
    long text (see ``LOW_SHARE``), and the lowest odds against equally likely pieces.
    """

    languages: list[str]
    pieces: Pieces
    table: np.ndarray
    floors: np.ndarray | None = None

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Logarithms of the words' probabilities, a column for each language."""
        marked = [_MARK + w for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for own in _by_length(marked):
            group = [marked[k] for k in own]
            forward = np.zeros((len(group[0]) + 1, len(group), len(self.languages)))
            forward[0] = 1
            for begin, end, at, ids in self.pieces.edges(group):
                forward[end, at] += forward[begin, at] * self.table[ids]
            out[own] = np.log(forward[-1])
        table = np.log(self.table)
        for k, word in enumerate(marked):
            if len(word) > PLAIN:
                begin, end, ids = self.pieces.lattice(word)
                out[k] = _log_sums(begin, end, table[ids], len(word))[-1]
        return out

    def expected(self, words: list[str], language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in words with a language and a frequency each."""
        marked = [_MARK + w for w in words]
        counts = np.zeros(self.table.size)

        def add(ids: np.ndarray, lang: np.ndarray, share: np.ndarray) -> None:
            nonlocal counts
            place = np.where(ids < 0, len(self.table) - 1, ids) * len(self.languages) + lang
            counts += np.bincount(place, share, minlength=len(counts))

        for own in _by_length(marked):
            group, lang = [marked[k] for k in own], language[own]
            edges = list(self.pieces.edges(group))
            forward = np.zeros((len(group[0]) + 1, len(group)))
            backward = np.zeros_like(forward)
            forward[0] = backward[-1] = 1
            for begin, end, at, ids in edges:
                forward[end, at] += forward[begin, at] * self.table[ids, lang[at]]
            for begin, end, at, ids in reversed(edges):
                backward[begin, at] += backward[end, at] * self.table[ids, lang[at]]
            weight = n[own] / forward[-1]
            for begin, end, at, ids in edges:
                share = forward[begin, at] * self.table[ids, lang[at]] * backward[end, at] * weight[at]
                add(ids, lang[at], share)
        for k, word in enumerate(marked):
            if len(word) > PLAIN:
                begin, end, ids = self.pieces.lattice(word)
                step = np.log(self.table[ids, language[k]])[:, None]
                ahead = _log_sums(begin, end, step, len(word))[:, 0]
                # Backwards is forwards along the word turned round.
                turn = np.argsort(-begin, kind="stable")
                last = len(word)
                behind = _log_sums(last - end[turn], last - begin[turn], step[turn], last)[::-1, 0]
                share = np.exp(ahead[begin] + step[:, 0] + behind[end] - ahead[-1]) * n[k]
                add(ids, np.full(len(ids), language[k]), share)
        return counts.reshape(self.table.shape)


def _log_sums(begin: np.ndarray, end: np.ndarray, steps: np.ndarray, size: int) -> np.ndarray:
    """Logarithm of the sum over all ways to each place; edges are in order of their ends."""
    out = np.zeros((size + 1, steps.shape[1]))
    cuts = np.searchsorted(end, np.arange(1, size + 2)).tolist()
    for place in range(1, size + 1):
        own = slice(cuts[place - 1], cuts[place])
        ways = out[begin[own]] + steps[own]
        most = ways.max(axis=0)
        out[place] = most + np.log(np.exp(ways - most).sum(axis=0))
    return out


def _normalized(counts: np.ndarray) -> np.ndarray:
    table = counts[:-1] + SMOOTHING
    table = table / table.sum(axis=0)
    return np.vstack((table, np.full((1, counts.shape[1]), UNSEEN)))


# ---- fitting ---------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_left()
    for batch in blocks(batches):
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            counts.update((lang, w) for w in words_of(text or ""))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.string()),
                pa.array(counts.values(), pa.int64()),
            ],
            ["lang", "word", "n"],
        )


def _expect(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    number = {lang: k for k, lang in enumerate(model.languages)}
    counts = np.zeros(model.table.shape)
    for batch in batches:
        if batch.num_rows:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            counts += model.expected(
                batch.column("word").to_pylist(), lang, batch.column("n").to_numpy()
            )
    piece, lang = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(piece), pa.array(lang), pa.array(counts[piece, lang])], ["piece", "lang", "n"]
    )


def _labelled_fits(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How well each labelled row fits its own language."""
    forget_left()
    number = {lang: k for k, lang in enumerate(model.languages)}
    scorer = Scorer(model)
    for batch in blocks(batches):
        lang = batch.column("lang").to_pylist()
        full, total, chars = scorer.totals(batch.column("text").to_pylist())
        own = [lang[k] for k in full.tolist()]
        fit = total[np.arange(len(own)), [number[x] for x in own]] / chars if own else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.string()), pa.array(fit, pa.float64())], ["lang", "fit"]
        )


def _floors(sample: DataFrame, model: Model) -> np.ndarray:
    """The model's ``floors`` from labelled rows; none for a language without rows."""
    fits = sample.mapInArrow(partial(_labelled_fits, model=model), "lang string, fit double")
    low = fits.groupBy("lang").agg(
        F.percentile("fit", F.lit(LOW_SHARE)).alias("low"), F.count(F.lit(1)).alias("n")
    )
    floors = {
        r.lang: (r.low - SLACK * (1 + FEW_DOCS / r.n), ODDS if r.n >= FEW_DOCS else -np.inf)
        for r in low.collect()
    }
    return np.array([floors.get(lang, (-np.inf, -np.inf)) for lang in model.languages])


def _rows_each(counts: list[int], bound: int) -> float:
    """Most rows of a language, so that ``bound`` is dealt evenly: small ones give all they have."""
    level, left = 0.0, float(bound)
    for k, n in enumerate(sorted(counts)):
        level = left / (len(counts) - k)
        if n > level:
            break
        left, level = left - n, float(n)
    return max(level, LEAST_DOCS)


def fit(
    docs: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, pieces: str = PIECES
) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang).

    Learns from rows with an id, a language and a text with a letter that aren't
    :func:`held_out`: from all of them, or, if they are more than ``train_docs``, from about
    so many.  Rows of all languages are counted; a language gives all its rows up to an even
    share of ``train_docs`` (what smaller ones leave goes to the others), or up to
    ``LEAST_DOCS`` if that is more, and of more rows those with the smallest hashes of the id.
    So the languages don't depend on the size of the table.  The driver sees no more than the
    vocabulary times the languages.
    """
    bound_batches(docs.sparkSession)
    doc_id, lang, text = docs["doc_id"], docs["lang"], docs["text"]
    place = F.pmod(F.xxhash64(doc_id.cast("long"), F.lit("sample")), F.lit(1 << 30))
    usable = docs.where(
        doc_id.isNotNull() & lang.isNotNull() & text.rlike(r"\p{L}") & ~held_out(doc_id)
    ).select(place.alias("place"), lang.alias("lang"), text.alias("text"))
    found = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    counts = sorted(found.collect(), key=lambda r: r.lang)
    languages = [r.lang for r in counts]
    most = _rows_each([r.n for r in counts], train_docs)
    last = [max(int(min(1.0, most / r.n) * (1 << 30)), r.first) for r in counts]
    ends = pa.table({"lang": pa.array(languages, pa.string()), "last": pa.array(last, pa.int64())})
    limits = F.broadcast(rows_frame(docs.sparkSession, ends))
    sample = usable.join(limits, "lang").where(F.col("place") <= F.col("last")).select("lang", "text")
    sample = through_files(sample, "sample")
    words = sample.mapInArrow(_count_words, "lang string, word string, n long")
    words = through_files(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    vocabulary = Pieces(pieces)
    shape = (len(vocabulary.names) + 1, len(languages))
    model = Model(languages, vocabulary, _normalized(np.ones(shape)))
    for _ in range(rounds if languages else 0):
        found = words.mapInArrow(partial(_expect, model=model), "piece long, lang long, n double")
        counts = np.zeros(shape)
        rows = found.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts[rows["piece"], rows["lang"]] = rows["n"]
        model = Model(languages, vocabulary, _normalized(counts))
    return replace(model, floors=_floors(sample, model)) if languages else model


# ---- predicting ------------------------------------------------------------


class Scorer:
    """Predicts texts; keeps the probabilities of words it has seen in its task."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the texts that have words; their log-probabilities and characters.

        A row of log-probabilities has a column for each language.  A word's mark counts as
        a character.
        """
        found = [words_of(t) if t else [] for t in texts]
        new = list(set().union(*found).difference(self.index))
        if len(self.index) + len(new) > KEPT:
            self.index, self.rows = {}, self.rows[:0]
            new = list(set().union(*found))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        chars = np.array([len(w) + 1.0 for w in new]).reshape(-1, 1)
        self.rows = np.concatenate((self.rows, np.hstack((self.model.log_probability(new), chars))))
        sizes = np.array([len(f) for f in found], np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return full, np.zeros((0, len(self.model.languages))), np.zeros(0)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64)
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(self.rows[at], starts, axis=0)
        return full, total[:, :-1], total[:, -1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        full, total, _ = self.totals(texts)
        if not self.model.languages or not len(full):
            return names, scores
        for row, k in zip(full.tolist(), total.argmax(axis=1).tolist(), strict=True):
            names[row] = self.model.languages[k]
        scores[full] = np.round(_posterior(total), 6)
        return names, scores


def _posterior(total: np.ndarray) -> np.ndarray:
    """The best languages' posteriors under equal priors."""
    return 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def _with_equal_pieces(model: Model) -> Model:
    """The model with one more language, last, in which all pieces are equally likely."""
    equal = _normalized(np.ones((len(model.table), 1)))
    return replace(model, languages=[*model.languages, UNKNOWN], table=np.hstack((model.table, equal)))


def _known(scorer: Scorer, texts: list[str | None], least: float) -> np.ndarray:
    """Whether the texts' language is known, by a scorer :func:`_with_equal_pieces`."""
    known = np.zeros(len(texts), bool)
    full, total, chars = scorer.totals(texts)
    total, equal = total[:, :-1], total[:, -1]
    if len(full):
        good = np.round(_posterior(total), 6) >= least
        if scorer.model.floors is not None:
            top = total.max(axis=1)
            floor, odds = scorer.model.floors[total.argmax(axis=1)].T
            good &= (top / chars >= floor - SHORT / np.sqrt(chars)) & (top - equal >= odds)
        known[full] = good
    return known


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    forget_left()
    scorer = Scorer(model)
    for batch in blocks(batches):
        names, scores = scorer.predict(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(names, pa.string()),
                pa.array(scores),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, lang_pred, score.

    ``score`` is the posterior of the best language under equal priors.  ``und`` with score
    0 where the text is null or has no letter, or where no language could be learnt.  Of
    equally probable languages the first in the order of their names is predicted.  A null
    doc_id isn't held out (and never learnt from); repeated rows and ids do no harm; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        held_out(docs["doc_id"]).alias("held_out"),
        docs["text"].alias("text"),
    )
    return rows.mapInArrow(
        partial(_predict, model=model),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )


def drop_unknown(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns.

    The best language's posterior must be ``least``, and its characters must be about as
    probable as those of labelled rows of that language; see ``LOW_SHARE``.  Null and empty
    texts, and texts without letters, are unknown; without a learnt language nothing else is.
    Repeated rows go the same way; of equally probable languages the first in order counts.
    An empty table stays empty.
    """
    if not model.languages:
        return docs.where(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))

    @F.arrow_udf("boolean")
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_left()
        scorer = Scorer(_with_equal_pieces(model))  # for the whole task: it remembers words
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = blocks(iter([batch]))
            found = [_known(scorer, b.column("text").to_pylist(), least) for b in parts]
            yield pa.array(np.concatenate([np.zeros(0, bool), *found]))

    return docs.where(known(docs["text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: language of all documents, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
