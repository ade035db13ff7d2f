"""Token counts, mostly without merging: words that are one token are counted, not encoded.

A tokenizer splits a text into pre-tokens and merges each of them on its own, so a
pre-token's number of tokens doesn't depend on its neighbours.  :func:`prove` encodes every
string of the vocabulary alone, once and ahead of the job, and keeps those that normalising
leaves as they are, that are one pre-token, and that merge into one token.  In a text, every
pre-token among them counts one.  Only the others are merged, by the tokenizer's own model.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import blocks, id_text, table, utf8
from tensorspark.llm.tokens import LETTERS, NORMALIZER, SPLIT, WORD_BPE

LIMIT = 2048
COUNTS = "doc_id long, n_bytes long, n_tokens long"
#: Merged pre-tokens whose counts a task remembers, and the longest of them.
KEPT, LONGEST = 200_000, 64
#: Characters of a text that are taken apart at a time, up to the next blank.
PIECE_CHARS = 1 << 20

# Characters that any regular-expression engine puts in the same class, that are their own
# composed form, and whose lower case is one such character; a text of nothing else can be
# split by Python's own engine.  Blank-separated parts with any other character go through
# the tokenizer's normaliser and pre-tokenizer.
_BLANKS = " \t\n\x0b\x0c\r"
_SMALL = "a-zß-öø-ÿ"
_CAPITAL = "A-ZÀ-ÖØ-Þ"
_SIGNS = "!-/:-@\\[-`{-~¡«»¿–—‘’“”„…€"
_OTHER = re.compile(f"[^{_BLANKS}{_SMALL}{_CAPITAL}0-9{_SIGNS}]")
_PARTS = re.compile(f"[^{_BLANKS}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[0-9]|[^{_BLANKS}{_SMALL}0-9]+")
_BYTE = {c: b for b, c in enumerate(LETTERS)}


def byte_level(text: str) -> str:
    return "".join([LETTERS[b] for b in text.encode()])


def token_bytes(token: str) -> bytes:
    """Bytes of a token of a byte-level vocabulary."""
    return bytes(_BYTE[c] for c in token)


class Steps:
    """A tokenizer's steps: special strings, normalising, pre-tokens, merging."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        added = spec["added_tokens"]
        if spec["model"]["type"] != "BPE" or any(
            t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added
        ):
            raise ValueError(f"{path}: not a merging tokenizer with plain special tokens")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        before = spec["pre_tokenizer"] or {}
        self.plain = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZER
            and [p.get("type") for p in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and before["pretokenizers"][0] == SPLIT
            and not before["pretokenizers"][1]["add_prefix_space"]
            and not any(set(n) & set(_BLANKS) for n in names)
        )

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, as the model takes them."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        if not splitter:
            return [text] if text else []
        return [p for p, _ in splitter.pre_tokenize_str(text)]

    def merged(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


def prove(path: str) -> list[str]:
    """Strings that encode alone as one token, in the model's own letters."""
    steps, out = Steps(path), []
    for token, token_id in steps.tokenizer.get_vocab(with_added_tokens=False).items():
        pre_token = token.removesuffix(steps.suffix) if steps.suffix else token
        if token == pre_token + steps.suffix and pre_token:
            try:
                text = token_bytes(pre_token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if steps.pre_tokens(text) != [pre_token]:
                continue
            found = steps.tokenizer.model.tokenize(pre_token)
            if [t.id for t in found] == [token_id]:
                out.append(pre_token)
    return sorted(out)


class _Merged(dict):
    """Counts of merged strings, up to ``KEPT`` short ones, by ``merge``."""

    def __init__(self, merge: Callable[[str], int]):
        super().__init__()
        self.merge = merge

    def __missing__(self, text: str) -> int:
        n = self.merge(text)
        if len(text) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[text] = n
        return n


class Counter:
    """Counts tokens of texts; remembers the counts of merged pre-tokens."""

    def __init__(self, path: str, proven: list[str]):
        self.steps = Steps(path)
        self.proven = frozenset(proven)
        texts = (token_bytes(p).decode() for p in proven)
        self.proven_texts = frozenset(t for t in texts if not _OTHER.search(t))
        self.merged = _Merged(self.steps.merged)
        self.merged_texts = _Merged(lambda text: self.steps.merged(byte_level(text)))
        self.total = self.direct = 0

    def _sum(self, found: list[str], proven: frozenset[str], merged: _Merged) -> int:
        rest = list(filterfalse(proven.__contains__, found))
        direct = len(found) - len(rest)
        self.total, self.direct = self.total + len(found), self.direct + direct
        return direct + sum(map(merged.__getitem__, rest))

    def _any(self, text: str) -> int:
        """Tokens of any text."""
        special, at, n = self.steps.special, 0, 0
        names = [m.span() for m in special.finditer(text)] if special else []
        for start, end in [*names, (len(text), len(text))]:
            if at < start:
                found = self.steps.pre_tokens(text[at:start])
                n += self._sum(found, self.proven, self.merged)
            n, at = n + (end > start), end
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text of plain characters without special strings."""
        return self._sum(_PIECES.findall(text.lower()), self.proven_texts, self.merged_texts)

    def count(self, text: str) -> int:
        if not self.steps.plain:
            return self._any(text)
        n, at = 0, 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE_CHARS:
                blank = re.compile(f"[{_BLANKS}]").search(text, at + PIECE_CHARS)
                end = blank.start() if blank else end
            piece = text[at:end] if at or end < len(text) else text
            special = self.steps.special
            if not _OTHER.search(piece) and not (special and special.search(piece)):
                n += self._plain(piece)
            else:
                parts = _PARTS.findall(piece)
                odd = [bool(_OTHER.search(p) or (special and special.search(p))) for p in parts]
                n += self._plain(" ".join([p for p, o in zip(parts, odd) if not o]))
                n += sum([self._any(p) for p, o in zip(parts, odd) if o])
            at = end
        return n


def _count(
    batches: Iterator[pa.RecordBatch], path: str, proven: list[str]
) -> Iterator[pa.RecordBatch]:
    counter = Counter(path, proven)
    for batch in blocks(batches):
        _, bounds = utf8(batch.column("text"))
        counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )


def count_tokens(docs: DataFrame, path: str = WORD_BPE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, without special tokens added.

    One row per row of ``docs``, without any shuffle; other columns are not read.  Null and
    empty texts have no bytes and no tokens; null ids stay null, repeated rows and ids are
    counted each; an empty table gives no rows.  A very long text is taken apart in pieces
    that end at blanks.  The proven strings are at most the vocabulary.
    """
    return id_text(docs).mapInArrow(partial(_count, path=path, proven=prove(path)), COUNTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
