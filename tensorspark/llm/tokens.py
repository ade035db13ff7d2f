"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from tensorspark.llm.common import SPACES, utf8, word_bounds, word_hashes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1

#: Stands between parts that are encoded together; texts that contain it are encoded alone.
_BETWEEN = b"\x1f"
_TOGETHER = 1000
#: Words of letters that are merged together.
_WORDS = 200
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False
#: ASCII characters that are neither letters, digits, blanks nor control characters.
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Signs at the end of a part that are looked at.
_SIGNS = 8
#: The steps before merging that leave a word of Latin letters one pre-token in lower case.
NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


LETTERS = _byte_letters()
_LETTER_OF = {b: c for b, c in enumerate(LETTERS) if b != 0x20}


def _odd_bytes(data: np.ndarray) -> np.ndarray:
    """Places of the bytes that don't belong to Latin letters."""
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    return np.flatnonzero(~letter)


def _of_letters(odd: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which parts have no odd byte."""
    return np.searchsorted(odd, starts) == np.searchsorted(odd, ends)


def _split_marks(
    data: np.ndarray, odd: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts with signs after nothing but Latin letters as two parts each.

    A pre-tokenizer that keeps letters apart from signs gives them the same ids.
    """
    marked = np.flatnonzero(_SIGN[data[ends - 1]] & (ends - starts > 1))
    cut = ends[marked] - 1
    for _ in range(_SIGNS - 1):
        more = _SIGN[data[cut - 1]] & (cut - 1 > starts[marked])
        if not more.any():
            break
        cut -= more
    fit = _of_letters(odd, starts[marked], cut)
    marked, cut = marked[fit], cut[fit]
    before = np.zeros(len(starts) + 1, np.int64)
    before[marked + 1] = 1
    ends = ends.copy()
    last, ends[marked] = ends[marked], cut
    starts, ends = np.insert(starts, marked + 1, cut), np.insert(ends, marked + 1, last)
    return starts, ends, at + np.cumsum(before)[at]


class _Words:
    """Merges words of Latin letters by the tokenizer's own model, without the steps before.

    The steps lower the case of such a word and leave it one pre-token; its last token, and no
    other, is one that ends words.
    """

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        self.suffix = tokenizer.model.end_of_word_suffix
        self.tokenizer = tokenizers.Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True

    @staticmethod
    def fit(tokenizer: tokenizers.Tokenizer) -> bool:
        """Whether the tokenizer has the steps and the kind of model that this stands for."""
        model, normalizer, before = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        if not isinstance(model, tokenizers.models.BPE) or not (normalizer and before):
            return False
        steps = json.loads(before.__getstate__()).get("pretokenizers", [])
        return (
            bool(model.end_of_word_suffix)
            and not (model.dropout or model.unk_token or model.continuing_subword_prefix)
            and json.loads(normalizer.__getstate__()).get("normalizers") == NORMALIZER
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0] == SPLIT
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        )

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words and the number of each; none if the ends don't tell words apart."""
        runs = [b" ".join(words[i : i + _WORDS]) for i in range(0, len(words), _WORDS)]
        lower = [r.decode().lower().encode().decode("latin-1").translate(_LETTER_OF) for r in runs]
        found = self.tokenizer.encode_batch_fast(lower, add_special_tokens=False)
        ids = np.frombuffer(b"".join([array("I", e.ids).tobytes() for e in found]), np.uint32)
        stops = np.flatnonzero(self.last[ids])
        if len(stops) != len(words):
            return None
        return ids, np.diff(np.append(-1, stops))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A tokenizer that drops blanks and case gives a text the ids of its blank-separated
    parts, one after the other.  Parts are told apart by 64-bit hashes and lengths, encoded
    once, and kept as rows of one array, up to ``KEPT`` with ``KEPT_IDS``, also for the
    worker's next task.  Texts with a very long part, or with the beginning of a special
    token's name, and all texts of other tokenizers, are encoded whole.
    """

    KEPT, KEPT_IDS = 500_000, 4_000_000
    LONGEST = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        texts = [b"a  B\n\tc,\x0b\x0cd.'#", b"a", b"b", b"c", b",", b"d", b".'#", b" \n\t\r", _BETWEEN]
        ids = self._ids(texts)
        self.by_part = ids[0] == b"".join(ids[1:7]) and not ids[7] and len(ids[8]) == 4
        self.between = int.from_bytes(ids[8][:4], "little")
        self.words = _Words(self.tokenizer) if self.by_part and _Words.fit(self.tokenizer) else None
        self.forget()

    def forget(self) -> None:
        """Drops the parts learnt."""
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)  # of each row, and the end of the last
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(
            [t.decode() for t in texts], add_special_tokens=False
        )
        return [array("I", e.ids).tobytes() for e in found]

    def _apart(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and the number of each, by the whole tokenizer."""
        runs = [parts[i : i + _TOGETHER] for i in range(0, len(parts), _TOGETHER)]
        between = b" " + _BETWEEN + b" "
        joined = self._ids([between.join(run) + between for run in runs])
        ids = np.frombuffer(b"".join(joined), np.uint32)
        stops = np.flatnonzero(ids == self.between)
        return ids[ids != self.between], np.diff(np.append(-1, stops)) - 1

    def _learn(self, hashes: np.ndarray, parts: list[bytes], letters: np.ndarray) -> None:
        """Adds rows for new parts, whose hashes are in order; ``letters``: of those alone."""
        found = None
        if self.words and letters.any():
            found = self.words.ids([parts[k] for k in np.flatnonzero(letters)])
        if found is None:
            letters = np.zeros(len(parts), bool)
            found = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rest = self._apart([parts[k] for k in np.flatnonzero(~letters)])
        sizes = np.concatenate((found[1], rest[1]))
        order = np.concatenate((np.flatnonzero(letters), np.flatnonzero(~letters)))
        rows = np.empty(len(parts), np.int32)
        rows[order] = len(self.starts) - 1 + np.arange(len(parts))
        ends = self.starts[-1] + np.cumsum(sizes)
        self.starts = np.append(self.starts, ends)
        self.ids = np.concatenate((self.ids, found[0], rest[0]))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.rows = np.insert(self.rows, place, rows)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` (in order) among the known ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null text is empty."""
        data, bounds = utf8(texts)
        if not self.by_part:
            return self._ids([data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])])
        starts, ends, at = word_bounds(data, bounds, SPACES)
        odd = np.zeros(len(texts), bool)
        names = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        between = np.flatnonzero(data == _BETWEEN[0])
        long = starts[ends - starts > self.LONGEST]
        odd[np.searchsorted(bounds, np.concatenate((names, between, long)), side="right") - 1] = True
        if odd.any():
            keep = ~np.repeat(odd, np.diff(at))
            starts, ends = starts[keep], ends[keep]
            at = np.searchsorted(starts, bounds)
        strange = _odd_bytes(data)
        starts, ends, at = _split_marks(data, strange, starts, ends, at)
        hashes = word_hashes(data, starts, ends) ^ (ends - starts).astype(np.uint64)
        distinct, which = np.unique(hashes, return_inverse=True)
        if len(self.hashes) > self.KEPT or len(self.ids) > self.KEPT_IDS:
            self.forget()
        new = np.flatnonzero(self._find(distinct) < 0)
        if len(new):
            some = np.empty(len(distinct), np.int64)
            some[which] = np.arange(len(which))  # any place of each
            first, last = starts[some[new]], ends[some[new]]
            raw = data.tobytes()
            parts = [raw[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            self._learn(distinct[new], parts, _of_letters(strange, first, last))
        row = self.rows[self._find(distinct)][which] if len(distinct) else which
        begin, size = self.starts[row], self.starts[row + 1] - self.starts[row]
        done = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        raw, cuts = ids.tobytes(), (4 * done[at]).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if odd.any():
            whole = np.flatnonzero(odd).tolist()
            found = self._ids([data[bounds[r] : bounds[r + 1]].tobytes() for r in whole])
            for r, one in zip(whole, found, strict=True):
                out[r] = one
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and worker.

    Functions of this package travel to the workers by value, so globals of theirs last for
    one task; the encoder with what it has learnt is kept with the library's module.
    """
    kept = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
