"""Encoder, block codec, token files and packing, against plain versions."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tensorspark.llm import packing, pfor, token_files
from tensorspark.llm.tokens import BYTE_BPE, END_ID, WORD_BPE, Encoder, encoder

PLAIN = Tokenizer.from_file(WORD_BPE)


def plain_ids(text):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, END_ID], "<u4")


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_whole_texts(path):
    texts = ["", "  ", "<|ENDOFTEXT|> x <|endoftext|>y", "it's, don't. A'S", "é ́e ́", "İI ΣΑΣ. Σ,"]
    texts += ["a,, b.. c.,", "\x1f x\x1fy Stra\u00dfe. \u00c9t\u00e9,", "\x1c a\x85b c", "x" * 300 + ". y,", "日本 語。", ",", ".", "don't."]
    texts += ["ab" * 400, "× ÷. á×, Ã. Ã,", "\x0b\x0c a\x0bb", None]
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = Encoder(path)
    assert encoder.encode(pa.array(texts)) == want
    assert encoder.encode(pa.array(texts[::-1])) == want[::-1]
    encoder.KEPT = 5
    assert encoder.encode(pa.array(texts)) == encoder.encode(pa.array(texts)) == want
    assert encoder.encode(pa.array([], pa.string())) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_equals_whole_texts_random(texts):
    want = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(WORD_BPE).encode(pa.array(texts, pa.string())) == want


LETTERS_AND_SIGNS = st.text("abzÉéßÿ×÷ñ'sS.,#<=!0 \u0301\u00aa", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS_AND_SIGNS, max_size=5))
def test_encoder_equals_whole_texts_of_letters_and_signs(texts):
    want = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(WORD_BPE).encode(pa.array(texts, pa.string())) == want


def test_words_of_letters_are_merged_once_without_the_steps_before(monkeypatch):
    """The whole tokenizer gets signs and digits only, and nothing a second time."""
    encoder = Encoder(WORD_BPE)
    seen = []
    whole = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: seen.extend(texts) or whole(texts))
    texts = pa.array(["Straße élan### zwölf, ABC.", "word'# word 12.", "abc straße***"])
    want = [np.array(PLAIN.encode(t.as_py(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    parts = b"".join(seen).replace(b"\x1f", b" ").split()
    assert sorted(parts) == sorted([b"###", b"***", b",", b".", b"'#", b"12."])
    seen.clear()
    assert encoder.encode(texts) == want and not seen
    encoder.KEPT_IDS = 3
    assert encoder.encode(texts) == want and seen


def test_tasks_keep_what_a_worker_has_learnt():
    """A task that follows another in the same worker learns only what is new."""
    batch = pa.record_batch([pa.array([1]), pa.array(["some words of a first task"])], ["doc_id", "text"])
    for _ in packing._encode(iter([batch]), WORD_BPE, END_ID, "<u2"):
        pass
    assert len(encoder(WORD_BPE).hashes) >= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=600), st.integers(0, 32))
def test_blocks_round_trip(values, bits):
    values = np.array(values, np.uint64) >> np.uint64(bits)
    values = values.astype(np.uint32)
    data, starts = pfor.encode(values)
    assert len(starts) == -(-len(values) // pfor.BLOCK)
    got = pfor.decode(np.frombuffer(data, np.uint8), starts)
    assert (got[: len(values)] == values).all()


def test_blocks_patch_outliers():
    values = np.arange(1000, 1128, dtype=np.uint32)
    values[5] = 2**31
    data, starts = pfor.encode(values)
    assert len(data) == 6 + 16 * 7 + 5
    assert (pfor.decode(np.frombuffer(data, np.uint8), starts) == values).all()


def expected_files(rows):
    """Per document in order: id, start, size, crc."""
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain_ids(text)
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, token_files.query(spark, sf_dir).collect()))
    assert got == expected_files(rows)


def test_files_of_odd_rows(spark, odd_docs):
    folder = token_files.write_token_files(odd_docs)
    got = token_files.read_token_files(spark, folder).collect()
    got = sorted(got, key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted(
        (d or -1, plain_ids(t).tobytes()) for d, t in rows
    )
    starts = np.cumsum([0] + [len(r.ids) // 4 for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_files_of_an_empty_table(spark, no_docs):
    folder = token_files.write_token_files(no_docs)
    assert token_files.read_token_files(spark, folder).count() == 0


def check_packing(pieces, rows):
    """Each id once, sequences gapless and full, or as long as a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want, got = defaultdict(list), defaultdict(list)
    for doc, text in rows:
        want[doc].append(plain_ids(text).tobytes())
    for doc, parts in by_doc.items():
        if len(want[doc]) == 1:
            parts.sort(key=lambda p: p.start)
            got[doc].append(b"".join(bytes(p.ids) for p in parts))
            assert [p.start for p in parts] == np.cumsum(
                [0] + [len(p.ids) // 4 for p in parts]
            ).tolist()[:-1]
            assert {p.doc_tokens for p in parts} == {len(got[doc][0]) // 4}
        else:
            assert sum(len(p.ids) for p in parts) == sum(map(len, want[doc]))
            got[doc] = want[doc]
    assert got == want
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        ends = np.cumsum([len(p.ids) // 4 for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_packing_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pieces = packing.pack(docs).collect()
    check_packing(pieces, rows)
    plain = sorted((p.doc_id, p.start, len(p.ids) // 4, zlib.crc32(p.ids)) for p in pieces)
    query = packing.query(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, query.collect())) == plain


def test_packing_of_odd_rows(odd_docs, no_docs):
    check_packing(packing.pack(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(no_docs).count() == 0


def test_packing_puts_like_documents_together():
    rng = np.random.default_rng(0)
    ids = [rng.integers(1000 * k, 1000 * k + 60, 400).astype("<u4") for k in (0, 1) * 20]
    order = np.argsort(packing.curve_keys(ids))
    kinds = np.array([0, 1] * 20)[order]
    assert (np.diff(kinds) != 0).sum() <= 3


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 5), (3, 3), (4, 3)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
    grid = np.stack(axes, -1).reshape(-1, dims)
    keys = packing.hilbert(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
