"""Token counts, source audit and tokenizer alignment against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tensorspark.llm import alignment, source_audit, token_counts
from tensorspark.llm.tokens import BYTE_BPE, WORD_BPE

PLAIN = Tokenizer.from_file(WORD_BPE)
TEXTS = ["", "  ", "<|ENDOFTEXT|> x <|endoftext|>y", "it's, don't. A'S", "é ́e ́"]
TEXTS += ["İI ΣΑΣ. Σ,", "a,, b.. c.,", "\x1f x\x1fy Straße. Été,"]
TEXTS += ["\x1c a\x85b c", "x" * 300 + ". y,", "日本 語。", ",", "don't.", "ab" * 400]
TEXTS += ["× ÷. á×, Ã.", "\x0b\x0c a\x0bb", "''s --'s 'lla 'Re's", "<|endoftext|>'s ²½ Ⅷ"]
TEXTS += ["a b c", "“x” – …€", " a", "a ", "a▁b", "  x  ", "a\n b\n  c\t d", "\x00 a"]
TEXTS += ["a  b   c <s> <0x0A>", " " * 50 + "z", "a b　 c  d", "\r\n x", "x." + " y" * 700]


def n_tokens(text):
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def proven():
    return token_counts.prove(WORD_BPE)


def test_proven_strings_are_one_token(proven):
    vocab = PLAIN.get_vocab()
    for p in proven[::50]:
        text = token_counts.token_bytes(p).decode()
        assert PLAIN.encode(text, add_special_tokens=False).ids == [vocab[p + "</w>"]]
    assert len(proven) > 30_000 and "the" in proven
    assert not any(p.startswith("'") for p in proven if p[1:].isalpha() and len(p) > 3)


def test_counts_of_texts(proven):
    counter = token_counts.Counter(WORD_BPE, proven)
    assert counter.steps.plain
    want = [n_tokens(t) for t in TEXTS]
    assert [counter.count(t) for t in TEXTS] == want
    assert [counter._any(t) for t in TEXTS] == want
    assert 0 < counter.direct < counter.total


def test_counts_in_small_pieces(proven, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 7)
    monkeypatch.setattr(token_counts, "KEPT", 2)
    counter = token_counts.Counter(WORD_BPE, proven)
    assert [counter.count(t) for t in TEXTS] == [n_tokens(t) for t in TEXTS]


def test_counts_of_another_tokenizer():
    plain = Tokenizer.from_file(BYTE_BPE)
    counter = token_counts.Counter(BYTE_BPE, token_counts.prove(BYTE_BPE))
    assert not counter.steps.plain
    want = [len(plain.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    assert [counter.count(t) for t in TEXTS] == want


@cache
def proven_counter():
    return token_counts.Counter(WORD_BPE, token_counts.prove(WORD_BPE))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_random_texts(text):
    assert proven_counter().count(text) == n_tokens(text)


def expected_counts(rows):
    key = lambda r: (r[0] is not None, *map(str, r))
    found = [(d, len((t or "").encode()), n_tokens(t), n_tokens(t) > 2048) for d, t in rows]
    return sorted(found, key=key), key


def test_counts_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, key = expected_counts(rows)
    assert sorted(map(tuple, token_counts.query(spark, sf_dir).collect()), key=key) == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_counts_of_odd_rows(odd_docs, no_docs):
    want, key = expected_counts([(r.doc_id, r.text) for r in odd_docs.collect()])
    got = token_counts.count_tokens(odd_docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted([(*r, r.n_tokens > 2048) for r in got.collect()], key=key) == want
    assert token_counts.count_tokens(no_docs).count() == 0


# ---- alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return alignment.Pair(BYTE_BPE, alignment.PIECE_BPE)


def plain_alignment(both, text):
    """Numbers and digest of a text, and how often each pair is linked."""
    none = (0, 0, 0, 0, ""), Counter()
    if not text:
        return none
    ids = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = f" {text}".encode()
    ends = []
    for names, some in zip((both.bytes_a, both.bytes_b), ids):
        if b"".join(names[k] for k in some) != raw:
            return none
        ends.append(np.cumsum([len(names[k]) for k in some]).tolist())
    i = j = n_links = 0
    found, a, b, linked = [], [], [], Counter()
    while i < len(ids[0]):
        linked[ids[0][i], ids[1][j]] += 1
        n_links += 1
        a += [i] * (i not in a[-1:])
        b += [j] * (j not in b[-1:])
        x, y = ends[0][i], ends[1][j]
        if x == y:
            parts = (",".join(str(s[k]) for k in p) for s, p in zip(ids, (a, b)))
            found.append("|".join(parts))
            a, b = [], []
        i, j = i + (x <= y), j + (y <= x)
    digest = hashlib.sha256(";".join(found).encode()).hexdigest()
    return (len(ids[0]), len(ids[1]), len(found), n_links, digest), linked


def check_rows(both, texts):
    numbers, (pairs, times) = both.rows(texts)
    for k, text in enumerate(texts):
        want, linked = plain_alignment(both, text)
        assert tuple(n[k].as_py() for n in numbers) == want
        keys = [(p >> alignment.SHIFT, p % (1 << alignment.SHIFT)) for p in pairs[k].as_py()]
        assert dict(zip(keys, times[k].as_py(), strict=True)) == dict(linked)


def test_alignment_of_texts(both):
    assert both.cuts
    check_rows(both, [*TEXTS, None])
    check_rows(both, TEXTS[::-1])
    assert all(len(u) <= alignment.LONGEST for u in both.known)
    check_rows(both, [])
    check_rows(both, [None, ""])


def test_alignment_without_units(both, monkeypatch):
    monkeypatch.setattr(both, "cuts", False)
    both.forget()
    check_rows(both, TEXTS)
    both.forget()


def test_long_texts_are_aligned_in_parts(both, monkeypatch):
    monkeypatch.setattr(alignment, "LONG_CHARS", 9)
    texts = [*TEXTS, "word " * 20 + "a▁b and more words after it", "one two  three\n four " * 9]
    for text in texts:
        check_rows(both, [text])


def test_alignment_forgets(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    both = alignment.Pair(BYTE_BPE, alignment.PIECE_BPE)
    for text in TEXTS:
        check_rows(both, [text])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n.é▁日'1"), max_size=30), max_size=4))
def test_alignment_of_random_texts(texts):
    check_rows(alignment.pair(BYTE_BPE, alignment.PIECE_BPE), texts)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 80)), st.sets(st.integers(1, 80)), st.integers(1, 9), st.integers(1, 5))
def test_groups_end_where_both_end(a, b, width, stretch):
    a, b = (np.array(sorted({*x, 81}), np.int64) for x in (a, b))
    common = np.intersect1d(a, b)[::stretch]
    common = np.append(common[common < 81], 81)
    bounds = [np.append(0, np.searchsorted(x, common) + 1) for x in (a, b)]
    odd = alignment.groups(a, b, *bounds, width)
    inner = [np.ones(len(x), bool) for x in (a, b)]
    for a0, a1, b0, b1 in odd:
        inner[0][a0:a1] = inner[1][b0:b1] = False
        assert a1 > a0 or b1 > b0
    assert a[inner[0]].tolist() == b[inner[1]].tolist() == np.intersect1d(a, b).tolist()


def plain_table(both, rows):
    found = [(doc, *plain_alignment(both, text)) for doc, text in rows]
    docs = Counter(p for _, _, linked in found for p in linked)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return sorted(
        (
            (
                doc,
                *numbers[:4],
                sum(n for p, n in linked.items() if docs[p] == most[p[0]]),
                sum(n * docs[p] for p, n in linked.items()),
                numbers[4],
            )
            for doc, numbers, linked in found
        ),
        key=str,
    )


def test_alignment_of_the_table(spark, sf_dir, both):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = alignment.query(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == plain_table(both, rows)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_BYTES, 0])
def test_alignment_of_odd_rows(odd_docs, both, limit):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    aligned = alignment.through_files(alignment.align(odd_docs), "aligned")
    got = alignment.count_links(aligned, limit)
    assert got.columns == alignment.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain_table(both, rows)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_BYTES, 0])
def test_alignment_of_an_empty_table(no_docs, limit):
    aligned = alignment.through_files(alignment.align(no_docs), "aligned")
    assert alignment.count_links(aligned, limit).count() == 0


# ---- source audit -----------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows):
    """Rows of the audit from (text, lang, source)."""
    docs = [(l or "", s or "", TERM.findall((t or "").translate(LOWER))) for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for l, _, words in docs if l == lang for w in set(words))
        kept = sorted(w for w, n in df.items() if n >= 3)
        counts = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, words in docs:
            if l == lang:
                counts[s].update(w for w in words if df[w] >= 3)
        counts[None] = sum(counts.values(), Counter())
        share = {
            s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
            for s, c in counts.items()
        }
        for s, p in share.items():
            if s is None:
                continue
            far = lambda q, some, p=p: sum((p[w] - q[w]) ** 2 // q[w] for w in some)
            pairs = [(far(q, kept), o) for o, q in share.items() if o not in (s, None)]
            q = share[None]
            terms = [(far(q, [w]), w) for w in kept if counts[s][w] and p[w] > q[w]]
            for part, some, top in (("pair", pairs, None), ("term", terms, 200)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(some[:top], 1)]
    return sorted(out)


AUDITED = ["lang", "source", "part", "item", "value", "rank"]


def as_rows(df):
    assert df.columns == AUDITED and df.schema["rank"].dataType.simpleString() == "int"
    return sorted(map(tuple, df.collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAé -z"), max_size=40), max_size=6))
def test_words_sort_by_their_bytes(texts):
    raw = [t.translate(LOWER).encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    starts, ends, _ = source_audit.word_bounds(data, bounds, source_audit.NO_LETTER)
    padded = np.append(data, np.zeros(7, np.uint8))
    order, runs = source_audit.sort_words(padded, starts, ends)
    words = [bytes(data[a:b]) for a, b in zip(starts[order], ends[order])]
    assert words == sorted(w.encode() for r in raw for w in TERM.findall(r.decode()))
    assert [words[r] for r in runs] == sorted(set(words))


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, more, v = (int(x) for x in rng.integers(0, 10 ** rng.integers(1, 13), 3))
        want = 1 + 10**9 * (n + 1) // (n + more + v + 1)
        assert source_audit.shares(np.array([n]), np.array([n + more]), v + 1)[0] == want


def test_audit_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    assert as_rows(source_audit.query(spark, sf_dir)) == plain_audit(docs.collect())


ODD = [
    ("the cat the cat", "en", "a"), ("The CAT sat", "en", "b"), ("the cat", "en", "b"),
    ("the cat", "en", "b"), (None, "en", "c"), ("", "en", None), ("12 -- 34", "en", "d"),
    ("the " * 3000 + "x" * 9000, "en", "a"), ("x" * 9000 + " " + "x" * 8999, "en", "e"),
    ("x" * 9000, "en", "e"), ("ça va été", "fr", "a"), ("ça été", "fr", "a"), ("Été ça", "fr", "a"),
    ("alone", None, None), ("alone again", None, "z"), ("日本 語 alone", None, "z"),
    ("rare word", "de", "a"), ("other", "de", "b"), ("the cat", "EN", "a"),
]


@pytest.mark.parametrize("size", [source_audit.SHARD_BYTES, 64])
@pytest.mark.parametrize("cells,tile", [(source_audit.CELLS, source_audit.TILE), (4, 2)])
def test_audit_of_odd_rows(make, monkeypatch, size, cells, tile):
    for name, value in (("SHARD_BYTES", size), ("CELLS", cells), ("TILE", tile)):
        monkeypatch.setattr(source_audit, name, value)
    docs = make("text string, lang string, source string, term string, n int", [(*r, "z", 1) for r in ODD])
    assert as_rows(source_audit.audit_sources(docs.repartition(3))) == plain_audit(ODD)
    assert source_audit.audit_sources(docs.limit(0)).count() == 0


def test_audit_joins_without_broadcast(make, monkeypatch):
    monkeypatch.setattr(source_audit, "small", lambda df, size: df.hint("merge"))
    docs = make("text string, lang string, source string", ODD)
    assert as_rows(source_audit.audit_sources(docs)) == plain_audit(ODD)
