"""Benchmark leaks, personal data, language and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from plain import leaks, personal, windows
from pyspark.sql import functions as F

from tensorspark.llm import chat, decontaminate, langid, pii
from tensorspark.llm.tokens import BYTE_BPE

# ---- leaks -----------------------------------------------------------------


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    for _ in range(20):
        docs = [rng.integers(0, 4, rng.integers(0, 50)).astype(np.uint64) for _ in range(8)]
        docs += docs[:3]
        bounds = np.append(0, np.cumsum([len(d) for d in docs]))
        index = decontaminate.FMIndex(np.concatenate(docs), bounds, 3)
        for size in (1, 3, 9):
            phrases = rng.integers(0, 5, (12, size)).astype(np.uint64)
            long = [d for d in docs if len(d) >= size]
            phrases[:6] = [d[len(d) - size :] for d in (long * 6)[:6]]
            which, lo, hi = index.search(phrases)
            got = {q: sorted(index.locate(np.arange(a, b))) for q, a, b in zip(which, lo, hi)}
            for q, phrase in enumerate(phrases):
                want = [
                    bounds[i] + i + s
                    for i, d in enumerate(docs)
                    for s in range(len(d) - size + 1)
                    if (d[s : s + size] == phrase).all()
                ]
                assert got.get(q, []) == want


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps for hours."),
    (2, "short one"),
    (3, None),
    (4, " .. "),
    (None, "an item which has no id at all but has more than ten words"),
    (2, "a second text under id two that is longer than the window is"),
]


@pytest.fixture
def benchmark(make):
    return make("item_id long, text string, items string", [(*i, "clash") for i in ITEMS])


def test_leaks_of_odd_rows(make, odd_docs, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontaminate, "WINDOWS_IN_BLOCK", 3)
    fox = ITEMS[0][1]
    texts = [fox, f"É {fox.upper()} {fox[:60]}", "word " * 500 + fox + " short ONE", fox[:40], "short"]
    texts += ["xxshort one", ITEMS[4][1], f"{ITEMS[5][1]} {fox}"]
    docs = odd_docs.select("doc_id", "text").unionByName(
        make("doc_id long, text string", [(100 + i, t) for i, t in enumerate(texts)])
    )
    found = windows([(i, t) for i, t in ITEMS if i is not None])
    every = windows(ITEMS)
    for r in decontaminate.find_leaks(docs, benchmark).collect():
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) if r.doc_id else ""
        if r.doc_id in (None, 4):
            continue
        n, hit, _ = leaks(text, every)
        assert (r.n_words, r.n_hit, r.items) == (n, hit, sorted(leaks(text, found)[2]))
        if not hit:
            assert r.clean is None and r.spans == []
        else:
            rest, last = "", 0
            for s in r.spans:
                rest += text[last : s.begin]
                last = s.end
            assert r.clean == rest + text[last:]
            assert leaks(r.clean, every)[1] < hit
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()}
    assert {103, 104, 105} <= kept and not kept & {100, 101, 102, 106, 107}


def test_leaks_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    found = windows([(r.item_id, r.text) for r in items])
    want = []
    for r in docs:
        n, hit, own = leaks(r.text, found)
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        want.append((r.doc_id, n, hit, len(own), sha, hit > 0))
    assert sorted(map(tuple, decontaminate.query(spark, sf_dir).collect())) == sorted(want)
    assert any(w[-1] for w in want)


def test_leaks_tell_apart_words_that_a_simple_hash_confuses(make):
    """Thue-Morse words: any polynomial modulo a power of two gives both one value."""
    word, turn = "a", str.maketrans("ab", "ba")
    while len(word) < 1024:
        word += word.translate(turn)
    docs = make("doc_id long, text string", [(1, f"{word} x"), (2, f"{word.translate(turn)} x")])
    items = make("item_id long, text string", [(7, f"{word} x")])
    got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: (2, ["7"]), 2: (0, [])}


def test_leaks_of_empty_tables(odd_docs, no_docs, benchmark):
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    none = benchmark.limit(0)
    assert {r.n_hit for r in decontaminate.find_leaks(odd_docs, none).collect()} == {0}
    assert decontaminate.drop_leaks(odd_docs, none).count() == odd_docs.count()


# ---- personal data ---------------------------------------------------------


def spans_of(docs, base=True):
    return {
        r.doc_id: [(s.start, s.order, s.stop) for s in r.spans if s.order < 4 or not base]
        for r in pii.find_personal_data(docs).collect()
    }


def test_personal_data_equals_plain_patterns(make):
    rng = random.Random(1)
    alphabet = "a.b@c-1 2+3(4)5.%_é\U0001f600,678 90-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["+1 (555) 123-4567 a@b.c_x@d.e 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 0.0.0.0"]
    texts += ["4111 1111 1111 1111, 4111-1111-1111-1112; a@b.c.@d.e.f", None, "", "a@b.c@d.e"]
    got = spans_of(make("doc_id long, text string", list(enumerate(texts))))
    assert got == {i: personal(t) for i, t in enumerate(texts)}


def test_very_long_runs(make):
    texts = ["1" * 100_000, "a" * 100_000, "a.b" * 40_000 + "@x.y", "1.1" * 30_000, "+1" + "(" * 50_000]
    texts.append("@" * 50_000)
    got = spans_of(make("doc_id long, text string", list(enumerate(texts))))
    assert got[2] == [(0, 0, 120_004)]
    assert got[0] == got[1] == got[4] == got[5] == []


def test_checksums_and_context(make):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 bank",
        "IBAN DE88 3704 0044 0532 0130 00 bank",
        "my ssn is 123-45-6789",
        "number 123-45-6789",
        "mail a@b.cd",
        "example a@b.cd",
    ]
    docs = make("doc_id long, text string, spans string", [(i, t, "x") for i, t in enumerate(texts)])
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert [[s.order for s in found[i]] for i in range(6)] == [[4], [], [5], [], [0], [0]]
    assert found[4][0].score > found[5][0].score
    assert not any(pii.find_personal_data(docs, 1.1).collect()[2].spans)


def test_ibans_before_other_words(make):
    de, gb, fr = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"
    mt = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    cases = [
        (f"IBAN {de} BIC: COBADEFF", [de]),
        (f"{gb} 2024", [gb]),
        (f"\U0001f600 konto {de} {gb} {fr} {mt} {gb}", [de, gb, fr, mt, gb]),
        (f"FR12 {de} BIC, DE12 DE13 {gb} AND MORE", [de, gb]),
        (f"{de}BIC x{gb} {gb[:-1]} {gb}7 {de[:-1]} 1 {fr}.", [fr]),
        ("AA11 " * 2000 + de, [de]),
        ("A1" * 50_000 + f" DE89{'0' * 50_000}", []),
    ]
    docs = make("doc_id long, text string", [(i, t) for i, (t, _) in enumerate(cases)])
    for r in pii.find_personal_data(docs).collect():
        text, want = cases[r.doc_id]
        assert [text[s.start : s.stop] for s in r.spans if s.order == 4] == want


def test_personal_data_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    assert pii.find_personal_data(odd_docs).count() == odd_docs.count()
    assert pii.find_personal_data(no_docs).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    names = [k.name for k in pii.KINDS]
    for r in pii.query(spark, sf_dir).collect():
        own = personal(texts[r.doc_id])
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = [sum(k == o for _, k, _ in own) for o in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts


def test_personal_data_stays_in_the_jvm(spark, sf_dir):
    plan = pii.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- language --------------------------------------------------------------


def segmentations(pieces, word, probability):
    """Sum over all segmentations, the slow way."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, len(word) + 1):
        if word[:size] in pieces:
            total += probability(word[:size]) * segmentations(pieces, word[size:], probability)
    if word[0] not in pieces:
        total += langid.UNSEEN * segmentations(pieces, word[1:], probability)
    return total


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces()
    rng = np.random.default_rng(0)
    table = langid._normalized(rng.random((len(pieces.names) + 1, 2)))
    model = langid.Model(["x", "y"], pieces, table)
    number = {p: i for i, p in enumerate(pieces.names)}
    words = ["the", "éàñß", "日本語x", "a", "internationally"]
    got = np.exp(model.log_probability(words))
    for row, word in zip(got, words, strict=True):
        for k in (0, 1):
            want = segmentations(number, langid._MARK + word, lambda p, k=k: table[number[p], k])
            assert row[k] == pytest.approx(want, rel=1e-9)
    counts = model.expected(["the", "the"], np.array([0, 1]), np.array([2, 3]))
    length = np.array([*map(len, pieces.names), 1])
    assert (length @ counts) == pytest.approx([8, 12])


def all_ways(pieces, word):
    """Segmentations, as tuples of pieces; a character that is no piece stands for itself."""
    if not word:
        return [()]
    sizes = [k for k in range(1, len(word) + 1) if word[:k] in pieces or k == 1]
    return [(word[:k], *rest) for k in sizes for rest in all_ways(pieces, word[k:])]


@pytest.fixture(scope="module")
def two_languages():
    pieces = langid.Pieces()
    table = langid._normalized(np.random.default_rng(1).random((len(pieces.names) + 1, 2)))
    return langid.Model(["x", "y"], pieces, table), {p: i for i, p in enumerate(pieces.names)}


@pytest.mark.parametrize("plain", [langid.PLAIN, 3])
def test_expected_counts_are_posteriors(two_languages, monkeypatch, plain):
    monkeypatch.setattr(langid, "PLAIN", plain)
    model, number = two_languages
    words, n = ["there", "日x語", "sets", "there"], [2, 3, 1, 4]
    lang = np.array([0, 1, 0, 1])
    want = np.zeros(model.table.shape)
    for word, k, times in zip(words, lang, n):
        ways = all_ways(number, langid._MARK + word)
        each = [np.prod([model.table[number.get(p, -1), k] for p in way]) for way in ways]
        for way, share in zip(ways, each):
            for p in way:
                want[number.get(p, -1), k] += times * share / sum(each)
        assert model.log_probability([word])[0, k] == pytest.approx(np.log(sum(each)), rel=1e-12)
    assert np.allclose(model.expected(words, lang, np.array(n)), want, rtol=1e-9, atol=1e-12)


def test_long_words_sum_all_segmentations(two_languages):
    """Words of 60 and 3,000 letters, not cut: sums over places that can't underflow."""
    model, number = two_languages
    rng = np.random.default_rng(2)
    for size in (60, 3000):
        word = "".join(rng.choice(list("thesinga日"), size))
        marked = langid._MARK + word
        ways = [Decimal(1)]
        for end in range(1, len(marked) + 1):
            total = Decimal(0)
            for begin in range(max(0, end - model.pieces.longest), end):
                p = marked[begin:end]
                if p in number or end - begin == 1:
                    total += ways[begin] * Decimal(float(model.table[number.get(p, -1), 1]))
            ways.append(total)
        assert model.log_probability([word])[0, 1] == pytest.approx(float(ways[-1].ln()), rel=1e-9)
        counts = model.expected([word], np.array([1]), np.array([2]))
        length = np.array([*map(len, model.pieces.names), 1])
        assert (length @ counts)[1] == pytest.approx(2 * len(marked), rel=1e-6)


def test_predictions_are_sums_of_words(two_languages):
    model, _ = two_languages
    texts = ["The cat, the dog!", None, "5² = 25", "½ ¼", "①②③", "Ⅷ", "x" * 100, "cat dog"]
    names, scores = langid.Scorer(model).predict(texts)
    for text, name, score in zip(texts, names, scores):
        words = re.findall("[^\\W\\d_]+", (text or "").lower())
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0)
            continue
        total = sum(model.log_probability([w])[0] for w in words)
        assert name == model.languages[int(np.argmax(total))]
        odds = np.exp(total - total.max())
        assert score == pytest.approx(1 / odds.sum(), abs=1e-6)
    assert langid.words_of("a²b Ⅷx 5y") == ["a", "b", "x", "y"]


def test_ties_go_to_the_first_language(two_languages):
    model, _ = two_languages
    same = langid.Model(["x", "y"], model.pieces, np.repeat(model.table[:, :1], 2, axis=1))
    assert langid.Scorer(same).predict(["the cat"])[0] == ["x"]


def test_language_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count() and found["held_out"].sum() > 20
    held = found[found["held_out"] & found["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_language_ignores_held_out_labels(make):
    en, fr = "the cat and the dog were there", "le chat et le chien sont ici"
    import zlib

    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, (en, fr)[i % 2], "xx" if i in held else ("en", "fr")[i % 2]) for i in range(80)]
    model = langid.fit(make("doc_id long, text string, lang string", rows))
    assert model.languages == ["en", "fr"]


def test_rare_languages_are_learnt(make):
    texts = {"en": "the cat and the dog were there", "de": "der hund und die katze sind da"}
    texts |= {"fr": "le chat et le chien sont ici", "zz": "123 456"}
    rows = [(i, texts[x], x) for i, x in enumerate(["en"] * 4000 + ["de"] * 400 + ["fr"] * 3 + ["zz"])]
    docs = make("doc_id long, text string, lang string", rows)
    model = langid.fit(docs, 50)
    assert model.languages == ["de", "en", "fr"]
    found = langid.predict(docs, model).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {
        i: x if x != "zz" else "und" for i, _, x in rows
    }


def test_rows_of_a_language():
    assert langid._rows_each([1, 2, 3], 10_000) >= 3
    assert langid._rows_each([10**7, 1000, 10**6], 10_000) == 4500
    assert langid._rows_each([10**6] * 1000, 10_000) == langid.LEAST_DOCS
    assert langid._rows_each([], 10_000) == langid.LEAST_DOCS


def test_foreign_and_junk_texts_are_dropped(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    junk = lambda size, n: " ".join(
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(n)
    )
    bad = ["日本語の文章です。これは試験です。", "Ελληνικό κείμενο για δοκιμή", "هذا نص عربي للاختبار"]
    bad += ["Это русский текст, который нужен для проверки модели языка. " * 5, "这是一个中文文本"]
    bad += ["qxzj vkwq zzxq", junk(60, 1), junk(6, 40), junk(9, 300)]
    good = ["Von.", "That it.", "the and of", "der und die", "de la et les", "los de la", "Osrañ."]
    planted = [(-1 - k, t, None) for k, t in enumerate(good + bad)]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    for model in (langid.fit(docs), langid.fit(docs.where("lang = 'en'"))):
        kept = {r.doc_id for r in langid.drop_unknown(both, model).select("doc_id").collect()}
        assert not kept.intersection(-1 - k for k in range(len(good), len(planted)))
        if len(model.languages) > 1:
            assert kept == {r.doc_id for r in docs.collect()} | {-1 - k for k in range(len(good))}
    languages = {r.doc_id: r.lang for r in docs.collect()}
    assert {languages[d] for d in kept if d >= 0} == {"en"}


def test_language_of_odd_rows(make, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    found = langid.predict(odd_docs, model).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert [r.lang_pred for r in found] == [
        "en" if t and any(c.isalpha() for c in t) else "und" for t in texts
    ]
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = langid.drop_unknown(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(
        t for t in texts if t and any(c.isalpha() for c in t)
    )
    nothing = langid.fit(no_docs)
    assert nothing.languages == [] and langid.predict(no_docs, nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.drop_unknown(odd_docs, nothing).count() == kept.count()


# ---- chat ------------------------------------------------------------------


@given(st.text(alphabet="<|\\>im_endx\n", max_size=30))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|"]), st.text(max_size=20)), max_size=5))
def test_render_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def digest_rows(rows):
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        size = len(chat.render(turns)[0])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learned)]
        out.append((conv, len(turns), sha[0], len(learned), sha[1], size))
    return out


def test_conversations_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    got = [tuple(r) for r in chat.query(spark, sf_dir).collect()]
    assert sorted(got) == sorted(digest_rows(rows))


def test_odd_conversations(make, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 300)
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} é\U0001f600 <|im_end|> <\\| x") for k in range(60)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, 0, "assistant", "  \n\n blanks \n ")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id either")]
    rows += [(4, 0, "assistant", "x" * 5000), (5, None, "user", "q"), (5, 1, "assistant", "<"), (5, 2, "assistant", "|")]
    table = make("conv_id long, turn long, role string, text string, ids string", [(*r, "z") for r in rows])
    formatted = chat.format_conversations(table).cache()
    assert sorted(map(tuple, chat.digests(formatted).collect()), key=str) == sorted(digest_rows(rows), key=str)
    tokenizer = chat._tokenizer(BYTE_BPE)
    for r in formatted.collect():
        assert tokenizer.decode(r.ids, skip_special_tokens=False) == r.formatted
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_a_hot_conversation_is_dealt_over_tasks(make, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 4000)
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k} of many") for k in range(1500)]
    rows += [(None, k, "user", "x" * 50) for k in range(300)]
    rows += [(k, 0, "assistant", f"alone {k}") for k in range(100, 400)]
    table = make("conv_id long, turn long, role string, text string", rows)
    formatted = chat.format_conversations(table).cache()
    for conv in (7, None):
        parts = [r.part for r in formatted.where(F.col("conv_id").eqNullSafe(F.lit(conv))).collect()]
        assert len(set(parts)) == len(parts) > 1
        assert conv is None or len({p >> 32 for p in parts}) > 1
    assert {r.part for r in formatted.where("conv_id >= 100").collect()} == {0}
    assert sorted(map(tuple, chat.digests(formatted).collect()), key=str) == sorted(digest_rows(rows), key=str)


def test_parts_have_the_tokens_of_the_whole(make):
    turns = [("user", "a b"), ("assistant", " c\n"), ("user", "\nd")]
    tokenizer = chat._tokenizer(BYTE_BPE)
    ids = lambda t: tokenizer.encode(chat.render(t)[0], add_special_tokens=False).ids
    assert ids(turns) == ids(turns[:1]) + ids(turns[1:])
