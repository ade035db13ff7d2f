"""Exact and near copies, and the components of links."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from plain import near_groups, shingle_set

from tensorspark.llm import exact_dedup, near_dedup
from tensorspark.llm.common import word_bounds, word_hashes, SPACES, utf8
from tensorspark.llm.components import components


def test_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 4, 256)
    histogram[40:48] = 500
    slots, buckets = exact_dedup.directory(histogram, 64)
    depth = len(slots).bit_length() - 1
    for slot, bucket in enumerate(slots):
        prefix, local = buckets[bucket]
        assert slot >> (depth - local) == prefix
    load = np.array([
        histogram[p << (8 - d) : (p + 1) << (8 - d)].sum() for p, d in buckets
    ])
    assert ((load <= 64) | (np.array([d for _, d in buckets]) == 8)).all()
    assert len(set(slots.tolist())) == len(buckets)
    owner = exact_dedup.owners(slots, histogram, 7)
    assert (np.diff(owner) >= 0).all() and owner.max() < 7
    assert all(len(set(owner[slots == b])) == 1 for b in range(len(buckets)))


def test_an_empty_histogram_has_one_bucket():
    slots, buckets = exact_dedup.directory(np.zeros(16, np.int64), 4)
    assert slots.tolist() == [0] and buckets == [(0, 0)]


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_copies_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append(doc)
    want = []
    for text, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [True] + [False] * (ids.count(low) - 1)
        for doc in ids:
            want.append((str(doc), str(low), len(ids), kept.pop(0) if doc == low else False, sha))
    got = [
        (str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256)
        for r in exact_dedup.find_copies(odd_docs, capacity=2).collect()
    ]
    assert sorted(got) == sorted(want)
    assert exact_dedup.find_copies(no_docs).count() == 0


def test_dropping_exact_copies_keeps_one_row_of_each(odd_docs, no_docs):
    out = exact_dedup.drop_copies(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [normal(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts))
    assert set(texts) == {normal(r.text) for r in odd_docs.collect()}
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_collided_keys_are_chained():
    import pyarrow as pa

    schema = [("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.binary())]
    schema += [("body", pa.binary()), ("low", pa.int64()), ("n", pa.int64())]
    rows = [(0, 5, b"x", b"one", 4, 1), (0, 5, b"y", b"two", 3, 2), (0, 5, b"x", b"one", 2, 1)]
    rows.append((0, 6, b"z", b"six", None, 1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], schema=pa.schema(schema)
    )
    got = [tuple(r.values()) for b in exact_dedup._pages(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, 5, 0, b"x", 2, 2), (0, 5, 1, b"y", 3, 2), (0, 6, 0, b"z", None, 1)]


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    texts = ["The cat", None, "  the\tCAT the ", "", "é" * 3, "x" * 3000000 + " cat"]
    data, bounds = utf8(pa.array(texts))
    starts, ends, at = word_bounds(data, bounds, SPACES)
    h = word_hashes(data, starts, ends).tolist()
    assert at.tolist() == [0, 2, 2, 5, 5, 6, 8]
    assert h[0] == h[2] == h[4] and h[1] == h[3] == h[7]
    assert len(set(h)) == 4


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_enough_chunks(percent):
    m = near_dedup.chunks_for(percent)
    rng = np.random.default_rng(0)
    far = (rng.random((200000, 4 * m)) > percent / 100).sum(axis=1) > 2 * m - 1
    assert far.sum() <= 6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    own = rng.integers(0, 2**63, 200).astype(np.uint64)
    values = np.concatenate([common, own[:100], common, own[100:]])
    got = near_dedup.signatures(values, np.array([0, 900, 900, 1800]), 400)
    assert got.shape == (2, 400)
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.08


def check_groups(docs, got, words, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = []
    for (doc, text), (n, group) in zip(rows, near_groups(rows, words, percent), strict=True):
        low = doc
        if shingle_set(text, words):
            low = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        want.append((str(doc), n, str(low), doc == low))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(want)


def test_near_copies_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_groups(docs, near_dedup.query(spark, sf_dir).collect(), 3, 85)


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    check_groups(odd_docs, near_dedup.find_groups(odd_docs, 3, 85).collect(), 3, 85)
    assert near_dedup.find_groups(no_docs).count() == 0
    assert near_dedup.drop_near_copies(no_docs).count() == 0


def test_chains_and_a_large_group_of_near_copies(make):
    """Links that no leader has: chains of texts, each like the next only."""
    rng = np.random.default_rng(5)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(200)]
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            words = words[6:] + [f"c{chain}s{step}n{k}" for k in range(6)]
    base = [f"b{k}" for k in range(150)]
    for _ in range(120):
        words = base.copy()
        for k in rng.integers(0, 150, 2):
            words[k] = f"r{rng.integers(10**9)}"
        rows.append((len(rows), " ".join(words)))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    docs = make("doc_id long, text string", rows)
    check_groups(docs, near_dedup.find_groups(docs, 3, 85).collect(), 3, 85)
    kept = {r.doc_id for r in near_dedup.drop_near_copies(docs, 3, 85).collect()}
    wanted = {min(rows[i][0] for i in group) for _, group in near_groups(rows, 3, 85)}
    assert kept == wanted


def family(n, seed):
    """Texts with two edits each in the same 120 words, without those themselves."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in range(120)]
        for x in rng.choice(120, 2, replace=False):
            words[x] = f"r{rng.integers(10**12)}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("blocks", [(8, near_dedup.BLOCK_NODES), (2, 9)])
def test_families_that_no_leader_links(make, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "FEW", blocks[0])
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", blocks[1])
    monkeypatch.setattr(near_dedup, "PAIRS", 7)
    docs = make("doc_id long, text string", family(90, 3) + [(None, "w1 w2"), (500, "w1 w2")])
    check_groups(docs, near_dedup.find_groups(docs, 3, 85).collect(), 3, 85)


def test_rows_of_pairs_grow_with_the_family(make, monkeypatch):
    written = []
    through = near_dedup.through_files

    def counted(df, label):
        out = through(df, label)
        if label in ("pairs", "links"):
            written[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "through_files", counted)
    for n in (250, 500):
        written.append(0)
        docs = make("doc_id long, text string", family(n, 4))
        near_dedup.find_groups(docs, 3, 85).count()
    assert written[1] <= 2.2 * written[0]


@pytest.mark.parametrize("percent,counted", [(80, near_dedup.COUNTED), (85, 150)])
def test_forest_joins_what_links_join(monkeypatch, percent, counted):
    monkeypatch.setattr(near_dedup, "COUNTED", counted)
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        kind = int(rng.integers(0, 5))
        base = np.arange(kind * 1000, kind * 1000 + 100, dtype=np.uint64)
        sets.append(np.sort(rng.choice(base, int(rng.integers(82, 100)), replace=False)))
    nodes = np.arange(60)
    given = nodes.copy()
    given[[7, 9]] = given[8]

    def joined(first, pairs):
        root = given.copy()
        for x, y in pairs:
            root[root == root[y]] = root[x]
        return {frozenset(nodes[root == r].tolist()) for r in set(root.tolist())}

    def linked(x, y):
        both = len(np.intersect1d(sets[x], sets[y]))
        return 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)

    for first in (np.ones(60, bool), nodes < 25):
        found = near_dedup.forest(given, first, sets, percent)
        every = [
            (x, y) for x in range(60) for y in range(x + 1, 60)
            if linked(x, y) and (first.all() or (x < 25 <= y))
        ]
        assert len(found) < 60 and set(found) <= set(every)
        assert joined(first, found) == joined(first, every)


def test_words_that_a_simple_hash_confuses(make):
    """Thue-Morse words: any polynomial modulo a power of two gives both one value."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y z"), (2, f"{other} x y z"), (3, f"{word}  x y z")]
    docs = make("doc_id long, text string", rows)
    check_groups(docs, near_dedup.find_groups(docs, 3, 85).collect(), 3, 85)


def test_components_of_a_path_and_stars(make):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    ids = rng.permutation(300)
    edges = [(int(ids[a]), int(ids[b])) for a, b in edges]
    got = {r.node: r.root for r in components(make("a long, b long", edges)).collect()}
    parts = [ids[:61], ids[100:130], ids[200:201]]
    assert got == {int(x): int(min(p)) for p in parts for x in p}
