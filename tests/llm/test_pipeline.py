"""The pipeline's stages, each on its own input, against plain versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
import tokenizers
from plain import leaks, near_groups, windows
from test_copies import normal
from test_tokens import check_packing

from tensorspark.llm import common, exact_dedup, langid, packing, tokens
from tensorspark.llm.common import through_files


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of every stage but the last, as rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = through_files(stage(spark, docs, sf_dir), name)
        assert docs.columns == out[0].columns
        out.append(docs)
    return out


def ids(docs):
    return {r.doc_id for r in docs.select("doc_id").collect()}


def test_language_keeps_clean_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "exact_copies", "near_copies", "benchmark_leaks", "pack"
    ]
    gone = ids(stages[0]) - ids(stages[1])
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(not any(c.isalpha() for c in texts[d] or "") for d in gone)


def test_exact_copies(stages):
    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    assert ids(stages[2]) == set(first.values())


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == {
        min(rows[i][0] for i in group) for _, group in near_groups(rows, 5, 80)
    }


def test_benchmark_leaks(spark, sf_dir, stages):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    found = windows([(r.item_id, r.text) for r in items])
    clean = {r.doc_id for r in stages[3].collect() if not leaks(r.text, found)[1]}
    assert ids(stages[4]) == clean and clean != ids(stages[3])


def test_run_packs_what_is_left(spark, sf_dir, stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    pieces = packing.pack(stages[4])
    check_packing(pieces.collect(), rows)
    plain = lambda df: Counter(map(tuple, df.select("doc_id", "doc_tokens").distinct().collect()))
    assert plain(corpus_pipeline.run(spark, sf_dir)) == plain(pieces)


def test_stages_take_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = through_files(stage(spark, docs, sf_dir), name)
        assert (docs.count() > 0) == (start is odd_docs)


def test_stages_start_no_second_kind_of_workers(spark, odd_docs, monkeypatch):
    """A list of rows of the driver would go through Python workers outside of SQL."""
    docs = through_files(odd_docs, "odd")

    def refuse(*rows):
        raise AssertionError("rows of the driver go through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    known = langid.drop_unknown(docs, langid.fit(docs))
    assert exact_dedup.drop_copies(known).count() > 0


def test_language_drops_encoders_of_earlier_tasks():
    tokens.encoder(tokens.WORD_BPE)
    assert vars(tokenizers)["_encoders_by_path"]
    assert list(langid._count_words(iter([]))) == []
    assert not vars(tokenizers).get("_encoders_by_path")


def test_scans_of_texts_are_bounded(spark, odd_docs):
    usual = spark.conf.get(common._SCAN_SETTING)
    try:
        spark.conf.unset(common._SCAN_SETTING)
        common.id_text(odd_docs)
        assert int(spark.conf.get(common._SCAN_SETTING)) == common.SCAN_ROWS
        spark.conf.set(common._SCAN_SETTING, "100")
        common.id_text(odd_docs)
        assert spark.conf.get(common._SCAN_SETTING) == "100"
    finally:
        spark.conf.set(common._SCAN_SETTING, usual)
