"""The pipeline against plain Python on whole documents, and its stages on odd rows."""

from __future__ import annotations

import hashlib
import re

import pytest
import public_tokenizers
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from tallyweir.llm import pii, quality
from tallyweir.llm.links import stored
from tests.llm.test_free import brute_components
from tests.llm.test_native import brute_overlap
from tests.oracle import compare, connect

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, folder):
    docs = stored(spark.read.parquet(f"{folder}/documents.parquet"), "docs")
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        by_stage[name] = (docs, docs := stored(stage(spark, docs, folder), name))
    before, after = by_stage["quality_rules"]
    passed = {r.doc_id for r in quality.ledger(before).where(quality.passes(corpus_pipeline.POLICY)).collect()}
    assert {r.doc_id for r in after.collect()} == passed and after.columns == before.columns

    before, after = by_stage["near_duplicates"]
    groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in groups.values()})

    before, after = by_stage["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    overlap = brute_overlap([(r.doc_id, r.text) for r in before.collect()], items)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, x in overlap.items() if not x[3])

    before, after = by_stage["personal_data"]
    spans = {r.doc_id: (r.text, r["spans"]) for r in pii.spans(before).collect()}
    texts = {r.doc_id: r for r in after.collect()}
    for doc, (text, found) in spans.items():
        inside = [any(s["start"] <= k < s["end"] for s in found) for k in range(len(text))]
        rest = "".join(c for c, i in zip(text, inside, strict=True) if not i)
        assert re.sub(r"\[[A-Z+]+\]", "", texts[doc].text) == re.sub(r"\[[A-Z+]+\]", "", rest)
        assert texts[doc].n_chars == len(texts[doc].text)

    before, after = by_stage["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        ids = [*library.encode(r.text), 2]
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = contract.queries()["pipeline"](spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows.values()))


def test_stages_on_odd_rows(spark, folder):
    long_ = "one two three four five six seven eight nine ten eleven mail a@b.co"
    rows = [(None,) * 6] + [(1, long_, None, "s", 9, "kept")] * 2 + [(None, "a b c d e f g h i j k l m n o p", None, None, None, None)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, COLUMNS + ", n_words string")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, folder), name)
            assert out.columns == docs.columns
            docs = out
        assert docs.count() == (2 if data else 0)
        assert {r.n_words for r in docs.collect()} == ({"kept", None} if data else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


@pytest.mark.parametrize("name", ["op1_benchmark_overlap", "op2_license_scan", "op3_quality_ledger", "op9_gram_components"])
def test_query_agrees_with_sql(spark, folder, name):
    assert compare(contract.queries()[name](spark, folder), connect(folder), contract.oracle_sql()[name]) == []
