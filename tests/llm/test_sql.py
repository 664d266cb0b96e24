"""Queries of the training-data operators against their SQL, and the pipeline against its parts."""

import collections

import pytest

import corpus_pipeline
from cachelens.llm.queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], SQL[name], "sf0.01")


def test_recrawls_ask_every_page(spark):
    pages = spark.read.parquet(str(DATA / "sf0.01" / "pages.parquet"))
    rows = QUERIES["op8_recrawls"](spark, str(DATA / "sf0.01")).collect()
    ids = {r.page_id for r in pages.select("page_id").collect()}
    assert {r.record_id for r in rows} == {8 * i + k for i in ids for k in (3, 5)} and len(rows) == 2 * len(ids)
    assert {(r.record_id - r.source_id) for r in rows if r.source_id is not None and r.record_id % 8 == 3} >= {1, 2}  # of several
    assert {"resolved", "mismatch", "unchecked", "unresolved"} == {r.status for r in rows}
    assert max(collections.Counter(r.url_key for r in rows).values()) > 20


def test_pipeline(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns
        if name in ("toxicity", "near_duplicates"):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()} and docs.count() > 0.5 * before.count()
        if name == "substrings":
            assert docs.count() == before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total[r.doc_id] for r in docs.collect())
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
