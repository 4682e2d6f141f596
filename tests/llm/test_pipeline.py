"""The pipeline's stages on a small table against what each must keep, and the registered queries."""

from __future__ import annotations

import json

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from cellmosaic.llm.queries import ORACLES, QUERIES
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(ORACLES[name]).df()) is None


def test_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).checkpoint()
        assert docs.columns == columns, name
        if name != "mix_sources":
            assert docs.count() <= before
            before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert last.count() == docs.count() > 0


def test_license_query_returns_the_paragraphs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op10_licenses"](spark, FOLDER).collect()
    for r in rows:
        found = json.loads(r.found)
        sure = [x["family"] for x in found if x["family"] != "unknown"]
        assert (len(sure), len(found) - len(sure), ",".join(sorted(set(sure)))) == (r.n_confirmed, r.n_unknown, r.families)
        assert all(0 <= x["start"] < x["end"] <= len(texts[r.doc_id]) for x in found)
    assert any(r.n_confirmed for r in rows)
