"""The registered queries against SQL, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F
from sparkloom.llm import queries

import corpus_pipeline

from .helpers import DOCS, awkward


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema or name == corpus_pipeline.STAGES[-1][0]
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen
        seen = now
    assert seen and {"ids", "n_ids", "round_trip"} <= set(docs.columns)
    assert docs.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_meets_awkward_and_empty_tables(spark, sf_dir, stage):
    fn = corpus_pipeline.STAGES[stage][1]
    assert fn(spark, spark.createDataFrame([], DOCS), sf_dir).count() == 0
    docs = awkward(spark).withColumns({c: F.lit("mine") for c in ("_id", "lang_pred", "n_removed", "class_id", "item_ids", "rep")})
    out = fn(spark, docs, sf_dir)
    assert out.count() > 0
    if stage < 4:
        assert out.columns == docs.columns and {tuple(r) for r in out.select("_id", "lang_pred", "n_removed", "score", "kept").collect()} == {("mine",) * 5}


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, sf_dir):
    kept = corpus_pipeline.near_duplicate_join(spark, awkward(spark), sf_dir)
    assert kept.where("doc_id = 6").count() == 1
