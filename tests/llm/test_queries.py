"""The registered queries: against SQL where there is some, by their contract elsewhere."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect, rows_of
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def labels(spark, name, label):
    rows = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", label)
    return QUERIES[name](spark, "/root/testdata/sf0.1").join(rows.dropna(), "doc_id").toPandas()


@pytest.mark.parametrize("name,label,modulus,rest,least", [("op8_toxicity", "toxic", 3, 1, 0.96), ("op10_quality", "quality", 4, 2, 0.98)])
def test_held_out_accuracy(spark, name, label, modulus, rest, least):
    found = labels(spark, name, label)
    held = found[[zlib.crc32(str(i).encode()) % modulus == rest for i in found.doc_id]]
    assert held.held_out.all() and len(held) > 500
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()
    assert (held.predicted == held[label]).mean() >= least


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language"](spark, "/root/testdata/sf0.1").join(docs, "doc_id").toPandas()
    assert len(found) == docs.count()
    held = found[found.held_out]
    assert np.mean(held.lang_pred == held.lang) > 0.995


def test_pipeline(spark):
    """Each stage against what it must keep, and the last one whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "mix", "shard"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, SF).filter("kept").collect()}
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name == "quality_rules":
            assert ids(after) == kept
        if name != "shard":
            assert after.columns == columns
        if name in ("near_dedup", "decontaminate"):
            assert ids(after) <= ids(before) and after.count() == len(ids(after))
        if name == "mix":
            total = lambda df: sum(len(r.text.split()) for r in df.collect())
            assert abs(total(after) - total(before)) < 0.1 * total(before)
        if name == "shard":
            assert after.count() == before.count()
            groups = after.groupBy("text").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0]
            assert groups == 1
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()
