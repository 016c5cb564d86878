"""The pipeline's stages, one after another, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import mixing, near_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "123 ...", "de", "s", 7)], docs.schema)
    docs = docs.unionByName(odd)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").exceptAll(kept.select("doc_id")).collect()}
    assert {9001, 9002, 9003} <= gone and len(gone) < 10
    one = corpus_pipeline.STAGES[1][1](spark, kept, sf)
    comp = {r.doc_id: r.kept for r in near_dedup.near_duplicates(kept, 5).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, k in comp.items() if k}
    mixed = corpus_pipeline.STAGES[2][1](spark, one, sf)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mixing.schedule(one).collect())
    coded = corpus_pipeline.STAGES[3][1](spark, mixed, sf)
    assert coded.groupBy("doc_id", "rank").agg(F.countDistinct("ids").alias("n")).where("n > 1").count() == 0
    assert {r.doc_id for r in coded.select("doc_id").collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
