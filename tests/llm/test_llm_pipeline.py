"""The pipeline's stages one after another, and every registered query of the subpackage."""

import corpus_pipeline
from sentinelweave.llm import queries

PATH = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, PATH).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert mixed.groupBy("doc_id").count().filter("count > 3").count() == 0
    assert mixed.join(docs, "doc_id", "left_anti").count() == 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
