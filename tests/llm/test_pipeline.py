"""The stages one after the other on the smallest tables."""

import corpus_pipeline
from stavework.llm import decontam, jaccard
from stavework.session import share

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = share(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            assert jaccard.jaccard_components(docs).where("doc_id <> component_id").count() == 0
        if k == 2:
            assert decontam.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] and docs.where("copies between 1 and 3").count() == sizes[-1] > 0


def test_near_duplicates_with_repeats_and_nulls(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, text, "z"), (None, text, "n"), (3, None, "e")], "doc_id long, text string, row string")
    got = corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()
    assert sorted((str(r["doc_id"]), r["row"]) for r in got) == [("1", "x"), ("3", "e"), ("None", "n")]
