"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stavework.catalog.common import Registry
from stavework.llm import decontam, jaccard, langid, lm, merkle, mixing, phrases, pii, quality, simhash, topk, urls, warc
from stavework.llm.sql import JACCARD, MERKLE, MIXING, PHRASES, TOPK, URLS, WARC
from stavework.session import new_folder

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SURROGATE_KEY = "surrogates of this release"
TARGET = "source = 'src1'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_norm_bucketed_topk", TOPK)
def op1(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_cross_entropy_difference")
def op2(spark, sf):
    return lm.cross_entropy_difference(table(spark, sf, "documents"), TARGET)


@query("op3_pii_surrogates")
def op3(spark, sf):
    out = pii.replaced(table(spark, sf, "documents"), SURROGATE_KEY)
    return out.select("doc_id", F.col("_entities").alias("entities"), "text")


@query("op4_url_rules", URLS)
def op4(spark, sf):
    return urls.url_verdicts(table(spark, sf, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op5_language_centroids")
def op5(spark, sf):
    return langid.languages(table(spark, sf, "documents"))


@query("op6_warc_writer", WARC)
def op6(spark, sf):
    folder = new_folder(spark)
    manifest = warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.read_archive(spark, folder, manifest).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_quality_ranking")
def op7(spark, sf):
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_benchmark_leaks")
def op8(spark, sf):
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_source_mixture", MIXING)
def op9(spark, sf):
    return mixing.mixture(table(spark, sf, "documents"))


@query("op10_ngram_jaccard_join", JACCARD)
def op10(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"))


@query("op11_phrase_collocations", PHRASES)
def op11(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op12_simhash_anchors")
def op12(spark, sf):
    return simhash.simhash_components(table(spark, sf, "documents"))


@query("op13_merkle_manifest", MERKLE)
def op13(spark, sf):
    return merkle.merkle_manifest(table(spark, sf, "documents"))
