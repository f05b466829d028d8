"""A training corpus in five stages: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written and read again as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stavework.llm import decontam, jaccard, mixing, pii, quality
from stavework.llm.queries import SURROGATE_KEY, table
from stavework.session import share


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned score is at least 0.5. Every row is judged by its text alone, so null ids and repeats are no special case."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; a document is an id with a text. Rows without an id can't be named by a group and stay."""
    return jaccard.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by surrogates; n_chars follows the new text."""
    out = pii.replaced(docs, SURROGATE_KEY).drop("_entities")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII surrogates", without_personal_data),
    ("mixing to target weights", mixed_sources),
]

#: Learned scores and keyed draws are outside SQL; the stages' operators are tested one by one, the pipeline by its sizes and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = share(stage(spark, docs, sf_dir))
    return docs
