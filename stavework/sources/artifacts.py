"""Run folders as tables: typed JSON artifacts, validated writes, catalogue, hashes, front-end hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad"
FRONT_ENDS: dict[str, tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], str]] = {}


def artifact_scan(spark: SparkSession, paths: str | list[str], schema: StructType, slug_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(readable artifacts with their run's `slug` and `path`, unreadable ones as (path, text)).

    The schema is given, never inferred; fields an older file lacks read as null.
    """
    full = StructType([*schema.fields, StructField(BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    text = spark.read.option("wholetext", True).text(paths)  # one artifact per file
    path = F.col("_metadata.file_path")
    raw = text.select(F.from_json("value", full, options).alias("a"), path.alias("path")).select("a.*", "path")
    rows = raw.withColumn("slug", F.element_at(F.split("path", "/"), -slug_depth))
    return rows.where(F.col(BAD).isNull()).drop(BAD), rows.where(F.col(BAD).isNotNull()).select("path", F.col(BAD).alias("text"))


def artifact_write(df: DataFrame, path: str, violations: DataFrame | None = None, partition: str = "track_id") -> None:
    """Validate, then replace the written tracks' partitions and nothing else.

    The job fails before writing when a constraint query returns rows.
    """
    if violations is not None:
        first = violations.limit(5).collect()  # five rows to name in the error
        if first:
            raise ValueError(f"artifact does not validate: {[r.asDict() for r in first]}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def run_catalogue(spark: SparkSession, manifests: str | list[str], schema: StructType) -> DataFrame:
    """Every run with a readable manifest; unreadable ones are skipped."""
    return artifact_scan(spark, manifests, schema, slug_depth=2)[0]


def content_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("hash"))


def shape_rows(texts: DataFrame, column: str = "json") -> DataFrame:
    """The nested shape dictionary flattened: key -> entries[suffix] -> positions[]."""
    schema = "struct<chords: map<string, array<struct<suffix: string, positions: array<struct<frets: array<int>, fingers: array<int>, baseFret: int, barres: array<int>>>>>>>"
    parsed = texts.select(F.from_json(column, schema).alias("d"))
    entries = parsed.select(F.explode("d.chords").alias("root", "entries")).select("root", F.explode("entries").alias("e"))
    rows = entries.select("root", "e.suffix", F.posexplode("e.positions").alias("pos", "p"))
    zeros = F.array(*[F.lit(0)] * 4)
    return rows.select(
        "root", "suffix", "pos", "p.frets", F.coalesce("p.fingers", zeros).alias("fingers"), F.coalesce("p.baseFret", F.lit(1)).alias("base_fret"),
        F.coalesce("p.barres", F.array().cast("array<int>")).alias("barres"))


def write_lines(lines: DataFrame, order: list[Column], path: str) -> None:
    """Text lines in one global order, as range-partitioned part files."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def register_front_end(name: str, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> None:
    """A detector that fills frames, onsets or spans from raw inputs, batch by batch."""
    FRONT_ENDS[name] = (fn, schema)


def run_front_end(name: str, inputs: DataFrame) -> DataFrame:
    fn, schema = FRONT_ENDS[name]
    return inputs.mapInPandas(fn, schema)
