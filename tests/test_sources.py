"""Readers and writers on files."""

import json

import pytest
from pyspark.sql import types as T

from stavework.sources import artifacts as A
from stavework.sources import records as R


def test_artifacts_scan_keeps_the_unreadable_apart_and_fills_new_fields(spark, tmp_path):
    for name, text in (("one", json.dumps({"bpm": 120.0})), ("two", '{"bpm": "fast"'), ("three", json.dumps({"bpm": 90.0, "silent": True}))):
        (tmp_path / name / "02_grid").mkdir(parents=True)
        (tmp_path / name / "02_grid" / "grid.json").write_text(text)
    schema = T.StructType([T.StructField("bpm", T.DoubleType()), T.StructField("silent", T.BooleanType())])
    good, bad = A.artifact_scan(spark, f"{tmp_path}/*/02_grid/grid.json", schema)
    assert sorted((r["slug"], r["bpm"], r["silent"]) for r in good.collect()) == [("one", 120.0, None), ("three", 90.0, True)]
    assert bad.count() == 1
    hashes = A.content_hashes(spark, f"{tmp_path}/*/02_grid/grid.json").collect()
    assert len({r["hash"] for r in hashes}) == 3


def test_write_replaces_only_the_written_tracks_and_refuses_violations(spark, tmp_path):
    path = str(tmp_path / "beats")
    one = spark.createDataFrame([(1, 0.5), (2, 0.7)], "track_id int, t double")
    A.artifact_write(one, path)
    A.artifact_write(spark.createDataFrame([(2, 9.0)], "track_id int, t double"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("track_id", "t").collect()) == [(1, 0.5), (2, 9.0)]
    with pytest.raises(ValueError):
        A.artifact_write(one, path, violations=one.limit(1))


def test_comments_end_lines_but_not_sharps(spark):
    df = spark.createDataFrame([(1, "# head\nC# minor book # why\n\n  \nF major")], "id int, text string")
    assert [(r["line"], r["record"]) for r in R.truth_lines(df, "text", ["id"]).orderBy("line").collect()] == [(2, "C# minor book"), (5, "F major")]


def test_front_end_hook_fills_a_table(spark):
    A.register_front_end("half", lambda batches: (b.assign(t=b["t"] / 2) for b in batches), "track_id int, t double")
    out = A.run_front_end("half", spark.createDataFrame([(1, 4.0)], "track_id int, t double")).collect()
    assert tuple(out[0]) == (1, 2.0)


def test_lines_are_written_in_order(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "i int, value string")
    A.write_lines(df, [F.col("i")], str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
