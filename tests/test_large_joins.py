"""Joins of long tables must not send one side through the driver, however small its file is."""

import re

from pyspark.sql import functions as F

from stavework.operators import intervals, riff
from stavework.session import share, share_rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spans(spark):
    return share(spark.range(3000).select(
        (F.col("id") % 100).alias("track_id"), F.floor(F.col("id") / 100).alias("bar"), (F.floor(F.col("id") / 100) * 10.0).alias("start"),
        (F.floor(F.col("id") / 100) * 10.0 + 10.0).alias("end")))


def test_range_joins_sort_both_sides(spark):
    a = spans(spark)
    points = a.select("track_id", (F.col("start") + 5).alias("t"))
    joins = [
        intervals.point_in_span(points, a, ["track_id"], "t", "start", "end", 10.0),
        intervals.overlap(points.withColumn("u", F.col("t") + 5), a, ["track_id"], ("t", "u"), ("start", "end"), 10.0),
        intervals.within(points, a.select("track_id", "start"), ["track_id"], "t", "start", 5.0, "left_anti"),
    ]
    assert [j.count() for j in joins] == [3000, 3000, 0]
    for j in joins:
        assert "BroadcastHashJoin" not in plan(j) and "SortMergeJoin" in plan(j)


def test_shared_rows_are_not_sent_whole(spark):
    a = share_rows(spans(spark))
    bars = a.groupBy("track_id").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" not in plan(a.join(bars, "track_id"))
    assert "BroadcastHashJoin" in plan(a.join(F.broadcast(bars), "track_id"))


def test_riffs_are_chosen_without_sending_bars(spark):
    bars = spark.range(400).select(
        (F.col("id") % 50).alias("track_id"), F.lit(0).alias("section"), F.floor(F.col("id") / 50).alias("bar"), F.lit(8).alias("width"),
        F.array(F.lit(60).cast("long"), (F.col("id") % 3 + 3060).cast("long")).alias("notes"))
    chosen = riff.choose_riff(bars)
    assert chosen.count() == 50
    assert re.search(r"SortMergeJoin \[[^\]]*note#", plan(chosen)) and not re.search(r"BroadcastHashJoin \[[^\]]*note#", plan(chosen))
