"""Constraints as queries that emit one row per (track, broken rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.ordered import with_neighbour, with_position

KEYS = ["track_id"]


def _rule(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("track_id").agg(F.count("*").alias("n")).select("track_id", F.lit(name).alias("rule"), "n")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def grid_constraints(beats: DataFrame, downbeats: DataFrame, bars: DataFrame, sections: DataFrame, chunk: float | None) -> DataFrame:
    """Beats (i, t) strictly increasing; downbeat indices in range; bars 0..n-1; sections from 0,
    contiguous, each at least a bar, ending at the last bar."""
    count = beats.groupBy("track_id").agg(F.count("*").alias("n_beats"))
    n_bars = bars.groupBy("track_id").agg(F.count("*").alias("n_bars"))
    before = with_neighbour(beats, KEYS, ["i"], chunk, {"prev_t": "t"})
    placed = with_position(bars.select("track_id", "bar"), KEYS, ["bar"], chunk)
    nxt = with_neighbour(sections.select("track_id", "start_bar", "end_bar"), KEYS, ["start_bar"], chunk, {"next_start": "start_bar"}, ahead=True)
    ends = sections.groupBy("track_id").agg(F.max("end_bar").alias("last_end"), F.min("start_bar").alias("first_start"))
    edges = n_bars.join(ends, KEYS, "left")
    return union_all([
        _rule(before.where("t <= prev_t"), "beats not increasing"),
        _rule(downbeats.join(count, KEYS, "left").where("i < 0 or i >= coalesce(n_beats, 0)"), "downbeat out of range"),
        _rule(placed.where("bar <> pos"), "bar index gap"),
        _rule(nxt.where("next_start <> end_bar"), "sections not contiguous"),
        _rule(nxt.where("end_bar <= start_bar"), "section without bars"),
        _rule(edges.where("first_start <> 0"), "sections do not start at bar 0"),
        _rule(edges.where("last_end is null or last_end <> n_bars"), "sections do not end at the last bar"),
    ])


def level_constraints(bars: DataFrame, loudness: DataFrame, vocal: DataFrame) -> DataFrame:
    """One loudness per bar, and either no vocal level or one per bar; `n` is how many there are instead.

    `bars` (track_id, bar); `loudness` and `vocal` (track_id, ...) one row per level. A track of levels without bars breaks
    the rule too.
    """
    tally = lambda df, name: df.groupBy("track_id").agg(F.count("*").alias(name))
    c = tally(bars, "n_bars").join(tally(loudness, "loud"), KEYS, "full").join(tally(vocal, "voiced"), KEYS, "full").na.fill(0)
    rules = F.array(F.struct(F.lit("not one loudness per bar").alias("rule"), F.col("loud").alias("n"), (F.col("loud") != F.col("n_bars")).alias("broken")),
                    F.struct(F.lit("not one vocal level per bar").alias("rule"), F.col("voiced").alias("n"), ((F.col("voiced") > 0) & (F.col("voiced") != F.col("n_bars"))).alias("broken")))
    return c.select("track_id", F.inline(rules)).where("broken").drop("broken")


def slot_constraints(rows: DataFrame, slots: int) -> DataFrame:
    """Rows whose vector has not `slots` cells or whose strokes name a slot outside it."""
    out_of_range = F.exists("slots", lambda s: ~s.between(0, slots - 1))
    checked = rows.select("event_id", (F.length("cells") != slots).alias("bad_width"), out_of_range.alias("bad_slot"))
    return checked.where("bad_width or bad_slot")


def plan_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Per track the first planned section that differs from what the inputs give now, and how many do."""
    a, b = stored.withColumn("_a", F.lit(True)), current.withColumn("_b", F.lit(True))
    b = b.withColumnsRenamed({"start_bar": "n_start", "end_bar": "n_end"})
    j = a.join(b, ["track_id", "k"], "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("start_bar") == F.col("n_start")) & (F.col("end_bar") == F.col("n_end"))
    return j.where(~F.coalesce(same, F.lit(False))).groupBy("track_id").agg(F.min("k").alias("first_difference"), F.count("*").alias("differences"))
