"""One constant swept against truth: every value is a row, leave-one-out is total less own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIE = 1e-9


def over_values(df: DataFrame, values: Sequence[float]) -> DataFrame:
    """Every row once per swept value (`value_index`, `value`); the values are a short literal list."""
    grid = F.array(*[F.struct(F.lit(i).alias("value_index"), F.lit(float(v)).alias("value")) for i, v in enumerate(values)])
    return df.select("*", F.inline(grid))


def f_measure(hits: str, false_pos: str, false_neg: str) -> Column:
    return F.try_divide(2 * F.col(hits), 2 * F.col(hits) + F.col(false_pos) + F.col(false_neg))


def pooled_curve(counts: DataFrame, columns: Sequence[str], objective: Column) -> DataFrame:
    """The metric over all songs at each value."""
    sums = counts.groupBy("value_index", "value").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.withColumn("objective", objective)


def held_out_bands(counts: DataFrame, song: str, columns: Sequence[str], objective: Column, higher: bool = True) -> DataFrame:
    """Per held-out song: the best metric over the others, the widest run of values tying it, its middle.

    `counts` (song, value_index, value, columns): the totals are one row per value, so they are
    broadcast; a song has one row per value, so its window is as long as the value list.
    """
    totals = counts.groupBy("value_index").agg(*[F.sum(c).alias(f"t_{c}") for c in columns], F.count_distinct(song).alias("t_songs"))
    rest = counts.join(F.broadcast(totals), "value_index").select(
        song, "value_index", "value", "t_songs", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in columns]
    ).where("t_songs > 1").withColumn("objective", objective)
    per_song, in_order = Window.partitionBy(song), Window.partitionBy(song).orderBy("value_index")
    best = F.max("objective").over(per_song) if higher else F.min("objective").over(per_song)
    tied = rest.withColumn("best", best).where(F.abs(F.col("objective") - F.col("best")) <= TIE)
    runs = tied.withColumn("run", F.col("value_index") - F.row_number().over(in_order))
    bands = runs.groupBy(song, "best", "run").agg(
        F.count("*").alias("width"), F.min("value_index").alias("first"), F.min("value").alias("low"), F.max("value").alias("high"))
    widest = bands.groupBy(song, "best").agg(F.max_by(F.struct("width", "first", "low", "high"), F.struct("width", -F.col("first"))).alias("b"))
    middle = runs.select(song, "value_index", F.col("value").alias("best_value"))
    picked = widest.select(song, "best", "b.low", "b.high", (F.col("b.first") + F.floor((F.col("b.width") - 1) / 2)).cast("int").alias("value_index"))
    return picked.join(middle, [song, "value_index"]).select(song, F.col("best").alias("objective"), "best_value", "low", "high")


def verdict(bands: DataFrame, current: float) -> DataFrame:
    """Is the current value inside every held-out band? One row."""
    inside = (F.col("low") - TIE <= current) & (F.lit(current) <= F.col("high") + TIE)
    return bands.agg(F.count("*").alias("songs"), F.count_if(~inside).alias("outside"), F.bool_and(inside).alias("inside"))
