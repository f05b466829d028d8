"""Run catalogue queries: status by input hash, missing inputs, upstream closure, names, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.titles import video_id
from stavework.operators.ordered import with_position
from stavework.session import share

RUN = ["run"]


def status(runs: DataFrame, stages: DataFrame, recorded: DataFrame, current: DataFrame, requires: DataFrame) -> DataFrame:
    """done, stale or missing per run and stage.

    `recorded` (run, stage, key, hash) are a stage's stored input hashes (key null for a stage without
    inputs), `current` (run, key, hash) what is there now, `requires` (stage, key). The stage tables
    are fixed by the chain and broadcast.
    """
    every = runs.join(F.broadcast(stages.select("stage", "place")))
    inputs = recorded.where("key is not null").join(current.withColumnRenamed("hash", "now"), ["run", "key"], "left")
    changed = inputs.groupBy("run", "stage").agg(F.count_if(~F.col("hash").eqNullSafe(F.col("now"))).alias("changed"))
    wanted = recorded.select("run", "stage").distinct().join(F.broadcast(requires), "stage")
    unhashed = wanted.join(recorded.select("run", "stage", "key"), ["run", "stage", "key"], "left_anti").groupBy("run", "stage").agg(F.count("*").alias("unhashed"))
    seen = recorded.select("run", "stage", F.lit(True).alias("seen")).distinct()
    j = every.join(seen, ["run", "stage"], "left").join(changed, ["run", "stage"], "left").join(unhashed, ["run", "stage"], "left")
    stale = (F.coalesce("changed", F.lit(0)) > 0) | (F.coalesce("unhashed", F.lit(0)) > 0)
    return j.select("run", "stage", F.when(F.col("seen").isNull(), "missing").when(stale, "stale").otherwise("done").alias("status"))


def missing_inputs(starts: DataFrame, requires: DataFrame, present: DataFrame, last: int) -> DataFrame:
    """Required artifacts neither present nor produced by an earlier stage of the chain from `start`.

    `starts` (run, start), `requires` (place, key, producer_place), `present` (run, key).
    """
    need = starts.join(F.broadcast(requires), (F.col("place") >= F.col("start")) & (F.col("place") <= last))
    open_ = need.where((F.col("producer_place") < F.col("start")) | (F.col("producer_place") >= F.col("place")))
    return open_.join(present, ["run", "key"], "left_anti").select("run", "start", "key", "producer_place").distinct()


def earliest_start(starts: DataFrame, requires: DataFrame, present: DataFrame, last: int) -> DataFrame:
    """The stage each run must start from so that no input is missing; a round per stage at most."""
    current = share(starts.select("run", "start"))
    for _ in range(last + 1):
        moved = missing_inputs(current, requires, present, last).where("producer_place < start").groupBy("run").agg(F.min("producer_place").alias("to"))
        moved = share(moved)
        if moved.isEmpty():
            break
        current = share(current.join(moved, RUN, "left").select("run", F.coalesce("to", "start").alias("start")))
    return current


def unique_names(sources: DataFrame, base: str, order: str, chunk: float) -> DataFrame:
    """base, base-2, base-3 for different sources sharing a base name, in order of arrival."""
    placed = with_position(sources, [base], [order], chunk, "_n")
    return placed.withColumn("name", F.when(F.col("_n") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), (F.col("_n") + 1).cast("string")))).drop("_n")


def find_run(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """The saved run of each source: the same source first, then the same video id (first name wins).

    `wanted` (source), `runs` (run, source, video_id).
    """
    exact = runs.groupBy("source").agg(F.min("run").alias("same"))
    known = runs.select("run", F.coalesce("video_id", video_id(F.col("source"))).alias("vid")).where("vid is not null").groupBy("vid").agg(F.min("run").alias("by_id"))
    w = wanted.withColumn("vid", video_id(F.col("source")))
    return w.join(exact, "source", "left").join(known, "vid", "left").select(*wanted.columns, F.coalesce("same", "by_id").alias("run"))


def overlay(given: DataFrame, saved: DataFrame, key: str, columns: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Given values over saved values over defaults, column by column."""
    s = saved.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    j = given.join(s, key, "left")
    return j.select(key, *[F.coalesce(F.col(c), F.col(f"_s_{c}"), defaults.get(c, F.lit(None))).alias(c) for c in columns])


def backfill_bars(patterns: DataFrame, bar_onsets: DataFrame) -> DataFrame:
    """Per-bar records for rows that carry none: the section's pattern, the bar's own strokes, no rest.

    `patterns` (track_id, section, start_bar, end_bar, pattern, uncertain, riff), `bar_onsets`
    (track_id, bar, strike, mute).
    """
    spread = patterns.select("track_id", "section", "pattern", "uncertain", "riff", F.explode(F.sequence(F.col("start_bar"), F.col("end_bar") - 1)).alias("bar"))
    zero = F.lit(0).cast("long")
    return spread.join(bar_onsets.select("track_id", "bar", "strike", "mute"), ["track_id", "bar"], "left").select(
        "track_id", "bar", "section", "pattern", "uncertain", "riff", F.coalesce("strike", zero).alias("strike"), F.coalesce("mute", zero).alias("mute"), F.lit(False).alias("rests"))
