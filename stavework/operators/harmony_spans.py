"""Label spans against beats and bars, and the small joins between onset lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.intervals import best, overlap, point_in_span, within
from stavework.operators.ordered import with_neighbour, with_position, with_runs
from stavework.params import EPS_OVERLAP

KEYS = ["track_id"]


def beat_labels(spans: DataFrame, beats: DataFrame, bucket: float) -> DataFrame:
    """Per beat the label with most overlap (the first span's on a tie) and its share; N when none."""
    hits = overlap(
        beats.select("track_id", "i", F.col("start").alias("b_start"), F.col("end").alias("b_end")),
        spans.select("track_id", "span_id", "start", "end", "label"), KEYS, ("b_start", "b_end"), ("start", "end"), bucket,
    )
    sums = hits.groupBy("track_id", "i", "label").agg(F.sum("overlap").alias("ov"), F.min("span_id").alias("first_span"))
    top = best(sums, ["track_id", "i"], [-F.round("ov", 6), F.col("first_span")])
    share = F.least(F.lit(1.0), F.col("ov") / (F.col("end") - F.col("start")))
    return beats.where(F.col("end") > F.col("start")).join(top, ["track_id", "i"], "left").select(
        *beats.columns, F.coalesce("label", F.lit("N")).alias("label"), F.coalesce(share, F.lit(0.0)).alias("share")
    )


def snap_to_beats(spans: DataFrame, beats: DataFrame, bucket: float) -> DataFrame:
    """Chord events: per-beat labels merged over runs, the confidence the plain mean of their shares."""
    runs = with_runs(beat_labels(spans, beats, bucket), KEYS, ["i"], 4096, "label")
    place = F.min_by(F.struct("bar", "beat"), "i")
    return runs.groupBy("track_id", "run", "label").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.avg("share").alias("confidence"), place.alias("place")
    ).select("track_id", F.col("run").alias("event"), "place.bar", "place.beat", "start", "end", "label", "confidence")


def over_bars(events: DataFrame, bars: DataFrame, bucket: float, eps: float = EPS_OVERLAP) -> DataFrame:
    """Events overlapping each bar by more than eps, with the overlap."""
    named = bars.withColumnsRenamed({"start": "bar_start", "end": "bar_end"})
    clash = [c for c in ("bar", "section", "beat") if c in events.columns]
    return overlap(named, events.drop(*clash), KEYS, ("bar_start", "bar_end"), ("start", "end"), bucket, eps)


def chords_over_bars(events: DataFrame, bars: DataFrame, bucket: float) -> DataFrame:
    """Per bar: its sorted triads joined with + (N when none), whether a chord sounds, whether all is N."""
    hits = over_bars(events, bars, bucket).groupBy("track_id", "bar").agg(
        F.array_sort(F.collect_set(F.when(~F.col("triad").isin("N", "X"), F.col("triad")))).alias("set"),
        F.bool_or(F.col("label") != "N").alias("any_chord"), F.bool_and(F.col("label") == "N").alias("only_n"),
    )
    empty = F.array().cast("array<string>")
    return bars.join(hits, ["track_id", "bar"], "left").select(
        *bars.columns, F.coalesce("set", empty).alias("triad_set"),
        F.when(F.size(F.coalesce("set", empty)) == 0, "N").otherwise(F.array_join("set", "+")).alias("triads"),
        F.coalesce("any_chord", F.lit(False)).alias("has_chord"), F.coalesce("only_n", F.lit(True)).alias("all_n"),
    )


def root_at(times: DataFrame, spans: DataFrame, bucket: float) -> DataFrame:
    """The chord root sounding at each time (the first span holding it); null for none or no chord."""
    hits = point_in_span(times, spans.select("track_id", "span_id", "start", "end", "label"), KEYS, "t", "start", "end", bucket)
    first = best(hits.select("track_id", "event_id", "start", "span_id", "label"), ["track_id", "event_id"], [F.col("start"), F.col("span_id")])
    return times.join(first, ["track_id", "event_id"], "left").select(
        "track_id", "event_id", F.when(~F.col("label").isin("N", "X"), F.split_part("label", F.lit(":"), F.lit(1))).alias("root")
    )


def merge_onsets(base: DataFrame, extra: DataFrame, radius: float) -> DataFrame:
    """The base and the extra onsets farther than `radius` from every base onset, marked `added`."""
    kept = within(extra, base.select("track_id", F.col("t").alias("b_t")), KEYS, "t", "b_t", radius, "left_anti")
    return base.withColumn("added", F.lit(False)).unionByName(kept.withColumn("added", F.lit(True)))


def splice(base: DataFrame, pieces: DataFrame, chunk: float | None) -> DataFrame:
    """Base and pieces in one stable time order (the base first at one time)."""
    both = base.withColumn("added", F.lit(False)).unionByName(pieces.withColumn("added", F.lit(True)))
    return with_position(both, KEYS, ["t", "added", "event_id"], chunk, "place")


def note_ends(onsets: DataFrame, bars: DataFrame, chunk: float | None, bucket: float) -> DataFrame:
    """The next onset of the track or the bar's end, whichever comes first."""
    nxt = with_neighbour(onsets, KEYS, ["t", "event_id"], chunk, {"next_t": "t"}, ahead=True)
    placed = point_in_span(nxt, bars.select("track_id", "bar", "start", "end"), KEYS, "t", "start", "end", bucket)
    return placed.withColumn("note_end", F.least(F.coalesce("next_t", "end"), F.col("end")))
