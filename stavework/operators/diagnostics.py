"""Truth-free figures of a run, and metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.harmony_spans import over_bars
from stavework.operators.intervals import within
from stavework.operators.ordered import exact_median, with_neighbour
from stavework.params import EPS_DIAGNOSTIC

KEYS = ["track_id"]


def chord_diagnostics(
    spans: DataFrame, bars: DataFrame, bucket: float, chunk: float | None, tolerance: float, beat_share: float = 1.0
) -> DataFrame:
    """No-chord time share, all-N bars, changes on a bar start, events shorter than a beat.

    A beat here is `beat_share` of the track's median event, the grid being given apart from the spans.
    """
    dur = F.col("end") - F.col("start")
    n_share = spans.groupBy("track_id").agg(F.try_divide(F.sum(F.when(F.col("label") == "N", dur).otherwise(0.0)), F.sum(dur)).alias("n_share"))
    chorded = over_bars(spans.where("label <> 'N'"), bars, bucket, EPS_DIAGNOSTIC).select("track_id", "bar").distinct()
    all_n = bars.select("track_id", "bar").join(chorded, ["track_id", "bar"], "left_anti").groupBy("track_id").agg(F.count("*").alias("all_n_bars"))
    near = with_neighbour(spans, KEYS, ["start", "span_id"], chunk, {"before": "label"}).where("before <> label").select("track_id", "span_id", "start")
    on = within(near, bars.select("track_id", F.col("start").alias("b_start")), KEYS, "start", "b_start", tolerance, "left_semi")
    changes = near.groupBy("track_id").agg(F.count("*").alias("n")).join(on.groupBy("track_id").agg(F.count("*").alias("on")), KEYS, "left")
    changes = changes.select("track_id", (F.coalesce("on", F.lit(0)) / F.col("n")).alias("changes_on_bar"))
    med = exact_median(spans.withColumn("d", dur), KEYS, "d", "median")
    sub = spans.join(med, KEYS).groupBy("track_id").agg(F.count_if(dur < beat_share * F.col("median")).alias("sub_beat_events"))
    tracks = bars.select("track_id").distinct()
    return tracks.join(n_share, KEYS, "left").join(all_n, KEYS, "left").join(changes, KEYS, "left").join(sub, KEYS, "left").fillna(0, ["all_n_bars"])


def metric_rows(wide: DataFrame) -> DataFrame:
    """One row per (track, metric)."""
    return wide.unpivot(["track_id"], [c for c in wide.columns if c != "track_id"], "metric", "value")
