"""Onsets to slots: bar positions, shifted windows, slot classes, mute rule, grid choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.rhythm import one_at
from stavework.operators.intervals import best, point_in_span
from stavework.operators.ordered import exact_median
from stavework.params import SIGNAL, SignalParams

KEYS = ["track_id"]


def onset_positions(onsets: DataFrame, bars: DataFrame, bucket: float, units: Column | None = None) -> DataFrame:
    """Each onset inside its bar with its position in `units` per bar (the bar's width by default)."""
    placed = point_in_span(onsets, bars, KEYS, "t", "start", "end", bucket)
    per_bar = F.col("width") if units is None else units
    return placed.withColumn("pos", (F.col("t") - F.col("start")) / (F.col("end") - F.col("start")) * per_bar)


def onset_to_shifted_bar(onsets: DataFrame, bars: DataFrame, bucket: float) -> DataFrame:
    """Each onset in every bar whose window, moved back half a slot, holds it."""
    half = (F.col("end") - F.col("start")) / F.col("width") / 2
    shifted = bars.withColumn("lo", F.col("start") - half).withColumn("hi", F.col("end") - half)
    return point_in_span(onsets, shifted, KEYS, "t", "lo", "hi", bucket)


def later_bar(placed: DataFrame) -> DataFrame:
    """Where two windows meet, the later bar owns the onset."""
    return best(placed, ["track_id", "onset_id"], [-F.col("bar")])


def nearest_slot() -> Column:
    """The slot of an onset placed in its shifted bar."""
    slot_width = (F.col("end") - F.col("start")) / F.col("width")
    slot = F.floor((F.col("t") - F.col("start")) / slot_width + 0.5)
    return F.greatest(F.lit(0), F.least(slot, F.col("width") - 1)).cast("int")


def slot_owners(onsets: DataFrame, bars: DataFrame, bucket: float) -> DataFrame:
    """Per struck (bar, slot): its class and the onset it came from; a strike beats a mute, else the first."""
    placed = onset_to_shifted_bar(onsets, bars, bucket)
    return (
        placed.withColumn("slot", nearest_slot())
        .groupBy("track_id", "section", "bar", "width", "slot")
        .agg(F.min(F.struct("muted", "t", "onset_id")).alias("owner"))
        .select(
            "track_id", "section", "bar", "width", "slot",
            F.col("owner.muted").alias("muted"), F.col("owner.onset_id").alias("onset_id"), F.col("owner.t").alias("t"),
        )
    )


def quantise(onsets: DataFrame, bars: DataFrame, bucket: float) -> DataFrame:
    """One row per bar with its struck and muted slots as masks; a bar without onsets is all rest.

    A slot is muted when every onset in it is, so no onset need be ranked: two `bit_or`s per bar, folded
    map-side in one hash aggregate over the joined onsets.
    """
    zero = F.lit(0).cast("long")
    here = one_at(nearest_slot())
    struck = (
        onset_to_shifted_bar(onsets, bars, bucket)
        .select("track_id", "bar", here.alias("any"), F.when(F.col("muted"), zero).otherwise(here).alias("clear"))
        .groupBy("track_id", "bar")
        .agg(F.bit_or("any").alias("strike"), F.bit_or("clear").alias("clear"))
    )
    return bars.join(struck, ["track_id", "bar"], "left").select(
        "track_id", "section", "bar", "width", F.coalesce("strike", zero).alias("strike"),
        F.coalesce(F.col("strike").bitwiseAND(F.bitwise_not("clear")), zero).alias("mute"),
    )


def mute_mask(onsets: DataFrame, p: SignalParams = SIGNAL) -> DataFrame:
    """`muted` where an onset is dull and smooth against its track's medians."""
    med_c = exact_median(onsets, KEYS, "centroid", "med_centroid")
    med_z = exact_median(onsets, KEYS, "zcr", "med_zcr")
    return (
        onsets.drop("muted").join(med_c.join(med_z, KEYS), KEYS)
        .withColumn(
            "muted",
            (F.col("centroid") < p.mute_centroid * F.col("med_centroid")) & (F.col("zcr") < p.mute_zcr * F.col("med_zcr")),
        )
        .drop("med_centroid", "med_zcr")
    )


def grid_fit(onsets: DataFrame, bars: DataFrame, bucket: float, p: SignalParams = SIGNAL) -> DataFrame:
    """Share of a track's onsets within a tolerance of a slot."""
    pos = onset_positions(onsets, bars, bucket)
    off = F.abs(F.col("pos") - F.floor(F.col("pos") + 0.5))
    return pos.groupBy("track_id").agg(F.avg((off <= p.grid_fit_tolerance).cast("double")).alias("grid_fit"))


def choose_slots(
    onsets: DataFrame, bars: DataFrame, tempo: DataFrame, numerator: int, bucket: float, p: SignalParams = SIGNAL
) -> DataFrame:
    """Eighth or sixteenth grid per track, from the share of odd sixteenths and the tempo."""
    pos = onset_positions(onsets, bars, bucket, F.lit(numerator * 4))
    odd = pos.groupBy("track_id").agg(
        F.avg((F.floor(F.col("pos") + 0.5) % 2 == 1).cast("double")).alias("odd_share")
    )
    fast = 60000.0 / F.col("bpm") / 4 < p.sixteenth_min_ms
    eighths = numerator * 2
    return tempo.join(odd, "track_id", "left").select(
        "track_id", "odd_share",
        F.when(fast | F.col("odd_share").isNull() | (F.col("odd_share") <= p.odd_sixteenth_share), F.lit(eighths))
        .otherwise(F.lit(eighths * 2)).cast("long").alias("slots"),
    )
