"""Bars the recogniser left empty, filled with one of the track's own chords."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.functions import harte as H
from stavework.operators.harmony_spans import over_bars
from stavework.operators.ordered import exact_median
from stavework.params import HARMONY, HarmonyParams
from stavework.session import share

KEYS = ["track_id"]


def chorded_energy_reference(events: DataFrame, bars: DataFrame, energy: DataFrame, bucket: float) -> DataFrame:
    """Median energy of the bars holding a chord; null when none does or it is silent."""
    return reference_of(over_bars(events.where(~H.is_no_chord(F.col("label"))), bars, bucket), energy)


def reference_of(over: DataFrame, energy: DataFrame) -> DataFrame:
    """`chorded_energy_reference` from the events over each bar, found before."""
    hits = over.where(~H.is_no_chord(F.col("label"))).select("track_id", "bar").distinct()
    med = exact_median(energy.join(hits, ["track_id", "bar"], "left_semi"), KEYS, "energy", "reference")
    return med.select("track_id", F.when(F.col("reference") > 0, F.col("reference")).alias("reference"))


def split_at_bars(events: DataFrame, bars: DataFrame, bucket: float) -> DataFrame:
    """N events over several bars cut at the bars; `piece` numbers the pieces of one event."""
    n = events.where("label = 'N'")
    pieces = over_bars(n, bars.select("track_id", "bar", "start", "end"), bucket)
    size = Window.partitionBy("track_id", "event")
    pieces = pieces.withColumn("_c", F.count("*").over(size)).where("_c >= 2").select(
        "track_id", "event", F.col("bar").alias("piece"), F.greatest("start", "bar_start").alias("start"), F.least("end", "bar_end").alias("end"), "label",
    )
    whole = events.join(pieces.select("track_id", "event").distinct(), ["track_id", "event"], "left_anti").select(
        "track_id", "event", F.lit(-1).alias("piece"), "start", "end", "label")
    return whole.unionByName(pieces)


def song_chords(events: DataFrame) -> DataFrame:
    """One label per triad, the longest held (the first on a tie), with its template."""
    known = events.where(~H.is_no_chord(F.col("label")) & H.is_valid(F.col("label")))
    held = known.groupBy("track_id", "label").agg(F.sum(F.col("end") - F.col("start")).alias("held"))
    held, parts = H.with_parts(held)
    held = held.withColumn("triad", H.to_triad(F.col("label"), parts))
    return held.groupBy("track_id", "triad").agg(F.max_by("label", F.struct(F.round("held", 6), F.col("label"))).alias("label")).withColumn(
        "template", H.template(F.col("label")))


def best_matches(chroma: DataFrame, chords: DataFrame) -> DataFrame:
    """Per bar: the chord whose template correlates best with its chroma, and the runner-up.

    `chroma` (track_id, bar, chroma array of 12). A track has at most 60 triads, so the pairs per
    bar are few; flat chroma has no match.
    """
    def total(term: Callable[[int], Column]) -> Column:
        return reduce(lambda acc, i: acc + term(i), range(12), F.lit(0.0))

    c, t = (lambda i: F.get("chroma", F.lit(i))), (lambda i: F.get("template", F.lit(i)))
    # what one side alone gives is summed before the join
    left = chroma.where(F.array_max("chroma") > F.array_min("chroma")).select(
        "track_id", "bar", "chroma", total(c).alias("x"), total(lambda i: c(i) * c(i)).alias("xx"))
    pairs = left.join(chords.select("track_id", "label", "template", total(t).alias("y")), KEYS)
    pairs = pairs.select("track_id", "bar", "label", "x", "xx", "y", total(lambda i: c(i) * t(i)).alias("xy"))
    corr = (F.col("xy") - F.col("x") * F.col("y") / 12) / F.sqrt(
        (F.col("xx") - F.col("x") * F.col("x") / 12) * (F.col("y") - F.col("y") * F.col("y") / 12))
    w = Window.partitionBy("track_id", "bar").orderBy(F.round("corr", 9).desc(), F.col("label").desc())
    ranked = pairs.withColumn("corr", corr).withColumn("r", F.row_number().over(w)).where("r <= 2")
    return ranked.groupBy("track_id", "bar").agg(
        F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("r") == 1, F.col("corr"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("corr"))), F.lit(-1.0)).alias("runner_up"),
    )


def fill_silent_bars(
    events: DataFrame, bars: DataFrame, chroma: DataFrame, energy: DataFrame, bucket: float, p: HarmonyParams = HARMONY
) -> DataFrame:
    """Split N events at bars, then fill the all-N bars that are loud enough and clearly match.

    A filled bar replaces every event over it by one chord.
    """
    split = share(split_at_bars(events, bars, bucket))
    over = share(over_bars(split, bars.select("track_id", "bar", "start", "end"), bucket))
    quiet = over.groupBy("track_id", "bar", "bar_start", "bar_end").agg(F.bool_and(F.col("label") == "N").alias("all_n")).where("all_n")
    reference = reference_of(over, energy)
    loud = quiet.join(energy, ["track_id", "bar"]).join(reference, KEYS).where(F.col("energy") >= p.fill_min_energy * F.col("reference"))
    match = best_matches(chroma.join(loud.select("track_id", "bar"), ["track_id", "bar"], "left_semi"), song_chords(split))
    fills = share(loud.join(match, ["track_id", "bar"]).where(
        (F.round("best", 9) >= p.fill_min_match) & (F.round(F.col("best") - F.col("runner_up"), 9) >= p.fill_min_margin)
    ).select("track_id", "bar", F.col("bar_start").alias("start"), F.col("bar_end").alias("end"), "label", F.col("best").alias("confidence")))
    gone = over.join(fills.select("track_id", "bar"), ["track_id", "bar"], "left_semi").select("track_id", "event", "piece").distinct()
    kept = split.join(gone, ["track_id", "event", "piece"], "left_anti").select(
        "track_id", "start", "end", "label", F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("filled"))
    return kept.unionByName(fills.select("track_id", "start", "end", "label", "confidence", F.lit(True).alias("filled")))


def masked_mean(chroma: DataFrame, keep: str) -> DataFrame:
    """Mean chroma over the kept bars of a track, over all of them when none is kept; long form (pc, v)."""
    pcs = chroma.select("track_id", keep, F.posexplode("chroma").alias("pc", "x")).groupBy("track_id", "pc").agg(
        F.avg(F.when(F.col(keep), F.col("x"))).alias("kept"), F.avg("x").alias("every"))
    return pcs.select("track_id", "pc", F.coalesce("kept", "every").alias("v"))
