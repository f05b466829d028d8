"""The user-level jobs: grid, harmony, riff, arrangement, and re-voting under other constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions import harte as H
from stavework.operators import arrange as A, fill as L, grid as G, harmony_spans as HS, key as K, riff as RF, sweep as W, truth as T
from stavework.operators.ordered import with_position
from stavework.params import SIGNAL, VOTE, VoteParams
from stavework.plans import strums
from stavework.session import share, share_rows

KEYS = ["track_id"]


def grid_job(beats: DataFrame, downbeats: DataFrame, durations: DataFrame, octave: DataFrame, numerator: int, chunk: float | None) -> DataFrame:
    """Bars of each track: clip filter, gap filling, octave repair where `octave` says half, modal phase.

    `beats` (track_id, event_id, t), `downbeats` (track_id, d_id, d), `octave` (track_id, octave).
    """
    kept, _ = G.end_of_clip(beats, durations)
    filled = share(G.fill_gaps(kept, chunk))
    placed = share(with_position(filled.select("track_id", "t"), KEYS, ["t"], chunk, "i"))
    down = share(G.nearest_beats(placed, downbeats))
    halved = octave.where("octave = 'half'").select("track_id")
    pace = G.tempo(placed.withColumn("event_id", F.col("i")), chunk)
    fast = placed.join(halved, KEYS, "left_semi").join(pace.select("track_id", "median_gap"), KEYS)
    # the target period differs per track, so times are scaled to it: one beat apart is 1
    scaled = fast.select("track_id", "i", (F.col("t") / (2 * F.col("median_gap"))).alias("t"))
    norm = G.normalise_octave(scaled, down.join(halved, KEYS, "left_semi"), 1.0, chunk)
    thinned = norm.join(placed.withColumnRenamed("t", "real_t"), ["track_id", "i"]).select("track_id", F.col("new_i").alias("i"), F.col("real_t").alias("t"), "is_downbeat")
    flags = down.withColumn("is_downbeat", F.lit(True))
    rest = placed.join(halved, KEYS, "left_anti").join(flags, ["track_id", "i"], "left").select("track_id", "i", "t", F.coalesce("is_downbeat", F.lit(False)).alias("is_downbeat"))
    final = share(rest.unionByName(thinned))
    medians = G.tempo(final.withColumn("event_id", F.col("i")), chunk)
    return G.build_bars(final.select("track_id", "i", "t"), G.modal_phase(final.where("is_downbeat"), numerator), durations, medians, numerator)


def harmony_job(
    spans: DataFrame, beats: DataFrame, bars: DataFrame, chroma: DataFrame, energy: DataFrame, corr: DataFrame, mix: DataFrame,
    bar_length: DataFrame, n_sections: DataFrame, section: Column, bucket: float,
) -> tuple[DataFrame, DataFrame]:
    """(chord events, keys): labels snapped to beats, silent bars filled, key decided, power chords named."""
    snapped = share(HS.snap_to_beats(spans, beats, bucket).select("track_id", "event", "start", "end", "label"))
    filled = L.fill_silent_bars(snapped, bars, chroma, energy, bucket)
    numbered = with_position(filled, KEYS, ["start", "end"], 7 * 86400.0, "event").withColumn("section", section)
    events = share(H.parsed(numbered))
    keys = share(K.decide_key(events, bar_length, n_sections, corr, mix))
    return K.power_chords(events, keys, corr), keys


def arrange_job(events: DataFrame, shapes: DataFrame, bar_seconds: float, easy: bool = False) -> DataFrame:
    """Each event's played label: tier, capo over the track, transposition, passing flag and name."""
    best = share(A.cheapest_shapes(shapes))
    chosen = share(A.simplify_for_tier(events, best, easy))
    played = chosen.select("track_id", "event", "start", "end", F.col("chosen").alias("label"))
    capo = A.choose_capo(A.capo_scores(played, best))
    passing = A.passing_labels(played, bar_seconds)
    j = played.join(capo, KEYS, "left").join(passing, ["track_id", "label"], "left")
    moved = H.transpose(F.col("label"), -F.coalesce("capo", F.lit(0)))
    return j.withColumn("played", moved).select(
        "track_id", "event", "label", "capo", "played", A.display_name(F.col("played")).alias("name"), F.coalesce("passing", F.lit(False)).alias("passing"))


def riff_job(
    bars: DataFrame, strokes: DataFrame, frames: DataFrame, flags: DataFrame, keys: Sequence[str], tuning: Sequence[int],
    bucket: float, skip_in: float, skip_out: float,
) -> DataFrame:
    """Per group: the riff of the pitches named at its strokes, why it may not print, and its tab as `slot:string:fret` text.

    `bars`, `strokes` and `frames` as `RF.note_bars` reads them; `flags` (keys, riff): the riff test of each group, false for one without a row.
    """
    note_bars = share_rows(RF.note_bars(bars, strokes, frames, bucket, skip_in, skip_out, keys))
    tested = share_rows(RF.named_share(note_bars, keys).join(flags, list(keys), "left").withColumn("riff", F.coalesce("riff", F.lit(False))))
    c = share_rows(RF.choose_riff(note_bars.drop("strokes"), keys).join(tested, list(keys)))
    reason = RF.riff_gate(F.col("agreement"), F.col("support"), F.col("named_share"), F.col("riff"), SIGNAL)
    notes = c.select(*keys, F.explode("notes").alias("note")).select(*keys, F.floor(F.col("note") / RF.SCALE).alias("slot"), F.pmod("note", F.lit(RF.SCALE)).cast("int").alias("midi"))
    shifts = notes.groupBy(*keys).agg(*RF.shift_counts(F.col("midi"))).select(*keys, RF.octave_shift().alias("shift"))
    at = notes.join(shifts, list(keys)).withColumn("at", RF.string_fret(RF.into_range(F.col("midi") + 12 * F.col("shift")), tuning))
    cell = F.concat_ws(":", F.col("slot"), F.col("at.string"), F.col("at.fret"))
    tab = at.groupBy(*keys, "shift").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", cell.alias("c")))), lambda x: x["c"]), " ").alias("tab"))
    out = c.withColumn("reason", reason).join(tab, list(keys), "left")
    return out.select(*keys, "unit", "candidate", "agreement", "support", "named_share", "reason", F.when(F.col("reason").isNull(), F.col("tab")).alias("tab"))


def revote_sweep(
    bars: DataFrame, truth: DataFrame, values: Sequence[int], constant: str, width: int, p: VoteParams = VOTE, seed: Column | None = None
) -> DataFrame:
    """False certain plus false grey per track and value of a vote constant, every section re-voted.

    The constant is a column of the groups, so all values are one job and one scoring.
    """
    spread = share_rows(W.over_values(bars, [float(v) for v in values]).withColumn("value", F.col("value").cast("int")))
    keys = ["value_index", "value", "track_id", "section"]
    moved = {constant: F.col("value")}
    voted = share_rows(strums.vote_sections(spread, width, keys, p, seed=seed, **moved))
    judged = W.over_values(truth, [float(v) for v in values]).withColumn("value", F.col("value").cast("int"))
    run = ["value_index", "value", "track_id"]
    scores = T.pattern_scores(judged, share_rows(strums.bar_records(spread, voted, keys)), run)
    out = T.false_certainty(scores, run).drop("value_index")
    return out.withColumn("errors", F.col("false_certain") + F.col("false_grey"))
