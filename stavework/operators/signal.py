"""Measures over frames: every one a range join and a fold of additive parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.operators.intervals import best, point_in_span
from stavework.operators.ordered import exact_median, with_neighbour
from stavework.params import SIGNAL, SignalParams

KEYS = ["track_id"]
EPS = 1e-9


def rms(sumsq: Column, n: Column) -> Column:
    return F.sqrt(F.coalesce(F.try_divide(sumsq, n), F.lit(0.0)))


def stem_sums(frames: DataFrame, spans: DataFrame, stems: Sequence[str], bucket: float, by: Sequence[str]) -> DataFrame:
    """Per span and stem: energy, samples and power, one column set per stem, in one pass."""
    placed = point_in_span(frames, spans, KEYS, "t", "lo", "hi", bucket)
    parts = []
    for s in stems:
        is_s = F.col("stem") == s
        for c in ("sumsq", "n_samples", "low_power", "total_power"):
            parts.append(F.sum(F.when(is_s, F.col(c)).otherwise(0.0)).alias(f"{s}_{c}"))
    return placed.groupBy(*by).agg(*parts)


def trimmed(bars: DataFrame) -> DataFrame:
    """Bar windows [lo, hi): the end cut by half a slot, never before the start."""
    half = (F.col("end") - F.col("start")) / F.col("width") / 2
    return bars.withColumn("lo", F.col("start")).withColumn("hi", F.greatest(F.col("start"), F.col("end") - half))


def ratio(part: str, whole: str) -> Column:
    top = rms(F.col(f"{part}_sumsq"), F.col(f"{part}_n_samples"))
    return top / F.greatest(rms(F.col(f"{whole}_sumsq"), F.col(f"{whole}_n_samples")), F.lit(EPS))


def low_share(stem: str) -> Column:
    return F.col(f"{stem}_low_power") / (F.col(f"{stem}_total_power") + 1e-12)


def bleed_figures(source: str, bass: str, mix: str) -> dict[str, Column]:
    """The four figures of the bass-on-stem gate."""
    low = F.greatest(F.col(f"{mix}_low_power"), F.lit(1e-12))
    return {
        "low_mix_share_bass": F.col(f"{bass}_low_power") / low, "low_mix_share_source": F.col(f"{source}_low_power") / low,
        "low_own_share": low_share(source), "bass_stem_ratio": ratio(bass, mix),
    }


def bass_on_stem(bass_ratio: Column, own_low: Column, p: SignalParams = SIGNAL) -> Column:
    return (bass_ratio <= p.bass_stem_max) & (own_low >= p.own_low_share_min)


def bar_holds(energy: Column, low: Column, gated: Column, p: SignalParams = SIGNAL) -> Column:
    """Loud enough against the mix, with low-register power unless the member is gated."""
    return (energy >= p.rest_ratio_min) & (gated | (low >= p.rest_low_share_min))


def choose_source(first: Column, second: Column, names: tuple[str, str], p: SignalParams = SIGNAL) -> tuple[Column, Column]:
    """(source, ratio): the louder stem (the second on a tie), the mix when it is too quiet."""
    louder = F.greatest(first, second)
    return F.when(louder < p.source_min_ratio, "mix").when(first > second, names[0]).otherwise(names[1]), louder


def riff_features(chroma: Column) -> tuple[Column, Column]:
    """(normalised entropy, single pitch class) of one 12-bin power vector; a zero vector gives (1, false)."""
    total = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x) + 1e-12
    entropy = -F.aggregate(chroma, F.lit(0.0), lambda a, x: a + (x / total) * F.log(x / total + 1e-12)) / F.log(F.lit(12.0))
    peak = F.array_max(chroma)
    single = F.size(F.filter(chroma, lambda x: x >= 0.5 * peak)) == 1
    return F.when(peak <= 0, F.lit(1.0)).otherwise(entropy), F.when(peak <= 0, F.lit(False)).otherwise(single)


def name_notes(
    onsets: DataFrame, frames: DataFrame, bucket: float, skip_in: float, skip_out: float, p: SignalParams = SIGNAL, ids: Sequence[str] = ("onset_id",),
) -> DataFrame:
    """The half-even median pitch of each onset's frames; null under half voiced.

    `onsets` (track_id, ids, t, note_end), `frames` (track_id, ft, midi). A note's frames are few,
    and the median is over integer-cent pitches at most a note long.
    """
    windows = onsets.withColumn("lo", F.col("t") + skip_in).withColumn("hi", F.col("note_end") - skip_out)
    inside = point_in_span(frames, windows.select(*KEYS, *ids, "lo", "hi"), KEYS, "ft", "lo", "hi", bucket)
    notes = inside.groupBy(*KEYS, *ids).agg(
        F.count("*").alias("n"), F.count("midi").alias("voiced"), F.percentile("midi", 0.5).alias("median")
    )
    named = F.when(F.col("voiced") / F.col("n") >= p.note_voiced_min, F.bround("median", 0).cast("int"))
    return onsets.join(notes.select(*KEYS, *ids, named.alias("note")), [*KEYS, *ids], "left")


def note_shares(notes: DataFrame, by: Sequence[str], order: Sequence[str], chunk: float | None) -> DataFrame:
    """Pitch-change, on-root and named shares of a group's notes (null when nothing counts).

    `notes` carries `note` (midi) and `root` (pitch class), both nullable.
    """
    near = with_neighbour(notes, by, order, chunk, {"before": "note"})
    pair = F.col("note").isNotNull() & F.col("before").isNotNull()
    rooted = F.col("note").isNotNull() & F.col("root").isNotNull()
    return near.groupBy(*by).agg(
        F.try_divide(F.count_if(pair & (F.col("note") != F.col("before"))), F.count_if(pair)).alias("pitch_change"),
        F.try_divide(F.count_if(rooted & (F.pmod("note", F.lit(12)) == F.col("root"))), F.count_if(rooted)).alias("root_share"),
        (F.count("note") / F.count("*")).alias("named_share"),
    )


def stroke_decay(onsets: DataFrame, frames: DataFrame, bucket: float, chunk: float | None, p: SignalParams = SIGNAL) -> DataFrame:
    """dB lost one slot after each stroke's peak frame; null when the next stroke or silence cuts it.

    `onsets` (track_id, onset_id, t, slot_seconds), `frames` (track_id, ft, level). The peak is the
    loudest frame within half a slot (the first on a tie); the later frame is the first at or after
    one slot from the peak.
    """
    nxt = with_neighbour(onsets, KEYS, ["t", "onset_id"], chunk, {"next_t": "t"}, ahead=True)
    free = nxt.where(F.col("next_t").isNull() | (F.col("next_t") - F.col("t") >= p.ring_min_gap_slots * F.col("slot_seconds")))
    heard = free.withColumn("lo", F.col("t")).withColumn("hi", F.col("t") + F.col("slot_seconds") / 2)
    hits = point_in_span(frames, heard.select("track_id", "onset_id", "slot_seconds", "lo", "hi"), KEYS, "ft", "lo", "hi", bucket)
    peaks = best(hits.select("track_id", "onset_id", "slot_seconds", "ft", "level"), ["track_id", "onset_id"], [-F.col("level"), F.col("ft")])
    peaks = peaks.where(F.col("level") > EPS).withColumnsRenamed({"ft": "peak_t", "level": "peak"})
    later = peaks.withColumn("lo", F.col("peak_t") + F.col("slot_seconds")).withColumn("hi", F.col("peak_t") + 2 * F.col("slot_seconds"))
    after = point_in_span(frames, later, KEYS, "ft", "lo", "hi", bucket)
    first = best(after.select("track_id", "onset_id", "peak", "ft", "level"), ["track_id", "onset_id"], [F.col("ft"), F.col("level")])
    decay = F.greatest(F.lit(0.0), 20.0 * F.log10(F.col("peak") / F.greatest(F.col("level"), F.lit(EPS))))
    return onsets.join(first.select("track_id", "onset_id", decay.alias("decay_db")), ["track_id", "onset_id"], "left")


def section_rings(decays: DataFrame, keys: Sequence[str], p: SignalParams = SIGNAL) -> DataFrame:
    """A section rings when its median measured decay is under the floor; with none measured it rings."""
    med = exact_median(decays, keys, "decay_db", "median_db")
    return decays.select(*keys).distinct().join(med, list(keys), "left").select(
        *keys, F.coalesce(F.col("median_db") < p.ring_section_db, F.lit(True)).alias("rings"), "median_db"
    )
