"""Riff lines: bars of (slot, pitch) notes reduced to one- or two-bar riffs, and the tab they map to.

A note bar is a sorted array of `slot * 1000 + pitch`, so equal notes are equal numbers and the
agreement of two bars is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.operators import signal as G, votes as V
from stavework.params import SIGNAL, VOTE, SignalParams, VoteParams
from stavework.session import share_rows

SECTION = V.SECTION
SCALE = 1000


def _slots(notes: Column) -> Column:
    return F.transform(notes, lambda x: F.floor(x / SCALE))


def note_bars(
    bars: DataFrame, strokes: DataFrame, frames: DataFrame, bucket: float, skip_in: float, skip_out: float, keys: Sequence[str] = SECTION, p: SignalParams = SIGNAL,
) -> DataFrame:
    """Every bar with the pitches named at its strokes as `notes`, and the number of its `strokes`.

    `bars` (keys, bar, start, end, width), `strokes` (track_id, bar, slot): one per struck or muted slot, none where a bar
    rests; `frames` (track_id, ft, midi): the pitch track, null where unvoiced. A note lasts from its slot to the next
    stroke of the bar or the bar's end; a stroke whose frames name no pitch has no note.
    """
    bar = ["track_id", "bar"]
    placed = strokes.select(*bar, "slot").join(bars.select(*bar, "start", "end", "width").hint("merge"), bar)
    placed = placed.withColumn("t", F.col("start") + F.col("slot") * ((F.col("end") - F.col("start")) / F.col("width")))
    following = F.lead("t").over(Window.partitionBy(*bar).orderBy("slot"))
    timed = placed.select(*bar, "slot", "t", F.least(F.coalesce(following, "end"), "end").alias("note_end"))
    named = G.name_notes(timed, frames, bucket, skip_in, skip_out, p, ["bar", "slot"])
    note = F.col("slot") * SCALE + F.col("note")  # one per slot, null where unnamed
    heard = named.groupBy(*bar).agg(F.array_sort(F.collect_list(note.cast("long"))).alias("notes"), F.count("*").alias("strokes"))
    return bars.join(heard.hint("merge"), bar, "left").select(
        *keys, "bar", "width", F.coalesce("notes", F.array().cast("array<bigint>")).alias("notes"), F.coalesce("strokes", F.lit(0)).alias("strokes"))


def named_share(note_bars: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """The share of a group's strokes whose pitch was named; 0 without strokes."""
    return note_bars.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.size("notes")), F.sum("strokes")), F.lit(0.0)).alias("named_share"))


def note_agreement(left: str, right: str) -> Column:
    """Over slots where either has a note: 1 for the same pitch, else 0; 1 when neither has any."""
    a, b = F.col(f"{left}notes"), F.col(f"{right}notes")
    union = F.size(F.array_union(_slots(a), _slots(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def note_pairs(units: DataFrame, phases: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Consecutive note bars from the phase as two-bar units."""
    placed = units.join(phases.select(*keys, "phase"), list(keys)).where("pos >= phase")
    half = F.pmod(F.col("pos") - F.col("phase"), F.lit(2))
    moved = placed.withColumn("moved", F.transform("notes", lambda x: x + half * F.col("width") * SCALE))
    paired = moved.groupBy(*keys, "width", F.floor((F.col("pos") - F.col("phase")) / 2).alias("pos")).agg(
        F.array_sort(F.flatten(F.collect_list("moved"))).alias("notes"), F.count("*").alias("_c")  # two bars at most
    )
    return paired.where("_c = 2").select(*keys, "pos", (F.col("width") * 2).alias("width"), "notes")


def pitch_counts(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Per group, slot and pitch: how many units hold it."""
    return units.select(*keys, F.explode("notes").alias("note")).groupBy(*keys, "note").agg(F.count("*").alias("c"))


def _majority(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per slot the commonest pitch (lowest on a tie) where at least half of the `n` units have a note."""
    slots = counts.where("c > 0").groupBy(*by, "n", F.floor(F.col("note") / SCALE).alias("slot")).agg(
        F.sum("c").alias("total"), F.max(F.struct("c", (-F.col("note")).alias("neg"))).alias("top")
    )
    return slots.where(F.col("total") * 2 >= F.col("n")).groupBy(*by).agg(
        F.array_sort(F.collect_list((-F.col("top.neg")).cast("long"))).alias("v_notes")  # one note per slot
    )


def riff_majority(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    sizes = units.groupBy(*keys).agg(F.count("*").alias("n"))
    found = _majority(pitch_counts(units, keys).join(sizes, list(keys)), keys)
    empty = F.array().cast("array<bigint>")
    return sizes.join(found, list(keys), "left").select(*keys, "n", F.coalesce("v_notes", empty).alias("v_notes"))


def riff_loo(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Mean agreement of each unit with the majority of the others, from counts less its own."""
    sizes = units.groupBy(*keys).agg(F.count("*").alias("n"))
    pats = units.groupBy(*keys, "notes").agg(F.count("*").alias("m"))
    counts = pitch_counts(units, keys).join(sizes, list(keys))
    lone = F.col("n") == 1
    own = F.array_contains("notes", F.col("note")).cast("int")
    rest = pats.join(counts, list(keys)).withColumn("c", F.col("c") - F.when(lone, 0).otherwise(own)).withColumn(
        "n", F.when(lone, F.col("n")).otherwise(F.col("n") - 1))
    votes = _majority(rest, [*keys, "notes", "m"])
    empty = F.array().cast("array<bigint>")
    joined = pats.join(votes, [*keys, "notes", "m"], "left").withColumn("v_notes", F.coalesce("v_notes", empty))
    return joined.groupBy(*keys).agg((F.sum(note_agreement("", "v_") * F.col("m")) / F.sum("m")).alias("score_majority"))


def choose_riff(note_bars: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE) -> DataFrame:
    """The majority riff, or the medoid bar when it represents the bars clearly better.

    `note_bars` (keys, bar, width, notes). Unit and phase come from the bars' rhythm alone.
    """
    units = share_rows(V.units_of_bars(note_bars, keys))
    shape = units.withColumn("strike", F.aggregate(_slots(F.col("notes")), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(V.one_at(x)))
                             ).withColumn("mute", F.lit(0).cast("long"))
    sums = share_rows(V.agreement_sums(shape, keys))
    phases = share_rows(V.unit_and_phase(V.medoid(sums, keys), V.best_pair(shape, sums, keys), keys, p))
    one = units.join(phases.where("unit = 1").select(*keys), list(keys), "left_semi").select(*keys, "pos", "width", "notes")
    voted = share_rows(one.unionByName(note_pairs(units, phases.where("unit = 2"), keys)))
    med = V.medoid(V.agreement_sums(voted, keys, ["notes"], note_agreement), keys, ["notes"])
    out = riff_majority(voted, keys).join(riff_loo(voted, keys), list(keys)).join(
        med.select(*keys, "score_medoid", "medoid_notes"), list(keys)).join(phases.select(*keys, "unit", "phase", F.col("width").alias("slots")), list(keys))
    better = (F.round(F.col("score_medoid") - F.col("score_majority"), 9) >= p.hybrid_delta) & (F.size("medoid_notes") >= p.medoid_min_strokes)
    out = out.withColumn("candidate", F.when(better, "medoid").otherwise("majority")).withColumn(
        "raw", F.when(better, F.col("medoid_notes")).otherwise(F.col("v_notes")))
    counts = pitch_counts(voted, keys)
    shares = out.select(*keys, "n", F.explode("raw").alias("note")).join(counts, [*keys, "note"], "left")
    support = shares.groupBy(*keys).agg(F.avg(F.coalesce("c", F.lit(0)) / F.col("n")).alias("support"))
    turned = F.array_sort(F.transform("raw", lambda x: F.pmod(x + F.col("slots") * SCALE, F.col("slots") * 2 * SCALE)))
    return out.join(support, list(keys), "left").select(
        *keys, "unit", "phase", "n", "candidate",
        F.when(F.col("candidate") == "medoid", F.col("score_medoid")).otherwise(F.col("score_majority")).alias("agreement"),
        F.coalesce("support", F.lit(0.0)).alias("support"),
        F.when((F.col("unit") == 2) & (F.col("phase") == 1), turned).otherwise(F.col("raw")).cast("array<bigint>").alias("notes"),
    )


def riff_gate(agreement: Column, support: Column, named: Column, flag: Column, p: SignalParams = SIGNAL) -> Column:
    """The first failing reason, null when the riff may print; no pitch heard at all names that."""
    def under(text: str, value: Column, floor: float) -> Column:
        return F.format_string(f"{text} %.2f < {floor:.2f}", value)
    return (
        F.when(named == 0, under("named", named, p.riff_named_min))
        .when(agreement < p.riff_agree_min, under("agreement", agreement, p.riff_agree_min))
        .when(support < p.riff_support_min, under("support", support, p.riff_support_min))
        .when(named < p.riff_named_min, under("named", named, p.riff_named_min))
        .when(~flag, "not a riff")
    )


# The playable range and the open strings of the tuning.
RANGE_LO, RANGE_HI = 60, 81
TUNING = ["G4", "C4", "E4", "A4"]
SEMITONE = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def pitch_midi(name: Column) -> Column:
    """A pitch name such as F#3 as its MIDI number; null when it is not one."""
    grammar = r"^\s*([A-Ga-g])([#b]?)(-?\d+)\s*$"
    letter = F.upper(F.regexp_extract(name, grammar, 1))
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEMITONE.items() for x in kv]), letter)
    shift = F.when(F.regexp_extract(name, grammar, 2) == "#", 1).when(F.regexp_extract(name, grammar, 2) == "b", -1).otherwise(0)
    octave = F.regexp_extract(name, grammar, 3).try_cast("int")
    return (12 * (octave + 1) + base + shift).cast("int")


def shift_counts(midi: Column) -> list[Column]:
    """Aggregates counting the pitches each whole-octave shift brings into range."""
    return [F.count_if((midi + 12 * s).between(RANGE_LO, RANGE_HI)).alias(f"in_{s + 2}") for s in range(-2, 3)]


def octave_shift() -> Column:
    """From `shift_counts`: the shift with most pitches in range, the smaller, then the positive."""
    ranked = F.array(*[F.struct((-F.col(f"in_{s + 2}")).alias("miss"), F.lit(abs(s)).alias("size"), F.lit(-s).alias("neg")) for s in range(-2, 3)])
    return (-F.array_min(ranked)["neg"]).cast("int")


def into_range(midi: Column) -> Column:
    """Moved by whole octaves until inside the range."""
    up, down = F.ceil((RANGE_LO - midi) / 12.0), F.ceil((midi - RANGE_HI) / 12.0)
    return (midi + 12 * F.when(midi < RANGE_LO, up).when(midi > RANGE_HI, -down).otherwise(0)).cast("int")


def string_fret(midi: Column, tuning: Sequence[int]) -> Column:
    """struct(fret, string): the lowest fret, the lower string on a tie."""
    return F.array_min(F.filter(
        F.array(*[F.struct((midi - o).cast("int").alias("fret"), F.lit(i).alias("string")) for i, o in enumerate(tuning)]),
        lambda x: x["fret"] >= 0,
    ))
