"""Chord labels in Harte syntax: `root[:quality][(degrees)][/bass]`, N and X for no chord."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
LETTER = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# The triad each known quality reduces to by its notes up to the fifth.
TRIAD = {
    "maj": "maj", "7": "maj", "maj7": "maj", "maj6": "maj", "maj9": "maj", "9": "maj", "b9": "maj", "#9": "maj",
    "11": "maj", "#11": "maj", "13": "maj", "b13": "maj", "maj13": "maj", "aug": "maj", "1": "maj",
    "min": "min", "min7": "min", "minmaj7": "min", "min6": "min", "min9": "min", "min11": "min", "min13": "min",
    "dim": "dim", "dim7": "dim", "hdim7": "dim", "sus4": "sus4", "sus2": "sus2",
}
TRIAD_NOTES = {"maj": [0, 4, 7], "min": [0, 3, 7], "dim": [0, 3, 6], "sus4": [0, 5, 7], "sus2": [0, 2, 7]}
GRAMMAR = r"^([A-G][#b]*)(?::([A-Za-z0-9#]*))?(?:\(([^)]*)\))?(?:/([#b]*\d+))?$"


class Parts(NamedTuple):
    """The parts of a label as columns."""

    root: Column
    quality: Column
    degrees: Column
    bass: Column


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def is_no_chord(label: Column) -> Column:
    return label.isin("N", "X")


def root(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, GRAMMAR, 1), F.lit(""))


def quality(label: Column) -> Column:
    """The quality as written; the major chord when none is (and none is spelled by degrees)."""
    written = F.regexp_extract(label, GRAMMAR, 2)
    return F.when(root(label).isNotNull(), F.when(written == "", "maj").otherwise(written))


def degrees(label: Column) -> Column:
    return F.regexp_extract(label, GRAMMAR, 3)


def bass(label: Column) -> Column:
    return F.when(root(label).isNotNull(), F.coalesce(F.nullif(F.regexp_extract(label, GRAMMAR, 4), F.lit("")), F.lit("1")))


def parts_of(label: Column) -> Parts:
    return Parts(root(label), quality(label), degrees(label), bass(label))


def with_parts(df: DataFrame) -> tuple[DataFrame, Parts]:
    """The parts of the column `label` read once a row, for functions that name them often, as columns to be dropped after."""
    label = F.col("label")
    df = df.withColumns({"_root": root(label), "_quality": F.regexp_extract(label, GRAMMAR, 2), "_degrees": degrees(label), "_bass": F.regexp_extract(label, GRAMMAR, 4)})
    named = F.col("_root").isNotNull()
    df = df.withColumns({
        "_quality": F.when(named, F.when(F.col("_quality") == "", "maj").otherwise(F.col("_quality"))),
        "_bass": F.when(named, F.when(F.col("_bass") == "", "1").otherwise(F.col("_bass"))),
    })
    return df, Parts(*[F.col(f"_{name}") for name in Parts._fields])


def is_valid(label: Column) -> Column:
    known = literal_map({q: True for q in [*TRIAD, "5"]})
    return is_no_chord(label) | (root(label).isNotNull() & F.coalesce(F.try_element_at(known, quality(label)), F.lit(False)))


def pitch_class(name: Column) -> Column:
    """Letter plus its accidentals, modulo 12."""
    letter = F.element_at(literal_map(LETTER), F.substring(name, 1, 1))
    sharps = F.length(name) - F.length(F.replace(name, F.lit("#"), F.lit("")))
    flats = F.length(name) - F.length(F.replace(name, F.lit("b"), F.lit("")))
    return F.pmod(letter + sharps - flats, F.lit(12)).cast("int")


def spelled(pc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SHARPS]), (F.pmod(pc, F.lit(12)) + 1).cast("int"))


def triad_quality(label: Column, parts: Parts | None = None) -> Column:
    return F.coalesce(F.try_element_at(literal_map(TRIAD), (parts or parts_of(label)).quality), F.lit("maj"))


def to_triad(label: Column, parts: Parts | None = None) -> Column:
    """No chord and power chords stay; any other quality on a valid root becomes its triad, an unreadable one the major triad."""
    lead = F.nullif(F.regexp_extract(label, r"^([A-G][#b]*)(?:[:/].*)?$", 1), F.lit(""))
    p = parts or parts_of(label)
    own = F.when(is_no_chord(label) | (p.quality == "5"), label).when(p.root.isNotNull(), F.concat(p.root, F.lit(":"), triad_quality(label, p)))
    return F.coalesce(own, F.concat(lead, F.lit(":maj")), label)


def plain_major_root(label: Column, parts: Parts | None = None) -> Column:
    p = parts or parts_of(label)
    plain = (p.quality == "maj") & (p.degrees == "") & (p.bass == "1")
    return F.when(~is_no_chord(label) & plain, p.root)


def transpose(label: Column, semitones: Column) -> Column:
    """The label moved by semitones, spelled with sharps; unmoved labels keep their spelling."""
    moved = spelled(pitch_class(root(label)) + semitones)
    rest = F.concat(
        F.lit(":"), quality(label), F.when(degrees(label) != "", F.concat(F.lit("("), degrees(label), F.lit(")"))).otherwise(""),
        F.when(bass(label) != "1", F.concat(F.lit("/"), bass(label))).otherwise(""),
    )
    plain = F.when(plain_major_root(label).isNotNull(), F.concat(moved, F.lit(":maj")))
    return F.when(is_no_chord(label) | (F.pmod(semitones, F.lit(12)) == 0), label).otherwise(F.coalesce(plain, F.concat(moved, rest)))


def template(label: Column) -> Column:
    """The triad's twelve 0/1 bins rotated to its root; null without a chord."""
    pc = pitch_class(root(label))
    notes = F.element_at(F.create_map(*[
        x for q, n in TRIAD_NOTES.items() for x in (F.lit(q), F.array(*[F.lit(i) for i in n]))
    ]), triad_quality(label))
    # an array of one row holds root and notes, so that they are read once and not for every bin
    once = F.array(F.struct(pc.alias("pc"), notes.alias("notes")))
    bins = F.transform(once, lambda x: F.transform(
        F.sequence(F.lit(0), F.lit(11)), lambda i: F.array_contains(x["notes"], F.pmod(i - x["pc"], F.lit(12))).cast("double")))[0]
    return F.when(~is_no_chord(label) & is_valid(label), bins)


def parsed(events: DataFrame) -> DataFrame:
    """Events with root pitch class, quality, triad and the plain-major flag; null where no chord."""
    read, p = with_parts(events)
    label = F.col("label")
    chord = ~is_no_chord(label) & p.root.isNotNull()
    return read.withColumns({
        "pc": F.when(chord, pitch_class(p.root)),
        "quality": F.when(chord, p.quality),
        "triad": to_triad(label, p),
        "triad_q": F.when(chord, F.when(p.quality == "5", "5").otherwise(triad_quality(label, p))),
        "plain": F.coalesce(plain_major_root(label, p).isNotNull(), F.lit(False)),
        "dur": F.col("end") - F.col("start"),
    }).drop(*[f"_{name}" for name in Parts._fields])
