"""Key names and how two keys relate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stavework.functions.harte import spelled

# The Krumhansl-Kessler profiles and the diatonic triads of a major key.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
DIATONIC = {0: "maj", 2: "min", 4: "min", 5: "maj", 7: "maj", 9: "min", 11: "dim"}


def signature(pc: Column, mode: Column) -> Column:
    """A key signature's place on the circle of fifths, 0 to 11; a minor key has that of the major key three semitones up."""
    return F.pmod((pc + F.when(mode == "minor", 3).otherwise(0)) * 7, F.lit(12))


def relation(pc_a: Column, mode_a: Column, pc_b: Column, mode_b: Column) -> Column:
    """same, fifth (either way), relative, parallel or other, told from signatures and tonics."""
    apart = F.pmod(signature(pc_b, mode_b) - signature(pc_a, mode_a), F.lit(12))
    named = {(True, 0): "same", (True, 1): "fifth", (True, 11): "fifth", (False, 0): "relative"}
    out = F.when((mode_a != mode_b) & (F.pmod(pc_a - pc_b, F.lit(12)) == 0), "parallel")
    for (alike, distance), name in named.items():
        out = out.when(((mode_a == mode_b) == F.lit(alike)) & (apart == distance), name)
    return out.otherwise("other")


def weighted_score(ref_pc: Column, ref_mode: Column, est_pc: Column, est_mode: Column) -> Column:
    """1 same, .5 a fifth above the reference, .3 relative, .2 parallel, else 0."""
    kind = relation(ref_pc, ref_mode, est_pc, est_mode)
    above = F.pmod(signature(est_pc, est_mode) - signature(ref_pc, ref_mode), F.lit(12)) == 1
    worth = F.create_map(*[F.lit(x) for pair in (("same", 1.0), ("relative", 0.3), ("parallel", 0.2)) for x in pair])
    return F.when((kind == "fifth") & above, 0.5).otherwise(F.coalesce(F.try_element_at(worth, kind), F.lit(0.0)))


def relative_pc(pc: Column, mode: Column) -> Column:
    return F.pmod(pc + F.when(mode == "major", -3).otherwise(3), F.lit(12))


def other_mode(mode: Column) -> Column:
    return F.when(mode == "major", "minor").otherwise("major")


def key_text(pc: Column, mode: Column) -> Column:
    return F.concat(spelled(pc), F.lit(" "), mode)
