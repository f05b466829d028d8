"""Row-level decisions over figures measured elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stavework.params import SIGNAL, SignalParams


def is_riff(entropy: Column, single: Column, change: Column, gated: Column, p: SignalParams = SIGNAL) -> Column:
    """A single-note line: low entropy, one pitch class at a time, and pitches that change."""
    hit = (entropy <= p.riff_entropy_max) & (single >= p.riff_single_pc_min) & (change >= p.pitch_change_min)
    return F.coalesce(hit, F.lit(False)) & ~gated


def section_state(no_instrument: Column, gated: Column, has_tab: Column, riff: Column, uncertain: Column) -> Column:
    """The section header's state, by priority."""
    return (
        F.when(no_instrument, "no strummed instrument detected").when(gated, "guitar not separated here")
        .when(has_tab, "riff").when(riff, "riff heard, not transcribed").when(uncertain, "pattern uncertain").otherwise("")
    )
