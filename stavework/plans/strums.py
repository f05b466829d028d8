"""The strum job: from quantised bars and their rest flags to each section's printed pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.rhythm import rotate_half
from stavework.operators import chance, members, votes as V
from stavework.operators.ordered import with_position
from stavework.params import VOTE, VoteParams
from stavework.session import share_rows


def vote_sections(
    bars: DataFrame, width: int, keys: Sequence[str] = V.SECTION, p: VoteParams = VOTE,
    min_support: Column | int | None = None, min_pairs: Column | int | None = None, min_vote_bars: Column | int | None = None,
    gated: str | None = None, seed: Column | None = None,
) -> DataFrame:
    """Every section voted over the bars that hold, judged on the held bars and on all of them.

    `bars` (keys, bar, width, strike, mute, rests). Constants may be columns of the keys, so one job
    re-votes a whole sweep. A section with no holding bar prints nothing and has no row.
    """
    bars = share_rows(bars)
    held = share_rows(V.units_of_bars(bars.where("not rests"), keys))
    every = share_rows(V.units_of_bars(bars, keys))
    sums = share_rows(V.agreement_sums(held, keys))
    phases = share_rows(V.unit_and_phase(V.medoid(sums, keys), V.best_pair(held, sums, keys), keys, p, min_pairs))
    chosen = share_rows(V.choose_from(held, phases, keys, p, min_support))
    votes = chosen.select(*keys, "unit", "slots_per_bar", F.col("strike").alias("v_strike"), F.col("mute").alias("v_mute"))
    own = members.member_figures(held, votes, keys)
    # over all bars the two-bar vote is read from the first holding bar's parity
    firsts = every.where("not rests").groupBy(*keys).agg(F.min("pos").alias("first_held"))
    turn = (F.col("unit") == 2) & (F.col("first_held") % 2 == 1)
    shifted = votes.join(firsts, list(keys)).select(
        *keys, "unit",
        *[F.when(turn, rotate_half(F.col(c), F.col("slots_per_bar"))).otherwise(F.col(c)).alias(c) for c in ("v_strike", "v_mute")],
    )
    whole = members.member_figures(every, shifted, keys)
    full = F.bit_count("v_strike") == F.col("unit") * F.col("slots_per_bar")
    flags = votes.select(*keys, full.alias("full_vote"))
    repeat = V.bar_repeat(held, keys)
    test = chance.structure_test(held, own.select(*keys, "density").join(flags, list(keys)), width, keys, p, seed, min_support)
    test_all = chance.structure_test(every, whole.select(*keys, "density").join(flags, list(keys)), width, keys, p, seed, min_support)
    out = chosen.join(own, list(keys)).join(repeat, list(keys))
    out = out.join(test.select(*keys, "chance_p", "structured"), list(keys))
    out = out.join(whole.select(*keys, F.col("confidence").alias("confidence_all")), list(keys))
    out = out.join(test_all.select(*keys, F.col("chance_p").alias("chance_p_all"), F.col("structured").alias("structured_all")), list(keys))
    if gated:
        out = out.join(bars.groupBy(*keys).agg(F.bool_or(gated).alias("gate")), list(keys))
    else:
        out = out.withColumn("gate", F.lit(False))
    n_voted = F.col("n_units") * F.col("unit")
    need = p.min_vote_bars if min_vote_bars is None else min_vote_bars
    floor = p.uncertain_below if width == 8 else p.uncertain_below_sixteenth
    return out.withColumn("n_voted", n_voted).withColumn("uncertain", certainty(floor, need, p))


def certainty(floor: float, need: Column | int, p: VoteParams = VOTE) -> Column:
    """True when any of the tests fails: confidence, explained, structure, on both readings."""
    return (
        (F.round("confidence", 9) < floor) | (F.round("explained", 9) < p.explained_below) | ~F.col("structured")
        | (F.round("confidence_all", 9) < floor) | ~F.col("structured_all") | (F.col("n_voted") < need) | F.col("gate")
    )


def bar_records(bars: DataFrame, voted: DataFrame, keys: Sequence[str] = V.SECTION) -> DataFrame:
    """One printed record per bar: its own section's vote at its place, empty where it rests.

    A two-bar vote prints by parity from the section's first holding bar.
    """
    first = bars.where("not rests").groupBy(*keys).agg(F.min("bar").alias("first_held"))
    votes = voted.select(*keys, "unit", F.col("strike").alias("v_strike"), F.col("mute").alias("v_mute"), "uncertain", "confidence")
    joined = bars.join(first, list(keys), "left").join(votes, list(keys), "left")
    s, m = members.vector_bar("v_strike", "v_mute", "unit", "width", F.col("bar") - F.col("first_held"))
    zero = F.lit(0).cast("long")
    prints = ~F.col("rests") & F.col("unit").isNotNull()
    return joined.select(
        *keys, "bar", "width", "strike", "mute", "rests",
        F.when(prints, s).otherwise(zero).alias("p_strike"), F.when(prints, m).otherwise(zero).alias("p_mute"),
        F.when(F.col("rests"), False).otherwise(F.coalesce("uncertain", F.lit(True))).alias("uncertain"),
        F.when(prints, F.col("confidence")).otherwise(0.0).alias("confidence"),
    )
