"""A member's bars against a one- or two-bar vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.rhythm import agreement, half_of
from stavework.operators.votes import SECTION


def vector_bar(strike: str, mute: str, unit: str, width: str, offset: Column) -> tuple[Column, Column]:
    """The bar of a `unit`-bar vote that the bar `offset` bars in plays against."""
    which = F.pmod(offset, F.col(unit))
    return half_of(F.col(strike), which, F.col(width)), half_of(F.col(mute), which, F.col(width))


def member_figures(units: DataFrame, votes: DataFrame, keys: Sequence[str] = SECTION, offset: str = "pos") -> DataFrame:
    """Confidence and explained share of bars against the matching bar of their vote.

    `votes` (keys, unit, v_strike, v_mute); the bars carry `width` slots.
    """
    joined = units.join(votes.select(*keys, "unit", "v_strike", "v_mute"), list(keys))
    s, m = vector_bar("v_strike", "v_mute", "unit", "width", F.col(offset))
    joined = joined.withColumn("b_strike", s).withColumn("b_mute", m)
    j = agreement(F.col("strike"), F.col("mute"), F.col("b_strike"), F.col("b_mute"))
    hit = F.bit_count(F.col("strike").bitwiseAND(F.col("b_strike")))
    return joined.groupBy(*keys).agg(
        F.avg(j).alias("confidence"),
        F.coalesce(F.try_divide(F.sum(hit), F.sum(F.bit_count("strike"))), F.lit(0.0)).alias("explained"),
        F.try_divide(F.sum(F.bit_count("strike")), F.sum("width")).alias("density"),
    )


def section_offset(units: DataFrame, votes: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """0 or 1: the alignment of a two-bar vote that fits the member's bars better (0 on a tie)."""
    joined = units.join(votes.select(*keys, "unit", "v_strike", "v_mute"), list(keys))
    fits = []
    for shift in (0, 1):
        s, m = vector_bar("v_strike", "v_mute", "unit", "width", F.col("pos") + shift)
        fits.append(F.avg(agreement(F.col("strike"), F.col("mute"), s, m)).alias(f"fit{shift}"))
    return joined.groupBy(*keys, "unit").agg(*fits).select(
        *keys, F.when((F.col("unit") == 2) & (F.round("fit1", 9) > F.round("fit0", 9)), 1).otherwise(0).alias("offset")
    )


def aligned_agreement(own_strike: Column, own_mute: Column, strike: str, mute: str, unit: str, width: str, offset: Column) -> Column:
    """Agreement of a member vote's first bar with the section vote's bar at the offset."""
    zero = F.lit(0)
    s, m = vector_bar(strike, mute, unit, width, offset)
    return agreement(half_of(own_strike, zero, F.col(width)), half_of(own_mute, zero, F.col(width)), s, m)
