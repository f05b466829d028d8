"""The strum job by members: a planned section's spans vote alone, and print their section's pattern where they agree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.operators import members as M, votes as V
from stavework.params import VOTE, VoteParams
from stavework.plans import strums
from stavework.session import share_rows

SECTION = ["track_id", "section"]
MEMBER = ["track_id", "section", "member"]


def member_bars(bars: DataFrame, members: DataFrame, trailing: DataFrame) -> DataFrame:
    """Every bar of each member, `analysed` where the member's vote reads it.

    `bars` (track_id, bar, ...), `members` (track_id, section, member, start_bar, end_bar), `trailing` (track_id, drop): the
    silent bars at a track's end. They are left out of the members that end with the track; a track without a row drops none.
    """
    ends = members.groupBy("track_id").agg(F.max("end_bar").alias("track_end"))
    last = members.join(ends, "track_id").join(trailing.select("track_id", "drop"), "track_id", "left")
    until = F.col("end_bar") - F.when(F.col("end_bar") == F.col("track_end"), F.coalesce("drop", F.lit(0))).otherwise(0)
    spread = last.select(*MEMBER, until.alias("until"), F.explode(F.sequence(F.col("start_bar"), F.col("end_bar") - 1)).alias("bar"))
    return bars.join(spread, ["track_id", "bar"]).withColumn("analysed", F.col("bar") < F.col("until")).drop("until")


def longest_members(members: DataFrame) -> DataFrame:
    """(track_id, section, longest): each section's member with most bars, the earlier on a tie."""
    size = F.struct((F.col("end_bar") - F.col("start_bar")).alias("n"), (-F.col("start_bar")).alias("early"))
    return members.groupBy(*SECTION).agg(F.max_by("member", size).alias("longest"))


def vote_members(bars: DataFrame, width: int, p: VoteParams = VOTE, seed: Column | None = None, **moved: Column) -> DataFrame:
    """`strums.vote_sections` of every member over its analysed bars. A member with no holding bar is silent and has no row."""
    return strums.vote_sections(bars.where("analysed"), width, MEMBER, p, seed=seed, **moved)


def printed_votes(bars: DataFrame, members: DataFrame, voted: DataFrame, riffs: DataFrame, p: VoteParams = VOTE) -> DataFrame:
    """The vote each voiced member prints, `from_section` where it is that of its section's longest member.

    A member takes the section's vote when its own first bar agrees with it, read at the alignment (0 or 1 bars) that fits the
    member's held bars. Members in `riffs` (keys) and those of a section whose longest member is silent print their own.
    """
    votes = voted.select(*MEMBER, "unit", "slots_per_bar", "strike", "mute", "confidence", "chance_p", "uncertain")
    names = ["unit", "strike", "mute", "confidence", "chance_p", "uncertain"]
    longest = longest_members(members)
    header = votes.join(longest, SECTION).where("member = longest").select(*SECTION, "longest", *[F.col(c).alias(f"s_{c}") for c in names])
    both = share_rows(votes.join(header, SECTION, "left"))
    others = both.where("member <> longest")
    held = V.units_of_bars(bars.where("analysed and not rests").join(others.select(*MEMBER), MEMBER, "left_semi"), MEMBER)
    fits = M.section_offset(held, others.select(*MEMBER, F.col("s_unit").alias("unit"), F.col("s_strike").alias("v_strike"), F.col("s_mute").alias("v_mute")), MEMBER)
    rows = both.join(fits, MEMBER, "left").join(riffs.select(*MEMBER).distinct().withColumn("riff", F.lit(True)), MEMBER, "left")
    agreement = M.aligned_agreement(F.col("strike"), F.col("mute"), "s_strike", "s_mute", "s_unit", "slots_per_bar", F.col("offset"))
    takes = F.coalesce((F.round(agreement, 9) >= p.member_agree) & F.col("riff").isNull(), F.lit(False))
    shown = [F.when(F.col("takes"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in names]
    return rows.withColumn("takes", takes).select(*MEMBER, *shown, F.when(F.col("takes"), F.col("offset")).otherwise(0).alias("offset"), F.col("takes").alias("from_section"))


def member_records(bars: DataFrame, shown: DataFrame) -> DataFrame:
    """One printed record per bar of each member, trailing bars included.

    A bar prints the vote's bar at its distance from the member's first holding bar, moved by the alignment. A resting bar of a
    voiced member is empty and certain; every bar of a silent member is empty and uncertain.
    """
    first = bars.where("analysed and not rests").groupBy(*MEMBER).agg(F.min("bar").alias("first_held"))
    rows = bars.join(first, MEMBER, "left").join(shown.withColumnsRenamed({"strike": "v_strike", "mute": "v_mute"}), MEMBER, "left")
    strike, mute = M.vector_bar("v_strike", "v_mute", "unit", "width", F.col("bar") - F.col("first_held") + F.col("offset"))
    voiced, zero = F.col("unit").isNotNull(), F.lit(0).cast("long")
    prints = voiced & ~F.col("rests")
    return rows.select(
        *MEMBER, "bar", "width", "rests", F.when(prints, strike).otherwise(zero).alias("p_strike"), F.when(prints, mute).otherwise(zero).alias("p_mute"),
        F.when(prints, F.col("unit")).otherwise(1).alias("unit"), F.when(prints, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(prints, F.col("chance_p")).alias("chance_p"), F.when(voiced, prints & F.col("uncertain")).otherwise(True).alias("uncertain"),
        F.coalesce("from_section", F.lit(False)).alias("from_section"))


def section_patterns(members: DataFrame, voted: DataFrame) -> DataFrame:
    """Each planned section's pattern: its longest member's vote, or an empty uncertain row where that member is silent."""
    longest = longest_members(members).withColumnRenamed("longest", "member")
    rows = longest.join(voted, MEMBER, "left")
    return rows.select(
        *MEMBER, F.col("unit").isNull().alias("silent"), "unit", "candidate", F.coalesce("strike", F.lit(0)).alias("strike"), F.coalesce("mute", F.lit(0)).alias("mute"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "chance_p", F.coalesce("uncertain", F.lit(True)).alias("uncertain"))


def member_job(
    bars: DataFrame, members: DataFrame, trailing: DataFrame, riffs: DataFrame, width: int, p: VoteParams = VOTE, seed: Column | None = None, **moved: Column,
) -> tuple[DataFrame, DataFrame]:
    """(bar records, section patterns) of all tracks; `bars` (track_id, bar, width, strike, mute, rests)."""
    members = share_rows(members)
    spread = share_rows(member_bars(bars, members, trailing))
    voted = share_rows(vote_members(spread, width, p, seed, **moved))
    return member_records(spread, printed_votes(spread, members, voted, riffs, p)), section_patterns(members, voted)
