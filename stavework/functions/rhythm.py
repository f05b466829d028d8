"""Strike vectors as two bit masks (struck slots, muted slots), so agreement is plain integer code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def shr(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def bit(mask: Column, slot: Column) -> Column:
    return shr(mask, slot).bitwiseAND(F.lit(1).cast("long"))


def one_at(slot: Column) -> Column:
    return shl(F.lit(1).cast("long"), slot)


def agreement(strike_a: Column, mute_a: Column, strike_b: Column, mute_b: Column) -> Column:
    """Agreement over slots struck in either vector, a strike against a mute earning half; 1 if none."""
    both = strike_a.bitwiseAND(strike_b)
    unlike = mute_a.bitwiseXOR(mute_b).bitwiseAND(both)
    union = F.bit_count(strike_a.bitwiseOR(strike_b))
    return F.when(union == 0, F.lit(1.0)).otherwise((F.bit_count(both) - 0.5 * F.bit_count(unlike)) / union)


def slot_list(width: Column) -> Column:
    return F.sequence(F.lit(0), (width - 1).cast("int"))


def cells(strike: Column, mute: Column, width: Column) -> Column:
    """The vector as text over S, x and -."""
    return F.array_join(
        F.transform(
            slot_list(width),
            lambda j: F.when(bit(mute, j) == 1, "x").when(bit(strike, j) == 1, "S").otherwise("-"),
        ),
        "",
    )


def printed(strike: Column, mute: Column, width: Column) -> Column:
    """The printed row over D, U, x and -: down on even slots, up on odd ones."""
    return F.array_join(
        F.transform(
            slot_list(width),
            lambda j: F.when(bit(mute, j) == 1, "x")
            .when(bit(strike, j) == 0, "-")
            .when(j % 2 == 0, "D").otherwise("U"),
        ),
        "",
    )


def mask_where(text: Column, letters: str) -> Column:
    """The mask of a text row's positions holding any of `letters`."""
    return F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.length(text) - 1),
            lambda j: F.when(F.instr(F.lit(letters), F.substring(text, j + 1, F.lit(1))) > 0, one_at(j)).otherwise(
                F.lit(0).cast("long")
            ),
        ),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(x),
    )


def rotate_half(mask: Column, half: Column) -> Column:
    """A two-bar mask with its bars swapped."""
    low = mask.bitwiseAND(one_at(half) - 1)
    return shr(mask, half).bitwiseOR(shl(low, half))


def half_of(mask: Column, which: Column, half: Column) -> Column:
    """One bar of a two-bar mask."""
    return shr(mask, which * half).bitwiseAND(one_at(half) - 1)


def swap_distance(strike_a: Column, strike_b: Column, width: Column) -> Column:
    """Sum of position differences between sorted strikes; the width when the counts differ.

    Sorted matching on a line costs, at each slot edge, how far the two running counts are apart.
    """
    apart = F.aggregate(
        slot_list(width),
        F.struct(F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("total")),
        lambda acc, j: F.struct(
            (acc["gap"] + bit(strike_a, j) - bit(strike_b, j)).alias("gap"),
            (acc["total"] + F.abs(acc["gap"] + bit(strike_a, j) - bit(strike_b, j))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(F.bit_count(strike_a) != F.bit_count(strike_b), width.cast("long")).otherwise(apart)
