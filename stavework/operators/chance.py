"""Is a section more repetitive than its own shuffled bars? A permutation test.

Each copy permutes every bar's cells on their own. The order comes from integer arithmetic on (seed,
copy, bar), so any engine draws the same copies. Only strikes and mutes per bar matter, so a
copy puts the bar's mutes, then its strikes, on the first slots of that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from stavework.functions.rhythm import agreement, bit
from stavework.operators.votes import (
    SECTION, density_floor, section_vote, strike_histogram, vote_figures,
)
from stavework.params import VOTE, VoteParams
from stavework.session import share_rows

LOCAL_BARS = 4096  # groups up to this many bars draw their copies in one task
CELLS = 65536  # (bar, copy) pairs drawn in one call


MASK31 = 0x7FFFFFFF
MIX = 0x45D9F3B


def mix31(x: Column) -> Column:
    """A 31-bit integer scrambled by shifts, an xor and a product that stay inside a long."""
    x = x.bitwiseAND(F.lit(MASK31))
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * MIX).bitwiseAND(F.lit(MASK31))
    return x.bitwiseXOR(F.shiftright(x, 15))


def _order(keys: list[Column]) -> list[Column]:
    """The rank of each key among the others, the earlier slot first on a tie."""
    return [
        sum(((a <= b) if i < j else (a < b)).cast("int") for i, a in enumerate(keys) if i != j) + F.lit(0)
        for j, b in enumerate(keys)
    ]


def _bits(tests: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for j, test in enumerate(tests):
        out = out.bitwiseOR(F.when(test, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _copies(bars: DataFrame, width: int) -> DataFrame:
    """One copy of each (bar, rep) row: `strike` and `mute` on the first slots of a drawn order.

    All integer arithmetic on columns, so it stays in generated code.
    """
    rows = bars.withColumn("_base", mix31(F.col("seed") + F.col("rep") * 7919))
    rows = rows.withColumn("_base", mix31(F.col("_base") + F.col("pos") * 104729))
    rows = rows.withColumn("_base", mix31(F.col("_base")))
    rows = rows.select("*", *[mix31(F.col("_base") + j * 32452843).alias(f"_d{j}") for j in range(width)])
    ranks = _order([F.col(f"_d{j}") for j in range(width)])
    rows = rows.select(*bars.columns, *[r.alias(f"_r{j}") for j, r in enumerate(ranks)])
    strikes, mutes = F.bit_count("strike"), F.bit_count("mute")
    return rows.select(
        *[c for c in bars.columns if c not in ("strike", "mute")],
        _bits([F.col(f"_r{j}") < strikes for j in range(width)]).alias("strike"),
        _bits([F.col(f"_r{j}") < mutes for j in range(width)]).alias("mute"),
    )


def _vote(rows: DataFrame, width: int, p: VoteParams) -> DataFrame:
    """The topped vote of each row's slot totals k0.., m0.. as `v_strike`, `v_mute`."""
    kept = [(F.col(f"k{j}") * p.strike_share_inverse > F.col("n")) & (F.col(f"k{j}") >= F.col("support")) for j in range(width)]
    rows = rows.select("*", *[c.alias(f"_f{j}") for j, c in enumerate(kept)])
    missing = F.col("floor") - sum((F.col(f"_f{j}").cast("int") for j in range(width)), F.lit(0))
    rows = rows.withColumn("_missing", missing)
    struck = []
    for j in range(width):
        before = sum(
            ((~F.col(f"_f{i}")) & (F.col(f"k{i}") >= F.col(f"k{j}") if i < j else F.col(f"k{i}") > F.col(f"k{j}"))).cast("int")
            for i in range(width) if i != j
        )
        struck.append(F.col(f"_f{j}") | (before < F.col("_missing")))
    muted = [F.col(f"_f{j}") & (F.col(f"m{j}") * 2 > F.col(f"k{j}")) for j in range(width)]
    return rows.withColumn("v_strike", _bits(struck)).withColumn("v_mute", _bits(muted))


def _np_mix(x: np.ndarray) -> np.ndarray:
    """`mix31` over unsigned 32-bit integers: products may wrap, only 31 bits are kept."""
    x = x & np.uint32(MASK31)
    x = ((x ^ (x >> np.uint32(16))) * np.uint32(MIX)) & np.uint32(MASK31)
    return x ^ (x >> np.uint32(15))


def _drawn(base: np.ndarray, counts: Sequence[np.ndarray], width: int) -> list[list[np.ndarray]]:
    """For each array of counts, per slot whether it is among that many first slots of the drawn order."""
    keys = [_np_mix(base + np.uint32(j * 32452843 & 0xFFFFFFFF)) for j in range(width)]
    ranks = [np.full(base.shape, width - 1 - j, np.uint8) for j in range(width)]
    for j in range(width):
        for i in range(j):
            first = (keys[i] <= keys[j]).view(np.uint8)  # the earlier slot first on a tie
            ranks[j] += first
            ranks[i] -= first
    return [[rank < c for rank in ranks] for c in counts]


def _packed(tests: Sequence[np.ndarray], kind: type) -> np.ndarray:
    out = tests[0].astype(kind)
    for j, test in enumerate(tests[1:], 1):
        out |= test.astype(kind) << kind(j)
    return out


def _at_least(
    pos: np.ndarray, strikes: np.ndarray, mutes: np.ndarray, seed: np.ndarray, floor: np.ndarray, support: np.ndarray,
    observed: np.ndarray, width: int, reps: np.ndarray, inverse: int,
) -> np.ndarray:
    """How many of the copies `reps` agree with their own vote at least as their group does, for groups of equal size.

    The same draw as `_copies`, over arrays of (group, bar, copy). Agreements are whole multiples of one fraction, so
    their sums are exact.
    """
    n, kind = pos.shape[1], np.uint8 if width <= 8 else np.uint16
    line = _np_mix(seed[:, None] + reps * np.uint32(7919))[:, None, :]
    base = _np_mix(_np_mix(line + pos[:, :, None] * np.uint32(104729)))
    strike, mute = _drawn(base, (strikes[:, :, None], mutes[:, :, None]), width)
    small = np.uint8 if n <= 255 else np.uint32
    total = [np.add.reduce(x.view(np.uint8), axis=1, dtype=small).astype(np.int32) for x in strike]
    muted = [np.add.reduce(x.view(np.uint8), axis=1, dtype=small).astype(np.int32) for x in mute]
    kept = [(t * inverse > n) & (t >= support[:, None]) for t in total]
    missing = floor[:, None] - sum(x.astype(np.int32) for x in kept)
    struck = []
    for j in range(width):
        before = np.zeros(missing.shape, np.int32)
        for i in range(width):
            if i != j:
                before += ~kept[i] & ((total[i] >= total[j]) if i < j else (total[i] > total[j]))
        struck.append(kept[j] | (before < missing))
    dull = [x & (m * 2 > t) for x, m, t in zip(kept, muted, total, strict=True)]
    own, vote = _packed(strike, kind), _packed(struck, kind)[:, None, :]
    both = own & vote
    odd = (_packed(mute, kind) ^ _packed(dull, kind)[:, None, :]) & both
    twice = np.bitwise_count(both) * kind(2) - np.bitwise_count(odd)
    unit = math.lcm(*range(1, width + 1))
    worth = np.array([[(2 * unit if u == 0 else t * unit // u) for t in range(2 * width + 1)] for u in range(width + 1)])
    worth = worth.ravel().astype(np.int32 if width <= 8 else np.int64)
    sums = worth[np.bitwise_count(own | vote).astype(np.uint16) * np.uint16(2 * width + 1) + twice].sum(axis=1, dtype=worth.dtype)
    return (np.round(sums / (2 * unit * n), 9) >= observed[:, None]).sum(axis=1)


def _counted(rows: pa.Table, starts: np.ndarray, names: Sequence[str], width: int, shuffles: int, inverse: int) -> pa.RecordBatch:
    """The counts of whole groups that begin at `starts`; groups of one size are counted together."""
    col = {c: rows[c].to_numpy() for c in ("pos", "strike", "mute", "seed", "floor", "support", "observed")}
    strikes, mutes = (np.bitwise_count(col[c].astype(np.uint64)).astype(np.uint8) for c in ("strike", "mute"))
    sizes = np.diff(starts, append=len(strikes))
    out = np.zeros(len(starts), np.int64)
    for n in np.unique(sizes):
        groups, step = np.flatnonzero(sizes == n), max(1, min(shuffles, CELLS // n))
        some = max(1, CELLS // (n * step))
        for lo in range(0, len(groups), some):
            g = groups[lo:lo + some]
            first, at = starts[g], starts[g][:, None] + np.arange(n)
            for rep in range(0, shuffles, step):
                reps = np.arange(rep, min(rep + step, shuffles), dtype=np.uint32)
                out[g] += _at_least(
                    col["pos"][at].astype(np.uint32), strikes[at], mutes[at], col["seed"][first].astype(np.uint32), col["floor"][first],
                    col["support"][first], col["observed"][first], width, reps, inverse)
    keys = rows.select(list(names)).take(pa.array(starts))
    return keys.append_column("at_least", pa.array(out)).combine_chunks().to_batches()[0]


def _starts(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """The row numbers at which a new group begins."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for name in names:
        c = rows[name].combine_chunks()
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _local_count(ready: DataFrame, keys: Sequence[str], width: int, p: VoteParams) -> DataFrame:
    """Groups of few bars: rows come sorted by group, and a batch's whole groups draw their copies in one call."""
    shuffles, inverse, names = p.chance_shuffles, p.strike_share_inverse, list(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the group a batch may have cut
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts(rows, names)
            held = rows.slice(starts[-1])
            if len(starts) > 1:
                yield _counted(rows.slice(0, starts[-1]), starts[:-1], names, width, shuffles, inverse)
        if held is not None:
            yield _counted(held, np.zeros(1, np.int64), names, width, shuffles, inverse)

    schema = StructType([*[ready.schema[k] for k in keys], StructField("at_least", LongType())])
    # little data, much work: a set number of partitions, which run-time coalescing leaves alone
    spread = ready.repartition(ready.sparkSession.sparkContext.defaultParallelism * 4, *keys)
    return spread.sortWithinPartitions(*keys, "pos").mapInArrow(count, schema)


def _folded_count(ready: DataFrame, keys: Sequence[str], width: int, p: VoteParams) -> DataFrame:
    """Groups of many bars: equal copies fold map-side, at most 3^width rows per (group, copy)."""
    by = [*keys, "rep"]
    slot = [(bit(F.col("strike"), F.lit(j)), bit(F.col("mute"), F.lit(j))) for j in range(width)]
    reps = F.sequence(F.lit(0), F.lit(p.chance_shuffles - 1))
    copies = _copies(ready.withColumn("rep", F.explode(reps)), width).groupBy(*by, "floor", "support", "observed", "strike", "mute").agg(
        F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    rows = copies.select(
        *copies.columns, F.sum("c").over(w).alias("n"),
        *[F.sum(s * F.col("c")).over(w).alias(f"k{j}") for j, (s, _) in enumerate(slot)],
        *[F.sum(x * F.col("c")).over(w).alias(f"m{j}") for j, (_, x) in enumerate(slot)],
    )
    j = agreement(F.col("strike"), F.col("mute"), F.col("v_strike"), F.col("v_mute"))
    scores = _vote(rows, width, p).groupBy(*by, "observed").agg((F.sum(j * F.col("c")) / F.sum("c")).alias("confidence"))
    return scores.groupBy(*keys).agg(F.count_if(F.round("confidence", 9) >= F.col("observed")).alias("at_least"))


def chance_p(
    units: DataFrame, width: int, keys: Sequence[str] = SECTION, p: VoteParams = VOTE,
    local_bars: int = LOCAL_BARS, seed: Column | None = None, min_support: Column | int | None = None,
) -> DataFrame:
    """(b + 1) / (shuffles + 1), b the copies whose own-vote agreement is at least the group's.

    `units` are one-bar units of one slot count; `min_support` may be a column of the keys. Groups over `local_bars` bars take the folding path;
    the two give the same numbers.
    """
    vote = share_rows(section_vote(units, keys, p, min_support))
    support = p.min_slot_support if min_support is None else min_support
    observed = vote_figures(units, vote, keys).select(*keys, F.round("confidence", 9).alias("observed"))
    floors = density_floor(strike_histogram(units, keys), keys, p)
    sizes = units.groupBy(*keys).agg(F.count("*").alias("_size"))
    drawn_from = F.xxhash64(*keys) if seed is None else seed
    dims = observed.join(floors, list(keys)).join(sizes, list(keys))
    ready = units.select(
        *keys, "pos", "width", "strike", "mute", drawn_from.cast("long").bitwiseAND(F.lit(MASK31)).alias("seed"),
        (support if isinstance(support, Column) else F.lit(support)).cast("int").alias("support"),
    ).join(dims, list(keys))
    ready = share_rows(ready)
    counted = _local_count(ready.where(F.col("_size") <= local_bars).drop("_size"), keys, width, p)
    large = ready.where(F.col("_size") > local_bars).drop("_size")
    if not large.isEmpty():
        counted = counted.unionByName(_folded_count(large, keys, width, p))
    return counted.select(*keys, ((F.col("at_least") + 1) / (p.chance_shuffles + 1)).alias("chance_p"))


def structure_test(
    units: DataFrame, figures: DataFrame, width: int, keys: Sequence[str] = SECTION, p: VoteParams = VOTE,
    seed: Column | None = None, min_support: Column | int | None = None,
) -> DataFrame:
    """structured, chance_p (null for a full vote) and density.

    `figures` (keys, density, full_vote) describes the printed vote; a full vote is judged by density.
    """
    figures = share_rows(figures)
    tested = share_rows(units.join(figures.where("not full_vote").select(*keys), list(keys), "left_semi"))
    out = figures.join(chance_p(tested, width, keys, p, seed=seed, min_support=min_support), list(keys), "left")
    ok = F.when(F.col("full_vote"), F.col("density") >= p.full_vote_density).otherwise(F.col("chance_p") <= p.chance_alpha)
    return out.select(*keys, "density", "full_vote", "chance_p", ok.alias("structured"))
