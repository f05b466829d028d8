"""Pattern votes over units (one or two bars) held as bit masks.

A unit table has the group keys, `pos` (0-based place in the group), `strike`, `mute` and
`width`. Everything a vote needs is additive, so units are first folded into per-slot
counts, a strike-count histogram and distinct patterns with multiplicities: a group holding
a third of all rows shrinks to at most 3^width patterns before it meets a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.functions.rhythm import agreement, bit, one_at, rotate_half, shl, slot_list
from stavework.operators.ordered import with_neighbour, with_position
from stavework.params import VOTE, VoteParams
from stavework.session import share_rows

SECTION = ["track_id", "section"]
BAR_CHUNK = 4096
BLOCK = 2048  # distinct patterns per block of the pattern-by-pattern pass


def _zero() -> Column:
    return F.lit(0).cast("long")


def units_of_bars(bars: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Bars as one-bar units, numbered in their group."""
    return with_position(bars, keys, ["bar"], BAR_CHUNK)


def slot_counts(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Per group and slot: n units, k strikes, m mutes, folded map-side."""
    return (
        units.select(*keys, "width", "strike", "mute", F.explode(slot_list(F.col("width"))).alias("slot"))
        .groupBy(*keys, "width", "slot")
        .agg(
            F.count("*").alias("n"), F.sum(bit(F.col("strike"), F.col("slot"))).alias("k"),
            F.sum(bit(F.col("mute"), F.col("slot"))).alias("m"),
        )
    )


def strike_histogram(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Units per strike count: at most width + 1 rows per group."""
    return units.groupBy(*keys, F.bit_count("strike").cast("int").alias("strikes")).agg(F.count("*").alias("c"))


def density_floor(hist: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE) -> DataFrame:
    """The least number of struck slots: half-even rounding of a share of the median strikes."""
    return hist.groupBy(*keys).agg(
        F.bround(p.density_floor * F.percentile("strikes", 0.5, F.col("c")), 0).cast("int").alias("floor")
    )


def is_kept(slot: Column, p: VoteParams = VOTE, min_support: Column | int | None = None) -> Column:
    support = p.min_slot_support if min_support is None else min_support
    return (slot["k"] * p.strike_share_inverse > slot["n"]) & (slot["k"] >= support)


def slots_of(counts: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """The slot counts of a group as one row, in the array `slots`."""
    return counts.groupBy(*keys).agg(F.collect_list(F.struct("width", "slot", "n", "k", "m")).alias("slots"))


def vote_of(
    groups: DataFrame, by: Sequence[str], p: VoteParams = VOTE, min_support: Column | int | None = None
) -> DataFrame:
    """The topped vote per row carrying `slots` and `floor` (0 for the plain majority).

    Slots struck in over a third of the units are kept (muted when most strikes are); then the
    highest-rate free slots, the earlier on a tie, fill up to the floor. A vote is worked out within its
    row, so however many votes a task gives, it sorts and holds no slots as rows.
    """
    def ranked(s: Column) -> Column:
        return F.struct(is_kept(s, p, min_support).alias("kept"), (-s["k"]).alias("less"), s["slot"].alias("slot"), s["width"].alias("width"),
                        s["n"].alias("n"), (s["m"] * 2 > s["k"]).alias("muted"))

    def marked(s: Column, place: Column) -> Column:
        struck = s["kept"] | (place < F.col("floor") - F.col("n_kept"))
        return F.struct(s["width"].alias("width"), s["n"].alias("n"), F.when(struck, one_at(s["slot"])).otherwise(_zero()).alias("strike"),
                        F.when(s["kept"] & s["muted"], one_at(s["slot"])).otherwise(_zero()).alias("mute"))

    def mask(name: str) -> Column:
        return F.aggregate("slots", _zero(), lambda acc, s: acc.bitwiseOR(F.when(s["width"] == F.col("width"), s[name]).otherwise(_zero())))

    free_first = groups.withColumn("slots", F.array_sort(F.transform("slots", ranked)))
    free_first = free_first.withColumn("n_kept", F.size(F.filter("slots", lambda s: s["kept"])))
    voted = free_first.withColumn("slots", F.transform("slots", marked))
    voted = voted.select(*by, "slots", F.explode(F.array_distinct(F.transform("slots", lambda s: s["width"]))).alias("width"))
    return voted.select(
        *by, "width", F.filter("slots", lambda s: s["width"] == F.col("width"))[0]["n"].alias("n"),
        mask("strike").alias("vote_strike"), mask("mute").alias("vote_mute"),
    )


def section_majority(units: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE) -> DataFrame:
    """The plain slot majority, without topping up."""
    return vote_of(slots_of(slot_counts(units, keys), keys).withColumn("floor", F.lit(0)), keys, p)


def section_vote(
    units: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE, min_support: Column | int | None = None
) -> DataFrame:
    """Per group: n, width and the topped vote as `vote_strike`, `vote_mute`."""
    floors = density_floor(strike_histogram(units, keys), keys, p)
    return vote_of(slots_of(slot_counts(units, keys), keys).join(floors, list(keys)), keys, p, min_support)


def vote_figures(units: DataFrame, votes: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Confidence, explained share and strike density of each group's units against a vote."""
    joined = units.join(votes.select(*keys, "vote_strike", "vote_mute"), list(keys))
    hit = F.bit_count(F.col("strike").bitwiseAND(F.col("vote_strike")))
    return joined.groupBy(*keys).agg(
        F.avg(agreement(F.col("strike"), F.col("mute"), F.col("vote_strike"), F.col("vote_mute"))).alias("confidence"),
        F.coalesce(F.try_divide(F.sum(hit), F.sum(F.bit_count("strike"))), F.lit(0.0)).alias("explained"),
        F.try_divide(F.sum(F.bit_count("strike")), F.sum("width")).alias("density"),
        F.first(F.bit_count("vote_strike") == F.col("width")).alias("full_vote"),
    )


def bar_repeat(units: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Mean agreement of consecutive units; 0 when there is no pair."""
    nxt = with_neighbour(units, keys, ["pos"], BAR_CHUNK, {"n_strike": "strike", "n_mute": "mute"}, ahead=True)
    pair = agreement(F.col("strike"), F.col("mute"), F.col("n_strike"), F.col("n_mute"))
    return nxt.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("n_strike").isNotNull(), pair)), F.lit(0.0)).alias("bar_repeat")
    )


MASKS = ("strike", "mute")


def mask_agreement(left: str, right: str) -> Column:
    """Agreement of two units given the prefixes of their mask columns."""
    return agreement(*[F.col(f"{side}{c}") for side in (left, right) for c in MASKS])


def distinct_patterns(units: DataFrame, keys: Sequence[str] = SECTION, cols: Sequence[str] = MASKS) -> DataFrame:
    """Patterns with their multiplicity at even and odd places and their first place."""
    even = F.col("pos") % 2 == 0
    return units.groupBy(*keys, "width", *cols).agg(
        F.count_if(even).alias("c_even"), F.count_if(~even).alias("c_odd"), F.min("pos").alias("first_pos")
    )


def agreement_sums(
    units: DataFrame, keys: Sequence[str] = SECTION, cols: Sequence[str] = MASKS,
    agree: Callable[[str, str], Column] = mask_agreement,
) -> DataFrame:
    """Per distinct pattern: its summed agreement with the group's even and odd units.

    Patterns meet patterns, not units units; a group with many patterns is cut into blocks so
    its candidates spread over tasks, and the sums are folded map-side.
    """
    whole = Window.partitionBy(*keys)
    pats = distinct_patterns(units, keys, cols).withColumn(
        "_blocks", F.ceil(F.count("*").over(whole) / BLOCK).cast("int")
    ).withColumn("n", F.sum(F.col("c_even") + F.col("c_odd")).over(whole))
    mine = pats.withColumn("_b", F.pmod(F.hash(*cols), F.col("_blocks"))).drop("_blocks")
    other = pats.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"),
        *[F.col(c).alias(f"o_{c}") for c in cols],
        F.col("c_even").alias("o_even"), F.col("c_odd").alias("o_odd"),
    )
    j = agree("", "o_")
    return mine.join(other, [*keys, "_b"]).groupBy(
        *keys, "width", "n", *cols, "c_even", "c_odd", "first_pos"
    ).agg(F.sum(j * F.col("o_even")).alias("s_even"), F.sum(j * F.col("o_odd")).alias("s_odd"))


def unit_means(sums: DataFrame) -> DataFrame:
    """Mean agreement of each pattern with the group's other units (1 for a lone unit)."""
    return sums.withColumn(
        "score",
        F.when(F.col("n") == 1, F.lit(1.0)).otherwise((F.col("s_even") + F.col("s_odd") - 1) / (F.col("n") - 1)),
    )


def medoid(sums: DataFrame, keys: Sequence[str] = SECTION, cols: Sequence[str] = MASKS) -> DataFrame:
    """The unit agreeing best with the others, the earliest on a tie."""
    top = unit_means(sums).groupBy(*keys, "n", "width").agg(
        F.max_by(F.struct(*cols, "score", "first_pos"), F.struct(F.round("score", 9), -F.col("first_pos"))).alias("m")
    )
    return top.select(
        *keys, "n", "width", F.col("m.first_pos").alias("medoid_pos"), F.col("m.score").alias("score_medoid"),
        *[F.col(f"m.{c}").alias(f"medoid_{c}") for c in cols],
    )


def two_best(sums: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """The best unit by mean agreement with the others, then the best whose pattern differs (the
    same pattern again when every unit is alike; none for a lone unit). `place` is 1 or 2."""
    scored = unit_means(sums)
    best = scored.groupBy(*keys, "width", "n").agg(
        F.max_by(F.struct("strike", "mute", "s_even", "s_odd"), F.struct(F.round("score", 9), -F.col("first_pos"))).alias("b")
    )
    rest = scored.join(best.select(*keys, "b"), list(keys)).where(
        (F.col("strike") != F.col("b.strike")) | (F.col("mute") != F.col("b.mute"))
    ).groupBy(*keys).agg(
        F.max_by(F.struct("strike", "mute", "s_even", "s_odd"), F.struct(F.round("score", 9), -F.col("first_pos"))).alias("r")
    )
    both = best.join(rest, list(keys), "left").withColumn("r", F.coalesce("r", F.when(F.col("n") > 1, F.col("b"))))
    rows = F.array(F.struct(F.lit(1).alias("place"), F.col("b").alias("u")), F.struct(F.lit(2).alias("place"), F.col("r").alias("u")))
    return both.select(*keys, "width", "n", F.inline(rows)).where("u is not null").select(
        *keys, "width", "place", "u.strike", "u.mute", ((F.col("u.s_even") + F.col("u.s_odd")) / F.col("n")).alias("mean_agreement")
    )


def majority_loo(
    units: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE, min_support: Column | int | None = None
) -> DataFrame:
    """Mean agreement of each unit with the topped vote of the others (of itself when alone).

    The others' counts are the group's totals minus the unit's own, per distinct pattern; the
    others' median depends only on the unit's strike count.
    """
    hist = strike_histogram(units, keys)
    own = hist.select(*keys, F.col("strikes").alias("own"), F.col("c").alias("own_c"))
    alone = Window.partitionBy(*keys, "own")
    others = (
        own.join(hist, list(keys))
        .withColumn("total", F.sum("c").over(alone))
        .withColumn("c", F.when((F.col("strikes") == F.col("own")) & (F.col("total") > 1), F.col("c") - 1).otherwise(F.col("c")))
        .where("c > 0")
    )
    floors = density_floor(others, [*keys, "own"], p)
    pats = units.groupBy(*keys, "strike", "mute").agg(F.count("*").alias("c"))

    def without(s: Column) -> Column:
        lone = s["n"] == 1
        return F.struct(
            s["width"].alias("width"), s["slot"].alias("slot"), F.when(lone, s["n"]).otherwise(s["n"] - 1).alias("n"),
            *[F.when(lone, s[c]).otherwise(s[c] - bit(F.col(mask), s["slot"])).alias(c) for c, mask in (("k", "strike"), ("m", "mute"))],
        )

    left = (
        pats.withColumn("own", F.bit_count("strike").cast("int")).join(floors, [*keys, "own"])
        .join(slots_of(slot_counts(units, keys), keys), list(keys)).withColumn("slots", F.transform("slots", without))
    )
    rest = vote_of(left, [*keys, "strike", "mute", "c"], p, min_support)
    j = agreement(F.col("strike"), F.col("mute"), F.col("vote_strike"), F.col("vote_mute"))
    return rest.groupBy(*keys).agg((F.sum(j * F.col("c")) / F.sum("c")).alias("score_majority"))


def best_pair(
    units: DataFrame, sums: DataFrame, keys: Sequence[str] = SECTION, cols: Sequence[str] = MASKS
) -> DataFrame:
    """The two-bar medoid: the consecutive pair that, alternating, agrees best with the other bars."""
    scored = units.join(sums.select(*keys, *cols, "n", "s_even", "s_odd"), [*keys, *cols])
    nxt = with_neighbour(
        scored, keys, ["pos"], BAR_CHUNK,
        {"n_even": "s_even", "n_odd": "s_odd", "n_strike": "strike"}, ahead=True,
    ).where("n_strike is not null and n >= 4")
    even = F.col("pos") % 2 == 0
    own = F.when(even, F.col("s_even") + F.col("n_odd")).otherwise(F.col("s_odd") + F.col("n_even"))
    score = (own - 2) / (F.col("n") - 2)
    return nxt.withColumn("score", score).groupBy(*keys).agg(
        F.max(F.struct(
            F.round("score", 9).alias("r"), (-F.col("pos")).alias("p"), "score",
            F.least(F.bit_count("strike"), F.bit_count("n_strike")).alias("fewest"),
        )).alias("b")
    ).select(*keys, (-F.col("b.p")).alias("pair_pos"), F.col("b.score").alias("score_pair"), F.col("b.fewest").alias("fewest"))


def unit_and_phase(
    medoids: DataFrame, pairs: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE,
    min_pairs: Column | int | None = None,
) -> DataFrame:
    """Unit 2 when the best pair beats the medoid by the margin, with enough pairs and strikes."""
    need = p.period2_min_pairs if min_pairs is None else min_pairs
    phase = F.pmod(F.col("pair_pos"), F.lit(2))
    margin = F.coalesce(F.col("score_pair") - F.col("score_medoid"), F.lit(0.0))
    two = (
        (F.round(margin, 9) >= p.period2_margin)
        & (F.floor((F.col("n") - phase) / 2) >= need)
        & (F.col("fewest") >= p.period2_min_strikes)
    )
    return medoids.join(pairs, list(keys), "left").select(
        *keys, "n", "width", "medoid_pos", "score_medoid", "medoid_strike", "medoid_mute", "pair_pos", "score_pair",
        margin.alias("period_margin"),
        F.when(two, 2).otherwise(1).alias("unit"),
        F.when(two, phase).otherwise(0).cast("int").alias("phase"),
    )


def pair_units(units: DataFrame, phases: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Consecutive pairs from each group's phase as units of twice the width."""
    placed = units.join(phases.select(*keys, "phase"), list(keys)).where("pos >= phase")
    half = F.pmod(F.col("pos") - F.col("phase"), F.lit(2))
    paired = placed.groupBy(*keys, "width", F.floor((F.col("pos") - F.col("phase")) / 2).alias("pos")).agg(
        F.bit_or(shl(F.col("strike"), half * F.col("width"))).alias("strike"),
        F.bit_or(shl(F.col("mute"), half * F.col("width"))).alias("mute"),
        F.count("*").alias("_c"),
    )
    return paired.where("_c = 2").select(*keys, "pos", (F.col("width") * 2).alias("width"), "strike", "mute")


def voted_units(units: DataFrame, phases: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """The units each group votes over: its bars, or its pairs where the vote is two bars long."""
    one = units.join(phases.where("unit = 1").select(*keys), list(keys), "left_semi")
    two = pair_units(units, phases.where("unit = 2"), keys)
    return one.select(*keys, "pos", "width", "strike", "mute").unionByName(two)


def choose_pattern(
    bars: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE,
    min_support: Column | int | None = None, min_pairs: Column | int | None = None,
) -> DataFrame:
    """The printed pattern per group: the topped majority, or the medoid when it is clearly better."""
    units = share_rows(units_of_bars(bars, keys))
    sums = share_rows(agreement_sums(units, keys))
    phases = share_rows(unit_and_phase(medoid(sums, keys), best_pair(units, sums, keys), keys, p, min_pairs))
    return choose_from(units, phases, keys, p, min_support)


def choose_from(
    units: DataFrame, phases: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE,
    min_support: Column | int | None = None,
) -> DataFrame:
    voted = share_rows(voted_units(units, phases, keys))
    votes = share_rows(section_vote(voted, keys, p, min_support))
    med = medoid(agreement_sums(voted, keys), keys).select(
        *keys, F.col("score_medoid").alias("med_score"), F.col("medoid_strike").alias("med_strike"),
        F.col("medoid_mute").alias("med_mute"),
    )
    loo = majority_loo(voted, keys, p, min_support)
    dims = phases.select(*keys, "unit", "phase", F.col("n").alias("n_bars"), F.col("width").alias("slots_per_bar"))
    out = dims.join(votes.select(*keys, F.col("n").alias("n_units"), "vote_strike", "vote_mute"), list(keys))
    out = out.join(med, list(keys)).join(loo, list(keys))
    strokes = F.bit_count(F.col("med_strike").bitwiseAND(F.bitwise_not("med_mute")))
    use_medoid = (F.round(F.col("med_score") - F.col("score_majority"), 9) >= p.hybrid_delta) & (
        strokes >= p.medoid_min_strokes
    )
    turn = (F.col("unit") == 2) & (F.col("phase") == 1)

    def aligned(a: str, b: str) -> Column:
        picked = F.when(use_medoid, F.col(a)).otherwise(F.col(b))
        return F.when(turn, rotate_half(picked, F.col("slots_per_bar"))).otherwise(picked)

    return out.select(
        *keys, "unit", "phase", "n_bars", "n_units", "slots_per_bar",
        F.when(use_medoid, "medoid").otherwise("majority").alias("candidate"),
        "score_majority", F.col("med_score").alias("score_medoid"),
        aligned("med_strike", "vote_strike").alias("strike"), aligned("med_mute", "vote_mute").alias("mute"),
        F.when(use_medoid, F.col("med_strike")).otherwise(F.col("vote_strike")).alias("raw_strike"),
        F.when(use_medoid, F.col("med_mute")).otherwise(F.col("vote_mute")).alias("raw_mute"),
    )


def candidate_margin(units: DataFrame, phases: DataFrame, chosen: DataFrame, keys: Sequence[str] = SECTION, p: VoteParams = VOTE) -> DataFrame:
    """The printed pattern's score less its best different rival's, and that rival.

    Candidates: majority and medoid per unit length, then the two best voted units; each scored
    by its mean agreement with the units it comes from. At most six rows per group.
    """
    def of(unit_table: DataFrame, sums: DataFrame, suffix: str, rank: int) -> DataFrame:
        vote = section_vote(unit_table, keys, p)
        fig = vote_figures(unit_table, vote, keys).select(*keys, F.col("confidence").alias("score"))
        major = vote.join(fig, list(keys)).select(
            *keys, F.lit(rank).alias("ord"), F.lit(f"majority_{suffix}").alias("name"), "width",
            F.col("vote_strike").alias("strike"), F.col("vote_mute").alias("mute"), "score")
        top = two_best(sums, keys).where("place = 1").select(
            *keys, F.lit(rank + 1).alias("ord"), F.lit(f"medoid_{suffix}").alias("name"), "width", "strike", "mute",
            F.col("mean_agreement").alias("score"))
        return major.unionByName(top)

    sums = share_rows(agreement_sums(units, keys))
    pairs = share_rows(pair_units(units, phases.where("unit = 2"), keys))
    pair_sums = share_rows(agreement_sums(pairs, keys))
    twos = phases.where("unit = 2").select(*keys)
    voted = two_best(sums, keys).join(twos, list(keys), "left_anti").unionByName(two_best(pair_sums, keys))
    named = F.when(F.col("place") == 1, "bar_best").otherwise("bar_second")
    cands = of(units, sums, "1", 0).unionByName(of(pairs, pair_sums, "2", 2)).unionByName(
        voted.select(*keys, (F.col("place") + 3).alias("ord"), named.alias("name"), "width", "strike", "mute", F.col("mean_agreement").alias("score"))
    )
    mine = chosen.select(*keys, (F.col("slots_per_bar") * F.col("unit")).alias("p_width"), "raw_strike", "raw_mute")
    same = (F.col("width") == F.col("p_width")) & (F.col("strike") == F.col("raw_strike")) & (F.col("mute") == F.col("raw_mute"))
    rival = F.struct(F.round("score", 9), -F.col("ord"))
    t = cands.join(mine, list(keys)).withColumn("same", same).groupBy(*keys).agg(
        F.max(F.when(F.col("same"), F.col("score"))).alias("printed_score"),
        F.max_by(F.struct("score", "strike", "mute", "width", "name"), F.when(~F.col("same"), rival)).alias("rival"),
    )
    has = F.col("rival.score").isNotNull() & t["rival"].isNotNull()
    return t.select(*keys, F.when(has, F.col("printed_score") - F.col("rival.score")).alias("margin"),
                    F.col("rival.name").alias("rival_name"), F.col("rival.strike").alias("rival_strike"),
                    F.col("rival.mute").alias("rival_mute"), F.col("rival.width").alias("rival_width"))
