"""Runs scored against truth ranges, figures and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.harte import pitch_class
from stavework.functions import keys as K
from stavework.functions.rhythm import agreement, mask_where, swap_distance
from stavework.operators.intervals import overlap, point_in_span
from stavework.operators.ordered import ranged, with_neighbour, with_position, with_running_sum, with_runs

KEYS = ["track_id"]
# The labels the truth files may hold.
VERDICTS = ["YES", "MOSTLY", "NO"]
RIFF_LABELS = ["riff", "strum", "mixed", "dyad", "bleed"]
REST_LABELS = ["rest", "play", "tail", "contested"]
COLLAR = 1
CHUNK_ROWS = 4096


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def range_bars(ranges: DataFrame, records: DataFrame, labels: Sequence[str], skipped: Sequence[str]) -> DataFrame:
    """One label per recorded bar: the last range's wins, skipped labels are dropped."""
    spread = ranges.where(F.col("label").isin(*labels)).select("track_id", "line", "label", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("bar"))
    last = spread.groupBy("track_id", "bar").agg(F.max_by("label", "line").alias("label"))
    return last.where(~F.col("label").isin(*skipped)).join(records.select("track_id", "bar"), ["track_id", "bar"], "left_semi")


def regions(bars: DataFrame, flag: str) -> DataFrame:
    """Runs of consecutive flagged bar numbers as (first, last)."""
    hit = bars.where(flag).select("track_id", "bar")
    near = with_neighbour(hit, KEYS, ["bar"], 4096, {"before": "bar"})
    runs = with_running_sum(near, KEYS, ["bar"], 4096, {"run": F.when(F.col("bar") - F.col("before") == 1, 0).otherwise(1)})
    return runs.groupBy("track_id", "run").agg(F.min("bar").alias("first"), F.max("bar").alias("last")).drop("run")


def unmatched(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, missing): how many references of each group stay without an estimate in a largest one-to-one matching.

    Each reference may take any of a run of estimates, and runs move forward with the references. By Hall's theorem the
    references left over are the most that any disjoint stretches of references have beyond the estimates in their reach.
    `points` (keys, pos from 0, opens, value) holds two rows a reference: where its run opens, with the estimates before
    it less the references before it, and where it closes, with the references up to it less the estimates up to there.
    Walking along, `best` is the most so far outside a stretch and `held` the most inside one. A step is linear in
    (max, +), so 4,096 rows fold to four numbers, and one row of a group's chunks to the answer.
    """
    low = F.lit(-(1 << 60)).cast("long")
    zero = F.lit(0).cast("long")

    def walk(state: Column, p: Column) -> Column:
        def moved(best: str, held: str) -> list[Column]:
            return [F.when(p["opens"], state[best]).otherwise(F.greatest(state[best], state[held] + p["value"])).alias(best),
                    F.when(p["opens"], F.greatest(state[held], state[best] + p["value"])).otherwise(state[held]).alias(held)]
        return F.struct(*moved("ss", "sh"), *moved("hs", "hh"))

    start = F.struct(zero.alias("ss"), low.alias("sh"), low.alias("hs"), zero.alias("hh"))
    rows = points.groupBy(*keys, F.floor(F.col("pos") / CHUNK_ROWS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "opens", "value"))).alias("rows"))
    rows = rows.select(*keys, F.struct("chunk", F.aggregate("rows", start, walk).alias("m")).alias("step"))
    whole = F.aggregate(
        F.array_sort(F.collect_list("step")), F.struct(zero.alias("best"), low.alias("held")),
        lambda a, x: F.struct(F.greatest(a["best"] + x["m"]["ss"], a["held"] + x["m"]["hs"]).alias("best"), F.greatest(a["best"] + x["m"]["sh"], a["held"] + x["m"]["hh"]).alias("held")))
    return rows.groupBy(*keys).agg(whole["best"].alias("missing"))


def region_match(reference: DataFrame, estimate: DataFrame, collar: int = COLLAR) -> DataFrame:
    """Regions matched one to one with both edges within the collar, and the F over both lists (null with none).

    The regions of a list lie apart, as runs of consecutive bars do; with the collar of one bar the estimates that a region may
    take then follow one another, and taking the first free one in turn is a largest matching.
    """
    r = with_position(reference.select("track_id", "first", "last"), KEYS, ["first", "last"], 4096, "i")
    e = with_position(estimate.select("track_id", "first", "last"), KEYS, ["first", "last"], 4096, "j")
    e = e.select("track_id", F.explode(F.sequence(F.col("first") - collar, F.col("first") + collar)).alias("first"), F.col("last").alias("e_last"), "j")
    fits = F.abs(F.col("last") - F.col("e_last")) <= collar
    runs = r.join(e, ["track_id", "first"], "left").groupBy("track_id", "i").agg(F.min(F.when(fits, F.col("j"))).alias("lo"), F.max(F.when(fits, F.col("j"))).alias("hi"))
    alone = runs.where("lo is null").groupBy("track_id").agg(F.count("*").alias("alone"))
    some = with_position(runs.where("lo is not null"), KEYS, ["i"], 4096, "n")
    steps = F.array(F.struct((2 * F.col("n")).alias("pos"), F.lit(True).alias("opens"), (F.col("lo") - F.col("n")).alias("value")),
                    F.struct((2 * F.col("n") + 1).alias("pos"), F.lit(False).alias("opens"), (F.col("n") - F.col("hi")).alias("value")))
    missing = unmatched(some.select("track_id", F.inline(steps)), KEYS)
    n_ref = reference.groupBy("track_id").agg(F.count("*").alias("n_ref"))
    n_est = estimate.groupBy("track_id").agg(F.count("*").alias("n_est"))
    counts = n_ref.join(n_est, KEYS, "full").join(alone, KEYS, "left").join(missing, KEYS, "left").na.fill(0)
    counts = counts.withColumn("matched", F.col("n_ref") - F.col("alone") - F.col("missing")).drop("alone", "missing")
    return counts.withColumn("event_f", 2 * F.col("matched") / (F.col("n_ref") + F.col("n_est")))


def event_f(reference: DataFrame, estimate: DataFrame, tolerance: float) -> DataFrame:
    """F of two event lists (track_id, t) under a largest one-to-one matching within the tolerance; null without a reference.

    Times count in whole microseconds. One walk in time order over the estimates and over both ends of each reference's
    reach gives the counts that `unmatched` needs, so no pair is formed however many events share a moment.
    """
    micros = lambda c: F.round(c * 1_000_000).cast("long")
    reach = round(tolerance * 1_000_000)
    r = reference.where("t is not null").select("track_id", micros(F.col("t")).alias("at"))
    e = estimate.where("t is not null").join(r.select("track_id").distinct(), KEYS, "left_semi").select("track_id", micros(F.col("t")).alias("at"), F.lit(1).alias("kind"))
    ends = r.select("track_id", F.inline(F.array(F.struct((F.col("at") - reach).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("at") + reach).alias("at"), F.lit(2).alias("kind")))))
    line = ranged(ends.unionByName(e).withColumn("tie", F.monotonically_increasing_id()), KEYS, ["at", "kind", "tie"])
    of = lambda kind: (F.col("kind") == kind).cast("long")
    line = with_running_sum(line, KEYS, ["at", "kind", "tie"], 0, {"opened": of(0), "seen": of(1), "closed": of(2)})
    opens = F.col("kind") == 0
    value = F.when(opens, F.col("seen") - F.col("opened") + 1).otherwise(F.col("closed") - F.col("seen"))
    points = line.where("kind <> 1").select("track_id", (F.col("opened") + F.col("closed") - 1).alias("pos"), opens.alias("opens"), value.alias("value"))
    n_ref = r.groupBy("track_id").agg(F.count("*").alias("n_ref"))
    n_est = e.groupBy("track_id").agg(F.count("*").alias("n_est"))
    c = n_ref.join(n_est, KEYS, "left").join(unmatched(points, KEYS), KEYS, "left").na.fill(0)
    c = c.withColumn("matched", F.col("n_ref") - F.col("missing")).drop("missing")
    return c.withColumn("f", 2 * F.col("matched") / (F.col("n_ref") + F.col("n_est")))


def rest_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """hits, deletions (playing bars rested) and insertions (resting bars held) of `pred` against `truth`."""
    return scored.groupBy(*by).agg(
        F.count_if(F.col("truth") & F.col("pred")).alias("hits"), F.count_if(~F.col("truth") & F.col("pred")).alias("deletions"),
        F.count_if(F.col("truth") & ~F.col("pred")).alias("insertions"), F.count("*").alias("scored"),
    )


def rest_scores(scored: DataFrame) -> DataFrame:
    c = rest_counts(scored, KEYS)
    return c.select("track_id", ratio(F.col("hits"), F.col("hits") + F.col("deletions")).alias("precision"),
                    ratio(F.col("hits"), F.col("hits") + F.col("insertions")).alias("recall"), "deletions", "insertions")


def flag_scores(ranges: DataFrame, records: DataFrame, patterns: DataFrame) -> DataFrame:
    """Precision, recall and the two constant baselines of the riff flag over labelled ranges.

    A range is flagged when any of its recorded bars is; one without records reads the planned
    section (start_bar, end_bar, riff) holding its first bar.
    """
    r = ranges.where(F.col("label").isin(*RIFF_LABELS))
    bars = r.select("track_id", "line", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("bar")).join(records, ["track_id", "bar"])
    seen = bars.groupBy("track_id", "line").agg(F.bool_or("riff").alias("by_bar"))
    fall = point_in_span(r.select("track_id", "line", "start"), patterns.select("track_id", "start_bar", "end_bar", F.col("riff").alias("by_section")), KEYS, "start", "start_bar", "end_bar", 64)
    fall = fall.groupBy("track_id", "line").agg(F.bool_or("by_section").alias("by_section"))
    j = r.join(seen, ["track_id", "line"], "left").join(fall, ["track_id", "line"], "left")
    flagged = F.coalesce("by_bar", "by_section", F.lit(False))
    hit = F.col("label").isin("riff", "mixed")
    c = j.withColumn("flagged", flagged).withColumn("hit", hit).groupBy("track_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("flagged").alias("fl"), F.count_if(F.col("flagged") & F.col("hit")).alias("both"))
    return c.select("track_id", ratio(F.col("both"), F.col("fl")).alias("precision"), ratio(F.col("both"), F.col("hits")).alias("recall"),
                    ((F.col("n") - F.col("hits")) / F.col("n")).alias("baseline_not_riff"), (F.col("hits") / F.col("n")).alias("baseline_riff"))


def pattern_scores(truth: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each judged range against the printed row of its first bar that holds.

    `truth` (track_id, line, start, end, verdict, figure array), `records` (track_id, bar, width,
    p_strike, p_mute, rests, uncertain). A two-bar figure is read in the printed rows' phase. `keys` names a track's run, in both tables.
    """
    bars = truth.select(*keys, "line", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("bar"))
    holds = bars.join(records.where("not rests").select(*keys, "bar"), [*keys, "bar"]).groupBy(*keys, "line").agg(F.min("bar").alias("held"))
    t = truth.join(holds, [*keys, "line"], "left").withColumn("first", F.coalesce("held", "start"))
    two = F.size("figure") == 2
    turned = F.when(two & ((F.col("first") - F.col("start")) % 2 == 1), F.reverse("figure")).otherwise(F.col("figure"))
    t = t.withColumn("figure", turned)
    rec = records.select(*keys, "bar", "width", "p_strike", "p_mute", "uncertain")
    a = t.join(rec.withColumnsRenamed({"bar": "first", "p_strike": "s1", "p_mute": "m1"}), [*keys, "first"], "left").withColumn("next", F.col("first") + 1)
    a = a.join(rec.select(*keys, F.col("bar").alias("next"), F.col("p_strike").alias("s2"), F.col("p_mute").alias("m2")), [*keys, "next"], "left")
    two = F.size("figure") == 2
    fits = F.col("figure").isNotNull() & F.forall("figure", lambda x: F.length(x) == F.col("width")) & F.col("s1").isNotNull() & (~two | F.col("s2").isNotNull())
    text = F.array_join("figure", "")
    shift = F.col("width")
    both = lambda lo, hi: F.when(two, lo.bitwiseOR(F.call_function("shiftleft", hi, shift))).otherwise(lo)
    ps, pm = both(F.col("s1"), F.col("s2")), both(F.col("m1"), F.col("m2"))
    fs, fm = mask_where(text, "DUx"), mask_where(text, "x")
    return a.select(
        *keys, "line", "verdict", "first",
        F.when(fits, agreement(ps, pm, fs, fm)).alias("jaccard"),
        F.when(fits, swap_distance(ps, fs, F.length(text))).alias("swap"),
        F.coalesce(~F.col("uncertain"), F.lit(False)).alias("certain"),
    )


def false_certainty(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count_if((F.col("verdict") == "NO") & F.col("certain")).alias("false_certain"),
        F.count_if(F.col("verdict").isin("YES", "MOSTLY") & ~F.col("certain")).alias("false_grey"),
    )


def discontinuity(records: DataFrame) -> DataFrame:
    """Printed pattern changes per bar."""
    near = with_neighbour(records, KEYS, ["bar"], 4096, {"b_strike": "p_strike", "b_mute": "p_mute"})
    change = (F.col("b_strike") != F.col("p_strike")) | (F.col("b_mute") != F.col("p_mute"))
    return near.groupBy("track_id").agg((F.count_if(change) / F.count("*")).alias("discontinuity"))


def key_scores(truth: DataFrame, keys: DataFrame) -> DataFrame:
    """The better weighted score over the truth and its alternative (the truth wins a tie), the
    category of that truth, and whether the hedge names a key related to either.

    `truth` (track_id, pc, mode, alt_pc, alt_mode), `keys` (track_id, tonic, mode, hedge_tonic, hedge_mode).
    """
    j = truth.withColumnsRenamed({"mode": "t_mode"}).join(keys, KEYS)
    lead = (F.col("tonic"), F.col("mode"))
    s1 = K.weighted_score(F.col("pc"), F.col("t_mode"), *lead)
    s2 = F.when(F.col("alt_pc").isNotNull(), K.weighted_score(F.col("alt_pc"), F.col("alt_mode"), *lead))
    alt = F.coalesce(s2 > s1, F.lit(False))
    cat = F.when(alt, K.relation(F.col("alt_pc"), F.col("alt_mode"), *lead)).otherwise(K.relation(F.col("pc"), F.col("t_mode"), *lead))
    hedge = (F.col("hedge_tonic"), F.col("hedge_mode"))
    related = (K.relation(F.col("pc"), F.col("t_mode"), *hedge) != "other") | F.coalesce(K.relation(F.col("alt_pc"), F.col("alt_mode"), *hedge) != "other", F.lit(False))
    return j.select("track_id", F.greatest(s1, F.coalesce(s2, F.lit(0.0))).alias("score"), cat.alias("category"),
                    F.when(F.col("hedge_tonic").isNotNull(), related).alias("hedge_related"))


def label_overlap(reference: DataFrame, estimate: DataFrame, bucket: float) -> DataFrame:
    """Duration-weighted agreement of two label lists over the reference's span: root, major-minor, triads.

    Both carry `start`, `end`, `triad` (N, X or root:triad); what the estimate leaves open counts as N.
    """
    def sounding(c: str) -> Column:
        """Roots by pitch class, so that C# and Db agree."""
        name, kind = F.split_part(c, F.lit(":"), F.lit(1)), F.split_part(c, F.lit(":"), F.lit(2))
        return F.when(F.col(c).isin("N", "X"), F.col(c)).otherwise(F.concat(pitch_class(name).cast("string"), F.lit(":"), kind))

    r = reference.select("track_id", "start", "end", sounding("triad").alias("ref"))
    e = estimate.select("track_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), sounding("triad").alias("est"))
    hits = overlap(r, e, KEYS, ("start", "end"), ("e_start", "e_end"), bucket)
    total = r.groupBy("track_id", "ref").agg(F.sum(F.col("end") - F.col("start")).alias("dur"))
    met = hits.groupBy("track_id", "ref", "est").agg(F.sum("overlap").alias("w"))
    covered = met.groupBy("track_id", "ref").agg(F.sum("w").alias("covered"))
    open_ = total.join(covered, ["track_id", "ref"], "left").select("track_id", "ref", F.lit("N").alias("est"), (F.col("dur") - F.coalesce("covered", F.lit(0.0))).alias("w"))
    rows = met.unionByName(open_).where("ref <> 'X'")
    root = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    plain = (F.col("ref") == "N") | F.col("ref").endswith(":maj") | F.col("ref").endswith(":min")
    same_root = root(F.col("ref")) == root(F.col("est"))
    same = F.col("ref") == F.col("est")

    def share(hit: Column, inside: Column) -> Column:
        return ratio(F.sum(F.when(inside & hit, F.col("w")).otherwise(0.0)), F.sum(F.when(inside, F.col("w")).otherwise(0.0)))

    every = F.lit(True)
    return rows.groupBy("track_id").agg(share(same_root, every).alias("root"), share(same, plain).alias("majmin"), share(same, every).alias("triads"))


def directional(a: DataFrame, b: DataFrame, bucket: float, name: str) -> DataFrame:
    """Share of a's time outside the best-overlapping interval of b, per track."""
    left = a.select("track_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = b.select("track_id", "start", "end")
    top = overlap(left, right, KEYS, ("a_start", "a_end"), ("start", "end"), bucket).groupBy("track_id", "a_start", "a_end").agg(F.max("overlap").alias("best"))
    j = left.join(top, ["track_id", "a_start", "a_end"], "left")
    dur = F.col("a_end") - F.col("a_start")
    return j.groupBy("track_id").agg((F.sum(dur - F.coalesce("best", F.lit(0.0))) / F.sum(dur)).alias(name))


def segmentation_scores(reference: DataFrame, estimate: DataFrame, bucket: float) -> DataFrame:
    """1 less the directional distances both ways; the estimate is cut to the reference's span."""
    span = reference.groupBy("track_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    cut = estimate.join(span, KEYS).select("track_id", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"), "lo", "hi").where("end > start")
    edge = cut.groupBy("track_id", "lo", "hi").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    pads = edge.select("track_id", F.col("lo").alias("start"), F.col("first").alias("end")).unionByName(edge.select("track_id", F.col("last").alias("start"), F.col("hi").alias("end"))).where("end > start")
    full = cut.select("track_id", "start", "end").unionByName(pads)
    over, under = directional(reference, full, bucket, "d1"), directional(full, reference, bucket, "d2")
    return over.join(under, KEYS).select("track_id", (1 - F.col("d1")).alias("overseg"), (1 - F.col("d2")).alias("underseg"), F.least(1 - F.col("d1"), 1 - F.col("d2")).alias("seg"))


def compact_ranges(bars: DataFrame, name: str) -> DataFrame:
    """Bar numbers as text, `0-3, 10, 11-12` written with runs of two or more joined."""
    runs = regions(bars.withColumn("_t", F.lit(True)), "_t")
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return runs.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), ", ").alias(name))
