"""Chord shapes, capo, simplification, passing chords, and the score's chord placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.functions import harte as H
from stavework.operators.intervals import best, point_in_span
from stavework.operators.ordered import with_last_known, with_neighbour, with_runs
from stavework.params import EPS_OVERLAP, HARMONY, HarmonyParams
from stavework.session import share

KEYS = ["track_id"]
# Chord qualities as the shape dictionary spells them, and its root spellings.
SUFFIX = {
    "maj": "major", "min": "minor", "dim": "dim", "aug": "aug", "7": "7", "min7": "m7", "maj7": "maj7", "hdim7": "m7b5",
    "dim7": "dim7", "sus2": "sus2", "sus4": "sus4", "sus4(b7)": "7sus4", "maj9": "maj9", "9": "9", "min9": "m9", "11": "11",
    "13": "13", "maj6": "6", "min6": "m6", "minmaj7": "mmaj7", "aug7": "aug7",
}
DISPLAY = {"major": "", "minor": "m", "mmaj7": "mMaj7"}
ROOT_KEY = {**dict(zip(H.SHARPS, H.FLATS)), **{f: f for f in H.FLATS}, "Cb": "B", "Fb": "E", "E#": "F", "B#": "C"}


def shape_key(label: Column) -> tuple[Column, Column]:
    """(dictionary root, suffix) of a label with its bass dropped; nulls when unknown."""
    body = F.split_part(label, F.lit("/"), F.lit(1))
    root = F.split_part(body, F.lit(":"), F.lit(1))
    quality = F.nullif(F.split_part(body, F.lit(":"), F.lit(2)), F.lit(""))
    chord = ~H.is_no_chord(label)
    return (
        F.when(chord, F.try_element_at(H.literal_map(ROOT_KEY), root)),
        F.when(chord, F.try_element_at(H.literal_map(SUFFIX), F.coalesce(quality, F.lit("maj")))),
    )


def display_name(label: Column) -> Column:
    """The label's own root spelling with the dictionary's suffix; an unknown label as it is."""
    root, suffix = shape_key(label)
    written = F.split_part(F.split_part(label, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    short = F.coalesce(F.try_element_at(H.literal_map(DISPLAY), suffix), suffix)
    return F.when(root.isNotNull() & suffix.isNotNull(), F.concat(written, short)).otherwise(label)


def shape_cost(frets: Column, fingers: Column, base_fret: Column, barres: Column) -> Column:
    """Playing cost: barre, fretted strings, position, stretch and fingers beyond three."""
    fretted = F.filter(frets, lambda f: f > 0)
    used = F.size(F.array_distinct(F.filter(fingers, lambda f: f > 0)))
    stretch = F.when(F.size(fretted) >= 2, 0.5 * (F.array_max(fretted) - F.array_min(fretted))).otherwise(0.0)
    return (
        F.when(F.size(barres) > 0, 1.5).otherwise(0.0) + 0.4 * F.size(fretted) + 0.6 * F.greatest(F.lit(0), base_fret - 1)
        + stretch + 0.4 * F.greatest(F.lit(0), used - 3)
    )


def movement(a: Column, a_base: Column, b: Column, b_base: Column) -> Column:
    """Summed absolute fret movement over strings both shapes play."""
    def absolute(f: Column, base: Column) -> Column:
        return F.when(f <= 0, f).otherwise(f + base - 1)
    steps = F.zip_with(a, b, lambda x, y: F.when((x >= 0) & (y >= 0), F.abs(absolute(x, a_base) - absolute(y, b_base))).otherwise(0))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def cheapest_shapes(shapes: DataFrame) -> DataFrame:
    """One shape per (root, suffix): at most 12 roots x the known suffixes, whatever the input's size."""
    cost = shape_cost(F.col("frets"), F.col("fingers"), F.col("base_fret"), F.col("barres"))
    return best(shapes.withColumn("cost", cost), ["root", "suffix"], [F.round("cost", 9), F.col("pos")])


def simplify_for_tier(events: DataFrame, known: DataFrame, easy: bool) -> DataFrame:
    """The label a tier plays and why: power chords by the key, triads when easy, else what has a shape.

    `known` (root, suffix) is `cheapest_shapes`-sized, so it is broadcast.
    """
    lab = F.col("label")
    root = F.split_part(lab, F.lit(":"), F.lit(1))
    power = F.col("quality") == "5"
    d = events.withColumn("_l1", F.when(F.coalesce(power, F.lit(False)), F.concat(root, F.lit(":min"))).otherwise(lab))
    d = d.withColumn("_r1", F.when(F.coalesce(power, F.lit(False)), "power chord: quality from key"))
    triad = H.to_triad(F.col("_l1"))
    if easy:
        moved = triad != F.col("_l1")
        d = d.withColumn("_r1", F.when(moved, "easy tier: reduced to triad").otherwise(F.col("_r1"))).withColumn("_l1", triad)
    k1, s1 = shape_key(F.col("_l1"))
    d = d.withColumn("_k1", k1).withColumn("_s1", s1).withColumn("_triad", H.to_triad(F.col("_l1")))
    k2, s2 = shape_key(F.col("_triad"))
    d = d.withColumn("_k2", k2).withColumn("_s2", s2)
    small = known.select("root", "suffix").distinct()
    one = F.broadcast(small.select(F.col("root").alias("_k1"), F.col("suffix").alias("_s1"), F.lit(True).alias("_has1")))
    two = F.broadcast(small.select(F.col("root").alias("_k2"), F.col("suffix").alias("_s2"), F.lit(True).alias("_has2")))
    d = d.join(one, ["_k1", "_s1"], "left").join(two, ["_k2", "_s2"], "left")
    none = H.is_no_chord(lab)
    wanted = F.coalesce(F.nullif(F.split_part(F.split_part("_l1", F.lit("/"), F.lit(1)), F.lit(":"), F.lit(2)), F.lit("")), F.lit("maj"))
    chosen = F.when(none, lab).when(F.col("_has1"), F.col("_l1")).when(F.col("_has2"), F.col("_triad")).otherwise("N")
    reason = F.when(none, F.lit(None)).when(F.col("_has1"), F.col("_r1")).when(F.col("_has2"), F.concat(F.lit("no shape for "), wanted)).otherwise("no shape; left blank")
    return d.select(*events.columns, chosen.alias("chosen"), reason.alias("reason"))


def passing_labels(events: DataFrame, bar_seconds: float, p: HarmonyParams = HARMONY) -> DataFrame:
    """Rare labels never held longer than a bar; the most used are unmarked until three keep a diagram."""
    held = events.where(~H.is_no_chord(F.col("label"))).groupBy("track_id", "label").agg(
        F.sum(F.col("end") - F.col("start")).alias("total"), F.max(F.col("end") - F.col("start")).alias("longest"))
    whole = Window.partitionBy("track_id")  # one row per label of the track
    d = held.withColumn("rare", (F.col("total") < p.passing_share * F.sum("total").over(whole)) & (F.col("longest") <= bar_seconds))
    d = d.withColumn("short", p.min_diagram_chords - (F.count("*").over(whole) - F.count_if("rare").over(whole)))
    d = d.withColumn("rank", F.row_number().over(whole.orderBy(F.col("rare").desc(), F.round("total", 6).desc(), "label")))
    return d.select("track_id", "label", (F.col("rare") & (F.col("rank") > F.col("short"))).alias("passing"))


def capo_scores(labels: DataFrame, shapes: DataFrame, max_capo: int = 5, p: HarmonyParams = HARMONY) -> DataFrame:
    """Per track and capo: mean cheapest cost over the distinct labels as played, plus the fret penalty."""
    each = labels.where(~H.is_no_chord(F.col("label"))).select("track_id", "label").distinct()
    spread = each.select("track_id", "label", F.explode(F.sequence(F.lit(0), F.lit(max_capo))).alias("capo"))
    root, suffix = shape_key(F.col("played"))
    spread = spread.withColumn("played", H.transpose(F.col("label"), -F.col("capo"))).withColumn("root", root).withColumn("suffix", suffix)
    costed = spread.join(F.broadcast(shapes.select("root", "suffix", "cost")), ["root", "suffix"], "left")
    return costed.groupBy("track_id", "capo").agg((F.avg(F.coalesce("cost", F.lit(p.no_shape_cost))) + p.capo_fret_penalty * F.col("capo")).alias("score"))


def choose_capo(scores: DataFrame) -> DataFrame:
    """The lowest score (the lower fret on a tie) and how much the next best is worse."""
    w = Window.partitionBy("track_id").orderBy(F.round("score", 9), "capo")  # six rows
    r = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return r.groupBy("track_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("capo"))).alias("capo"),
        (F.max(F.when(F.col("r") == 2, F.col("score"))) - F.max(F.when(F.col("r") == 1, F.col("score")))).alias("margin"))


def transitions(events: DataFrame, chunk: float | None) -> DataFrame:
    """How often each label follows each, per track."""
    real = events.where(~H.is_no_chord(F.col("label")))
    nxt = with_neighbour(real, KEYS, ["start", "event"], chunk, {"next_label": "label"}, ahead=True).where("next_label is not null")
    return nxt.groupBy("track_id", "label", "next_label").agg(F.count("*").alias("times"))


def select_voicings(events: DataFrame, shapes: DataFrame, chunk: float | None = None, passes: int = 20) -> DataFrame:
    """(track_id, label, pos, passes, converged): one shape per label of a track, settled by coordinate descent.

    Each label starts on its cheapest shape. In turn, by first appearance, a label takes the shape with the least sum of its
    cost times its uses and a tenth of the movement to and from its neighbours' shapes, the first of equal ones, until a pass
    changes nothing. `events` (track_id, event, start, label); labels without a shape are left out before neighbours are told.
    A track's group holds its distinct labels, the transitions between them and their shapes: what the dictionary bounds, however
    long the track is.
    """
    cost = shape_cost(F.col("frets"), F.col("fingers"), F.col("base_fret"), F.col("barres"))
    absolute = F.transform("frets", lambda f: F.when(f <= 0, f).otherwise(f + F.col("base_fret") - 1))
    # of shapes alike in cost and frets only the first can be chosen, so a label has as many as the fretboard allows
    alike = shapes.groupBy("root", "suffix", cost.alias("cost"), absolute.alias("at")).agg(F.min(F.struct("pos"))["pos"].alias("pos"))
    held = F.array_sort(F.collect_list(F.struct("pos", "cost", "at")))
    root, suffix = shape_key(F.col("label"))
    labels = events.select("label").distinct().withColumn("root", root).withColumn("suffix", suffix)
    known = share(labels.join(alike.groupBy("root", "suffix").agg(held.alias("shapes")), ["root", "suffix"]).select("label", "shapes"))
    played = share(events.join(known.select("label"), "label", "left_semi").select("track_id", "start", "event", "label"))
    used = played.groupBy("track_id", "label").agg(F.count("*").alias("uses"), F.min(F.struct("start", "event")).alias("first"))
    after = transitions(played, chunk).groupBy("track_id", "label").agg(F.collect_list(F.struct("next_label", "times")).alias("after"))
    # the shapes join when a track's rows are together: moved with every row they would outweigh all else
    together = used.join(after, ["track_id", "label"], "left").repartition("track_id")
    rows = together.join(F.broadcast(known), "label")
    rows = rows.select("track_id", "label", "uses", F.col("first.start").alias("start"), F.col("first.event").alias("event"), "shapes", "after")
    track, label, event = (rows.schema[c].dataType.simpleString() for c in ("track_id", "label", "event"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "event"]).reset_index(drop=True)
        place = {name: i for i, name in enumerate(pdf["label"])}
        costs = [np.array([s["cost"] for s in row]) * n for row, n in zip(pdf["shapes"], pdf["uses"])]
        frets = [np.array([s["at"] for s in row]) for row in pdf["shapes"]]
        near: list[dict] = [{} for _ in place]
        for i, row in enumerate(pdf["after"]):
            for x in row if row is not None else []:
                j = place[x["next_label"]]
                if i != j:
                    near[i][j] = near[i].get(j, 0) + x["times"]
                    near[j][i] = near[j].get(i, 0) + x["times"]
        choice, turn, changed = [int(np.argmin(np.round(c, 9))) for c in costs], 0, True
        while changed and turn < passes:
            changed, turn = False, turn + 1
            for i, own in enumerate(frets):
                total = costs[i].copy()
                for j, times in near[i].items():
                    other = frets[j][choice[j]]
                    total += 0.1 * times * np.where((own >= 0) & (other >= 0), np.abs(own - other), 0).sum(axis=1)
                best_ = int(np.argmin(np.round(total, 9)))
                changed, choice[i] = changed or best_ != choice[i], best_
        pos = [row[c]["pos"] for row, c in zip(pdf["shapes"], choice)]
        return pd.DataFrame({"track_id": pdf["track_id"], "label": pdf["label"], "pos": pos, "passes": turn, "converged": not changed})

    return rows.groupBy("track_id").applyInPandas(settle, f"track_id {track}, label {label}, pos int, passes int, converged boolean")


def voicing_cost(events: DataFrame, choice: DataFrame, chunk: float | None) -> DataFrame:
    """The cost of a track's voicings: uses times cost plus a tenth of the movement between neighbours.

    `choice` (label, frets, base_fret, cost), at most one row per label of the vocabulary.
    """
    small = F.broadcast(choice)
    uses = events.join(small, "label").groupBy("track_id").agg(F.sum("cost").alias("shapes"))
    known = events.join(F.broadcast(choice.select("label")), "label", "left_semi")
    t = transitions(known, chunk).join(small, "label")
    t = t.join(F.broadcast(choice.select(F.col("label").alias("next_label"), F.col("frets").alias("n_frets"), F.col("base_fret").alias("n_base"))), "next_label")
    moved = t.groupBy("track_id").agg((0.1 * F.sum(F.col("times") * movement(F.col("frets"), F.col("base_fret"), F.col("n_frets"), F.col("n_base")))).alias("moves"))
    return uses.join(moved, KEYS, "left").select("track_id", (F.col("shapes") + F.coalesce("moves", F.lit(0.0))).alias("cost"))


def place_events(events: DataFrame, bars: DataFrame, slots: int, bucket: float, eps: float = EPS_OVERLAP) -> DataFrame:
    """Each bar's chord starts: events rounded half-even to slots, later ones replacing earlier, and
    slot 0 carried from the last event still sounding. A no-chord event takes its slot and blocks the carry.

    `events` (track_id, event, start, end, label); returns (track_id, bar, slot, event, label).
    """
    n = bars.groupBy("track_id").agg(F.max("bar").alias("last_bar"))
    ev = events.select("track_id", "event", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "label")
    at = point_in_span(ev, bars.select("track_id", "bar", "start", "end"), KEYS, "e_start", "start", "end", bucket, slack=eps)
    at = best(at, ["track_id", "event"], [F.col("bar")])
    raw = F.greatest(F.lit(0), F.bround((F.col("e_start") - F.col("start")) / (F.col("end") - F.col("start")) * slots, 0).cast("int"))
    at = at.withColumn("raw", raw).withColumn("bar", F.when(F.col("raw") >= slots, F.col("bar") + 1).otherwise(F.col("bar")))
    at = at.withColumn("slot", F.when(F.col("raw") >= slots, 0).otherwise(F.col("raw"))).join(n, KEYS).where("bar <= last_bar")
    placed = at.groupBy("track_id", "bar", "slot").agg(F.max_by(F.struct("event", "label", "e_end"), "event").alias("e"))
    line = placed.select("track_id", "bar", F.col("slot").alias("rank"), "e").unionByName(
        bars.select("track_id", "bar", F.lit(-1).alias("rank"), F.lit(None).cast(placed.schema["e"].dataType).alias("e")))
    carried = with_last_known(line, KEYS, ["bar", "rank"], 4096, {"held": "e"}, inclusive=False).where("rank = -1")
    empty = carried.join(placed.where("slot = 0").select("track_id", "bar"), ["track_id", "bar"], "left_anti")
    starts = empty.join(bars.select("track_id", "bar", "start"), ["track_id", "bar"]).where(F.col("held")["e_end"] > F.col("start") + eps)
    carry = starts.select("track_id", "bar", F.lit(0).alias("slot"), F.col("held").alias("e"))
    both = placed.unionByName(carry)
    return both.select("track_id", "bar", "slot", "e.event", "e.label").where(~H.is_no_chord(F.col("label")))


def diagrams(arranged: DataFrame) -> DataFrame:
    """Distinct (name, shape) in first-use order; passing only if every use is, power if any is."""
    d = arranged.groupBy("track_id", "name", "shape").agg(
        F.min("event").alias("first_use"), F.bool_and("passing").alias("passing"), F.bool_or("power").alias("power"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("first_use")))  # a vocabulary's rows


def pickup_column(j: Column, n: Column, k: Column) -> Column:
    """The column full-bar cell j of n maps to when only the last k columns draw."""
    return (n - k + F.floor(j * k / n)).cast("int")


def pickup_slots(pickup: Column, n_beats: Column, numerator: int, slots: Column) -> Column:
    """Columns a short pickup bar draws; null for a full bar."""
    per_beat = F.greatest(F.lit(1), F.floor(slots / numerator))
    return F.when(pickup & (n_beats < numerator), F.greatest(F.lit(1), F.least(slots - 1, n_beats * per_beat))).cast("int")


def fold_repeats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive identical lines as one with a count; `lines` (keys, line, text)."""
    runs = with_runs(lines, keys, ["line"], 4096, "text")
    return runs.groupBy(*keys, "run", "text").agg(F.min("line").alias("line"), F.count("*").alias("times")).drop("run")
