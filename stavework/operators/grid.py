"""The beat grid: gap filling, tempo, octave, downbeat phase, bars, levels and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.operators.intervals import best, within
from stavework.operators.ordered import (
    CHUNK, chunked, exact_median, with_halo, with_last_known, with_neighbour, with_position, with_running_sum, with_runs,
)
from stavework.params import GRID, GridParams
from stavework.session import share

KEYS = ["track_id"]
BAR_CHUNK = 4096


def end_of_clip(beats: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(beats before their track's end, tracks left with fewer than two beats)."""
    kept = beats.join(durations, KEYS).where("t < duration").drop("duration")
    counts = kept.groupBy("track_id").agg(F.count("*").alias("n"))
    few = durations.join(counts, KEYS, "left").select(
        "track_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_beats")
    ).where("n_beats < 2")
    return kept.join(few, KEYS, "left_anti"), few


def intervals(beats: DataFrame, chunk: float | None, tie: str = "event_id") -> DataFrame:
    """Beats with the previous beat's time and the gap to it (null on a track's first beat)."""
    return with_neighbour(beats, KEYS, ["t", tie], chunk, {"prev_t": "t"}).withColumn("gap", F.col("t") - F.col("prev_t"))


def fill_gaps(beats: DataFrame, chunk: float | None, p: GridParams = GRID, tie: str = "event_id") -> DataFrame:
    """Evenly spaced beats where an interval exceeds the local median by the factor.

    The local median reads the interval and up to eight on either side, so the rows are chunked
    by position with an eight-row halo. Where it is zero, as among repeated beats, nothing is filled.
    """
    line = chunked(beats, KEYS, ["t", tie], chunk)
    placed = with_position(intervals(line, chunk, tie), KEYS, ["t", tie], chunk)
    near = Window.partitionBy("track_id", CHUNK).orderBy("pos").rowsBetween(-p.gap_half_window, p.gap_half_window)
    local = (
        with_halo(placed.where("gap is not null"), KEYS, "pos", p.gap_half_window)
        .withColumn("median", F.percentile("gap", 0.5).over(near)).where("_own")
    )
    wide = local.where((F.col("gap") > p.gap_factor * F.col("median")) & (F.col("median") > 0))
    n = F.greatest(F.lit(1), F.bround(F.col("gap") / F.col("median"), 0).cast("int") - 1)
    inserted = (
        wide.withColumn("n", n)
        .select("track_id", "prev_t", "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"))
        .select("track_id", (F.col("prev_t") + F.col("j") * (F.col("gap") / (F.col("n") + 1))).alias("t"),
                F.lit("inserted").alias("origin"))
    )
    return beats.select("track_id", "t", F.lit("detected").alias("origin")).unionByName(inserted)


def tempo(beats: DataFrame, chunk: float | None, tie: str = "event_id") -> DataFrame:
    """60 over the median interval and 60 over the mean interval; tracks with two beats at least."""
    gaps = intervals(beats, chunk, tie).where("gap is not null")
    mean = gaps.groupBy("track_id").agg(F.avg("gap").alias("mean_gap"))
    return exact_median(gaps, KEYS, "gap", "median_gap").join(mean, KEYS).select(
        "track_id", F.try_divide(F.lit(60.0), "median_gap").alias("bpm"),
        F.try_divide(F.lit(60.0), "mean_gap").alias("mean_bpm"), "median_gap",
    )


def modal_phase(downbeats: DataFrame, numerator: int, index: str = "i") -> DataFrame:
    """The most common downbeat index modulo the meter (lowest on a tie) and its share."""
    counts = downbeats.groupBy("track_id", F.pmod(F.col(index), F.lit(numerator)).cast("int").alias("phase")).agg(
        F.count("*").alias("c")
    )
    return counts.groupBy("track_id").agg(
        F.max(F.struct("c", (-F.col("phase")).alias("neg"))).alias("top"), F.sum("c").alias("total")
    ).select("track_id", (-F.col("top.neg")).alias("phase"), (F.col("top.c") / F.col("total")).alias("share"))


def decide_octave(mode: Column, bpm: Column, ratio: Column, silent: Column) -> Column:
    halves = (bpm > 140) & (bpm / 2).between(60, 95) & (silent | ratio.isNull() | (ratio < 1))
    return F.when(mode != "auto", mode).when(halves, F.lit("half")).otherwise(F.lit("none"))


def nearest_beats(beats: DataFrame, downbeats: DataFrame, p: GridParams = GRID) -> DataFrame:
    """Distinct beat indices nearest to a downbeat within the tolerance."""
    pairs = within(
        downbeats.select("track_id", "d_id", "d"), beats.select("track_id", "i", "t"), KEYS, "d", "t",
        p.downbeat_tolerance, "inner",
    )
    near = best(pairs, ["track_id", "d_id"], [F.abs(F.col("t") - F.col("d")), F.col("i")])
    return near.select("track_id", "i").distinct()


def double_beats(beats: DataFrame, chunk: float | None, tie: str = "event_id") -> DataFrame:
    """Beats and the midpoints between neighbours, with their new index."""
    nxt = with_neighbour(chunked(beats, KEYS, ["t", tie], chunk), KEYS, ["t", tie], chunk, {"next_t": "t"}, ahead=True)
    nxt = with_position(nxt, KEYS, ["t", tie], chunk, "i")
    own = nxt.select("track_id", (F.col("i") * 2).alias("i"), "t")
    mid = nxt.where("next_t is not null").select(
        "track_id", (F.col("i") * 2 + 1).alias("i"), ((F.col("t") + F.col("next_t")) / 2).alias("t")
    )
    return own.unionByName(mid)


LONG_RUN = 65536  # longer runs of close points are followed by pointers instead of folded in a row


def thin(points: DataFrame, keys: Sequence[str], x: str, gap: float, chunk: float | None, long_run: int = LONG_RUN) -> DataFrame:
    """Greedy thinning: keep the first point, then each point at least `gap` after the last kept.

    A point that far from its predecessor is always kept, so a track falls apart into runs of close
    points that are thinned independently: short runs in one row each, long ones by doubling pointers.
    Both compare a point with `last + gap`, so the two agree on points that lie exactly there.
    """
    near = with_neighbour(chunked(points, keys, [x], chunk), keys, [x], chunk, {"_prev": x})
    starts = F.when(F.col("_prev").isNull() | (F.col(x) >= F.col("_prev") + gap), 1).otherwise(0)
    runs = share(with_running_sum(near, keys, [x], chunk, {"_run": starts}).drop(CHUNK))
    by = [*keys, "_run"]
    sizes = runs.groupBy(*by).agg(F.count("*").alias("_size"))
    long_ = sizes.where(F.col("_size") > long_run).select(*by)
    folded = runs.join(sizes.where(F.col("_size") <= long_run).select(*by), by, "left_semi").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.col(x).cast("double"))).alias("_xs"))
    kept = F.aggregate(
        "_xs", F.array().cast("array<double>"),
        lambda acc, v: F.when((F.size(acc) == 0) | (v >= F.element_at(acc, -1) + gap), F.concat(acc, F.array(v))).otherwise(acc),
    )
    out = folded.select(*keys, F.explode(kept).alias(x))
    if long_.isEmpty():
        return out
    return out.unionByName(_follow(runs.join(long_, by, "left_semi").select(*by, F.col(x).cast("double").alias("x")), by, gap, chunk).select(*keys, F.col("x").alias(x)))


def _follow(points: DataFrame, by: Sequence[str], gap: float, chunk: float | None) -> DataFrame:
    """The points reached from each run's first by jumping to the first point `gap` further on.

    Jumps double every round, so a run of n kept points takes log2(n) rounds of two joins.
    """
    line = points.select(*by, (F.col("x") + gap).alias("at"), F.lit(0).alias("kind"), F.col("x").alias("src"), F.lit(None).cast("double").alias("hit")).unionByName(
        points.select(*by, F.col("x").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("src"), F.col("x").alias("hit")))
    found = with_last_known(line, by, ["at", "kind"], chunk, {"hit": "hit"}, ahead=True).where("kind = 0 and hit is not null")
    jump = share(found.select(*by, F.col("src").alias("x"), "hit"))
    kept = share(points.groupBy(*by).agg(F.min("x").alias("x")))
    while True:
        new = kept.join(jump, [*by, "x"]).select(*by, F.col("hit").alias("x")).join(kept, [*by, "x"], "left_anti")
        new = share(new.distinct())
        if new.isEmpty():
            break
        kept = share(kept.unionByName(new))
        then = jump.select(*by, F.col("hit").alias("hit2"), F.col("x").alias("hit"))
        jump = share(jump.join(then, [*by, "hit"]).select(*by, "x", F.col("hit2").alias("hit")))
    return kept


def normalise_octave(beats: DataFrame, downbeats: DataFrame, target_period: float, chunk: float | None, tol: float = 0.75) -> DataFrame:
    """Beats kept when every beat closer than tol * period to the last kept one is dropped.

    `beats` has (track_id, i, t), `downbeats` (track_id, i). A leading run of fast beats starts
    on the parity most of its downbeats have. Returns the kept beats with their new index.
    """
    gap = tol * target_period
    nxt = with_neighbour(beats, KEYS, ["t"], chunk, {"next_t": "t"}, ahead=True)
    first_slow = nxt.where(F.col("next_t").isNull() | (F.col("next_t") - F.col("t") >= gap)).groupBy("track_id").agg(
        F.min("i").alias("fast_end")
    )
    lead = downbeats.join(first_slow, KEYS).where("i <= fast_end and fast_end > 1").groupBy("track_id").agg(
        F.count_if(F.col("i") % 2 == 1).alias("odd"), F.count_if(F.col("i") % 2 == 0).alias("even")
    )
    started = beats.join(lead, KEYS, "left").where(F.col("i") >= F.when(F.col("odd") > F.col("even"), 1).otherwise(0))
    started = share(chunked(started, KEYS, ["t"], chunk)) if chunk else chunked(started, KEYS, ["t"], chunk)
    kept = thin(started.select("track_id", "t", CHUNK), KEYS, "t", gap, chunk)
    # a time is held by one beat here: beats are strictly increasing
    back = started.select("track_id", "i", "t").join(kept, ["track_id", "t"])
    flags = downbeats.select("track_id", "i", F.lit(True).alias("is_downbeat")).distinct()
    return with_position(back, KEYS, ["t"], chunk, "new_i").join(flags, ["track_id", "i"], "left").select(
        "track_id", "i", "new_i", "t", F.coalesce("is_downbeat", F.lit(False)).alias("is_downbeat")
    )


def build_bars(beats: DataFrame, phases: DataFrame, durations: DataFrame, medians: DataFrame, numerator: int) -> DataFrame:
    """Bars of `numerator` beats from the phase; earlier beats form a pickup bar 0.

    `beats` (track_id, i, t). The last bar ends one median beat after the last beat, at most at the
    clip's end.
    """
    counts = beats.groupBy("track_id").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))
    dims = counts.join(phases.select("track_id", "phase"), KEYS, "left").join(durations, KEYS).join(medians, KEYS, "left")
    dims = dims.withColumn("phase", F.least(F.coalesce("phase", F.lit(0)), F.col("n") - 1).cast("int")).withColumn(
        "final_end", F.when(F.col("n") >= 2, F.least("duration", F.col("last_t") + F.col("median_gap"))).otherwise(F.col("duration"))
    )
    full = F.floor((F.col("i") - F.col("phase")) / numerator) + F.when(F.col("phase") > 0, 1).otherwise(0)
    placed = beats.join(dims.select("track_id", "phase", "final_end"), KEYS)
    placed = placed.withColumn("bar", F.when(F.col("i") < F.col("phase"), F.lit(0)).otherwise(full).cast("int"))
    grouped = placed.groupBy("track_id", "bar").agg(
        F.min("t").alias("start"), F.min("i").alias("first_beat"), F.count("*").alias("n_beats"),
        F.first("phase").alias("phase"), F.first("final_end").alias("final_end"),
    )
    ended = with_neighbour(grouped, KEYS, ["bar"], BAR_CHUNK, {"next_start": "start"}, ahead=True)
    return ended.select(
        "track_id", "bar", "start", F.coalesce("next_start", "final_end").alias("end"), "first_beat", "n_beats",
        ((F.col("bar") == 0) & (F.col("phase") > 0)).alias("pickup"),
    )


def bar_change(beats: DataFrame, phase: Column, numerator: int, chroma: str = "chroma") -> DataFrame:
    """Mean cosine distance between adjacent bars' mean chroma, for bars starting at `phase`.

    `beats` carries a 12-vector per beat; used to settle a near tie between two phases.
    """
    number = F.floor((F.col("i") - phase) / numerator)
    pcs = beats.where(F.col("i") >= phase).select("track_id", number.alias("bar"), F.posexplode(chroma).alias("pc", "v"))
    mean = pcs.groupBy("track_id", "bar", "pc").agg(F.avg("v").alias("v"))
    unit = mean.groupBy("track_id", "bar").agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) + 1e-9).alias("norm"))
    scaled = mean.join(unit, ["track_id", "bar"]).withColumn("v", F.col("v") / F.col("norm"))
    after = scaled.select("track_id", (F.col("bar") - 1).alias("bar"), "pc", F.col("v").alias("w"))
    dots = scaled.join(after, ["track_id", "bar", "pc"]).groupBy("track_id", "bar").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dots.groupBy("track_id").agg(F.avg(1 - F.col("dot")).alias("change"))


def choose_phase(beats: DataFrame, downbeats: DataFrame, numerator: int, p: GridParams = GRID) -> DataFrame:
    """The modal phase; when the second count is near the first, the phase whose bars change more."""
    counts = downbeats.groupBy("track_id", F.pmod(F.col("i"), F.lit(numerator)).cast("int").alias("phase")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("track_id").orderBy(F.col("c").desc(), "phase")  # at most `numerator` rows
    top = counts.withColumn("r", F.row_number().over(order)).where("r <= 2")
    top = top.groupBy("track_id").agg(
        F.max(F.when(F.col("r") == 1, F.struct("phase", "c"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("phase", "c"))).alias("b")
    )
    close = top.where(F.col("b.c") >= p.near_tie * F.col("a.c"))
    lo, hi = F.least("a.phase", "b.phase"), F.greatest("a.phase", "b.phase")
    tied = beats.join(close.select("track_id", lo.alias("lo"), hi.alias("hi")), KEYS)
    first = bar_change(tied, F.col("lo"), numerator).withColumnRenamed("change", "c_lo")
    second = bar_change(tied, F.col("hi"), numerator).withColumnRenamed("change", "c_hi")
    out = top.join(close.select("track_id", lo.alias("lo"), hi.alias("hi")), KEYS, "left").join(first, KEYS, "left").join(second, KEYS, "left")
    higher = F.round(F.coalesce("c_hi", F.lit(0.0)), 9) > F.round(F.coalesce("c_lo", F.lit(0.0)), 9)
    return out.select(
        "track_id",
        F.when(F.col("lo").isNull(), F.col("a.phase")).when(higher, F.col("hi")).otherwise(F.col("lo")).alias("phase"),
        F.col("lo").isNotNull().alias("near_tie"),
    )


def beat_positions(beats: DataFrame, bars: DataFrame, numerator: int) -> DataFrame:
    """1-based place of each beat in its bar; a short pickup is numbered from the bar's end."""
    b = bars.select("track_id", "bar", "first_beat", "n_beats", "pickup")
    short = F.when(F.col("pickup"), F.greatest(F.lit(0), numerator - F.col("n_beats"))).otherwise(0)
    return beats.join(b, ["track_id", "bar"]).select(
        "track_id", "i", "t", "bar", (F.col("i") - F.col("first_beat") + 1 + short).cast("int").alias("position")
    )


def backbeat_ratio(beats: DataFrame, frames: DataFrame, numerator: int, chunk: float | None, peak: int = 2) -> DataFrame:
    """Mean peak flux on the backbeats over the mean on the strong beats; null under eight beats.

    `frames` (track_id, t, flux); a beat reads the peak of the frames around the first one at or
    after it, 0 past the last. The peak is a five-row frame, taken with a halo before the as-of step.
    """
    placed = with_position(frames, KEYS, ["t"], chunk)
    near = Window.partitionBy("track_id", CHUNK).orderBy("pos").rowsBetween(-peak, peak)
    peaks = with_halo(placed, KEYS, "pos", peak).withColumn("peak", F.max("flux").over(near)).where("_own")
    line = beats.select("track_id", "t", F.lit(0).alias("kind"), "i", F.lit(None).cast("double").alias("peak")).unionByName(
        peaks.select("track_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i"), "peak")
    )
    at = with_last_known(line, KEYS, ["t", "kind", "i"], chunk, {"peak": "peak"}, ahead=True).where("kind = 0")
    place = F.col("i") % numerator
    back = place.isin(1, 2) if numerator == 3 else place.isin(1, 3)
    strong = place == 0 if numerator == 3 else place.isin(0, 2)
    value = F.coalesce("peak", F.lit(0.0))
    return at.groupBy("track_id").agg(
        F.count("*").alias("n"), F.avg(F.when(back, value)).alias("back"), F.avg(F.when(strong, value)).alias("strong")
    ).select(
        "track_id", F.when((F.col("n") >= 8) & (F.col("strong") > 0), F.col("back") / F.col("strong")).alias("ratio")
    )


def level_db(sumsq: Column, n: Column) -> Column:
    """20 log10 of the RMS, floored at -120 dB."""
    rms = F.sqrt(F.coalesce(F.try_divide(sumsq, n), F.lit(0.0)))
    return 20.0 * F.log10(F.greatest(rms, F.lit(1e-6)))


def vocal_flags(levels: DataFrame, p: GridParams = GRID) -> DataFrame:
    """True where a bar is within 12 dB of the track's median audible level, smoothed over three bars."""
    audible = levels.where(F.col("db") > p.vocal_audible_db)
    med = exact_median(audible, KEYS, "db", "median_db")
    raw = levels.join(med, KEYS, "left").withColumn(
        "raw", F.col("median_db").isNull() | (F.col("db") >= F.col("median_db") - p.vocal_below_median_db)
    ).drop("median_db")
    near = with_neighbour(raw, KEYS, ["bar"], BAR_CHUNK, {"before": "raw"})
    near = with_neighbour(near, KEYS, ["bar"], BAR_CHUNK, {"after": "raw"}, ahead=True)
    votes = F.col("before").cast("int") + F.col("raw").cast("int") + F.col("after").cast("int")
    edge = F.col("before").isNull() | F.col("after").isNull()
    return near.select("track_id", "bar", F.when(edge, F.col("raw")).otherwise(votes >= 2).alias("vocal"))


def flag_runs(flags: DataFrame, flag: str, wanted: bool, min_bars: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of consecutive bars holding `wanted`, at least `min_bars` long, as [start, end)."""
    runs = with_runs(flags, keys, ["bar"], BAR_CHUNK, flag)
    return runs.where(F.col(flag) == F.lit(wanted)).groupBy(*keys, "run").agg(
        F.min("bar").alias("start_bar"), (F.max("bar") + 1).alias("end_bar")
    ).where(F.col("end_bar") - F.col("start_bar") >= min_bars).drop("run")


def vocal_runs(flags: DataFrame, p: GridParams = GRID) -> DataFrame:
    """Non-vocal runs; `trailing` when fewer than four bars follow."""
    size = flags.groupBy("track_id").agg((F.max("bar") + 1).alias("n_bars"))
    return flag_runs(flags, "vocal", False, p.vocal_run_min_bars).join(size, KEYS).select(
        "track_id", "start_bar", "end_bar", (F.col("n_bars") - F.col("end_bar") < p.vocal_run_min_bars).alias("trailing")
    )


def run_collapse(spans: DataFrame, order: Sequence[str], chunk: float | None, label: str = "label", share: str = "share") -> DataFrame:
    """Consecutive equal labels merged; the share is the plain mean over the run."""
    return with_runs(spans, KEYS, order, chunk, label).groupBy("track_id", "run", label).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.avg(share).alias("share"), F.count("*").alias("n")
    )


def cluster_boundaries(clusters: DataFrame, min_bars: int) -> DataFrame:
    """Segments from per-bar cluster ids: short runs merge forward, a short tail folds back, then
    equal neighbours merge. A run end closes a segment when it lies `min_bars` after the last
    close, which is `thin` over the run ends."""
    size = clusters.groupBy("track_id").agg((F.max("bar") + 1).alias("n_bars"))
    nxt = with_neighbour(clusters, KEYS, ["bar"], BAR_CHUNK, {"next_c": "cluster"}, ahead=True)
    ends = nxt.where(F.col("next_c").isNull() | (F.col("next_c") != F.col("cluster"))).select(
        "track_id", (F.col("bar") + 1).cast("double").alias("x")
    )
    zero = size.select("track_id", F.lit(0.0).alias("x"))
    points = share(zero.unionByName(ends))
    closes = share(thin(points, KEYS, "x", float(min_bars), BAR_CHUNK).where("x > 0"))
    first = with_neighbour(closes, KEYS, ["x"], BAR_CHUNK, {"start": "x"}).select(
        "track_id", F.coalesce("start", F.lit(0.0)).alias("start"), F.col("x").alias("end"), (F.col("x") - 1).alias("bar")
    )
    # a track with no close at all is one segment under its last id; a short tail joins the last close
    lone = size.join(first.select("track_id").distinct(), KEYS, "left_anti").select(
        "track_id", F.lit(0.0).alias("start"), F.col("n_bars").cast("double").alias("end"), (F.col("n_bars") - 1).cast("double").alias("bar")
    )
    segs = share(first.unionByName(lone)).join(clusters.select("track_id", "bar", "cluster"), ["track_id", "bar"])
    runs = with_runs(segs, KEYS, ["start"], BAR_CHUNK, "cluster").groupBy("track_id", "run", "cluster").agg(F.min("start").alias("start_bar"))
    ended = with_neighbour(runs, KEYS, ["start_bar"], BAR_CHUNK, {"e": "start_bar"}, ahead=True).join(size, KEYS)
    return ended.select(
        "track_id", F.col("start_bar").cast("int"), F.coalesce(F.col("e").cast("int"), F.col("n_bars")).alias("end_bar"), "cluster"
    )


def trailing_silent_bars(events: DataFrame, bars: DataFrame, caps: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Whole bars at a track's end that start after its last chord, at most the last section less one."""
    last = events.where("label <> 'N'").groupBy("track_id").agg(F.max("end").alias("last_end"))
    late = bars.join(last, KEYS).where(F.col("start") >= F.col("last_end") - eps).groupBy("track_id").agg(F.count("*").alias("n"))
    return caps.join(late, KEYS, "left").select(
        "track_id", F.least(F.coalesce("n", F.lit(0)), F.greatest(F.col("cap") - 1, F.lit(0))).cast("long").alias("drop")
    )
