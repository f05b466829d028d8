"""The recall gate: is a section better with the extra onsets than without?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators import quantise as Q, votes as V
from stavework.operators.harmony_spans import merge_onsets
from stavework.params import SIGNAL, SignalParams
from stavework.session import share_rows


def _reading(onsets: DataFrame, bars: DataFrame, bucket: float, name: str) -> DataFrame:
    """Strikes per bar, agreement with the own vote, raw onsets per bar and grid fit, per section.

    The mute rule is left out: the gate judges where strikes land.
    """
    plain = onsets.withColumn("muted", F.lit(False))
    masks = Q.quantise(plain, bars, bucket)
    figures = V.vote_figures(masks, V.section_vote(masks)).select(*V.SECTION, F.col("confidence").alias(f"{name}_agreement"))
    strikes = masks.groupBy(*V.SECTION).agg(F.avg(F.bit_count("strike")).alias(f"{name}_strikes"), F.count("*").alias("n_bars"))
    raw = Q.onset_to_shifted_bar(plain, bars, bucket).groupBy(*V.SECTION).agg(F.count("*").alias(f"{name}_raw"))
    pos = Q.onset_positions(plain, bars, bucket)
    off = F.abs(F.col("pos") - F.floor(F.col("pos") + 0.5))
    fit = pos.groupBy(*V.SECTION).agg(F.avg((off <= SIGNAL.grid_fit_tolerance).cast("double")).alias(f"{name}_fit"))
    out = strikes.join(figures, V.SECTION).join(raw, V.SECTION, "left").join(fit, V.SECTION, "left")
    return out.withColumnRenamed("n_bars", f"{name}_bars")


def gate_sections(
    base: DataFrame, extra: DataFrame, bars: DataFrame, silent: DataFrame, song_fit: DataFrame, radius: float, bucket: float,
    p: SignalParams = SIGNAL,
) -> DataFrame:
    """Per section: accepted, strikes per bar before and after, and the first failing reason.

    `silent` (track_id, bar, silent) marks bars whose extra onsets do not count; `song_fit`
    (track_id, grid_fit).
    """
    bars = share_rows(bars)
    kept = Q.later_bar(Q.onset_to_shifted_bar(extra, bars, bucket)).join(silent.where("not silent"), ["track_id", "bar"], "left_semi")
    usable = extra.join(kept.select("track_id", "onset_id"), ["track_id", "onset_id"], "left_semi")
    union = share_rows(merge_onsets(base, usable, radius))
    before, after = _reading(base, bars, bucket, "b"), _reading(union, bars, bucket, "a")
    d = before.join(after, V.SECTION).join(song_fit, ["track_id"], "left").join(bars.select(*V.SECTION, "width").distinct(), V.SECTION)
    reason = (
        F.when(F.coalesce("b_raw", F.lit(0)) == 0, "no onsets")
        .when(F.col("b_strikes") * F.col("b_bars") >= p.sparse_share * F.col("width") * F.col("b_bars") - 1e-9, "dense")
        .when(F.round(F.col("a_strikes") - F.col("b_strikes"), 9) < p.min_gain, "gain")
        .when(F.round(F.col("a_agreement") - F.col("b_agreement"), 9) < 0, "jaccard")
        .when(F.col("a_raw") / F.col("a_bars") > F.col("width"), "raw")
        .when(F.round(F.coalesce("a_fit", F.lit(0.0)) - F.col("grid_fit") + p.fit_tolerance, 9) < 0, "fit")
        .otherwise("accepted")
    )
    tried = ~F.col("reason").isin("no onsets", "dense")
    return d.withColumn("reason", reason).select(
        *V.SECTION, (F.col("reason") == "accepted").alias("accepted"), F.col("b_strikes").alias("before"),
        F.when(tried, F.col("a_strikes")).otherwise(F.col("b_strikes")).alias("after"), "reason",
    )
