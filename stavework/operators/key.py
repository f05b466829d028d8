"""The key from the chord stream: tonic by score, pair rule and mix; mode from the chroma.

Chord time is folded to at most 12 roots x a few triads per track before anything else, so
every window below sees a handful of rows per track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.functions import keys as K
from stavework.functions.harte import spelled
from stavework.params import HARMONY, HarmonyParams

KEYS = ["track_id"]


def _whole():
    return Window.partitionBy("track_id")


def profiles(spark: SparkSession) -> DataFrame:
    """The 24 rotated profiles, 288 rows whatever the data (broadcast)."""
    rows = [
        (mode, tonic, (pc + tonic) % 12, profile[pc])
        for mode, profile in (("major", K.MAJOR), ("minor", K.MINOR)) for tonic in range(12) for pc in range(12)
    ]
    return F.broadcast(spark.createDataFrame(rows, "mode string, tonic int, pc int, w double"))


def correlations(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson of each 12-bin vector (long form: keys, pc, v) with the 24 profiles; 0 when flat."""
    j = vectors.join(profiles(vectors.sparkSession), "pc")
    s = j.groupBy(*keys, "mode", "tonic").agg(
        F.sum("v").alias("x"), F.sum("w").alias("y"), F.sum(F.col("v") * F.col("w")).alias("xy"),
        F.sum(F.col("v") * F.col("v")).alias("xx"), F.sum(F.col("w") * F.col("w")).alias("yy"),
        F.max("v").alias("hi"), F.min("v").alias("lo"),
    )
    cov = F.col("xy") - F.col("x") * F.col("y") / 12
    var = (F.col("xx") - F.col("x") * F.col("x") / 12) * (F.col("yy") - F.col("y") * F.col("y") / 12)
    corr = F.when((F.col("hi") <= F.col("lo")) | (var <= 0), F.lit(0.0)).otherwise(cov / F.sqrt(var))
    return s.select(*keys, "mode", "tonic", corr.alias("corr"))


def estimate_key(corr: DataFrame, keys: list[str]) -> DataFrame:
    """The best of the 24 profiles (major first, lower tonic first on a tie) and its margin ratio."""
    order = F.struct(-F.round("corr", 9), F.when(F.col("mode") == "major", 0).otherwise(1), F.col("tonic"))
    w = Window.partitionBy(*keys).orderBy(order)  # 24 rows
    top = corr.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("r") == 1, F.struct("tonic", "mode", "corr"))).alias("a"),
        F.max(F.when(F.col("r") == 2, F.col("corr"))).alias("second"),
    )
    conf = F.when(F.col("a.corr") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a.corr") - F.col("second")) / F.col("a.corr"))))
    return top.select(*keys, "a.tonic", "a.mode", F.coalesce(conf, F.lit(0.0)).alias("confidence"))


def mode_at(corr: DataFrame, keys: list[str]) -> DataFrame:
    """Per tonic: the sign of major minus minor and its size."""
    both = corr.groupBy(*keys, "tonic").agg(
        F.sum(F.when(F.col("mode") == "major", F.col("corr")).otherwise(-F.col("corr"))).alias("diff"), F.max("corr").alias("fit")
    )
    return both.select(*keys, "tonic", F.when(F.round("diff", 9) >= 0, "major").otherwise("minor").alias("mode"),
                       F.abs("diff").alias("mode_margin"), "fit")


def root_time(chords: DataFrame) -> DataFrame:
    """Chord time per root and triad (no-chord events left out)."""
    held = chords.where("pc is not null and dur > 0").groupBy("track_id", "pc", "triad_q", "plain").agg(F.sum("dur").alias("dur"))
    return held


def section_endings(events: DataFrame) -> DataFrame:
    """Sections per root whose last event has that root; a no-chord ending counts for none."""
    last = events.where("section is not null").groupBy("track_id", "section").agg(F.max_by(F.struct("pc"), "event").alias("e"))
    return last.where("e.pc is not null").groupBy("track_id", F.col("e.pc").alias("pc")).agg(F.count("*").alias("endings"))


def final_run(events: DataFrame) -> DataFrame:
    """The root of the last chord and the time its last unbroken run of events holds."""
    chords = events.where("pc is not null and dur > 0").select("track_id", "event", "pc", "dur")
    last = chords.groupBy("track_id").agg(F.max_by("pc", "event").alias("final_pc"))
    same = chords.join(last, KEYS)
    broken = same.groupBy("track_id").agg(F.max(F.when(F.col("pc") != F.col("final_pc"), F.col("event"))).alias("broken_at"))
    return same.join(broken, KEYS).where("broken_at is null or event > broken_at").groupBy("track_id", "final_pc").agg(
        F.sum("dur").alias("held")
    )


def tonic_scores(events: DataFrame, bar_length: DataFrame, n_sections: DataFrame, p: HarmonyParams = HARMONY) -> DataFrame:
    """Per root: its share of chord time plus the final-chord and section-ending bonuses.

    Roots under the share floor are dropped before the bonuses; a track left with none scores all.
    """
    times = root_time(events).groupBy("track_id", "pc").agg(F.sum("dur").alias("dur"))
    shares = times.withColumn("share", F.col("dur") / F.sum("dur").over(_whole()))
    shares = shares.withColumn("any_big", F.max(F.col("share") >= p.tonic_min_share).over(_whole()))
    kept = shares.where((F.col("share") >= p.tonic_min_share) | ~F.col("any_big"))
    out = (
        kept.join(final_run(events), KEYS).join(bar_length, KEYS, "left").join(n_sections, KEYS, "left")
        .join(section_endings(events), ["track_id", "pc"], "left")
    )
    final = (F.col("pc") == F.col("final_pc")) & (F.col("held") >= F.coalesce("bar_length", F.lit(0.0)) - 1e-9)
    bonus = F.when(final, p.final_chord_bonus).otherwise(0.0)
    ends = F.coalesce(p.section_end_weight * F.try_divide(F.coalesce("endings", F.lit(0)), "n_sections"), F.lit(0.0))
    return out.select("track_id", "pc", "share", (F.col("share") + bonus + ends).alias("score"))


def set_shares(events: DataFrame) -> DataFrame:
    """Per track and candidate tonic: the diatonic share of its major set and of its better pair."""
    degree = F.create_map(*[F.lit(x) for kv in K.DIATONIC.items() for x in kv])
    times = root_time(events).groupBy("track_id", "pc", "triad_q").agg(F.sum("dur").alias("dur"))
    spread = times.withColumn("total", F.sum("dur").over(_whole())).withColumn(
        "tonic", F.explode(F.sequence(F.lit(0), F.lit(11)))
    )
    wanted = F.try_element_at(degree, F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)).cast("int"))
    credit = F.when(wanted.isNull(), 0.0).when(wanted == F.col("triad_q"), 1.0).otherwise(0.5)
    major = spread.groupBy("track_id", "tonic").agg((F.sum(F.col("dur") * credit) / F.first("total")).alias("set_share"))
    up = major.select("track_id", F.pmod(F.col("tonic") - 3, F.lit(12)).cast("int").alias("tonic"), F.col("set_share").alias("relative_share"))
    return major.join(up, ["track_id", "tonic"]).withColumn("pair_share", F.greatest("set_share", "relative_share"))


def best_major_set(shares: DataFrame) -> DataFrame:
    return shares.groupBy("track_id").agg(
        F.max(F.struct(F.round("set_share", 9).alias("r"), (-F.col("tonic")).alias("n"), "set_share")).alias("b")
    ).select("track_id", (-F.col("b.n")).alias("set_tonic"), F.col("b.set_share").alias("set_share_best"))


def top2(values: DataFrame, value: str, name: str = "pc") -> DataFrame:
    """The winner, its margin over the runner-up and the runner-up; a sole entry's margin is its value."""
    w = Window.partitionBy("track_id").orderBy(F.round(value, 9).desc(), name)  # at most 12 rows
    ranked = values.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    t = ranked.groupBy("track_id").agg(
        F.max(F.when(F.col("_r") == 1, F.struct(name, value))).alias("a"), F.max(F.when(F.col("_r") == 2, F.struct(name, value))).alias("b")
    )
    return t.select("track_id", F.col(f"a.{name}").alias("winner"),
                    (F.col(f"a.{value}") - F.coalesce(f"b.{value}", F.lit(0.0))).alias("margin"), F.col(f"b.{name}").alias("runner_up"))


def pair_rule(cands: DataFrame, p: HarmonyParams = HARMONY) -> DataFrame:
    """Winner by pair share; shares within the tie band of the best go to the better profile fit.

    `cands` (track_id, pc, pair_share, fit).
    """
    tied = cands.withColumn("_best", F.max("pair_share").over(_whole())).withColumn(
        "_w", F.max(F.when(F.round(F.col("_best") - F.col("pair_share"), 9) < p.pair_tie,
                           F.struct(F.round("fit", 9), F.round("pair_share", 9), -F.col("pc")))).over(_whole())
    ).withColumn("winner", -F.col("_w")["col3"])
    t = tied.groupBy("track_id", "winner").agg(
        F.max(F.when(F.col("pc") == F.col("winner"), F.col("pair_share"))).alias("ws"),
        F.max(F.when(F.col("pc") != F.col("winner"), F.struct(F.round("pair_share", 9).alias("r"), (-F.col("pc")).alias("n"), "pair_share"))).alias("o"),
    )
    return t.select("track_id", "winner", F.when(F.col("o").isNull(), F.col("ws")).otherwise(F.abs(F.col("ws") - F.col("o.pair_share"))).alias("margin"),
                    (-F.col("o.n")).alias("runner_up"))


def tonic_chord_mode(events: DataFrame) -> DataFrame:
    """Per root: the quality (major or minor triads) holding more of its time; null on a tie."""
    t = root_time(events).groupBy("track_id", F.col("pc").alias("tonic")).agg(
        F.sum(F.when(F.col("triad_q") == "maj", F.col("dur")).otherwise(0.0)).alias("major"),
        F.sum(F.when(F.col("triad_q") == "min", F.col("dur")).otherwise(0.0)).alias("minor"),
    )
    return t.select("track_id", "tonic", F.when(F.col("major") > F.col("minor"), "major").when(F.col("minor") > F.col("major"), "minor").alias("chord_mode"))


def decide_key(
    events: DataFrame, bar_length: DataFrame, n_sections: DataFrame, corr: DataFrame, mix: DataFrame, p: HarmonyParams = HARMONY
) -> DataFrame:
    """Tonic by two of three votes, the set veto, the mode and the hedge; one row per track.

    `corr` holds the profile correlations of the track's chroma, `mix` (track_id, mix_tonic, mix_mode,
    mix_confidence) the whole-mix estimate that stands when a track has too few chords.
    """
    modes = mode_at(corr, KEYS)
    shares = set_shares(events)
    scores = tonic_scores(events, bar_length, n_sections, p)
    cands = scores.join(
        shares.join(modes.select("track_id", "tonic", "fit"), ["track_id", "tonic"]).withColumnRenamed("tonic", "pc"), ["track_id", "pc"]
    )
    score = top2(scores, "score").select("track_id", F.col("winner").alias("score_tonic"), F.col("margin").alias("score_margin"), F.col("runner_up").alias("score_runner"))
    pair = pair_rule(cands, p).select("track_id", F.col("winner").alias("pair_tonic"), F.col("margin").alias("pair_margin"))
    near = pair_rule(cands.withColumn("_top", F.max("score").over(_whole())).where(F.round(F.col("_top") - F.col("score"), 9) < p.key_tie_margin).drop("_top"), p)
    near = near.select("track_id", F.col("winner").alias("near_tonic"), F.col("margin").alias("near_margin"), F.col("runner_up").alias("near_runner"))
    count = events.where("pc is not null and dur > 0").groupBy("track_id").agg(F.count("*").alias("n_chords"))
    d = mix.join(count, KEYS, "left").join(score, KEYS, "left").join(pair, KEYS, "left").join(near, KEYS, "left").join(best_major_set(shares), KEYS, "left")
    stands = F.coalesce("n_chords", F.lit(0)) < p.min_chord_events
    close = F.col("score_runner").isNotNull() & (F.round("score_margin", 9) < p.key_tie_margin)
    agree = F.col("pair_tonic") == F.col("score_tonic")
    by = (
        F.when(stands, F.lit(None).cast("string")).when(close, "pair rule").when(agree, "agreement")
        .when((F.col("mix_tonic") == F.col("score_tonic")) | (F.col("mix_tonic") == F.col("pair_tonic")), "mix").otherwise("score")
    )
    d = d.withColumn("by", by)
    to_pair = (F.col("by") == "mix") & (F.col("mix_tonic") == F.col("pair_tonic"))
    d = d.withColumn("t0", F.when(F.col("by") == "pair rule", F.col("near_tonic")).when(to_pair, F.col("pair_tonic")).otherwise(F.col("score_tonic")))
    d = d.withColumn("m0", F.when(F.col("by") == "pair rule", F.col("near_margin")).otherwise(F.col("score_margin")))
    d = d.withColumn("r0", F.when(F.col("by") == "pair rule", F.col("near_runner")).when(to_pair, F.col("score_tonic")).otherwise(F.col("score_runner")))
    d = d.join(shares.select("track_id", F.col("tonic").alias("t0"), F.col("pair_share").alias("set_share_decided")), ["track_id", "t0"], "left")
    veto = F.col("by").isNotNull() & (F.round(F.col("set_share_best") - F.col("set_share_decided"), 9) >= p.set_veto_margin)
    d = d.withColumn("veto", F.coalesce(veto, F.lit(False)))
    d = d.select(
        "track_id", "mix_tonic", "mix_mode", "mix_confidence", "score_tonic", "pair_tonic", "pair_margin", "set_tonic", "set_share_best", "set_share_decided",
        F.when(F.col("veto"), "set").otherwise(F.col("by")).alias("decided_by"),
        F.when(F.col("by").isNull(), F.col("mix_tonic")).when(F.col("veto"), F.col("set_tonic")).otherwise(F.col("t0")).alias("tonic"),
        F.when(F.col("by").isNull(), F.lit(None)).when(F.col("veto"), F.col("set_share_best") - F.col("set_share_decided")).otherwise(F.col("m0")).alias("margin"),
        F.when(~F.col("veto") & F.col("by").isNotNull(), F.col("r0")).alias("runner_up"),
    )
    named = modes.join(tonic_chord_mode(events), ["track_id", "tonic"], "left").select(
        "track_id", "tonic", "mode_margin",
        F.when(F.round("mode_margin", 9) < p.mode_tie_margin, F.coalesce("chord_mode", "mode")).otherwise(F.col("mode")).alias("mode"),
    )
    d = d.join(named, ["track_id", "tonic"], "left")
    d = d.withColumn("mode", F.when(F.col("decided_by").isNull(), F.col("mix_mode")).otherwise(F.col("mode")))
    d = d.withColumn("confidence", F.when(F.col("decided_by").isNull(), F.col("mix_confidence")).otherwise(F.col("mode_margin")))
    return hedge(d, named, p)


def hedge(d: DataFrame, named: DataFrame, p: HarmonyParams = HARMONY) -> DataFrame:
    """The other key a hedged key names, by four rungs, dropped when unrelated on a clear margin."""
    is_close = F.coalesce(F.round("margin", 9) < p.key_hedge_margin, F.lit(False))
    loser = F.when(F.col("decided_by").isin("mix", "score"),
                   F.when(F.col("tonic") == F.col("score_tonic"), F.col("pair_tonic")).otherwise(F.col("score_tonic")))
    loser = F.when(loser != F.col("tonic"), loser)
    mix = F.when(F.col("decided_by").isNotNull() & (F.col("mix_tonic") != F.col("tonic")), F.col("mix_tonic"))
    source = (
        F.when(F.col("decided_by") == "set", "set").when(is_close & F.col("runner_up").isNotNull(), "runner_up")
        .when(loser.isNotNull(), "chord rule").when(mix.isNotNull(), "mix")
    )
    d = d.withColumn("_source", source).withColumn("_close", is_close)
    other = (
        F.when(F.col("_source") == "set", K.relative_pc(F.col("tonic"), F.col("mode"))).when(F.col("_source") == "runner_up", F.col("runner_up"))
        .when(F.col("_source") == "chord rule", loser).when(F.col("_source") == "mix", mix)
    )
    d = d.withColumn("_other", other.cast("int"))
    theirs = named.select("track_id", F.col("tonic").alias("_other"), F.col("mode").alias("_their_mode"))
    d = d.join(theirs, ["track_id", "_other"], "left").withColumn(
        "_hmode", F.when(F.col("_source") == "set", K.other_mode(F.col("mode"))).otherwise(F.col("_their_mode"))
    )
    unrelated = K.relation(F.col("tonic"), F.col("mode"), F.col("_other"), F.col("_hmode")) == "other"
    keep = F.col("_source").isNotNull() & ~(unrelated & ~F.col("_close"))
    return d.withColumn("hedge_source", F.when(keep, F.col("_source"))).withColumn(
        "hedge_tonic", F.when(keep, F.col("_other"))).withColumn("hedge_mode", F.when(keep, F.col("_hmode"))).drop(
        "_source", "_close", "_other", "_hmode", "_their_mode")


def key_label(tonic: str = "tonic", mode: str = "mode") -> Column:
    text = K.key_text(F.col(tonic), F.col(mode))
    hedged = F.concat(text, F.lit(" (or "), K.key_text(F.col("hedge_tonic"), F.col("hedge_mode")), F.lit(")"))
    return F.when(F.col("hedge_tonic").isNotNull(), hedged).otherwise(text)


def pair_rule_note(p: HarmonyParams = HARMONY) -> Column:
    named = F.when(F.col("pair_margin") < p.pair_tie, F.concat(F.lit("tie, "), spelled(F.col("pair_tonic")), F.lit(" by chroma"))).otherwise(
        F.concat(spelled(F.col("pair_tonic")), F.lit(" by "), F.format_string("%.3f", "pair_margin")))
    return F.when(F.col("decided_by").isNull(), "none").otherwise(named)


def votes_note() -> Column:
    def name(c: str) -> Column:
        return F.coalesce(spelled(F.col(c)), F.lit("none"))
    note = F.concat(
        F.lit("score "), name("score_tonic"), F.lit(", pair "), name("pair_tonic"), F.lit(", mix "), name("mix_tonic"),
        F.lit(", decided by "), F.col("decided_by"), F.lit(", set "), name("set_tonic"), F.lit(" ("),
        F.format_string("%.3f", "set_share_best"), F.lit(" vs "), F.format_string("%.3f", "set_share_decided"), F.lit(")"),
    )
    return F.when(F.col("decided_by").isNull(), "none").otherwise(note)


def power_chords(events: DataFrame, keys: DataFrame, corr: DataFrame, p: HarmonyParams = HARMONY) -> DataFrame:
    """Events of a minor tonic played as root and fifth: the tonic's plain majors, relabelled `X:5`."""
    modes = mode_at(corr, KEYS)
    t = root_time(events)
    totals = t.groupBy("track_id").agg(F.sum("dur").alias("total"))
    minor_keys = keys.where("mode = 'minor'").select("track_id", "tonic")
    at = t.join(minor_keys, KEYS).where("pc = tonic").groupBy("track_id", "tonic").agg(
        F.sum("dur").alias("root_time"), F.sum(F.when(F.col("plain"), F.col("dur")).otherwise(0.0)).alias("major"),
        F.sum(F.when(~F.col("plain") & (F.col("triad_q") == "min"), F.col("dur")).otherwise(0.0)).alias("minor"),
    )
    gate = at.join(totals, KEYS).join(modes, ["track_id", "tonic"]).where(
        (F.col("major") > F.col("minor")) & (F.col("root_time") >= p.power_min_share * F.col("total"))
        & (F.col("mode") == "minor") & (F.round("mode_margin", 9) >= p.power_mode_margin)
    ).select("track_id", F.col("tonic").alias("pc"), F.lit(True).alias("_power"))
    out = events.join(gate, ["track_id", "pc"], "left")
    hit = F.coalesce(F.col("_power") & F.col("plain") & (F.col("dur") > 0), F.lit(False))
    written = F.split_part("label", F.lit(":"), F.lit(1))
    return out.select(
        *[c for c in events.columns if c not in ("label", "triad")],
        F.when(hit, F.concat(written, F.lit(":5"))).otherwise(F.col("label")).alias("label"),
        F.when(hit, F.concat(written, F.lit(":min"))).otherwise(F.col("triad")).alias("triad"), hit.alias("power"),
    )
