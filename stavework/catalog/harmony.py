"""Queries over chord spans: labels, key, fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r3, r6
from stavework.functions import harte as H, keys as KF
from stavework.operators import fill as L, key as K
from stavework.operators.grid import KEYS
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
DAY = B.DAY
NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"

CE = S.SPANS + """,
ce AS (SELECT s.track_id, span_id AS event, s.start, s."end", label, CASE WHEN label <> 'N' THEN e.k % 12 END AS pc,
  CASE e.event_type WHEN 'view' THEN 'maj' WHEN 'click' THEN 'min' WHEN 'purchase' THEN 'maj' WHEN 'error' THEN 'dim' END AS tq,
  e.event_type = 'view' AS plain, s."end" - s.start AS dur, CAST(floor(s.start / 86400) AS INTEGER) AS bar,
  CASE WHEN floor(s.start / 86400) < 7 THEN 0 WHEN floor(s.start / 86400) < 14 THEN 1 WHEN floor(s.start / 86400) < 21 THEN 2 ELSE 3 END AS section, e.k
  FROM spans s JOIN ev e ON e.event_id = s.span_id),
ch AS (SELECT * FROM ce WHERE pc IS NOT NULL AND dur > 0)"""


def events(spark, sf):
    bar = F.floor(F.col("start") / DAY).cast("int")
    sp = B.spans(spark, sf).withColumnRenamed("span_id", "event").withColumn("bar", bar)
    return H.parsed(sp.withColumn("section", B.section_of(F.col("bar"))))


def dims(spark, sf):
    t = B.tracks(spark, sf)
    return t.withColumn("bar_length", F.lit(DAY)), t.withColumn("n_sections", F.lit(4))


def vectors(spark, sf, weight):
    ev = B.events(spark, sf)
    v = ev.groupBy("track_id", (F.col("k") % 12).alias("pc")).agg(F.sum(weight).cast("double").alias("v"))
    full = B.tracks(spark, sf).select("track_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    return full.join(v, ["track_id", "pc"], "left").select("track_id", "pc", F.coalesce("v", F.lit(0.0)).alias("v"))


def prof(p):
    return "[" + ",".join(str(x) for x in p) + "]"


PROFILES = f"""pf AS (SELECT 'major' AS mode, t AS tonic, p AS pc, CAST(({prof(KF.MAJOR)})[(p - t + 12) % 12 + 1] AS DOUBLE) AS w FROM range(12) a(t), range(12) b(p)
  UNION ALL SELECT 'minor', t, p, CAST(({prof(KF.MINOR)})[(p - t + 12) % 12 + 1] AS DOUBLE) FROM range(12) a(t), range(12) b(p))"""


def corr_sql(vec: str, out: str, key: str) -> str:
    return f"""{out} AS (SELECT {key}, mode, tonic, CASE WHEN max(v) <= min(v) THEN 0 ELSE corr(v, w) END AS corr FROM {vec} JOIN pf USING (pc) GROUP BY {key}, mode, tonic)"""


VEC = S.TRACKS + """,
cv AS (SELECT t.track_id, CAST(p AS INTEGER) AS pc, coalesce(sum(e.value), 0.0) AS v FROM tracks t CROSS JOIN range(12) r(p) LEFT JOIN ev e ON e.track_id = t.track_id AND e.k % 12 = p GROUP BY 1, 2),
mv AS (SELECT t.track_id, CAST(p AS INTEGER) AS pc, CAST(count(e.t) AS DOUBLE) AS v FROM tracks t CROSS JOIN range(12) r(p) LEFT JOIN ev e ON e.track_id = t.track_id AND e.k % 12 = p GROUP BY 1, 2)"""
MIX = f"""{VEC}, {PROFILES}, {corr_sql('cv', 'cc', 'track_id')}, {corr_sql('mv', 'mc', 'track_id')},
mr AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(corr, 9) DESC, mode, tonic) AS r FROM mc),
mix AS (SELECT a.track_id, a.tonic AS mix_tonic, a.mode AS mix_mode, CASE WHEN a.corr > 0 THEN greatest(0, least(1, (a.corr - b.corr) / a.corr)) ELSE 0 END AS mix_confidence
  FROM mr a JOIN mr b ON a.track_id = b.track_id AND a.r = 1 AND b.r = 2)"""
SCORES = CE + """,
rt AS (SELECT track_id, pc, sum(dur) AS dur FROM ch GROUP BY 1, 2),
sh AS (SELECT *, dur / sum(dur) OVER (PARTITION BY track_id) AS share FROM rt),
kp AS (SELECT *, max(share) OVER (PARTITION BY track_id) AS mx FROM sh),
fr AS (SELECT track_id, arg_max(pc, event) AS fpc FROM ch GROUP BY 1),
br AS (SELECT ch.track_id, max(event) AS b FROM ch JOIN fr USING (track_id) WHERE pc <> fpc GROUP BY 1),
hd AS (SELECT ch.track_id, sum(dur) AS held, any_value(fpc) AS fpc FROM ch JOIN fr USING (track_id) LEFT JOIN br USING (track_id) WHERE b IS NULL OR event > b GROUP BY 1),
en AS (SELECT track_id, pc, count(*) AS endings FROM (SELECT track_id, section, pc, row_number() OVER (PARTITION BY track_id, section ORDER BY event DESC) AS r FROM ce) WHERE r = 1 AND pc IS NOT NULL GROUP BY 1, 2),
scores AS (SELECT kp.track_id, kp.pc, share, share + CASE WHEN kp.pc = fpc AND held >= 86400 - 1e-9 THEN 0.1 ELSE 0 END + 0.15 * coalesce(endings, 0) / 4.0 AS score
  FROM kp JOIN hd USING (track_id) LEFT JOIN en ON en.track_id = kp.track_id AND en.pc = kp.pc WHERE share >= 0.2 OR mx < 0.2),
sc2 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9) DESC, pc) AS r FROM scores)"""
SETS = """tt AS (SELECT track_id, pc, tq, sum(dur) AS dur FROM ch GROUP BY 1, 2, 3),
ss AS (SELECT track_id, CAST(c AS INTEGER) AS tonic, sum(dur * CASE (pc - c + 12) % 12 WHEN 0 THEN CASE tq WHEN 'maj' THEN 1 ELSE 0.5 END WHEN 2 THEN CASE tq WHEN 'min' THEN 1 ELSE 0.5 END
   WHEN 4 THEN CASE tq WHEN 'min' THEN 1 ELSE 0.5 END WHEN 5 THEN CASE tq WHEN 'maj' THEN 1 ELSE 0.5 END WHEN 7 THEN CASE tq WHEN 'maj' THEN 1 ELSE 0.5 END
   WHEN 9 THEN CASE tq WHEN 'min' THEN 1 ELSE 0.5 END WHEN 11 THEN CASE tq WHEN 'dim' THEN 1 ELSE 0.5 END ELSE 0 END) / sum(dur) AS set_share FROM tt, range(12) r(c) GROUP BY 1, 2),
ps AS (SELECT a.track_id, a.tonic, a.set_share, greatest(a.set_share, b.set_share) AS pair_share FROM ss a JOIN ss b ON a.track_id = b.track_id AND b.tonic = (a.tonic + 3) % 12),
bs AS (SELECT track_id, tonic AS set_tonic, set_share AS set_share_best FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(set_share, 9) DESC, tonic) AS r FROM ss) WHERE r = 1)"""


def pair_sql(cands: str, out: str) -> str:
    return f"""{out}_b AS (SELECT *, max(pair_share) OVER (PARTITION BY track_id) AS best FROM {cands}),
{out}_w AS (SELECT track_id, pc AS winner, pair_share AS ws FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(fit, 9) DESC, round(pair_share, 9) DESC, pc) AS r
  FROM {out}_b WHERE round(best - pair_share, 9) < 0.02) WHERE r = 1),
{out}_o AS (SELECT track_id, pc AS runner_up, pair_share AS os FROM (SELECT c.*, row_number() OVER (PARTITION BY c.track_id ORDER BY round(pair_share, 9) DESC, pc) AS r
  FROM {cands} c JOIN {out}_w w ON w.track_id = c.track_id AND c.pc <> w.winner) WHERE r = 1),
{out} AS (SELECT w.track_id, winner, CASE WHEN os IS NULL THEN ws ELSE abs(ws - os) END AS margin, runner_up FROM {out}_w w LEFT JOIN {out}_o o USING (track_id))"""


MODES = """modes AS (SELECT track_id, tonic, CASE WHEN round(sum(CASE mode WHEN 'major' THEN corr ELSE -corr END), 9) >= 0 THEN 'major' ELSE 'minor' END AS mode,
  abs(sum(CASE mode WHEN 'major' THEN corr ELSE -corr END)) AS mode_margin, max(corr) AS fit FROM cc GROUP BY 1, 2)"""


@query("label_algebra", f"""WITH {S.EV}, p AS (SELECT event_id, event_type, k, (CASE WHEN event_id % 2 = 0 THEN {NAMES} ELSE ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'] END)[k % 12 + 1] AS root,
  ['maj','min','7','min7','maj7','hdim7','dim','sus4','sus2','minmaj7','9','maj6','5','aug','min9','weird'][k % 16 + 1] AS q, ['maj','min','maj','min','maj','dim','dim','sus4','sus2','min','maj','maj','5','maj','min','maj'][k % 16 + 1] AS tq,
  CASE WHEN k % 7 = 0 THEN '(9)' ELSE '' END AS dg, CASE WHEN k % 11 = 0 THEN '/5' ELSE '' END AS bs FROM ev)
SELECT event_id, CAST(CASE WHEN event_type <> 'signup' THEN k % 12 END AS DOUBLE) AS pc, CASE WHEN event_type <> 'signup' THEN q END AS quality,
  CASE WHEN event_type = 'signup' THEN 'N' WHEN q = '5' THEN root || ':' || q || dg || bs ELSE root || ':' || tq END AS triad,
  CASE WHEN event_type <> 'signup' AND q = 'maj' AND dg = '' AND bs = '' THEN root END AS plain_root, event_type = 'signup' OR q <> 'weird' AS valid,
  CASE WHEN event_type = 'signup' THEN 'N' ELSE {NAMES}[(k + 2) % 12 + 1] || ':' || q || dg || bs END AS up_two FROM p""")
def label_algebra(spark, sf):
    lab = F.col("label")
    return _labels(spark, sf).select(
        "event_id", F.when(~H.is_no_chord(lab), H.pitch_class(H.root(lab))).cast("double").alias("pc"), F.when(~H.is_no_chord(lab), H.quality(lab)).alias("quality"),
        H.to_triad(lab).alias("triad"), H.plain_major_root(lab).alias("plain_root"), H.is_valid(lab).alias("valid"),
        H.transpose(lab, F.lit(2)).alias("up_two"))


def _labels(spark, sf):
    ev = B.events(spark, sf)
    root = F.element_at(F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, H.SHARPS))).otherwise(F.array(*map(F.lit, H.FLATS))), (F.col("k") % 12 + 1).cast("int"))
    quals = ["maj", "min", "7", "min7", "maj7", "hdim7", "dim", "sus4", "sus2", "minmaj7", "9", "maj6", "5", "aug", "min9", "weird"]
    q = F.element_at(F.array(*map(F.lit, quals)), (F.col("k") % 16 + 1).cast("int"))
    text = F.concat(root, F.lit(":"), q, F.when(F.col("k") % 7 == 0, "(9)").otherwise(""), F.when(F.col("k") % 11 == 0, "/5").otherwise(""))
    return ev.select("track_id", "event_id", "k", "event_type", F.when(F.col("event_type") == "signup", "N").otherwise(text).alias("label"))


@query("label_validity", f"""WITH {S.EV} SELECT event_type, k % 16 = 15 AND event_type <> 'signup' AS bad, count(*) AS n FROM ev GROUP BY ALL""")
def label_validity(spark, sf):
    bad = ~H.is_valid(F.col("label"))
    return _labels(spark, sf).groupBy("event_type", bad.alias("bad")).agg(F.count("*").alias("n"))


@query("tonic_names", f"""WITH {S.EV} SELECT DISTINCT k % 12 AS pc, {NAMES}[k % 12 + 1] AS sharp, ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][k % 12 + 1] AS flat FROM ev""")
def tonic_names(spark, sf):
    pc = (F.col("k") % 12)
    return B.events(spark, sf).select(pc.alias("pc"), H.spelled(pc).alias("sharp"), F.element_at(F.array(*map(F.lit, H.FLATS)), (pc + 1).cast("int")).alias("flat")).distinct()


@query("chord_template", f"""WITH {CE}, d AS (SELECT DISTINCT label, pc, tq FROM ch), n AS (SELECT label, pc, CASE tq WHEN 'maj' THEN [0,4,7] WHEN 'min' THEN [0,3,7] ELSE [0,3,6] END AS notes FROM d)
SELECT label, string_agg(CASE WHEN list_contains(notes, (b - pc + 12) % 12) THEN '1' ELSE '0' END, '' ORDER BY b) AS bins FROM n, range(12) r(b) GROUP BY 1""")
def chord_template(spark, sf):
    t = F.array_join(F.transform(H.template(F.col("label")), lambda x: x.cast("int").cast("string")), "")
    return events(spark, sf).where("pc is not null and dur > 0").select("label").distinct().select("label", t.alias("bins"))


@query("tonic_scores", f"WITH {SCORES} SELECT track_id, pc, round(share, 6) AS share, round(score, 6) AS score FROM scores")
def tonic_scores(spark, sf):
    length, n = dims(spark, sf)
    return K.tonic_scores(events(spark, sf), length, n).select("track_id", "pc", r6("share"), r6("score"))


@query("section_endings", f"WITH {SCORES} SELECT track_id, pc, endings FROM en")
def section_endings(spark, sf):
    return K.section_endings(events(spark, sf))


@query("final_run_hold", f"WITH {SCORES} SELECT track_id, fpc AS final_pc, round(held, 3) AS held FROM hd")
def final_run_hold(spark, sf):
    return K.final_run(events(spark, sf)).select("track_id", "final_pc", r3("held"))


@query("diatonic_set_share", f"WITH {CE}, {SETS} SELECT track_id, tonic, round(set_share, 6) AS set_share, round(pair_share, 6) AS pair_share FROM ps")
def diatonic_set_share(spark, sf):
    return K.set_shares(events(spark, sf)).select("track_id", "tonic", r6("set_share"), r6("pair_share"))


@query("best_major_set", f"WITH {CE}, {SETS} SELECT track_id, set_tonic, round(set_share_best, 6) AS share FROM bs")
def best_major_set(spark, sf):
    return K.best_major_set(K.set_shares(events(spark, sf))).select("track_id", "set_tonic", r6("set_share_best", "share"))


@query("top2_margin", f"""WITH {SCORES} SELECT a.track_id, a.pc AS winner, round(a.score - coalesce(b.score, 0), 6) AS margin, CAST(b.pc AS DOUBLE) AS runner_up
FROM sc2 a LEFT JOIN sc2 b ON a.track_id = b.track_id AND b.r = 2 WHERE a.r = 1""")
def top2_margin(spark, sf):
    length, n = dims(spark, sf)
    return K.top2(K.tonic_scores(events(spark, sf), length, n), "score").select("track_id", "winner", r6("margin"), F.col("runner_up").cast("double").alias("runner_up"))


CANDS = f"""{SCORES}, {SETS}, {MIX}, {MODES},
cands AS (SELECT s.track_id, s.pc, s.score, p.pair_share, m.fit FROM scores s JOIN ps p ON p.track_id = s.track_id AND p.tonic = s.pc JOIN modes m ON m.track_id = s.track_id AND m.tonic = s.pc),
{pair_sql('cands', 'pr')}"""


@query("pair_rule", f"WITH {CANDS} SELECT track_id, winner, round(margin, 6) AS margin, CAST(runner_up AS DOUBLE) AS runner_up FROM pr")
def pair_rule(spark, sf):
    ev = events(spark, sf)
    length, n = dims(spark, sf)
    corr = K.correlations(vectors(spark, sf, "value"), KEYS)
    s = K.set_shares(ev).join(K.mode_at(corr, KEYS).select("track_id", "tonic", "fit"), ["track_id", "tonic"]).withColumnRenamed("tonic", "pc")
    return K.pair_rule(K.tonic_scores(ev, length, n).join(s, ["track_id", "pc"])).select("track_id", "winner", r6("margin"), F.col("runner_up").cast("double").alias("runner_up"))


EMB = f"""{S.CHROMA}, vx AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS pc, chroma[i] AS v FROM (SELECT vec_id, chroma, unnest(range(1, 13)) AS i FROM chroma)),
{PROFILES}, {corr_sql('vx', 'ec', 'vec_id')}"""


def emb_corr(spark, sf):
    v = B.chroma(spark, sf).select("vec_id", F.posexplode("chroma").alias("pc", "v"))
    return K.correlations(v, ["vec_id"])


@query("profile_correlation", f"WITH {EMB} SELECT vec_id, mode, CAST(tonic AS INTEGER) AS tonic, round(corr, 6) AS corr FROM ec")
def profile_correlation(spark, sf):
    return emb_corr(spark, sf).select("vec_id", "mode", "tonic", r6("corr"))


@query("estimate_key", f"""WITH {EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(corr, 9) DESC, mode, tonic) AS r FROM ec)
SELECT a.vec_id, CAST(a.tonic AS INTEGER) AS tonic, a.mode, round(CASE WHEN a.corr > 0 THEN greatest(0, least(1, (a.corr - b.corr) / a.corr)) ELSE 0 END, 6) AS confidence
FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2""")
def estimate_key(spark, sf):
    return K.estimate_key(emb_corr(spark, sf), ["vec_id"]).select("vec_id", "tonic", "mode", r6("confidence"))


@query("mode_at", f"""WITH {S.EV}, {MIX}, {MODES} SELECT track_id, CAST(tonic AS INTEGER) AS tonic, mode, round(mode_margin, 6) AS mode_margin FROM modes""")
def mode_at(spark, sf):
    return K.mode_at(K.correlations(vectors(spark, sf, "value"), KEYS), KEYS).select("track_id", "tonic", "mode", r6("mode_margin"))


TCM = """tcm AS (SELECT track_id, pc AS tonic, CASE WHEN sum(CASE WHEN tq = 'maj' THEN dur ELSE 0 END) > sum(CASE WHEN tq = 'min' THEN dur ELSE 0 END) THEN 'major'
  WHEN sum(CASE WHEN tq = 'min' THEN dur ELSE 0 END) > sum(CASE WHEN tq = 'maj' THEN dur ELSE 0 END) THEN 'minor' END AS chord_mode FROM ch GROUP BY 1, 2)"""


@query("tonic_chord_mode", f"WITH {CE}, {TCM} SELECT * FROM tcm")
def tonic_chord_mode(spark, sf):
    return K.tonic_chord_mode(events(spark, sf))


DECIDE = f"""{CANDS}, {TCM},
s1 AS (SELECT a.track_id, a.pc AS score_tonic, a.score - coalesce(b.score, 0) AS score_margin, b.pc AS score_runner FROM sc2 a LEFT JOIN sc2 b ON a.track_id = b.track_id AND b.r = 2 WHERE a.r = 1),
nc AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY track_id) AS top FROM cands) WHERE round(top - score, 9) < 0.05),
{pair_sql('nc', 'np')},
cnt AS (SELECT track_id, count(*) AS n FROM ch GROUP BY 1),
d0 AS (SELECT mix.*, s1.score_tonic, score_margin, score_runner, pr.winner AS pair_tonic, pr.margin AS pair_margin, np.winner AS nt, np.margin AS nm, np.runner_up AS nr, set_tonic, set_share_best,
  CASE WHEN coalesce(n, 0) < 4 THEN NULL WHEN score_runner IS NOT NULL AND round(score_margin, 9) < 0.05 THEN 'pair rule' WHEN pr.winner = s1.score_tonic THEN 'agreement'
    WHEN mix_tonic IN (s1.score_tonic, pr.winner) THEN 'mix' ELSE 'score' END AS byy
  FROM mix LEFT JOIN cnt USING (track_id) LEFT JOIN s1 USING (track_id) LEFT JOIN pr USING (track_id) LEFT JOIN np USING (track_id) LEFT JOIN bs USING (track_id)),
d1 AS (SELECT *, CASE WHEN byy = 'pair rule' THEN nt WHEN byy = 'mix' AND mix_tonic = pair_tonic THEN pair_tonic ELSE score_tonic END AS t0,
  CASE WHEN byy = 'pair rule' THEN nm ELSE score_margin END AS m0, CASE WHEN byy = 'pair rule' THEN nr WHEN byy = 'mix' AND mix_tonic = pair_tonic THEN score_tonic ELSE score_runner END AS r0 FROM d0),
d2 AS (SELECT d1.*, ps.pair_share AS set_share_decided, coalesce(byy IS NOT NULL AND round(set_share_best - ps.pair_share, 9) >= 0.10, false) AS veto FROM d1 LEFT JOIN ps ON ps.track_id = d1.track_id AND ps.tonic = t0),
d3 AS (SELECT *, CASE WHEN veto THEN 'set' ELSE byy END AS decided_by, CASE WHEN byy IS NULL THEN mix_tonic WHEN veto THEN set_tonic ELSE t0 END AS tonic,
  CASE WHEN byy IS NULL THEN NULL WHEN veto THEN set_share_best - set_share_decided ELSE m0 END AS margin, CASE WHEN NOT veto AND byy IS NOT NULL THEN r0 END AS runner_up FROM d2),
nmd AS (SELECT m.track_id, m.tonic, mode_margin, CASE WHEN round(mode_margin, 9) < 0.05 THEN coalesce(chord_mode, mode) ELSE mode END AS mode FROM modes m LEFT JOIN tcm USING (track_id, tonic)),
d4 AS (SELECT d3.*, CASE WHEN decided_by IS NULL THEN mix_mode ELSE nmd.mode END AS mode, CASE WHEN decided_by IS NULL THEN mix_confidence ELSE mode_margin END AS confidence
  FROM d3 LEFT JOIN nmd ON nmd.track_id = d3.track_id AND nmd.tonic = d3.tonic),
d5 AS (SELECT *, coalesce(round(margin, 9) < 0.05, false) AS close, CASE WHEN decided_by IN ('mix', 'score') THEN CASE WHEN tonic = score_tonic THEN pair_tonic ELSE score_tonic END END AS loser FROM d4),
d6 AS (SELECT *, CASE WHEN decided_by = 'set' THEN 'set' WHEN close AND runner_up IS NOT NULL THEN 'runner_up' WHEN loser <> tonic THEN 'chord rule' WHEN decided_by IS NOT NULL AND mix_tonic <> tonic THEN 'mix' END AS src FROM d5),
d7 AS (SELECT *, CASE src WHEN 'set' THEN (tonic + CASE mode WHEN 'major' THEN 9 ELSE 3 END) % 12 WHEN 'runner_up' THEN runner_up WHEN 'chord rule' THEN loser WHEN 'mix' THEN mix_tonic END AS oth FROM d6),
d8 AS (SELECT d7.*, CASE WHEN src = 'set' THEN CASE d7.mode WHEN 'major' THEN 'minor' ELSE 'major' END ELSE nmd.mode END AS om FROM d7 LEFT JOIN nmd ON nmd.track_id = d7.track_id AND nmd.tonic = d7.oth),
d9 AS (SELECT *, src IS NOT NULL AND (close OR (CASE WHEN mode = om THEN (oth - tonic + 12) % 12 IN (0, 5, 7) ELSE (oth - tonic + 12) % 12 = 0 OR (oth - tonic + 12) % 12 = CASE mode WHEN 'major' THEN 9 ELSE 3 END END)) AS keep FROM d8)"""


def decided(spark, sf):
    ev = share(events(spark, sf))
    length, n = dims(spark, sf)
    corr = share(K.correlations(vectors(spark, sf, "value"), KEYS))
    mix = K.estimate_key(K.correlations(vectors(spark, sf, F.lit(1)), KEYS), KEYS)
    mix = mix.select("track_id", F.col("tonic").alias("mix_tonic"), F.col("mode").alias("mix_mode"), F.col("confidence").alias("mix_confidence"))
    return ev, corr, K.decide_key(ev, length, n, corr, mix)


@query("decide_tonic", f"""WITH {DECIDE} SELECT track_id, CAST(tonic AS INTEGER) AS tonic, mode, decided_by, round(margin, 6) AS margin, round(confidence, 6) AS confidence,
  CAST(runner_up AS DOUBLE) AS runner_up, CAST(pair_tonic AS DOUBLE) AS pair_tonic, CAST(set_tonic AS DOUBLE) AS set_tonic, round(set_share_decided, 6) AS set_share_decided FROM d9""")
def decide_tonic(spark, sf):
    d = decided(spark, sf)[2]
    return d.select("track_id", "tonic", "mode", "decided_by", r6("margin"), r6("confidence"), *[F.col(c).cast("double").alias(c) for c in ("runner_up", "pair_tonic", "set_tonic")], r6("set_share_decided"))


TEXT = f"{NAMES}[tonic + 1] || ' ' || mode"


@query("hedge", f"""WITH {DECIDE} SELECT track_id, CASE WHEN keep THEN src END AS hedge_source, CAST(CASE WHEN keep THEN oth END AS DOUBLE) AS hedge_tonic, CASE WHEN keep THEN om END AS hedge_mode,
  {TEXT} || CASE WHEN keep THEN ' (or ' || {NAMES}[oth + 1] || ' ' || om || ')' ELSE '' END AS key_text FROM d9""")
def hedge(spark, sf):
    return decided(spark, sf)[2].select("track_id", "hedge_source", F.col("hedge_tonic").cast("double").alias("hedge_tonic"), "hedge_mode", K.key_label().alias("key_text"))


@query("key_notes", f"""WITH {DECIDE} SELECT track_id, CASE WHEN decided_by IS NULL THEN 'none' WHEN pair_margin < 0.02 THEN 'tie, ' || {NAMES}[pair_tonic + 1] || ' by chroma'
   ELSE {NAMES}[pair_tonic + 1] || ' by ' || printf('%.3f', pair_margin) END AS pair_note,
  CASE WHEN decided_by IS NULL THEN 'none' ELSE 'score ' || {NAMES}[score_tonic + 1] || ', pair ' || {NAMES}[pair_tonic + 1] || ', mix ' || {NAMES}[mix_tonic + 1] || ', decided by ' || decided_by
    || ', set ' || {NAMES}[set_tonic + 1] || printf(' (%.3f vs %.3f)', set_share_best, set_share_decided) END AS votes_note FROM d9""")
def key_notes(spark, sf):
    return decided(spark, sf)[2].select("track_id", K.pair_rule_note().alias("pair_note"), K.votes_note().alias("votes_note"))


@query("power_chords", f"""WITH {DECIDE}, tot AS (SELECT track_id, sum(dur) AS total FROM ch GROUP BY 1),
g AS (SELECT ch.track_id, any_value(d9.tonic) AS tonic, sum(dur) AS rt, sum(CASE WHEN plain THEN dur ELSE 0 END) AS mj, sum(CASE WHEN tq = 'min' THEN dur ELSE 0 END) AS mn FROM ch JOIN d9 ON d9.track_id = ch.track_id AND d9.tonic = ch.pc AND d9.mode = 'minor' GROUP BY 1),
ok AS (SELECT g.track_id, g.tonic FROM g JOIN tot USING (track_id) JOIN modes m ON m.track_id = g.track_id AND m.tonic = g.tonic WHERE mj > mn AND rt >= 0.2 * total AND m.mode = 'minor' AND round(mode_margin, 9) >= 0.2)
SELECT ce.track_id, event, CASE WHEN ok.track_id IS NOT NULL AND plain AND dur > 0 THEN split_part(label, ':', 1) || ':5' ELSE label END AS label, coalesce(ok.track_id IS NOT NULL AND plain AND dur > 0, false) AS power
FROM ce LEFT JOIN ok ON ok.track_id = ce.track_id AND ok.tonic = ce.pc""")
def power_chords(spark, sf):
    ev, corr, d = decided(spark, sf)
    return K.power_chords(ev, d, corr).select("track_id", "event", "label", "power")


REL = """CASE WHEN ma = mb THEN CASE (b - a + 12) % 12 WHEN 0 THEN 'same' WHEN 5 THEN 'fifth' WHEN 7 THEN 'fifth' ELSE 'other' END
 WHEN a = b THEN 'parallel' WHEN (b - a + 12) % 12 = CASE ma WHEN 'major' THEN 9 ELSE 3 END THEN 'relative' ELSE 'other' END"""


@query("key_relations", f"""WITH {S.EV}, p AS (SELECT k % 12 AS a, CASE WHEN event_type IN ('view', 'error') THEN 'major' ELSE 'minor' END AS ma, (k // 12) % 12 AS b, CASE WHEN event_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mb FROM ev)
SELECT a, ma, b, mb, {REL} AS relation, CASE WHEN ma = mb AND a = b THEN 1.0 WHEN ma = mb AND (b - a + 12) % 12 = 7 THEN 0.5 WHEN ma <> mb AND (b - a + 12) % 12 = CASE ma WHEN 'major' THEN 9 ELSE 3 END THEN 0.3
  WHEN ma <> mb AND a = b THEN 0.2 ELSE 0.0 END::DOUBLE AS weighted, count(*) AS n FROM p GROUP BY ALL""")
def key_relations(spark, sf):
    ev = B.events(spark, sf)
    p = ev.select((F.col("k") % 12).alias("a"), F.when(F.col("event_type").isin("view", "error"), "major").otherwise("minor").alias("ma"),
                  F.floor(F.col("k") / 12).cast("int").alias("b"), F.when(F.col("event_id") % 2 == 0, "major").otherwise("minor").alias("mb"))
    args = [F.col(c) for c in ("a", "ma", "b", "mb")]
    return p.groupBy("a", "ma", "b", "mb", KF.relation(*args).alias("relation"), KF.weighted_score(*args).alias("weighted")).agg(F.count("*").alias("n"))


# the fill runs on six-hour bars, whose chroma and energy come from the overlapping events
QBAR = S.TRACKS + """,
qb AS (SELECT track_id, bar, bar * 21600e0 AS start, (bar + 1) * 21600e0 AS "end" FROM (SELECT track_id, CAST(unnest(range(120)) AS INTEGER) AS bar FROM tracks)),
qo AS (SELECT q.track_id, q.bar, q.start AS bs, q."end" AS be, c.event, c.label, c.k FROM qb q JOIN ce c ON c.track_id = q.track_id AND least(q."end", c."end") - greatest(q.start, c.start) > 1e-6),
qe AS (SELECT track_id, bar, avg(k) / 100.0 AS energy FROM qo GROUP BY 1, 2),
qc AS (SELECT track_id, bar, CAST(p AS INTEGER) AS pc, avg(CAST((k * (p + 3)) % 17 AS DOUBLE)) AS v FROM qo, range(12) r(p) GROUP BY 1, 2, 3),
sc AS (SELECT track_id, label, any_value(pc) AS pc, any_value(tq) AS tq, sum(dur) AS held FROM ch GROUP BY 1, 2),
sg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, pc, tq ORDER BY round(held, 6) DESC, label DESC) AS r FROM sc) WHERE r = 1)"""


def qbars(spark, sf):
    bars = B.regular_beats(spark, sf).select("track_id", F.col("i").alias("bar"), "start", "end")
    ev = share(B.spans(spark, sf).withColumnRenamed("span_id", "event").join(
        B.events(spark, sf).select(F.col("event_id").alias("event"), "k"), "event"))
    over = share(L.over_bars(ev, bars, 21600.0))
    energy = over.groupBy("track_id", "bar").agg((F.avg("k") / 100.0).alias("energy"))
    bins = [F.avg(((F.col("k") * (p + 3)) % 17).cast("double")) for p in range(12)]
    chroma = over.groupBy("track_id", "bar").agg(F.array(*bins).alias("chroma"))
    return ev, bars, energy, chroma


@query("chorded_energy_reference", f"""WITH {CE}, {QBAR}, m AS (SELECT track_id, median(energy) AS r FROM qe WHERE EXISTS (SELECT 1 FROM qo WHERE qo.track_id = qe.track_id AND qo.bar = qe.bar AND label <> 'N') GROUP BY 1)
SELECT track_id, round(CASE WHEN r > 0 THEN r END, 6) AS reference FROM m""")
def chorded_energy_reference(spark, sf):
    ev, bars, energy, _ = qbars(spark, sf)
    return L.chorded_energy_reference(ev, bars, energy, 21600.0).select("track_id", r6("reference"))


@query("song_chords", f"""WITH {CE}, {QBAR} SELECT track_id, split_part(label, ':', 1) || ':' || tq AS triad, label FROM sg""")
def song_chords(spark, sf):
    return L.song_chords(B.spans(spark, sf)).select("track_id", "triad", "label")


@query("chroma_bar_mean", f"""WITH {CE}, {QBAR} SELECT track_id, bar, CAST(pc AS INTEGER) AS pc, round(v, 6) AS v FROM qc""")
def chroma_bar_mean(spark, sf):
    return qbars(spark, sf)[3].select("track_id", "bar", F.posexplode("chroma").alias("pc", "v")).select("track_id", "bar", "pc", r6("v"))


@query("fill_silent_bars", f"""WITH {CE}, {QBAR},
ref AS (SELECT track_id, median(energy) AS r FROM qe WHERE EXISTS (SELECT 1 FROM qo WHERE qo.track_id = qe.track_id AND qo.bar = qe.bar AND label <> 'N') GROUP BY 1),
nb AS (SELECT track_id, bar, any_value(bs) AS bs, any_value(be) AS be FROM qo GROUP BY 1, 2 HAVING bool_and(label = 'N')),
ld AS (SELECT nb.* FROM nb JOIN qe USING (track_id, bar) JOIN ref USING (track_id) WHERE r > 0 AND energy >= 0.2 * r),
tp AS (SELECT track_id, label, CAST(p AS INTEGER) AS pc, CASE WHEN list_contains(CASE tq WHEN 'maj' THEN [0,4,7] WHEN 'min' THEN [0,3,7] ELSE [0,3,6] END, (p - pc + 12) % 12) THEN 1.0 ELSE 0.0 END AS w FROM sg, range(12) r(p)),
mt AS (SELECT l.track_id, l.bar, tp.label, corr(qc.v, tp.w) AS c FROM ld l JOIN qc USING (track_id, bar) JOIN tp ON tp.track_id = l.track_id AND tp.pc = qc.pc GROUP BY 1, 2, 3 HAVING max(qc.v) > min(qc.v)),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id, bar ORDER BY round(c, 9) DESC, label DESC) AS r FROM mt),
fl AS (SELECT ld.track_id, ld.bar, bs, be, a.label, a.c FROM ld JOIN rk a ON a.track_id = ld.track_id AND a.bar = ld.bar AND a.r = 1 LEFT JOIN rk b ON b.track_id = ld.track_id AND b.bar = ld.bar AND b.r = 2
  WHERE round(a.c, 9) >= 0.32 AND round(a.c - coalesce(b.c, -1), 9) >= 0.05),
cov AS (SELECT track_id, event, count(*) AS n FROM qo WHERE label = 'N' GROUP BY 1, 2),
sp AS (SELECT o.track_id, greatest(c.start, bs) AS start, least(c."end", be) AS "end", 'N' AS label, o.bar FROM qo o JOIN ce c ON c.track_id = o.track_id AND c.event = o.event JOIN cov ON cov.track_id = o.track_id AND cov.event = o.event AND n >= 2
  UNION ALL SELECT c.track_id, c.start, c."end", c.label, (SELECT min(bar) FROM qo WHERE qo.track_id = c.track_id AND qo.event = c.event AND c.label = 'N') FROM ce c WHERE c.label <> 'N' OR NOT EXISTS (SELECT 1 FROM cov WHERE cov.track_id = c.track_id AND cov.event = c.event AND n >= 2))
SELECT track_id, round(start, 3) AS start, round("end", 3) AS "end", label, NULL::DOUBLE AS confidence, false AS filled FROM sp WHERE NOT (label = 'N' AND EXISTS (SELECT 1 FROM fl WHERE fl.track_id = sp.track_id AND fl.bar = sp.bar))
UNION ALL SELECT track_id, bs, be, label, round(c, 6), true FROM fl""")
def fill_silent_bars(spark, sf):
    ev, bars, energy, chroma = qbars(spark, sf)
    out = L.fill_silent_bars(ev.select("track_id", "event", "start", "end", "label"), bars, chroma, energy, 21600.0)
    return out.select("track_id", r3("start"), r3("end"), "label", r6("confidence"), "filled")
