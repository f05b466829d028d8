"""Queries that score runs against truth, compare runs and sweep constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r6
from stavework.catalog.harmony import MIX, vectors
from stavework.catalog.rhythm import bars_of
from stavework.catalog.signal import FS, bar_sums, rq
from stavework.functions import rhythm as R
from stavework.operators import grid as G, key as K, signal as SG, sweep as W, truth as T, votes as V
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS, SEC = ["track_id"], ["track_id", "section"]

# truth ranges: one per event, from its day, one to three bars long
TR = f"""{S.EV}, rng AS (SELECT track_id, event_id AS line, CAST(floor(t / 86400) AS INTEGER) AS start, CAST(floor(t / 86400) AS INTEGER) + 1 + k % 3 AS "end", event_type, k,
  CASE event_type WHEN 'signup' THEN 'rest' WHEN 'purchase' THEN 'tail' WHEN 'error' THEN 'contested' ELSE 'play' END AS label,
  CASE event_type WHEN 'signup' THEN 'riff' WHEN 'purchase' THEN 'mixed' WHEN 'error' THEN 'dyad' WHEN 'view' THEN 'bleed' ELSE 'strum' END AS rlabel FROM ev)"""
MASKS = f"""{S.ONSETS}, {S.BARS}, {S.OWNERS}, {S.MASKS}"""
REST = f"""{TR}, onsets AS (SELECT track_id, event_id AS onset_id, t, event_type = 'error' AS muted, value AS centroid, CAST(k AS DOUBLE) AS zcr FROM ev), {S.BARS}, {S.OWNERS}, {S.MASKS},
rec AS (SELECT track_id, section, bar, strike, mute, strike = 0 OR (track_id + bar) % 11 = 0 AS rests FROM masks),
lab AS (SELECT track_id, bar, arg_max(label, line) AS label FROM (SELECT track_id, line, label, unnest(range(start, "end")) AS bar FROM rng) GROUP BY 1, 2),
sc AS (SELECT l.track_id, l.bar, label IN ('rest', 'tail') AS truth, rests AS pred FROM lab l JOIN rec USING (track_id, bar) WHERE label <> 'contested')"""


def ranges(spark, sf):
    ev = B.events(spark, sf)
    start = F.floor(F.col("t") / B.DAY).cast("int")
    label = F.when(F.col("event_type") == "signup", "rest").when(F.col("event_type") == "purchase", "tail").when(F.col("event_type") == "error", "contested").otherwise("play")
    rl = F.when(F.col("event_type") == "signup", "riff").when(F.col("event_type") == "purchase", "mixed").when(F.col("event_type") == "error", "dyad").when(F.col("event_type") == "view", "bleed").otherwise("strum")
    return ev.select("track_id", F.col("event_id").alias("line"), start.alias("start"), (start + 1 + F.col("k") % 3).alias("end"), label.alias("label"), rl.alias("rlabel"), "k", "event_type")


def records(spark, sf):
    return bars_of(spark, sf).withColumn("rests", (F.col("strike") == 0) | ((F.col("track_id") + F.col("bar")) % 11 == 0))


def scored(spark, sf):
    rec = share(records(spark, sf))
    lab = T.range_bars(ranges(spark, sf), rec, T.REST_LABELS, ["contested"])
    return share(lab.join(rec, ["track_id", "bar"]).select("track_id", "bar", F.col("label").isin("rest", "tail").alias("truth"), F.col("rests").alias("pred")))


@query("range_label_expand", f"WITH {REST} SELECT track_id, CAST(bar AS INTEGER) AS bar, truth, pred FROM sc")
def range_label_expand(spark, sf):
    return scored(spark, sf)


@query("rest_scores", f"""WITH {REST} SELECT track_id, round(count(*) FILTER (truth AND pred) / nullif(CAST(count(*) FILTER (pred) AS DOUBLE), 0), 6) AS "precision", round(count(*) FILTER (truth AND pred) / nullif(CAST(count(*) FILTER (truth) AS DOUBLE), 0), 6) AS recall,
  count(*) FILTER (pred AND NOT truth) AS deletions, count(*) FILTER (truth AND NOT pred) AS insertions FROM sc GROUP BY 1""")
def rest_scores(spark, sf):
    return T.rest_scores(scored(spark, sf)).select("track_id", r6("precision"), r6("recall"), "deletions", "insertions")


@query("rest_regions", f"""WITH {REST}, g AS (SELECT track_id, bar, bar - row_number() OVER (PARTITION BY track_id ORDER BY bar) AS g FROM sc WHERE truth)
SELECT track_id, CAST(min(bar) AS INTEGER) AS "first", CAST(max(bar) AS INTEGER) AS "last" FROM g GROUP BY track_id, g""")
def rest_regions(spark, sf):
    return T.regions(scored(spark, sf), "truth")


@query("region_match", f"""WITH RECURSIVE {REST}, t AS (SELECT track_id, min(bar) AS a, max(bar) AS b FROM (SELECT track_id, bar, bar - row_number() OVER (PARTITION BY track_id ORDER BY bar) AS g FROM sc WHERE truth) GROUP BY track_id, g),
p AS (SELECT track_id, min(bar) AS a, max(bar) AS b FROM (SELECT track_id, bar, bar - row_number() OVER (PARTITION BY track_id ORDER BY bar) AS g FROM sc WHERE pred) GROUP BY track_id, g),
ti AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY a) AS i FROM t), pj AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY a) AS j FROM p),
c AS (SELECT ti.track_id, i, list(j ORDER BY j) FILTER (j IS NOT NULL) AS js FROM ti LEFT JOIN pj ON pj.track_id = ti.track_id AND abs(pj.a - ti.a) <= 1 AND abs(pj.b - ti.b) <= 1 GROUP BY 1, 2),
w AS (SELECT track_id, 0::BIGINT AS i, []::BIGINT[] AS used FROM c GROUP BY 1 UNION ALL
 SELECT c.track_id, c.i, CASE WHEN list_filter(coalesce(c.js, []), lambda x: NOT list_contains(w.used, x))[1] IS NULL THEN w.used ELSE list_append(w.used, list_filter(c.js, lambda x: NOT list_contains(w.used, x))[1]) END FROM w JOIN c ON c.track_id = w.track_id AND c.i = w.i + 1),
m AS (SELECT track_id, max(len(used)) AS m FROM w GROUP BY 1), nt AS (SELECT track_id, count(*) AS n FROM t GROUP BY 1), np AS (SELECT track_id, count(*) AS n FROM p GROUP BY 1)
SELECT track_id, coalesce(nt.n, 0) AS n_ref, coalesce(np.n, 0) AS n_est, CAST(coalesce(m, 0) AS BIGINT) AS matched, round(2 * coalesce(m, 0) / CAST(coalesce(nt.n, 0) + coalesce(np.n, 0) AS DOUBLE), 6) AS event_f
 FROM nt FULL JOIN np USING (track_id) LEFT JOIN m USING (track_id)""")
def region_match(spark, sf):
    s = scored(spark, sf)
    return T.region_match(T.regions(s, "truth"), T.regions(s, "pred")).select("track_id", "n_ref", "n_est", "matched", r6("event_f"))


@query("event_f_measure", f"""WITH RECURSIVE {S.EV}, r AS (SELECT track_id, event_id, t FROM ev WHERE event_type IN ('view', 'click', 'error')), e AS (SELECT track_id, event_id, t + (k % 5) * 0.02 AS t FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
ri AS (SELECT track_id, CAST(round(t * 1000000) AS BIGINT) AS x, row_number() OVER (PARTITION BY track_id ORDER BY t) AS i FROM r), ej AS (SELECT track_id, CAST(round(t * 1000000) AS BIGINT) AS x, row_number() OVER (PARTITION BY track_id ORDER BY t) AS j FROM e),
w AS (SELECT DISTINCT track_id, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS m FROM ri UNION ALL
 SELECT w.track_id, w.i + CASE WHEN ri.x <= ej.x + 70000 THEN 1 ELSE 0 END, w.j + CASE WHEN ej.x <= ri.x + 70000 THEN 1 ELSE 0 END, w.m + CASE WHEN abs(ri.x - ej.x) <= 70000 THEN 1 ELSE 0 END
 FROM w JOIN ri ON ri.track_id = w.track_id AND ri.i = w.i JOIN ej ON ej.track_id = w.track_id AND ej.j = w.j),
m AS (SELECT track_id, max(m) AS m FROM w GROUP BY 1), a AS (SELECT track_id, count(*) AS n FROM r GROUP BY 1), b AS (SELECT track_id, count(*) AS n FROM e GROUP BY 1)
SELECT a.track_id, round(2 * coalesce(m, 0) / CAST(a.n + coalesce(b.n, 0) AS DOUBLE), 6) AS f FROM a LEFT JOIN b USING (track_id) LEFT JOIN m USING (track_id)""")
def event_f_measure(spark, sf):
    ev = B.events(spark, sf)
    ref = ev.where("event_type in ('view', 'click', 'error')").select("track_id", "t")
    est = ev.where("event_type in ('view', 'click', 'purchase')").select("track_id", (F.col("t") + (F.col("k") % 5) * 0.02).alias("t"))
    return T.event_f(ref, est, 0.07).select("track_id", r6("f"))


@query("flag_precision_recall", f"""WITH {REST}, b AS (SELECT r.track_id, r.line, bool_or(bit_count(strike) >= 3) AS f FROM (SELECT track_id, line, unnest(range(start, "end")) AS bar FROM rng) r JOIN rec ON rec.track_id = r.track_id AND rec.bar = r.bar GROUP BY 1, 2),
f AS (SELECT r.track_id, rlabel IN ('riff', 'mixed') AS hit, coalesce(b.f, start >= 21) AS fl FROM rng r LEFT JOIN b USING (track_id, line))
SELECT track_id, round(count(*) FILTER (fl AND hit) / nullif(CAST(count(*) FILTER (fl) AS DOUBLE), 0), 6) AS "precision", round(count(*) FILTER (fl AND hit) / nullif(CAST(count(*) FILTER (hit) AS DOUBLE), 0), 6) AS recall,
 round(count(*) FILTER (NOT hit) / CAST(count(*) AS DOUBLE), 6) AS baseline_not_riff, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS baseline_riff FROM f GROUP BY 1""")
def flag_precision_recall(spark, sf):
    rec = records(spark, sf).select("track_id", "bar", (F.bit_count("strike") >= 3).alias("riff"))
    pats = B.sections(spark, sf).withColumn("riff", F.col("section") == 3)
    r = ranges(spark, sf).drop("label").withColumnRenamed("rlabel", "label")
    out = T.flag_scores(r, rec, pats)
    return out.select("track_id", r6("precision"), r6("recall"), r6("baseline_not_riff"), r6("baseline_riff"))


FIGS = ["D-DU-UDU", "D---D---", "DxDU-xDU", "-U-U-U-U"]
PRINT = f"""{REST}, units AS (SELECT track_id, section, 8 AS width, strike, mute FROM rec), {S.vote('units', 'v')},
cf AS (SELECT u.track_id, u.section, avg({S.jac('u.', 'v.')}) AS c FROM units u JOIN v USING (track_id, section) GROUP BY 1, 2),
pr AS (SELECT r.track_id, r.section, r.bar, r.rests, CASE WHEN rests THEN 0 ELSE v.strike END AS ps, CASE WHEN rests THEN 0 ELSE v.mute END AS pm, NOT rests AND round(c, 9) < 0.3 AS uncertain FROM rec r JOIN v USING (track_id, section) JOIN cf USING (track_id, section))"""


def printed(spark, sf):
    rec = share(records(spark, sf))
    votes = share(V.section_vote(rec))
    conf = V.vote_figures(rec, votes).select(*SEC, "confidence")
    zero = F.lit(0).cast("long")
    j = rec.join(votes.select(*SEC, "vote_strike", "vote_mute"), SEC).join(conf, SEC)
    return share(j.select(*SEC, "bar", "width", "strike", "mute", "rests", F.when(F.col("rests"), zero).otherwise(F.col("vote_strike")).alias("p_strike"),
                          F.when(F.col("rests"), zero).otherwise(F.col("vote_mute")).alias("p_mute"), (~F.col("rests") & (F.round("confidence", 9) < 0.3)).alias("uncertain")))


def truth_patterns(spark, sf):
    r = ranges(spark, sf).where("event_type = 'purchase'")
    figs = F.array(*map(F.lit, FIGS))
    one = F.element_at(figs, (F.col("k") % 4 + 1).cast("int"))
    two = F.element_at(figs, ((F.col("k") + 1) % 4 + 1).cast("int"))
    return r.select("track_id", "line", "start", "end", F.element_at(F.array(*map(F.lit, T.VERDICTS)), (F.col("k") % 3 + 1).cast("int")).alias("verdict"),
                    F.when(F.col("k") % 5 == 0, F.array(one, two)).otherwise(F.array(one)).alias("figure"))


def fmask(e: str, letters: str) -> str:
    return f"list_sum(list_transform(range(len({e})), lambda j: CASE WHEN contains('{letters}', substr({e}, CAST(j + 1 AS BIGINT), 1)) THEN CAST(1 AS BIGINT) << j ELSE 0 END))::BIGINT"


PS = f"""{PRINT}, tp AS (SELECT track_id, line, start, "end", ['YES','MOSTLY','NO'][k % 3 + 1] AS verdict, {FIGS}[k % 4 + 1] AS f1, CASE WHEN k % 5 = 0 THEN {FIGS}[(k + 1) % 4 + 1] END AS f2 FROM rng WHERE event_type = 'purchase'),
hb AS (SELECT t.track_id, t.line, min(p.bar) AS h FROM tp t JOIN pr p ON p.track_id = t.track_id AND p.bar >= t.start AND p.bar < t."end" AND NOT p.rests GROUP BY 1, 2),
tf AS (SELECT t.*, coalesce(h, start) AS fb FROM tp t LEFT JOIN hb USING (track_id, line)),
tx AS (SELECT *, CASE WHEN f2 IS NULL THEN f1 WHEN (fb - start) % 2 = 1 THEN f2 || f1 ELSE f1 || f2 END AS txt FROM tf),
ts AS (SELECT x.*, a.ps | (coalesce(b.ps, 0) << 8) AS ps, a.pm | (coalesce(b.pm, 0) << 8) AS pm, a.uncertain, a.ps IS NOT NULL AND (f2 IS NULL OR b.ps IS NOT NULL) AS ok, {fmask('txt', 'DUx')} AS fs, {fmask('txt', 'x')} AS fm
  FROM tx x LEFT JOIN pr a ON a.track_id = x.track_id AND a.bar = fb LEFT JOIN pr b ON b.track_id = x.track_id AND b.bar = fb + 1 AND f2 IS NOT NULL),
psc AS (SELECT track_id, line, verdict, CASE WHEN ok THEN {S.jac('ps', 'fs', 'pm', 'fm')} END AS jaccard, coalesce(NOT uncertain, false) AS certain FROM ts)"""


@query("pattern_scores", f"WITH {PS} SELECT track_id, line, verdict, round(jaccard, 6) AS jaccard, certain FROM psc")
def pattern_scores(spark, sf):
    return T.pattern_scores(truth_patterns(spark, sf), printed(spark, sf)).select("track_id", "line", "verdict", r6("jaccard"), "certain")


@query("false_certainty", f"WITH {PS} SELECT track_id, count(*) FILTER (verdict = 'NO' AND certain) AS false_certain, count(*) FILTER (verdict <> 'NO' AND NOT certain) AS false_grey FROM psc GROUP BY 1")
def false_certainty(spark, sf):
    return T.false_certainty(T.pattern_scores(truth_patterns(spark, sf), printed(spark, sf)), KEYS)


DISC = f"{PRINT}, dl AS (SELECT *, lag(ps) OVER w AS a, lag(pm) OVER w AS b FROM pr WINDOW w AS (PARTITION BY track_id ORDER BY bar))"


@query("discontinuity", f"WITH {DISC} SELECT track_id, round(count(*) FILTER (ps <> a OR pm <> b) / CAST(count(*) AS DOUBLE), 6) AS discontinuity FROM dl GROUP BY 1")
def discontinuity(spark, sf):
    return T.discontinuity(printed(spark, sf)).select("track_id", r6("discontinuity"))


WS = "CASE WHEN {m} = lm AND {p} = lp THEN 1.0 WHEN {m} = lm AND (lp - {p} + 12) % 12 = 7 THEN 0.5 WHEN {m} <> lm AND (lp - {p} + 12) % 12 = CASE {m} WHEN 'major' THEN 9 ELSE 3 END THEN 0.3 WHEN {m} <> lm AND lp = {p} THEN 0.2 ELSE 0.0 END"
CAT = "CASE WHEN {m} = lm THEN CASE (lp - {p} + 12) % 12 WHEN 0 THEN 'same' WHEN 5 THEN 'fifth' WHEN 7 THEN 'fifth' ELSE 'other' END WHEN lp = {p} THEN 'parallel' WHEN (lp - {p} + 12) % 12 = CASE {m} WHEN 'major' THEN 9 ELSE 3 END THEN 'relative' ELSE 'other' END"


@query("key_score", f"""WITH {S.EV}, {MIX}, t AS (SELECT track_id, mix_tonic AS lp, mix_mode AS lm, track_id % 12 AS pc, CASE WHEN track_id % 2 = 0 THEN 'major' ELSE 'minor' END AS md, CASE WHEN track_id % 3 = 0 THEN track_id * 5 % 12 END AS ap, 'major' AS am FROM mix),
s AS (SELECT *, {WS.format(m='md', p='pc')} AS s1, CASE WHEN ap IS NOT NULL THEN {WS.format(m='am', p='ap')} END AS s2 FROM t)
SELECT track_id, CAST(round(greatest(s1, coalesce(s2, 0)), 6) AS DOUBLE) AS score, CASE WHEN coalesce(s2 > s1, false) THEN {CAT.format(m='am', p='ap')} ELSE {CAT.format(m='md', p='pc')} END AS category FROM s""")
def key_score(spark, sf):
    mix = K.estimate_key(K.correlations(vectors(spark, sf, F.lit(1)), KEYS), KEYS)
    keys = mix.select("track_id", "tonic", "mode", F.lit(None).cast("int").alias("hedge_tonic"), F.lit(None).cast("string").alias("hedge_mode"))
    t = B.tracks(spark, sf).select("track_id", (F.col("track_id") % 12).alias("pc"), F.when(F.col("track_id") % 2 == 0, "major").otherwise("minor").alias("mode"),
                                   F.when(F.col("track_id") % 3 == 0, F.col("track_id") * 5 % 12).alias("alt_pc"), F.lit("major").alias("alt_mode"))
    return T.key_scores(t, keys).select("track_id", r6("score"), "category")


AB = f"""{S.SPANS}, a AS (SELECT track_id, span_id, start, "end", replace(label, ':7', ':maj') AS triad FROM spans), b AS (SELECT track_id, start + 3600 AS s, "end" + 3600 AS e, triad FROM a WHERE span_id % 5 <> 0)"""


@query("weighted_label_overlap", f"""WITH {AB}, o AS (SELECT a.track_id, a.triad AS r, b.triad AS e, least(a."end", b.e) - greatest(a.start, b.s) AS w FROM a JOIN b ON a.track_id = b.track_id AND least(a."end", b.e) > greatest(a.start, b.s)),
al AS (SELECT * FROM o UNION ALL SELECT track_id, r, 'N', d - coalesce(c, 0) FROM (SELECT track_id, triad AS r, sum("end" - start) AS d FROM a GROUP BY 1, 2) LEFT JOIN (SELECT track_id, r, sum(w) AS c FROM o GROUP BY 1, 2) USING (track_id, r))
SELECT track_id, round(sum(CASE WHEN split_part(r, ':', 1) = split_part(e, ':', 1) THEN w ELSE 0 END) / sum(w), 6) AS root, round(sum(CASE WHEN r = e AND NOT r LIKE '%:dim' THEN w ELSE 0 END) / sum(CASE WHEN NOT r LIKE '%:dim' THEN w ELSE 0 END), 6) AS majmin,
 round(sum(CASE WHEN r = e THEN w ELSE 0 END) / sum(w), 6) AS triads FROM al GROUP BY 1""")
def weighted_label_overlap(spark, sf):
    a = share(B.spans(spark, sf).withColumn("triad", F.regexp_replace("label", ":7$", ":maj")))
    b = a.where("span_id % 5 <> 0").withColumn("start", F.col("start") + 3600).withColumn("end", F.col("end") + 3600)
    return T.label_overlap(a, b, B.DAY).select("track_id", r6("root"), r6("majmin"), r6("triads"))


@query("segmentation_scores", f"""WITH {AB}, sp AS (SELECT track_id, min(start) AS lo, max("end") AS hi FROM a GROUP BY 1), c AS (SELECT b.track_id, greatest(s, lo) AS s, least(e, hi) AS e, lo, hi FROM b JOIN sp USING (track_id) WHERE least(e, hi) > greatest(s, lo)),
ed AS (SELECT track_id, lo, hi, min(s) AS f, max(e) AS l FROM c GROUP BY 1, 2, 3), fu AS (SELECT track_id, s, e FROM c UNION ALL SELECT track_id, lo, f FROM ed WHERE f > lo UNION ALL SELECT track_id, l, hi FROM ed WHERE hi > l),
d1 AS (SELECT track_id, sum(d - b) / sum(d) AS d FROM (SELECT a.track_id, a.start, a."end" - a.start AS d, coalesce(max(least(a."end", fu.e) - greatest(a.start, fu.s)) FILTER (least(a."end", fu.e) > greatest(a.start, fu.s)), 0) AS b FROM a LEFT JOIN fu ON a.track_id = fu.track_id GROUP BY 1, 2, 3) GROUP BY 1),
d2 AS (SELECT track_id, sum(d - b) / sum(d) AS d FROM (SELECT fu.track_id, fu.s, fu.e - fu.s AS d, coalesce(max(least(a."end", fu.e) - greatest(a.start, fu.s)) FILTER (least(a."end", fu.e) > greatest(a.start, fu.s)), 0) AS b FROM fu LEFT JOIN a ON a.track_id = fu.track_id GROUP BY 1, 2, 3) GROUP BY 1)
SELECT track_id, round(1 - d1.d, 6) AS overseg, round(1 - d2.d, 6) AS underseg, round(least(1 - d1.d, 1 - d2.d), 6) AS seg FROM d1 JOIN d2 USING (track_id)""")
def segmentation_scores(spark, sf):
    a = share(B.spans(spark, sf).select("track_id", "span_id", "start", "end").where("end > start"))
    b = a.where("span_id % 5 <> 0").withColumn("start", F.col("start") + 3600).withColumn("end", F.col("end") + 3600)
    return T.segmentation_scores(a, b, B.DAY).select("track_id", r6("overseg"), r6("underseg"), r6("seg"))


@query("compact_ranges", f"""WITH {REST}, g AS (SELECT track_id, bar, bar - row_number() OVER (PARTITION BY track_id ORDER BY bar) AS g FROM rec WHERE rests), r AS (SELECT track_id, min(bar) AS a, max(bar) AS b FROM g GROUP BY track_id, g)
SELECT track_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS resting FROM r GROUP BY 1""")
def compact_ranges(spark, sf):
    return T.compact_ranges(records(spark, sf).where("rests").select("track_id", "bar"), "resting")


# --- the sweep: suppliers are songs, their 28 frame bars carry the energy ratio and a truth flag
VALUES = [round(0.80 + 0.05 * i, 10) for i in range(9)]
SW = f"""{FS}, en AS (SELECT track_id, bar, {rq('guitar', 'mix')} AS energy, guitar_low_power < 0.5 * guitar_total_power AS truth, (track_id + bar) % 13 = 0 AS fixed FROM bs WHERE mix_n_samples > 0),
vl AS (SELECT CAST(i AS INTEGER) AS value_index, round(0.80 + 0.05 * i, 10)::DOUBLE AS value FROM range(9) t(i)),
rf AS (SELECT track_id, bar, value_index, value, truth, CASE WHEN fixed THEN bar % 2 = 0 ELSE energy < value END AS pred FROM en, vl),
ct AS (SELECT track_id, value_index, value, count(*) FILTER (truth AND pred) AS hits, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (truth AND NOT pred) AS fn FROM rf GROUP BY 1, 2, 3),
tot AS (SELECT value_index, sum(hits) AS th, sum(fp) AS tp, sum(fn) AS tn FROM ct GROUP BY 1),
lo AS (SELECT c.track_id, c.value_index, value, 2 * (th - hits) / nullif(CAST(2 * (th - hits) + tp - fp + tn - fn AS DOUBLE), 0) AS obj FROM ct c JOIN tot USING (value_index)),
bt AS (SELECT *, max(obj) OVER (PARTITION BY track_id) AS best FROM lo),
ti AS (SELECT *, value_index - row_number() OVER (PARTITION BY track_id ORDER BY value_index) AS run FROM bt WHERE abs(obj - best) <= 1e-9),
bd AS (SELECT track_id, best, run, count(*) AS w, min(value_index) AS f, min(value) AS low, max(value) AS high FROM ti GROUP BY 1, 2, 3),
wd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, f) AS r FROM bd) WHERE r = 1)"""


def reflagged(spark, sf):
    b = bar_sums(spark, sf).where("mix_n_samples > 0").select("track_id", "bar", SG.ratio("guitar", "mix").alias("energy"),
        (F.col("guitar_low_power") < 0.5 * F.col("guitar_total_power")).alias("truth"), ((F.col("track_id") + F.col("bar")) % 13 == 0).alias("fixed"))
    pred = F.when(F.col("fixed"), F.col("bar") % 2 == 0).otherwise(F.col("energy") < F.col("value"))
    return W.over_values(b, VALUES).withColumn("pred", pred)


def sweep_counts(spark, sf):
    c = T.rest_counts(reflagged(spark, sf), ["track_id", "value_index", "value"])
    return share(c.withColumnsRenamed({"deletions": "fp", "insertions": "fn"}).drop("scored"))


@query("rest_reflag", f"WITH {SW} SELECT track_id, bar, value, pred FROM rf")
def rest_reflag(spark, sf):
    return reflagged(spark, sf).select("track_id", "bar", "value", "pred")


@query("sweep_pooled", f"""WITH {SW} SELECT value, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * sum(hits) / CAST(2 * sum(hits) + sum(fp) + sum(fn) AS DOUBLE), 6) AS objective FROM ct GROUP BY 1""")
def sweep_pooled(spark, sf):
    return W.pooled_curve(sweep_counts(spark, sf), ["hits", "fp", "fn"], W.f_measure("hits", "fp", "fn")).select("value", "hits", "fp", "fn", r6("objective"))


@query("param_sweep_loo", f"""WITH {SW} SELECT wd.track_id, round(wd.best, 6) AS objective, ti.value AS best_value, low, high FROM wd JOIN ti ON ti.track_id = wd.track_id AND ti.value_index = wd.f + (w - 1) // 2""")
def param_sweep_loo(spark, sf):
    b = W.held_out_bands(sweep_counts(spark, sf), "track_id", ["hits", "fp", "fn"], W.f_measure("hits", "fp", "fn"))
    return b.select("track_id", r6("objective"), "best_value", "low", "high")


@query("sweep_verdict", f"""WITH {SW} SELECT count(*) AS songs, count(*) FILTER (NOT (low <= 1.0 + 1e-9 AND 1.0 <= high + 1e-9)) AS outside, bool_and(low <= 1.0 + 1e-9 AND 1.0 <= high + 1e-9) AS inside FROM wd""")
def sweep_verdict(spark, sf):
    b = W.held_out_bands(sweep_counts(spark, sf), "track_id", ["hits", "fp", "fn"], W.f_measure("hits", "fp", "fn"))
    return W.verdict(b, 1.0)


@query("rollup_view", f"""WITH {SW} SELECT value, CAST(track_id AS DOUBLE) AS track_id, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ct GROUP BY ROLLUP (value, track_id)""")
def rollup_view(spark, sf):
    return sweep_counts(spark, sf).rollup("value", "track_id").agg(*[F.sum(c).alias(c) for c in ("hits", "fp", "fn")]).withColumn("track_id", F.col("track_id").cast("double"))


GATE = f"""{FS}, sg AS (SELECT track_id, section, section * 7 AS a, section * 7 + 7 AS b, sum(bass_low_power) / nullif(sum(mix_low_power), 0) - 0.5 <= 0.25 AND sum(guitar_low_power) / (sum(guitar_total_power) + 1e-12) >= 0.40 AS fired FROM bs GROUP BY 1, 2),
tr AS (SELECT l_suppkey AS track_id, l_orderkey * 16 + l_linenumber AS line, l_orderkey % 25 AS s, l_orderkey % 25 + 1 + l_linenumber AS e, l_returnflag = 'R' AS positive FROM lineitem),
rg AS (SELECT t.track_id, t.line, bool_or(positive) AS positive, bool_or(fired) AS fired FROM tr t JOIN sg ON sg.track_id = t.track_id AND sg.a < t.e AND t.s < sg.b GROUP BY 1, 2)"""


@query("gate_counts", f"""WITH {GATE} SELECT track_id, count(*) FILTER (fired AND positive) AS true_pos, count(*) FILTER (fired AND NOT positive) AS false_pos, count(*) FILTER (positive AND NOT coalesce(fired, false)) AS missed FROM rg GROUP BY 1""")
def gate_counts(spark, sf):
    return range_gate(spark, sf).groupBy("track_id").agg(
        F.count_if(F.col("fired") & F.col("positive")).alias("true_pos"), F.count_if(F.col("fired") & ~F.col("positive")).alias("false_pos"),
        F.count_if(F.col("positive") & ~F.col("fired")).alias("missed"))


@query("figures_over_range", f"""WITH {GATE} SELECT track_id, line, coalesce(fired, false) AS fired FROM rg""")
def figures_over_range(spark, sf):
    return range_gate(spark, sf).select("track_id", "line", "fired")


def range_gate(spark, sf):
    from stavework.operators.intervals import overlap
    b = bar_sums(spark, sf)
    sec = b.groupBy(*SEC).agg(*[F.sum(c).alias(c) for c in ("bass_low_power", "mix_low_power", "guitar_low_power", "guitar_total_power")])
    fired = F.coalesce((F.try_divide("bass_low_power", "mix_low_power") - 0.5 <= 0.25) & (SG.low_share("guitar") >= 0.40), F.lit(False))
    sec = sec.select("track_id", "section", (F.col("section") * 7).alias("a"), (F.col("section") * 7 + 7).alias("b"), fired.alias("fired"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    tr = li.select(F.col("l_suppkey").alias("track_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line"), (F.col("l_orderkey") % 25).alias("s"),
                   (F.col("l_orderkey") % 25 + 1 + F.col("l_linenumber")).alias("e"), (F.col("l_returnflag") == "R").alias("positive"))
    hits = overlap(tr, sec, KEYS, ("s", "e"), ("a", "b"), 16)
    return hits.groupBy("track_id", "line").agg(F.bool_or("positive").alias("positive"), F.bool_or("fired").alias("fired"))
