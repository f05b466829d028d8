"""Queries over frames and notes: levels, shares, rests, riffs, rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r6
from stavework.operators import harmony_spans as H, intervals as I, riff as RF, signal as G
from stavework.operators.ordered import with_position
from stavework.session import share, share_rows

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS = ["track_id"]
SEC = ["track_id", "section"]
STEMS = ["guitar", "bass", "mix"]
BUCKET = B.FRAME_BAR

FS = f"""{S.FRAMES}, {S.FBARS},
bs AS (SELECT b.track_id, b.section, b.bar, b.width, {', '.join(f"coalesce(sum({c}) FILTER (stem = '{s}'), 0) AS {s}_{c}" for s in STEMS for c in ('sumsq', 'n_samples', 'low_power', 'total_power'))}
  FROM fbars b LEFT JOIN frames f ON f.track_id = b.track_id AND f.t >= b.start AND f.t < b."end" - (b."end" - b.start) / b.width / 2 GROUP BY 1, 2, 3, 4)"""


def rq(s, w):
    def rms(x):
        return f"sqrt(coalesce({x}_sumsq / nullif({x}_n_samples, 0), 0))"
    return f"({rms(s)} / greatest({rms(w)}, 1e-9))"


def bar_sums(spark, sf):
    bars = G.trimmed(B.frame_bars(spark, sf))
    sums = G.stem_sums(B.frames(spark, sf), bars, STEMS, BUCKET, ["track_id", "bar"])
    fill = {c: 0.0 for c in sums.columns if c not in ("track_id", "bar")}
    return bars.select("track_id", "section", "bar").join(sums, ["track_id", "bar"], "left").fillna(fill)


@query("span_rms_ratio", f"WITH {FS} SELECT track_id, bar, round({rq('guitar', 'mix')}, 6) AS energy_ratio FROM bs")
def span_rms_ratio(spark, sf):
    return bar_sums(spark, sf).select("track_id", "bar", r6(G.ratio("guitar", "mix"), "energy_ratio"))


@query("low_share", f"""WITH {FS} SELECT track_id, bar, round(guitar_low_power / (guitar_total_power + 1e-12), 6) AS low_own_share, round(bass_low_power / greatest(mix_low_power, 1e-12), 6) AS low_mix_share_bass,
  round(guitar_low_power / greatest(mix_low_power, 1e-12), 6) AS low_mix_share_source, round({rq('bass', 'mix')}, 6) AS bass_stem_ratio FROM bs WHERE mix_low_power > 0""")
def low_share(spark, sf):
    f = G.bleed_figures("guitar", "bass", "mix")
    return bar_sums(spark, sf).where("mix_low_power > 0").select("track_id", "bar", *[r6(c, n) for n, c in f.items()])


@query("rest_rule", f"""WITH {FS} SELECT track_id, bar, {rq('guitar', 'mix')} >= 0.05 AND (track_id % 3 = 0 OR guitar_low_power / (guitar_total_power + 1e-12) >= 0.005) AS holds FROM bs""")
def rest_rule(spark, sf):
    return bar_sums(spark, sf).select("track_id", "bar", G.bar_holds(G.ratio("guitar", "mix"), G.low_share("guitar"), F.col("track_id") % 3 == 0).alias("holds"))


SECSUM = f"""{FS}, ss AS (SELECT track_id, section, {', '.join(f"sum({s}_{c}) AS {s}_{c}" for s in STEMS for c in ('sumsq', 'n_samples', 'low_power', 'total_power'))} FROM bs GROUP BY 1, 2)"""


def section_sums(spark, sf):
    b = bar_sums(spark, sf)
    return b.groupBy(*SEC).agg(*[F.sum(c).alias(c) for c in b.columns if c not in ("track_id", "section", "bar")])


@query("section_has_instrument", f"WITH {SECSUM} SELECT track_id, section, {rq('guitar', 'mix')} >= 0.10 AS has_instrument FROM ss")
def section_has_instrument(spark, sf):
    return section_sums(spark, sf).select(*SEC, (G.ratio("guitar", "mix") >= 0.10).alias("has_instrument"))


@query("bass_on_stem", f"""WITH {SECSUM} SELECT track_id, section, {rq('bass', 'mix')} - 0.95 <= 0.05 AND guitar_low_power / (guitar_total_power + 1e-12) >= 0.40 AS gated FROM ss""")
def bass_on_stem(spark, sf):
    return section_sums(spark, sf).select(*SEC, G.bass_on_stem(G.ratio("bass", "mix") - 0.95, G.low_share("guitar")).alias("gated"))


@query("choose_source", f"""WITH {SECSUM}, r AS (SELECT track_id, section, {rq('guitar', 'mix')} * CASE WHEN section = 3 THEN 0.01 ELSE 1 END AS g, {rq('bass', 'mix')} * CASE WHEN section = 3 THEN 0.01 ELSE 1 END AS o FROM ss)
SELECT track_id, section, CASE WHEN greatest(g, o) < 0.05 THEN 'mix' WHEN g > o THEN 'guitar_stem' ELSE 'other_stem' END AS source, round(greatest(g, o), 6) AS ratio FROM r""")
def choose_source(spark, sf):
    quiet = F.when(F.col("section") == 3, 0.01).otherwise(1.0)
    src, ratio = G.choose_source(G.ratio("guitar", "mix") * quiet, G.ratio("bass", "mix") * quiet, ("guitar_stem", "other_stem"))
    return section_sums(spark, sf).select(*SEC, src.alias("source"), r6(ratio, "ratio"))


RIFF = S.CHROMA + """,
p AS (SELECT track_id, vec_id, list_transform(chroma, lambda x: x * x) AS c FROM chroma),
e AS (SELECT track_id, vec_id, CASE WHEN list_max(c) <= 0 THEN 1.0 ELSE -list_sum(list_transform(c, lambda x: x / (list_sum(c) + 1e-12) * ln(x / (list_sum(c) + 1e-12) + 1e-12))) / ln(12) END AS entropy,
  list_max(c) > 0 AND len(list_filter(c, lambda x: x >= 0.5 * list_max(c))) = 1 AS single FROM p),
f AS (SELECT track_id, median(entropy) AS entropy, avg(CAST(single AS INTEGER)) AS single_share FROM e GROUP BY 1)"""


def features(spark, sf):
    c = B.chroma(spark, sf).withColumn("power", F.transform("chroma", lambda x: x * x))
    entropy, single = G.riff_features(F.col("power"))
    rows = share(c.select("track_id", entropy.alias("entropy"), single.alias("single")))
    med = G.exact_median(rows, KEYS, "entropy", "entropy")
    return med.join(rows.groupBy("track_id").agg(F.avg(F.col("single").cast("int")).alias("single_share")), KEYS)


@query("riff_features", f"WITH {RIFF} SELECT track_id, round(entropy, 6) AS entropy, round(single_share, 6) AS single_share FROM f")
def riff_features(spark, sf):
    return features(spark, sf).select("track_id", r6("entropy"), r6("single_share"))


# notes: each onset's pitches are the track's events in the six hours after it, one per frame
NOTES = f"""{S.EV}, on0 AS (SELECT track_id, event_id, t, k, least(coalesce(lead(t, 3) OVER (PARTITION BY track_id ORDER BY t, event_id), t + 86400), t + 86400) AS ne FROM ev),
fr AS (SELECT track_id, event_id AS fid, t AS ft, CASE WHEN event_type <> 'signup' THEN 40 + k * 0.5 END AS midi FROM ev),
nn AS (SELECT o.track_id, o.event_id, any_value(o.t) AS t, any_value(o.k) AS k, CASE WHEN count(midi) / CAST(count(*) AS DOUBLE) >= 0.5 THEN CAST(round_even(median(midi), 0) AS INTEGER) END AS note
  FROM on0 o JOIN fr ON fr.track_id = o.track_id AND fr.ft >= o.t + 72 AND fr.ft < o.ne - 36 GROUP BY 1, 2),
notes AS (SELECT o.track_id, o.event_id, o.t, nn.note, CASE WHEN o.k % 5 <> 0 THEN o.k % 12 END AS root FROM on0 o LEFT JOIN nn USING (track_id, event_id))"""


def pitch_frames(ev):
    return ev.select("track_id", F.col("t").alias("ft"), F.when(F.col("event_type") != "signup", 40 + F.col("k") * 0.5).alias("midi"))


def notes(spark, sf):
    ev = share(B.events(spark, sf))
    on = share(with_position(ev.select("track_id", F.col("event_id").alias("onset_id"), "t", "k"), KEYS, ["t", "onset_id"], B.EVENT_CHUNK))
    third = on.select("track_id", (F.col("pos") - 3).alias("pos"), F.col("t").alias("then"))  # the third event after each onset
    on = on.join(third, ["track_id", "pos"], "left")
    on = on.withColumn("note_end", F.least(F.coalesce("then", F.col("t") + 86400), F.col("t") + 86400)).drop("then", "pos")
    return G.name_notes(on, pitch_frames(ev), B.DAY, 72.0, 36.0).withColumn("root", F.when(F.col("k") % 5 != 0, F.col("k") % 12))


@query("note_naming", f"WITH {NOTES} SELECT track_id, event_id AS onset_id, CAST(note AS DOUBLE) AS note FROM notes")
def note_naming(spark, sf):
    return notes(spark, sf).select("track_id", "onset_id", F.col("note").cast("double").alias("note"))


@query("note_shares", f"""WITH {NOTES}, l AS (SELECT *, lag(note) OVER (PARTITION BY track_id ORDER BY t, event_id) AS b FROM notes)
SELECT track_id, round(sum(CASE WHEN note <> b THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (note IS NOT NULL AND b IS NOT NULL), 0), 6) AS pitch_change,
  round(sum(CASE WHEN note % 12 = root THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (note IS NOT NULL AND root IS NOT NULL), 0), 6) AS root_share, round(count(note) / CAST(count(*) AS DOUBLE), 6) AS named_share FROM l GROUP BY 1""")
def note_shares(spark, sf):
    s = G.note_shares(share(notes(spark, sf)), KEYS, ["t", "onset_id"], B.EVENT_CHUNK)
    return s.select("track_id", r6("pitch_change"), r6("root_share"), r6("named_share"))


def riff_flags(spark, sf, named, by):
    """(by, riff) of each group of named notes: its own pitch changes, the chroma of the track's label, every seventh track gated."""
    from stavework.operators.rules import is_riff
    s = G.note_shares(named, by, ["t", "onset_id"], B.EVENT_CHUNK).withColumn("label", F.col("track_id") % 10)
    f = features(spark, sf).withColumnRenamed("track_id", "label")
    flag = is_riff(F.col("entropy") - 0.1, F.col("single_share") + 0.2, F.col("pitch_change"), F.col("track_id") % 7 == 0)
    return s.join(f, "label", "left").select(*by, flag.alias("riff"))


@query("riff_flag", f"""WITH {NOTES}, l AS (SELECT *, lag(note) OVER (PARTITION BY track_id ORDER BY t, event_id) AS b FROM notes), s AS (SELECT track_id, sum(CASE WHEN note <> b THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (note IS NOT NULL AND b IS NOT NULL), 0) AS pc FROM l GROUP BY 1),
{RIFF}
SELECT s.track_id, coalesce(entropy - 0.1 <= 0.82 AND single_share + 0.2 >= 0.45 AND pc >= 0.26, false) AND s.track_id % 7 <> 0 AS riff FROM s LEFT JOIN f ON f.track_id = s.track_id % 10""")
def riff_flag(spark, sf):
    return riff_flags(spark, sf, share(notes(spark, sf)), KEYS)


DECAY = f"""{S.EV}, st AS (SELECT track_id, event_id, t, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS nt FROM ev),
ok AS (SELECT * FROM st WHERE nt IS NULL OR nt - t >= 1.5 * 7200),
fr AS (SELECT track_id, t + 60 * (j * j % 97) AS ft, abs(value) * (1.0 + (k * j) % 13) AS level FROM ev, range(1, 120, 17) r(j)),
pk AS (SELECT * FROM (SELECT o.track_id, o.event_id, ft AS pt, level AS pl, row_number() OVER (PARTITION BY o.track_id, o.event_id ORDER BY level DESC, ft) AS r FROM ok o JOIN fr ON fr.track_id = o.track_id AND ft >= o.t AND ft < o.t + 3600) WHERE r = 1 AND pl > 1e-9),
af AS (SELECT * FROM (SELECT p.*, fr.level, row_number() OVER (PARTITION BY p.track_id, p.event_id ORDER BY ft, level) AS r2 FROM pk p JOIN fr ON fr.track_id = p.track_id AND ft >= p.pt + 7200 AND ft < p.pt + 14400) WHERE r2 = 1),
dc AS (SELECT st.track_id, st.event_id, st.t, CASE WHEN level IS NOT NULL THEN greatest(0, 20 * log10(pl / greatest(level, 1e-9))) END AS db FROM st LEFT JOIN af USING (track_id, event_id))"""


def decays(spark, sf):
    ev = share(B.events(spark, sf))
    fr = ev.select("track_id", "t", "value", "k", F.explode(F.array(*[F.lit(j) for j in range(1, 120, 17)])).alias("j")).select(
        "track_id", (F.col("t") + 60 * (F.col("j") * F.col("j") % 97)).alias("ft"), (F.abs("value") * (1.0 + (F.col("k") * F.col("j")) % 13)).alias("level"))
    on = ev.select("track_id", F.col("event_id").alias("onset_id"), "t", F.lit(7200.0).alias("slot_seconds"))
    return G.stroke_decay(on, fr, 7200.0, B.EVENT_CHUNK)


@query("stroke_decay", f"WITH {DECAY} SELECT track_id, event_id AS onset_id, round(db, 6) AS decay_db FROM dc")
def stroke_decay(spark, sf):
    return decays(spark, sf).select("track_id", "onset_id", r6("decay_db"))


@query("section_rings", f"""WITH {DECAY}, s AS (SELECT track_id, CASE WHEN t < 604800 THEN 0 WHEN t < 1209600 THEN 1 WHEN t < 1814400 THEN 2 ELSE 3 END AS section, median(db) AS m FROM dc GROUP BY 1, 2)
SELECT track_id, section, coalesce(m < 5, true) AS rings, round(m, 6) AS median_db FROM s""")
def section_rings(spark, sf):
    d = share(decays(spark, sf).withColumn("section", B.section_of(F.floor(F.col("t") / B.DAY))))
    return G.section_rings(d, SEC).select(*SEC, "rings", r6("median_db"))


# note bars of the vote's own queries: the slot owners that strike, with a pitch from their k (the riff job names its notes)
NB = f"""{S.QUANT}, nt AS (SELECT track_id, section, bar, slot, CAST(slot * 1000 + 60 + CAST(zcr AS INTEGER) % 4 AS BIGINT) AS note FROM owners WHERE NOT muted),
nb AS (SELECT b.track_id, b.section, b.bar, coalesce(list_sort(list(note) FILTER (note IS NOT NULL)), []) AS notes, row_number() OVER (PARTITION BY b.track_id, b.section ORDER BY b.bar) - 1 AS pos FROM bars b LEFT JOIN nt ON nt.track_id = b.track_id AND nt.bar = b.bar GROUP BY 1, 2, 3),
jn AS (SELECT a.track_id, a.section, a.pos, b.pos AS bpos, CASE WHEN len(list_distinct(list_concat(list_transform(a.notes, lambda x: x // 1000), list_transform(b.notes, lambda x: x // 1000)))) = 0 THEN 1.0
  ELSE len(list_intersect(a.notes, b.notes)) / CAST(len(list_distinct(list_concat(list_transform(a.notes, lambda x: x // 1000), list_transform(b.notes, lambda x: x // 1000)))) AS DOUBLE) END AS j FROM nb a JOIN nb b USING (track_id, section)),
md AS (SELECT track_id, section, pos, avg(j) FILTER (pos <> bpos) AS sc FROM jn GROUP BY 1, 2, 3),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, section ORDER BY round(sc, 9) DESC, pos) AS r FROM md) WHERE r = 1)"""


def note_bars(spark, sf):
    from stavework.operators import quantise as Q
    bars = B.bars(spark, sf)
    own = Q.slot_owners(B.onsets(spark, sf), bars, B.DAY).where("not muted")
    pitched = own.join(B.onsets(spark, sf).select("onset_id", "zcr"), "onset_id").withColumn(
        "note", (F.col("slot") * RF.SCALE + 60 + F.col("zcr").cast("int") % 4).cast("long"))
    per_bar = pitched.groupBy("track_id", "bar").agg(F.array_sort(F.collect_list("note")).alias("notes"))  # one per slot
    return share_rows(bars.join(per_bar, ["track_id", "bar"], "left").select(
        *SEC, "bar", "width", F.coalesce("notes", F.array().cast("array<bigint>")).alias("notes")))


@query("riff_medoid", f"WITH {NB} SELECT track_id, section, pos AS medoid_pos, round(sc, 6) AS score FROM m1")
def riff_medoid(spark, sf):
    from stavework.operators import votes as V
    units = V.units_of_bars(note_bars(spark, sf))
    m = V.medoid(V.agreement_sums(units, SEC, ["notes"], RF.note_agreement), SEC, ["notes"])
    return m.select(*SEC, "medoid_pos", r6("score_medoid", "score"))


@query("riff_majority", f"""WITH {NB}, c AS (SELECT track_id, section, note // 1000 AS slot, note, count(*) AS c FROM nt GROUP BY ALL), n AS (SELECT track_id, section, count(*) AS n FROM nb GROUP BY 1, 2),
w AS (SELECT *, sum(c) OVER (PARTITION BY track_id, section, slot) AS tot, row_number() OVER (PARTITION BY track_id, section, slot ORDER BY c DESC, note) AS r FROM c)
SELECT n.track_id, n.section, coalesce(string_agg(CAST(note AS VARCHAR), ',' ORDER BY note), '') AS riff FROM n LEFT JOIN w ON w.track_id = n.track_id AND w.section = n.section AND r = 1 AND tot * 2 >= n GROUP BY 1, 2""")
def riff_majority(spark, sf):
    return RF.riff_majority(note_bars(spark, sf)).select(*SEC, F.array_join("v_notes", ",").alias("riff"))


@query("choose_riff")
def choose_riff(spark, sf):
    c = RF.choose_riff(note_bars(spark, sf))
    return c.select(*SEC, "unit", "phase", "candidate", r6("agreement"), r6("support"), F.array_join("notes", ",").alias("riff"))


@query("riff_gate", f"""WITH {S.EV}, p AS (SELECT event_id, k / 100.0 AS a, value / 100.0 AS s, (k % 10) / 10.0 AS n, event_type <> 'error' AS f FROM ev)
SELECT event_id, CASE WHEN n = 0 THEN printf('named %.2f < 0.60', n) WHEN a < 0.70 THEN printf('agreement %.2f < 0.70', a) WHEN s < 0.75 THEN 'support' WHEN n < 0.60 THEN printf('named %.2f < 0.60', n) WHEN NOT f THEN 'not a riff' END AS reason FROM p""")
def riff_gate(spark, sf):
    ev = B.events(spark, sf)
    reason = RF.riff_gate((F.col("k") / 100.0), F.col("value") / 100.0, (F.col("k") % 10) / 10.0, F.col("event_type") != "error")
    return ev.select("event_id", F.when(reason.startswith("support"), "support").otherwise(reason).alias("reason"))


@query("pitch_midi", f"""WITH {S.EV} SELECT DISTINCT ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][k % 12 + 1] || CAST(k // 12 - 1 AS VARCHAR) AS name, CAST(k AS INTEGER) AS midi FROM ev""")
def pitch_midi(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, B.SHARPS)), (F.col("k") % 12 + 1).cast("int")), (F.floor(F.col("k") / 12) - 1).cast("string"))
    return B.events(spark, sf).select(name.alias("name")).distinct().select("name", RF.pitch_midi(F.col("name")).alias("midi"))


@query("octave_shift", f"""WITH {S.EV}, n AS (SELECT track_id, CAST(floor(t / 86400) AS INTEGER) AS bar, 30 + k AS m FROM ev), s AS (SELECT track_id, bar, sh, count(*) FILTER (m + 12 * sh BETWEEN 60 AND 81) AS c FROM n, range(-2, 3) r(sh) GROUP BY 1, 2, 3)
SELECT track_id, bar, CAST(sh AS INTEGER) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY track_id, bar ORDER BY c DESC, abs(sh), -sh) AS r FROM s) WHERE r = 1""")
def octave_shift(spark, sf):
    n = B.events(spark, sf).groupBy("track_id", F.floor(F.col("t") / B.DAY).cast("int").alias("bar")).agg(*RF.shift_counts(30 + F.col("k")))
    return n.select("track_id", "bar", RF.octave_shift().alias("shift"))


@query("string_fret", f"""WITH {S.EV}, m AS (SELECT DISTINCT 20 + k AS midi FROM ev), r AS (SELECT midi, CASE WHEN midi < 60 THEN midi + 12 * CAST(ceil((60 - midi) / 12.0) AS INTEGER) WHEN midi > 81 THEN midi - 12 * CAST(ceil((midi - 81) / 12.0) AS INTEGER) ELSE midi END AS moved FROM m),
o AS (SELECT midi, moved, s, moved - v AS f FROM r, (VALUES (0, 67), (1, 60), (2, 64), (3, 69)) t(s, v) WHERE moved >= v)
SELECT midi, CAST(moved AS INTEGER) AS moved, CAST(s AS INTEGER) AS string, CAST(f AS INTEGER) AS fret FROM (SELECT *, row_number() OVER (PARTITION BY midi ORDER BY f, s) AS r FROM o) WHERE r = 1""")
def string_fret(spark, sf):
    m = B.events(spark, sf).select((F.col("k") + 20).alias("midi")).distinct().withColumn("moved", RF.into_range(F.col("midi")))
    at = RF.string_fret(F.col("moved"), [67, 60, 64, 69])
    return m.withColumn("at", at).select("midi", "moved", "at.string", "at.fret")
