"""Queries over the beat grid: the irregular beats are each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r3, r6
from stavework.operators import grid as G, harmony_spans as H, intervals as I, ordered as O
from stavework.operators.validate import grid_constraints as check_grid, level_constraints as check_levels
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
DAY, WEEK = B.DAY, B.EVENT_CHUNK
KEYS = ["track_id"]
END = 30 * DAY

POS = S.EV + """,
beats AS (SELECT track_id, event_id, t, k, event_type, value, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS i,
  lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS prev_t, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS gap FROM ev)"""
TEMPO = "tempo AS (SELECT track_id, 60.0 / median(gap) AS bpm, 60.0 / avg(gap) AS mean_bpm, median(gap) AS median_gap FROM beats GROUP BY 1 HAVING count(gap) > 0)"
FILL = """loc AS (SELECT *, median(gap) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med FROM beats WHERE gap IS NOT NULL),
ins AS (SELECT track_id, prev_t, gap, greatest(1, CAST(round_even(gap / med, 0) AS INTEGER) - 1) AS n FROM loc WHERE gap > 1.6 * med),
filled AS (SELECT track_id, t, 'detected' AS origin FROM beats UNION ALL
  SELECT track_id, prev_t + j * (gap / (n + 1)), 'inserted' FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM ins))"""


def beats(spark, sf):
    return B.events(spark, sf)


def indexed(spark, sf):
    return O.with_position(beats(spark, sf), KEYS, ["t", "event_id"], WEEK, "i")


@query("end_of_clip_filter", f"""WITH {S.EV}, k AS (SELECT track_id, count(*) FILTER (t < (track_id % 5) * 86400) AS n FROM ev GROUP BY 1)
SELECT track_id, n AS n_beats, n < 2 AS rejected FROM k""")
def end_of_clip_filter(spark, sf):
    dur = B.tracks(spark, sf).withColumn("duration", (F.col("track_id") % 5) * 86400.0)
    kept, few = G.end_of_clip(beats(spark, sf), dur)
    counts = kept.groupBy("track_id").agg(F.count("*").alias("n_beats")).where("n_beats >= 2")
    return counts.withColumn("rejected", F.lit(False)).unionByName(few.withColumn("rejected", F.lit(True)))


@query("fill_gaps", f"WITH {POS}, {FILL} SELECT track_id, round(t, 3) AS t, origin FROM filled")
def fill_gaps(spark, sf):
    return G.fill_gaps(beats(spark, sf), WEEK).select("track_id", r3("t"), "origin")


@query("inserted_beats", f"""WITH {POS}, {FILL} SELECT DISTINCT track_id, round(t, 3) AS t FROM filled
EXCEPT SELECT track_id, round(t, 3) FROM beats""")
def inserted_beats(spark, sf):
    b = beats(spark, sf)
    return G.fill_gaps(b, WEEK).select("track_id", r3("t")).subtract(b.select("track_id", r3("t")))


@query("tempo", f"WITH {POS}, {TEMPO} SELECT track_id, round(bpm, 6) AS bpm, round(mean_bpm, 6) AS mean_bpm FROM tempo")
def tempo(spark, sf):
    return G.tempo(beats(spark, sf), WEEK).select("track_id", r6("bpm"), r6("mean_bpm"))


PHASE = """cnt AS (SELECT track_id, CAST(i % 4 AS INTEGER) AS phase, count(*) AS c FROM beats WHERE event_type = 'purchase' GROUP BY 1, 2),
phase AS (SELECT track_id, phase, c, sum(c) OVER (PARTITION BY track_id) AS total, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, phase) AS r FROM cnt)"""


@query("modal_phase", f"WITH {POS}, {PHASE} SELECT track_id, phase, round(c / total, 6) AS share FROM phase WHERE r = 1")
def modal_phase(spark, sf):
    down = indexed(spark, sf).where("event_type = 'purchase'")
    return G.modal_phase(down, 4).select("track_id", "phase", r6("share"))


@query("downbeat_nearest", f"""WITH {POS}, d AS (SELECT track_id, event_id, t + (k % 10) * 0.03 - 0.1 AS d FROM beats WHERE event_type IN ('view', 'click')),
n AS (SELECT d.track_id, d.event_id, b.i, row_number() OVER (PARTITION BY d.track_id, d.event_id ORDER BY abs(b.t - d.d), b.i) AS r
  FROM d JOIN beats b ON d.track_id = b.track_id AND abs(b.t - d.d) <= 0.07)
SELECT DISTINCT track_id, i FROM n WHERE r = 1""")
def downbeat_nearest(spark, sf):
    b = indexed(spark, sf)
    d = b.where("event_type in ('view', 'click')").select(
        "track_id", F.col("event_id").alias("d_id"), (F.col("t") + (F.col("k") % 10) * 0.03 - 0.1).alias("d"))
    return G.nearest_beats(b, d)


@query("decide_octave", f"""WITH {S.EV}, f AS (SELECT track_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM ev GROUP BY 1),
g AS (SELECT *, 100.0 + track_id % 100 AS bpm, CASE WHEN v = 0 THEN NULL ELSE p / CAST(v AS DOUBLE) END AS ratio, track_id % 5 = 0 AS silent FROM f)
SELECT track_id, CASE WHEN bpm > 140 AND bpm / 2 BETWEEN 60 AND 95 AND (silent OR ratio IS NULL OR ratio < 1) THEN 'half' ELSE 'none' END AS octave FROM g""")
def decide_octave(spark, sf):
    f = beats(spark, sf).groupBy("track_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "view").alias("v"))
    return f.select("track_id", G.decide_octave(
        F.lit("auto"), 100.0 + F.col("track_id") % 100, F.try_divide("p", "v"), F.col("track_id") % 5 == 0).alias("octave"))


@query("double_beats", f"""WITH {POS} SELECT track_id, 2 * i AS i, round(t, 3) AS t FROM beats
UNION ALL SELECT track_id, 2 * i - 1, round((prev_t + t) / 2, 3) FROM beats WHERE prev_t IS NOT NULL""")
def double_beats(spark, sf):
    return G.double_beats(beats(spark, sf), WEEK).select("track_id", "i", r3("t"))


NORM = """fe AS (SELECT a.track_id, min(a.i) AS fe FROM (SELECT track_id, i, lead(gap) OVER (PARTITION BY track_id ORDER BY i) AS ng FROM beats) a
  WHERE ng IS NULL OR ng >= 43200 GROUP BY 1),
par AS (SELECT b.track_id, count(*) FILTER (b.i % 2 = 1) AS o, count(*) FILTER (b.i % 2 = 0) AS e FROM beats b JOIN fe USING (track_id)
  WHERE b.event_type = 'purchase' AND fe > 1 AND b.i <= fe GROUP BY 1),
st AS (SELECT b.* FROM beats b LEFT JOIN par USING (track_id) WHERE b.i >= CASE WHEN o > e THEN 1 ELSE 0 END),
walk AS (SELECT track_id, min(t) AS t FROM st GROUP BY 1 UNION ALL
  SELECT w.track_id, (SELECT min(s.t) FROM st s WHERE s.track_id = w.track_id AND s.t >= w.t + 43200) FROM walk w WHERE w.t IS NOT NULL)"""


@query("normalise_octave", f"""WITH RECURSIVE {POS}, {NORM}
SELECT b.track_id, b.i, row_number() OVER (PARTITION BY b.track_id ORDER BY b.i) - 1 AS new_i, b.event_type = 'purchase' AS is_downbeat
FROM walk w JOIN beats b ON b.track_id = w.track_id AND b.t = w.t""")
def normalise_octave(spark, sf):
    b = share(indexed(spark, sf))
    return G.normalise_octave(b.select("track_id", "i", "t"), b.where("event_type = 'purchase'").select("track_id", "i"),
                              57600.0, WEEK).select("track_id", "i", "new_i", "is_downbeat")


@query("dropped_beats", f"""WITH RECURSIVE {POS}, {NORM} SELECT track_id, i FROM beats
EXCEPT SELECT b.track_id, b.i FROM walk w JOIN beats b ON b.track_id = w.track_id AND b.t = w.t""")
def dropped_beats(spark, sf):
    b = share(indexed(spark, sf))
    kept = G.normalise_octave(b.select("track_id", "i", "t"), b.where("event_type = 'purchase'").select("track_id", "i"), 57600.0, WEEK)
    return b.select("track_id", "i").subtract(kept.select("track_id", "i"))


BBARS = f"""{PHASE},
dm AS (SELECT b.track_id, count(*) AS n, max(t) AS last_t, least(coalesce(any_value(p.phase), 0), count(*) - 1) AS phase,
  any_value(median_gap) AS mg FROM beats b LEFT JOIN (SELECT * FROM phase WHERE r = 1) p USING (track_id) LEFT JOIN tempo USING (track_id) GROUP BY 1),
pl AS (SELECT b.*, dm.phase, CASE WHEN n >= 2 THEN least(2592000.0, last_t + mg) ELSE 2592000.0 END AS fin,
  CAST(CASE WHEN b.i < dm.phase THEN 0 ELSE (b.i - dm.phase) // 4 + CASE WHEN dm.phase > 0 THEN 1 ELSE 0 END END AS INTEGER) AS bar
  FROM beats b JOIN dm USING (track_id)),
bb AS (SELECT track_id, bar, min(t) AS start, min(i) AS first_beat, count(*) AS n_beats, any_value(phase) AS phase, any_value(fin) AS fin FROM pl GROUP BY 1, 2),
bbars AS (SELECT track_id, bar, start, coalesce(lead(start) OVER (PARTITION BY track_id ORDER BY bar), fin) AS "end", first_beat, n_beats, bar = 0 AND phase > 0 AS pickup FROM bb)"""


def built(spark, sf):
    b = share(indexed(spark, sf))
    dur = B.tracks(spark, sf).withColumn("duration", F.lit(END))
    bars = G.build_bars(b.select("track_id", "i", "t"), G.modal_phase(b.where("event_type = 'purchase'"), 4), dur,
                        G.tempo(beats(spark, sf), WEEK), 4)
    return b, bars


@query("build_bars", f"""WITH {POS}, {TEMPO}, {BBARS} SELECT track_id, bar, round(start, 3) AS start, round("end", 3) AS "end", n_beats, pickup FROM bbars""")
def build_bars(spark, sf):
    return built(spark, sf)[1].select("track_id", "bar", r3("start"), r3("end"), "n_beats", "pickup")


@query("beat_positions", f"""WITH {POS}, {TEMPO}, {BBARS} SELECT p.track_id, p.i, CAST(p.i - b.first_beat + 1 +
  CASE WHEN b.pickup THEN greatest(0, 4 - b.n_beats) ELSE 0 END AS INTEGER) AS position FROM pl p JOIN bbars b USING (track_id, bar)""")
def beat_positions(spark, sf):
    b, bars = built(spark, sf)
    bars = share(bars)
    placed = I.point_in_span(b.select("track_id", "i", "t"), bars.select("track_id", "bar", "start", "end"), KEYS, "t", "start", "end", 7 * DAY)
    last = b.select("track_id", "i", "t").join(placed.select("track_id", "i", "bar"), ["track_id", "i"], "left")
    final = bars.groupBy("track_id").agg(F.max("bar").alias("last_bar"))
    last = last.join(final, KEYS).withColumn("bar", F.coalesce("bar", "last_bar")).drop("last_bar")
    return G.beat_positions(last, bars, 4).select("track_id", "i", "position")


@query("phase_by_chroma", f"""WITH {POS}, cnt AS (SELECT track_id, CAST(i % 4 AS INTEGER) AS phase, count(*) AS c FROM beats WHERE event_type = 'purchase' GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, phase) AS r FROM cnt),
top AS (SELECT a.track_id, a.phase AS pa, b.phase AS pb, coalesce(b.c >= 0.75 * a.c, false) AS near FROM rk a LEFT JOIN rk b ON a.track_id = b.track_id AND b.r = 2 WHERE a.r = 1),
cand AS (SELECT track_id, unnest([pa, pb]) AS phase FROM top WHERE near),
mv AS (SELECT c.track_id, c.phase, (b.i - c.phase) // 4 AS bar, pc, avg(CASE WHEN b.k % 12 = pc THEN 1.0 + b.k / 100.0 ELSE 0.1 END) AS v
  FROM cand c JOIN beats b ON b.track_id = c.track_id AND b.i >= c.phase, range(12) r(pc) GROUP BY 1, 2, 3, 4),
nv AS (SELECT *, v / (sqrt(sum(v * v) OVER (PARTITION BY track_id, phase, bar)) + 1e-9) AS u FROM mv),
ch AS (SELECT track_id, phase, avg(1 - dot) AS change FROM (SELECT x.track_id, x.phase, x.bar, sum(x.u * y.u) AS dot FROM nv x JOIN nv y
  ON x.track_id = y.track_id AND x.phase = y.phase AND x.pc = y.pc AND y.bar = x.bar + 1 GROUP BY 1, 2, 3) GROUP BY 1, 2),
fin AS (SELECT t.track_id, least(pa, pb) AS lo, greatest(pa, pb) AS hi, pa, near, coalesce(l.change, 0) AS cl, coalesce(h.change, 0) AS chi FROM top t
  LEFT JOIN ch l ON l.track_id = t.track_id AND l.phase = least(pa, pb) LEFT JOIN ch h ON h.track_id = t.track_id AND h.phase = greatest(pa, pb))
SELECT track_id, CASE WHEN NOT near THEN pa WHEN round(chi, 9) > round(cl, 9) THEN hi ELSE lo END AS phase, near AS near_tie FROM fin""")
def phase_by_chroma(spark, sf):
    b = share(indexed(spark, sf).withColumn("chroma", F.transform(
        F.sequence(F.lit(0), F.lit(11)), lambda pc: F.when(F.col("k") % 12 == pc, 1.0 + F.col("k") / 100.0).otherwise(0.1))))
    return G.choose_phase(b.select("track_id", "i", "chroma"), b.where("event_type = 'purchase'"), 4)


@query("backbeat_ratio", f"""WITH {S.EV}, {S.TRACKS}, {S.RBEATS}, fr AS (SELECT track_id, t, value, row_number() OVER (PARTITION BY track_id ORDER BY t) AS p FROM ev),
at0 AS (SELECT b.track_id, b.i, (SELECT min(p) FROM fr WHERE fr.track_id = b.track_id AND fr.t >= b.start) AS p FROM rbeats b),
at1 AS (SELECT a.track_id, a.i, coalesce(max(fr.value), 0.0) AS v FROM at0 a LEFT JOIN fr ON fr.track_id = a.track_id AND fr.p BETWEEN a.p - 2 AND a.p + 2 GROUP BY 1, 2),
m AS (SELECT track_id, count(*) AS n, avg(CASE WHEN i % 4 IN (1, 3) THEN v END) AS b, avg(CASE WHEN i % 4 IN (0, 2) THEN v END) AS s FROM at1 GROUP BY 1)
SELECT track_id, round(CASE WHEN n >= 8 AND s > 0 THEN b / s END, 6) AS ratio FROM m""")
def backbeat_ratio(spark, sf):
    frames = beats(spark, sf).select("track_id", "t", F.col("value").alias("flux"))
    grid = B.regular_beats(spark, sf).select("track_id", F.col("start").alias("t"), F.col("i").cast("long").alias("i"))
    return G.backbeat_ratio(grid, frames, 4, WEEK).select("track_id", r6("ratio"))


LEVELS = S.EV + ",\n" + S.BARS + """,
lv AS (SELECT b.track_id, b.section, b.bar, sqrt(coalesce(avg(e.value * e.value), 0)) AS rms FROM bars b LEFT JOIN ev e
  ON e.track_id = b.track_id AND e.t >= b.start AND e.t < b."end" GROUP BY 1, 2, 3),
db AS (SELECT *, 20.0 * log10(greatest(rms, 1e-6)) AS db FROM lv)"""
FLAGS = LEVELS + """,
md AS (SELECT track_id, median(db) AS m FROM db WHERE db > -60 GROUP BY 1),
raw AS (SELECT db.track_id, bar, CASE WHEN m IS NULL OR db >= m - 12 THEN 1 ELSE 0 END AS f FROM db LEFT JOIN md USING (track_id)),
flags AS (SELECT track_id, bar, CASE WHEN lag(f) OVER w IS NULL OR lead(f) OVER w IS NULL THEN f = 1
  ELSE lag(f) OVER w + f + lead(f) OVER w >= 2 END AS vocal FROM raw WINDOW w AS (PARTITION BY track_id ORDER BY bar))"""


def levels(spark, sf):
    bars = B.bars(spark, sf)
    placed = I.point_in_span(B.events(spark, sf).select("track_id", "t", "value"), bars, KEYS, "t", "start", "end", DAY)
    sums = placed.groupBy("track_id", "bar").agg(F.sum(F.col("value") * F.col("value")).alias("sumsq"), F.count("*").alias("n"))
    out = bars.join(sums, ["track_id", "bar"], "left")
    return out.select("track_id", "section", "bar", G.level_db(F.col("sumsq"), F.col("n")).alias("db"),
                      F.sqrt(F.coalesce(F.try_divide("sumsq", "n"), F.lit(0.0))).alias("rms"))


@query("bar_level_db", f"WITH {LEVELS} SELECT track_id, bar, round(db, 6) AS db FROM db")
def bar_level_db(spark, sf):
    return levels(spark, sf).select("track_id", "bar", r6("db"))


@query("vocal_flags", f"WITH {FLAGS} SELECT track_id, bar, vocal FROM flags")
def vocal_flags(spark, sf):
    return G.vocal_flags(share(levels(spark, sf).select("track_id", "bar", "db")))


RUNS = FLAGS + """,
vr AS (SELECT track_id, min(bar) AS start_bar, max(bar) + 1 AS end_bar FROM (SELECT *, bar - row_number() OVER (PARTITION BY track_id, vocal ORDER BY bar) AS g FROM flags)
  WHERE NOT vocal GROUP BY track_id, g HAVING count(*) >= 4)"""


@query("vocal_runs", f"WITH {RUNS} SELECT track_id, start_bar, end_bar, 30 - end_bar < 4 AS trailing FROM vr")
def vocal_runs(spark, sf):
    return G.vocal_runs(share(G.vocal_flags(share(levels(spark, sf).select("track_id", "bar", "db")))))


@query("silent_bar_mask", f"""WITH {LEVELS} SELECT track_id, bar, rms < 0.25 * median(rms) OVER (PARTITION BY track_id, section) AS silent FROM db""")
def silent_bar_mask(spark, sf):
    lv = share(levels(spark, sf))
    med = O.exact_median(lv, ["track_id", "section"], "rms", "median_rms")
    return lv.join(med, ["track_id", "section"]).select("track_id", "bar", (F.col("rms") < 0.25 * F.col("median_rms")).alias("silent"))


@query("run_collapse", f"""WITH {S.EV}, c AS (SELECT *, lead(t) OVER w AS e, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM ev
  WINDOW w AS (PARTITION BY track_id ORDER BY t, event_id)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY t, event_id) AS run FROM c)
SELECT track_id, event_type AS label, round(min(t), 6) AS start, round(max(e), 6) AS "end", round(avg(value), 6) AS share, count(*) AS n
FROM g GROUP BY track_id, run, event_type""")
def run_collapse(spark, sf):
    ev = O.with_neighbour(beats(spark, sf), KEYS, ["t", "event_id"], WEEK, {"end": "t"}, ahead=True)
    spans = ev.select("track_id", F.col("t").alias("start"), "event_id", "end", F.col("event_type").alias("label"), F.col("value").alias("share"))
    out = G.run_collapse(spans, ["start", "event_id"], WEEK)
    return out.select("track_id", "label", r6("start"), r6("end"), r6("share"), "n")


CLUST = S.EV + ",\n" + S.BARS + """,
cl AS (SELECT b.track_id, b.bar, CAST(count(e.t) // 2 % 3 AS INTEGER) AS cluster FROM bars b LEFT JOIN ev e
  ON e.track_id = b.track_id AND e.t >= b.start AND e.t < b."end" GROUP BY 1, 2)"""


def clusters(spark, sf):
    bars = B.bars(spark, sf)
    placed = I.point_in_span(B.events(spark, sf).select("track_id", "t"), bars, KEYS, "t", "start", "end", DAY)
    n = placed.groupBy("track_id", "bar").agg(F.count("*").alias("n"))
    return bars.join(n, ["track_id", "bar"], "left").select(
        "track_id", "bar", (F.floor(F.coalesce("n", F.lit(0)) / 2) % 3).cast("int").alias("cluster"))


@query("boundaries_from_clusters", f"""WITH RECURSIVE {CLUST},
re AS (SELECT track_id, bar + 1 AS e FROM (SELECT *, lead(cluster) OVER (PARTITION BY track_id ORDER BY bar) AS nc FROM cl) WHERE nc IS NULL OR nc <> cluster),
wk AS (SELECT DISTINCT track_id, 0 AS x FROM cl UNION ALL SELECT w.track_id, (SELECT min(e) FROM re WHERE re.track_id = w.track_id AND e >= w.x + 2) FROM wk w WHERE w.x IS NOT NULL),
sg AS (SELECT w.track_id, lag(x) OVER (PARTITION BY w.track_id ORDER BY x) AS s, x FROM wk w WHERE x IS NOT NULL),
sc AS (SELECT sg.track_id, s, x, cluster FROM sg JOIN cl ON cl.track_id = sg.track_id AND cl.bar = x - 1 WHERE s IS NOT NULL),
ru AS (SELECT *, CASE WHEN cluster = lag(cluster) OVER (PARTITION BY track_id ORDER BY s) THEN 0 ELSE 1 END AS ch FROM sc),
st AS (SELECT track_id, s AS start_bar, cluster FROM ru WHERE ch = 1)
SELECT track_id, CAST(start_bar AS INTEGER) AS start_bar, CAST(coalesce(lead(start_bar) OVER (PARTITION BY track_id ORDER BY start_bar), 30) AS INTEGER) AS end_bar, cluster FROM st""")
def boundaries_from_clusters(spark, sf):
    return G.cluster_boundaries(share(clusters(spark, sf)), 2)


@query("trailing_silent_bars", f"""WITH {S.SPANS}, {S.BARS}, l AS (SELECT track_id, max("end") AS le FROM spans WHERE label <> 'N' GROUP BY 1)
SELECT track_id, CAST(least(coalesce(n, 0), 8) AS BIGINT) AS "drop" FROM tracks LEFT JOIN
  (SELECT b.track_id, count(*) AS n FROM bars b JOIN l USING (track_id) WHERE b.start >= le - 1e-6 GROUP BY 1) USING (track_id)""")
def trailing_silent_bars(spark, sf):
    caps = B.tracks(spark, sf).withColumn("cap", F.lit(9))
    return G.trailing_silent_bars(B.spans(spark, sf), B.bars(spark, sf), caps)


@query("sections_to_bar", f"""WITH {S.BARS}, {S.SECTIONS} SELECT b.track_id, b.bar, s.section, s.label FROM bars b JOIN sections s
  ON s.track_id = b.track_id AND b.bar >= s.start_bar AND b.bar < s.end_bar""")
def sections_to_bar(spark, sf):
    return I.point_in_span(B.bars(spark, sf).select("track_id", "bar"), B.sections(spark, sf), KEYS, "bar", "start_bar", "end_bar", 64
                           ).select("track_id", "bar", "section", "label")


@query("span_beat_snap", f"""WITH {S.SPANS}, {S.TRACKS}, {S.RBEATS},
ov AS (SELECT b.track_id, b.i, b.start AS bs, b."end" AS be, s.label, sum(least(b."end", s."end") - greatest(b.start, s.start)) AS ov, min(s.span_id) AS f
  FROM rbeats b JOIN spans s ON s.track_id = b.track_id AND least(b."end", s."end") - greatest(b.start, s.start) > 0 GROUP BY 1, 2, 3, 4, 5),
bl AS (SELECT *, row_number() OVER (PARTITION BY track_id, i ORDER BY round(ov, 6) DESC, f) AS r FROM ov),
pb AS (SELECT b.track_id, b.i, b.start, b."end", coalesce(label, 'N') AS label, coalesce(least(1.0, ov / 21600.0), 0.0) AS sh
  FROM rbeats b LEFT JOIN (SELECT * FROM bl WHERE r = 1) x ON x.track_id = b.track_id AND x.i = b.i),
c AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY track_id ORDER BY i) THEN 0 ELSE 1 END AS ch FROM pb),
g AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY i) AS run FROM c)
SELECT track_id, min(start) AS start, max("end") AS "end", label, round(avg(sh), 6) AS confidence FROM g GROUP BY track_id, run, label""")
def span_beat_snap(spark, sf):
    out = H.snap_to_beats(B.spans(spark, sf), B.regular_beats(spark, sf), 21600.0)
    return out.select("track_id", "start", "end", "label", r6("confidence"))


@query("chord_over_bar", f"""WITH {S.SPANS}, {S.BARS}, o AS (SELECT b.track_id, b.bar, s.label FROM bars b JOIN spans s ON s.track_id = b.track_id
  AND s.start < b."end" - 1e-6 AND s."end" > b.start + 1e-6)
SELECT b.track_id, b.bar, coalesce(any_value(tr), 'N') AS triads, coalesce(bool_or(hc), false) AS has_chord, coalesce(bool_and(an), true) AS all_n FROM bars b LEFT JOIN
 (SELECT track_id, bar, string_agg(DISTINCT replace(label, ':7', ':maj'), '+' ORDER BY replace(label, ':7', ':maj')) FILTER (label <> 'N') AS tr, bool_or(label <> 'N') AS hc, bool_and(label = 'N') AS an
  FROM o GROUP BY 1, 2) USING (track_id, bar) GROUP BY 1, 2""")
def chord_over_bar(spark, sf):
    sp = B.spans(spark, sf).withColumn("triad", F.regexp_replace("label", ":7$", ":maj"))
    return H.chords_over_bars(sp, B.bars(spark, sf), DAY).select("track_id", "bar", "triads", "has_chord", "all_n")


@query("root_at_time", f"""WITH {S.SPANS}, q AS (SELECT track_id, event_id, t + 1800.0 AS t FROM ev),
m AS (SELECT q.track_id, q.event_id, s.label, row_number() OVER (PARTITION BY q.track_id, q.event_id ORDER BY s.start, s.span_id) AS r FROM q
  JOIN spans s ON s.track_id = q.track_id AND s.start <= q.t AND q.t < s."end")
SELECT q.track_id, q.event_id, CASE WHEN m.label <> 'N' THEN split_part(m.label, ':', 1) END AS root FROM q LEFT JOIN m ON m.track_id = q.track_id AND m.event_id = q.event_id AND m.r = 1""")
def root_at_time(spark, sf):
    q = beats(spark, sf).select("track_id", "event_id", (F.col("t") + 1800.0).alias("t"))
    return H.root_at(q, B.spans(spark, sf), DAY)


@query("proximity_anti_join", f"""WITH {S.EV}, b AS (SELECT * FROM ev WHERE event_type <> 'view'), x AS (SELECT * FROM ev v WHERE event_type = 'view'
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.track_id = v.track_id AND abs(b.t - v.t) <= 3600.0))
SELECT track_id, event_id, false AS added FROM b UNION ALL SELECT track_id, event_id, true FROM x""")
def proximity_anti_join(spark, sf):
    ev = beats(spark, sf).select("track_id", "event_id", "t", "event_type")
    out = H.merge_onsets(ev.where("event_type <> 'view'"), ev.where("event_type = 'view'"), 3600.0)
    return out.select("track_id", "event_id", "added")


@query("stable_splice", f"""WITH {S.EV}, u AS (SELECT track_id, t, event_id, event_type = 'view' AS added FROM ev)
SELECT track_id, event_id, added, row_number() OVER (PARTITION BY track_id ORDER BY t, added, event_id) - 1 AS place FROM u""")
def stable_splice(spark, sf):
    ev = beats(spark, sf).select("track_id", "event_id", "t", "event_type")
    return H.splice(ev.where("event_type <> 'view'"), ev.where("event_type = 'view'"), WEEK).select("track_id", "event_id", "added", "place")


@query("note_end", f"""WITH {POS}, {S.BARS} SELECT p.track_id, p.event_id, round(least(coalesce(p.nt, b."end"), b."end"), 6) AS note_end
FROM (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS nt FROM beats) p JOIN bars b ON b.track_id = p.track_id AND p.t >= b.start AND p.t < b."end" """)
def note_end(spark, sf):
    return H.note_ends(beats(spark, sf).select("track_id", "event_id", "t"), B.bars(spark, sf), WEEK, DAY).select("track_id", "event_id", r6("note_end"))


@query("level_constraints", f"""WITH {S.EV}, {S.BARS}, lv AS (SELECT DISTINCT track_id, floor(t / 86400) AS bar FROM ev), vo AS (SELECT DISTINCT track_id, floor(t / 86400) AS bar FROM ev WHERE event_type = 'error'),
b AS (SELECT track_id, count(*) AS n FROM bars GROUP BY 1), l AS (SELECT track_id, count(*) AS c FROM lv GROUP BY 1), v AS (SELECT track_id, count(*) AS c FROM vo GROUP BY 1)
SELECT b.track_id, 'not one loudness per bar' AS rule, coalesce(l.c, 0) AS n FROM b LEFT JOIN l USING (track_id) WHERE coalesce(l.c, 0) <> b.n UNION ALL SELECT b.track_id, 'not one vocal level per bar', v.c FROM b JOIN v USING (track_id) WHERE v.c <> b.n""")
def level_constraints(spark, sf):
    ev = B.events(spark, sf).select("track_id", F.floor(F.col("t") / DAY).alias("bar"), "event_type")
    return check_levels(B.bars(spark, sf), ev.select("track_id", "bar").distinct(), ev.where("event_type = 'error'").select("track_id", "bar").distinct())


@query("grid_constraints", f"""WITH {S.EV}, {S.BARS}, {S.SECTIONS},
bt AS (SELECT track_id, floor(t / 3600) AS h, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) AS i FROM ev),
v1 AS (SELECT track_id, 'beats not increasing' AS rule, count(*) AS n FROM (SELECT *, lag(h) OVER (PARTITION BY track_id ORDER BY i) AS p FROM bt) WHERE h <= p GROUP BY 1),
v2 AS (SELECT e.track_id, 'downbeat out of range' AS rule, count(*) AS n FROM (SELECT track_id, k FROM ev WHERE event_type = 'purchase') e
   JOIN (SELECT track_id, count(*) AS c FROM ev GROUP BY 1) USING (track_id) WHERE k >= c GROUP BY 1),
bb AS (SELECT track_id, bar FROM bars WHERE NOT (track_id % 7 = 3 AND bar = 5)),
v3 AS (SELECT track_id, 'bar index gap' AS rule, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY bar) - 1 AS p FROM bb) WHERE bar <> p GROUP BY 1),
ss AS (SELECT track_id, start_bar, CASE WHEN track_id % 5 = 2 AND section = 1 THEN 13 ELSE end_bar END AS end_bar FROM sections),
v4 AS (SELECT track_id, 'sections not contiguous' AS rule, count(*) AS n FROM (SELECT *, lead(start_bar) OVER (PARTITION BY track_id ORDER BY start_bar) AS nx FROM ss) WHERE nx <> end_bar GROUP BY 1),
v5 AS (SELECT track_id, 'sections do not end at the last bar' AS rule, 1 AS n FROM (SELECT track_id, max(end_bar) AS e FROM ss GROUP BY 1) JOIN (SELECT track_id, count(*) AS c FROM bb GROUP BY 1) USING (track_id) WHERE e <> c)
SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4 UNION ALL SELECT * FROM v5""")
def grid_constraints(spark, sf):
    ev = share(indexed(spark, sf))
    b = ev.select("track_id", "i", F.floor(F.col("t") / 3600).cast("double").alias("t"))
    down = ev.where("event_type = 'purchase'").select("track_id", F.col("k").alias("i"))
    bars = B.bars(spark, sf).where("not (track_id % 7 = 3 and bar = 5)")
    secs = B.sections(spark, sf).withColumn("end_bar", F.when((F.col("track_id") % 5 == 2) & (F.col("section") == 1), 13).otherwise(F.col("end_bar")))
    return check_grid(b, down, bars, secs, 4096)
