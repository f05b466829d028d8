"""Queries of the composite jobs and of section naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import grid as GR, harmony as HA, sql as S
from stavework.catalog.arrange import CAPO, FLATOF, SFX, shapes
from stavework.catalog.common import Registry, r3, r6
from stavework.catalog.harmony import dims, qbars, vectors
from stavework.catalog.signal import notes, pitch_frames, riff_flags
from stavework.catalog.strums import RECORDS, job_bars, job_sql, seed
from stavework.catalog.truth import PRINT, PS, REST, truth_patterns
from stavework.functions import harte as H
from stavework.operators import key as K, labels as LB, quantise as Q
from stavework.plans import jobs as J
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS, SEC = ["track_id"], ["track_id", "section"]

LS = f"""{GR.FLAGS}, clu AS (SELECT b.track_id, b.bar, CAST((count(e.t) + b.section * b.track_id) % 4 AS INTEGER) AS cluster FROM bars b LEFT JOIN ev e ON e.track_id = b.track_id AND e.t >= b.start AND e.t < b."end" GROUP BY b.track_id, b.bar, b.section),
bx AS (SELECT f.track_id, f.bar, f.bar // 5 AS seg, clu.cluster, db.db, (f.bar // 5 + f.track_id) % 4 > 0 AS vocal FROM flags f JOIN clu USING (track_id, bar) JOIN db USING (track_id, bar)),
md1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY c DESC, fb) AS r FROM (SELECT track_id, seg, cluster, count(*) AS c, min(bar) AS fb FROM bx GROUP BY 1, 2, 3)) WHERE r = 1),
sm AS (SELECT track_id, seg, count(*) AS n, sum(db) AS db, count(*) FILTER (vocal) AS sung FROM bx GROUP BY 1, 2),
s0 AS (SELECT m.track_id, m.seg, m.seg * 5 AS sb, m.seg * 5 + 5 AS eb, m.cluster, n, db, sung, sung / n < CASE WHEN m.seg IN (0, 5) THEN 0.5 ELSE 0.25 END AS l0 FROM md1 m JOIN sm USING (track_id, seg)),
s1 AS (SELECT *, l0 AND NOT bool_and(l0) OVER (PARTITION BY track_id) AS low FROM s0),
su AS (SELECT *, CASE WHEN cluster = lag(cluster) OVER (PARTITION BY track_id ORDER BY seg) THEN 0 ELSE 1 END AS nw FROM s1 WHERE NOT low),
so AS (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY seg) AS oc FROM su),
cs AS (SELECT track_id, cluster, count(DISTINCT oc) AS occ, sum(n) AS bars, sum(db) / sum(n) AS db, sum(sung) / sum(n) AS voice FROM so GROUP BY 1, 2),
c1 AS (SELECT *, bars > 0.6 * sum(bars) OVER (PARTITION BY track_id) AS big FROM cs),
c2 AS (SELECT *, occ >= 2 AND NOT big AS again FROM c1),
c3 AS (SELECT *, bool_or(again) OVER (PARTITION BY track_id) AS aa FROM c2),
chs AS (SELECT track_id, cluster AS chorus FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN aa THEN round(db, 9) ELSE bars END DESC, cluster) AS r FROM c3 WHERE voice >= 0.5 AND CASE WHEN aa THEN again ELSE NOT big END) WHERE r = 1),
vss AS (SELECT track_id, cluster AS verse FROM (SELECT c3.*, row_number() OVER (PARTITION BY c3.track_id ORDER BY big DESC, bars DESC, cluster) AS r FROM c3 LEFT JOIN chs USING (track_id) WHERE big OR (again AND cluster IS DISTINCT FROM chorus)) WHERE r = 1),
mg AS (SELECT c.track_id, max(c.db) FILTER (c.cluster = chorus) - max(c.db) FILTER (occ >= 2 AND c.cluster <> chorus) AS margin FROM c3 c JOIN chs USING (track_id) GROUP BY 1),
oo AS (SELECT track_id, oc, min(seg) AS f, max(seg) AS l FROM so GROUP BY 1, 2),
nm AS (SELECT so.track_id, so.seg, CASE WHEN so.cluster = verse THEN 'verse' WHEN so.cluster = chorus THEN 'chorus' WHEN occ = 1 AND f = 0 THEN 'intro' WHEN occ = 1 AND l = 5 THEN 'outro' ELSE 'verse' END AS label
  FROM so JOIN c3 USING (track_id, cluster) JOIN oo USING (track_id, oc) LEFT JOIN chs USING (track_id) LEFT JOIN vss USING (track_id)),
gr AS (SELECT *, sum(CASE WHEN low AND plow THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seg) AS g FROM (SELECT s1.*, coalesce(lag(low) OVER (PARTITION BY track_id ORDER BY seg), false) AS plow FROM s1)),
fin AS (SELECT gr.track_id, min(sb) AS start_bar, max(eb) AS end_bar, bool_or(low) AS low, max(nm.label) AS lb FROM gr LEFT JOIN nm USING (track_id, seg) GROUP BY gr.track_id, g)"""


def labelled(spark, sf):
    from stavework.catalog.grid import levels
    from stavework.operators.intervals import point_in_span
    bars = B.bars(spark, sf)
    placed = point_in_span(B.events(spark, sf).select("track_id", "t"), bars, KEYS, "t", "start", "end", B.DAY).groupBy("track_id", "bar").agg(F.count("*").alias("c"))
    b = levels(spark, sf).select("track_id", "section", "bar", "db").join(placed, ["track_id", "bar"], "left")
    seg = F.floor(F.col("bar") / 5).cast("int")
    b = share(b.select("track_id", "bar", seg.alias("seg"), ((F.coalesce("c", F.lit(0)) + F.col("section") * F.col("track_id")) % 4).cast("int").alias("cluster"), "db",
                       ((seg + F.col("track_id")) % 4 > 0).alias("vocal")))
    segs = b.groupBy("track_id", "seg").agg(F.min("bar").alias("start_bar"), (F.max("bar") + 1).alias("end_bar"))
    rows = share(LB.segment_rows(segs, b))
    return rows, LB.cluster_roles(rows)


@query("cluster_stats", f"""WITH {LS} SELECT c.track_id, c.cluster, c.occ, CAST(bars AS BIGINT) AS bars, round(db, 6) AS db, round(voice, 6) AS voice, coalesce(cluster = chorus, false) AS chorus, coalesce(cluster = verse, false) AS verse, round(margin, 6) AS margin
FROM c3 c LEFT JOIN chs USING (track_id) LEFT JOIN vss USING (track_id) LEFT JOIN mg USING (track_id)""")
def cluster_stats(spark, sf):
    return labelled(spark, sf)[1].select("track_id", "cluster", "occ", "bars", r6("db"), r6("voice"), "chorus", "verse", r6("margin"))


@query("label_sections", f"""WITH {LS} SELECT track_id, CAST(start_bar AS INTEGER) AS start_bar, CAST(end_bar AS INTEGER) AS end_bar, CASE WHEN NOT low THEN lb WHEN start_bar = 0 THEN 'intro' WHEN end_bar = 30 THEN 'outro' ELSE 'instrumental' END AS label,
 CAST(CASE WHEN low THEN 0.5 WHEN round(margin, 9) < 1.5 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS confidence FROM fin LEFT JOIN mg USING (track_id)""")
def label_sections(spark, sf):
    rows, roles = labelled(spark, sf)
    return LB.label_sections(rows, roles)


@query("masked_mean", f"""WITH {HA.CE}, {HA.QBAR}, kp AS (SELECT qc.track_id, pc, v, (bar + qc.track_id) % 7 = 0 AND qc.track_id % 3 > 0 AS keep FROM qc), ok AS (SELECT track_id, bool_or(keep) AS anyk FROM kp GROUP BY 1)
SELECT kp.track_id, pc, round(avg(v), 6) AS v FROM kp JOIN ok USING (track_id) WHERE keep OR NOT anyk GROUP BY 1, 2""")
def masked_mean(spark, sf):
    from stavework.operators.fill import masked_mean as mean
    chroma = qbars(spark, sf)[3].withColumn("keep", ((F.col("bar") + F.col("track_id")) % 7 == 0) & (F.col("track_id") % 3 > 0))
    return mean(chroma, "keep").select("track_id", "pc", r6("v"))


@query("arrange_job", f"""WITH {CAPO.replace('d AS (SELECT DISTINCT track_id, pc, q FROM cq', f'''tq0 AS (SELECT c.track_id, c.event, c.label, c.pc, c.written, CASE WHEN c.pc IS NULL THEN NULL WHEN s.pos IS NOT NULL THEN q WHEN t.pos IS NOT NULL THEN tq END AS q
  FROM cq c LEFT JOIN shp s ON s.root = c.root AND s.suffix = {SFX} LEFT JOIN shp t ON t.root = c.root AND t.suffix = CASE tq WHEN 'maj' THEN 'major' WHEN 'min' THEN 'minor' ELSE tq END), d AS (SELECT DISTINCT track_id, pc, q FROM (SELECT * FROM tq0 WHERE q IS NOT NULL)''')},
pk AS (SELECT track_id, capo FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9), capo) AS r FROM cs) WHERE r = 1)
SELECT t.track_id, t.event, CAST(pk.capo AS DOUBLE) AS capo, CASE WHEN q IS NULL THEN 'N' ELSE {H.SHARPS}[(pc - coalesce(capo, 0) + 12) % 12 + 1] || ':' || q END AS played FROM tq0 t LEFT JOIN pk USING (track_id)""")
def arrange_job(spark, sf):
    j = J.arrange_job(HA.events(spark, sf), shapes(spark, sf), B.DAY)
    return j.select("track_id", "event", F.col("capo").cast("double").alias("capo"), "played")


@query("grid_job")
def grid_job(spark, sf):
    ev = share(B.events(spark, sf))
    down = ev.where("event_type = 'purchase'").select("track_id", F.col("event_id").alias("d_id"), F.col("t").alias("d"))
    tracks = B.tracks(spark, sf)
    bars = J.grid_job(ev.select("track_id", "event_id", "t"), down, tracks.withColumn("duration", F.lit(GR.END)),
                      tracks.withColumn("octave", F.when(F.col("track_id") % 2 == 0, "half").otherwise("none")), 4, B.EVENT_CHUNK)
    return bars.select("track_id", "bar", r3("start"), r3("end"), "n_beats", "pickup")


@query("harmony_job")
def harmony_job(spark, sf):
    ev, bars, energy, chroma = qbars(spark, sf)
    length, n = dims(spark, sf)
    corr = share(K.correlations(vectors(spark, sf, "value"), KEYS))
    mix = K.estimate_key(K.correlations(vectors(spark, sf, F.lit(1)), KEYS), KEYS)
    mix = mix.select("track_id", F.col("tonic").alias("mix_tonic"), F.col("mode").alias("mix_mode"), F.col("confidence").alias("mix_confidence"))
    section = B.section_of(F.floor(F.col("start") / B.DAY))
    events, _ = J.harmony_job(B.spans(spark, sf), B.regular_beats(spark, sf), bars, share(chroma), share(energy), corr, mix, length, n, section, 21600.0)
    return events.select("track_id", r3("start"), r3("end"), "label", "triad", "filled", "power")


@query("riff_job")
def riff_job(spark, sf):
    bars = B.bars(spark, sf)
    strokes = Q.slot_owners(B.onsets(spark, sf), bars, B.DAY)
    own = share(notes(spark, sf).withColumn("section", B.section_of(F.floor(F.col("t") / B.DAY))).where("section is not null"))
    job = J.riff_job(bars, strokes, pitch_frames(B.events(spark, sf)), riff_flags(spark, sf, own, SEC), SEC, [67, 60, 64, 69], B.DAY, 72.0, 36.0)
    return job.select(*SEC, "unit", "candidate", r6("agreement"), r6("support"), "reason", "tab")


def revoted(support: int) -> str:
    """One value's run: the job at that support, its records, and the judged figures against them."""
    printed = f"WITH {job_sql(str(support))}, {RECORDS} SELECT track_id, bar, rests, ps, pm, CASE WHEN rests THEN false ELSE coalesce(uncertain, true) END AS uncertain FROM rec"
    return f"""SELECT track_id, {support} AS value, false_certain, false_grey, false_certain + false_grey AS errors FROM (WITH pr AS ({printed}), rng AS (WITH {REST} SELECT * FROM rng){PS.removeprefix(PRINT)}
  SELECT track_id, count(*) FILTER (verdict = 'NO' AND certain) AS false_certain, count(*) FILTER (verdict <> 'NO' AND NOT certain) AS false_grey FROM psc GROUP BY 1)"""


@query("revote_sweep", " UNION ALL ".join(revoted(v) for v in (2, 3)))
def revote_sweep(spark, sf):
    return J.revote_sweep(job_bars(spark, sf), truth_patterns(spark, sf), [2, 3], "min_support", 8, seed=seed())
