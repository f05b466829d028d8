"""Queries of the member-level strum job: both verses are members of one planned section."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r6
from stavework.catalog.grid import trailing_silent_bars
from stavework.catalog.strums import HALF, JOB, RESTS, halves, job_bars, vs
from stavework.functions import rhythm as R
from stavework.plans import members as P
from stavework.session import share_rows

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# the spans of a track's sections are its members; a planned section is the first span of its label
TRIMMED = S.SPANS.removeprefix(S.EV) + """, le AS (SELECT track_id, max("end") AS le FROM spans WHERE label <> 'N' GROUP BY 1),
tsb AS (SELECT b.track_id, least(count(*), 8) AS d FROM bars b JOIN le USING (track_id) WHERE b.start >= le - 1e-6 GROUP BY 1),
read AS (SELECT m.* FROM masks m LEFT JOIN tsb USING (track_id) WHERE m.section < 3 OR m.bar < 30 - coalesce(d, 0)), allu AS ("""
MJOB = JOB.replace(", allu AS (", TRIMMED).replace("AS pos FROM masks)", "AS pos FROM read)")
SHOWN = f"""{MJOB}, hf AS (SELECT track_id, section, min(bar) AS fb FROM allu WHERE NOT rests GROUP BY 1, 2),
off AS (SELECT u.track_id, CASE WHEN any_value(c.unit) = 2 AND round(avg({vs('u.pos + 1')}), 9) > round(avg({vs('u.pos')}), 9) THEN 1 ELSE 0 END AS o
  FROM units u JOIN ch c ON c.track_id = u.track_id AND c.section = 0 WHERE u.section = 2 GROUP BY 1),
agr AS (SELECT off.track_id, o FROM off JOIN ch w ON w.track_id = off.track_id AND w.section = 2 JOIN ch c ON c.track_id = off.track_id AND c.section = 0
  WHERE (off.track_id + 2) % 5 <> 0 AND round({S.jac('(w.strike & 255)', HALF.format(o='o', m='strike'), '(w.mute & 255)', HALF.format(o='o', m='mute'))}, 9) >= 0.35),
sh AS (SELECT m.track_id, m.section AS member, m.bar, {RESTS.replace('strike', 'm.strike').replace('track_id', 'm.track_id').replace('bar)', 'm.bar)')} AS rests, fb, coalesce(o, 0) AS o, m.section = 2 AND o IS NOT NULL AS taken
  FROM masks m LEFT JOIN hf USING (track_id, section) LEFT JOIN agr ON agr.track_id = m.track_id AND m.section = 2),
rec AS (SELECT sh.*, j.unit IS NOT NULL AS voiced, j.unit IS NOT NULL AND NOT rests AS prints, c.unit, c.strike, c.mute, c.confidence, c.chance_p, c.uncertain
  FROM sh LEFT JOIN job j ON j.track_id = sh.track_id AND j.section = member LEFT JOIN job c ON c.track_id = sh.track_id AND c.section = CASE WHEN taken THEN 0 ELSE member END),
pr AS (SELECT *, CASE WHEN prints THEN {halves('bar - fb + o')[0]} ELSE 0 END AS ps, CASE WHEN prints THEN {halves('bar - fb + o')[1]} ELSE 0 END AS pm FROM rec c)"""
PLANNED = "CASE WHEN {m} = 2 THEN 0 ELSE {m} END"


def job(spark, sf):
    planned = F.when(F.col("section") == 2, 0).otherwise(F.col("section"))
    members = share_rows(B.sections(spark, sf).select("track_id", planned.alias("section"), F.col("section").alias("member"), "start_bar", "end_bar"))
    riffs = members.where("(track_id + member) % 5 = 0")
    seed = F.col("track_id") * 4099 + F.col("member") * 31
    return P.member_job(job_bars(spark, sf).drop("section"), members, trailing_silent_bars(spark, sf), riffs, 8, seed=seed)


@query("member_records", f"""WITH {SHOWN} SELECT track_id, {PLANNED.format(m='member')} AS section, member, bar, rests, CASE WHEN prints THEN unit ELSE 1 END AS unit,
  CASE WHEN prints THEN round(confidence, 6) ELSE 0.0 END AS confidence, CASE WHEN prints THEN round(chance_p, 6) END AS chance_p,
  CASE WHEN voiced THEN prints AND uncertain ELSE true END AS uncertain, taken AS from_section, {S.printed('ps', 'pm', '8')} AS printed FROM pr""")
def member_records(spark, sf):
    rec = job(spark, sf)[0]
    return rec.select(*P.MEMBER, "bar", "rests", "unit", r6("confidence"), r6("chance_p"), "uncertain", "from_section",
                      R.printed(F.col("p_strike"), F.col("p_mute"), F.col("width")).alias("printed"))


@query("section_patterns", f"""WITH {MJOB}, pl AS (SELECT track_id, unnest([0, 1, 3]) AS section FROM tracks)
SELECT pl.track_id, pl.section, pl.section AS member, j.unit IS NULL AS silent, unit, candidate, round(coalesce(confidence, 0), 6) AS confidence, round(chance_p, 6) AS chance_p, coalesce(uncertain, true) AS uncertain,
  {S.printed('(coalesce(strike, 0) & 255)', '(coalesce(mute, 0) & 255)', '8')} AS printed FROM pl LEFT JOIN job j USING (track_id, section)""")
def section_patterns(spark, sf):
    head = job(spark, sf)[1]
    first = [F.col(c).bitwiseAND(F.lit(255)) for c in ("strike", "mute")]
    return head.select(*P.MEMBER, "silent", "unit", "candidate", r6("confidence"), r6("chance_p"), "uncertain", R.printed(*first, F.lit(8)).alias("printed"))
