"""Queries of the strum and riff jobs, and the signal measures they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r3, r6
from stavework.catalog.rhythm import bars_of, choose_sql, medoid_sql, pair_sql
from stavework.functions import rhythm as R
from stavework.operators import chance as C, harmony_spans as H, members as M, quantise as Q, recall, riff as RF, signal as G, votes as V
from stavework.plans import strums as P
from stavework.session import share_rows

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
DAY = B.DAY
SEC = ["track_id", "section"]
BIT1 = "CAST(1 AS BIGINT)"


def mix(x: str) -> str:
    y = f"(({x}) & 2147483647)"
    z = f"((xor({y}, {y} >> 16) * 73244475) & 2147483647)"
    return f"xor({z}, {z} >> 15)"


def seed():
    return F.col("track_id") * 4099 + F.col("section") * 31


def copies_sql(units: str, out: str, by: str = "track_id, section", tag: str = "(track_id * 4099 + section * 31)", support: str = "2") -> str:
    """CTEs ending in `out`(by, chance_p) over one-bar units with `pos`."""
    return f"""{units}_v0 AS (SELECT 1),
{S.vote(units, units + '_v', by, support)},
{units}_ob AS (SELECT {', '.join('u.' + b.strip() for b in by.split(','))}, round(avg({S.jac('u.', 'v.')}), 9) AS ob FROM {units} u JOIN {units}_v v USING ({by}) GROUP BY ALL),
{units}_fl AS (SELECT {by}, CAST(round_even(0.6 * median(bit_count(strike)), 0) AS INTEGER) AS fl FROM {units} GROUP BY {by}),
{units}_h0 AS (SELECT {by}, pos, rep, bit_count(strike) AS ks, bit_count(mute) AS ms, {mix(mix(mix(f'{tag} + rep * 7919') + ' + pos * 104729'))} AS h FROM {units}, range(1000) r(rep)),
{units}_h AS (SELECT {by}, pos, rep, ks, ms, CAST(j AS INTEGER) AS j, {mix('h + j * 32452843')} AS d FROM {units}_h0, range(8) t(j)),
{units}_o AS (SELECT *, row_number() OVER (PARTITION BY {by}, pos, rep ORDER BY d, j) AS rk FROM {units}_h),
{units}_c AS (SELECT {by}, pos, rep, bit_or(CASE WHEN rk <= ks THEN {BIT1} << j ELSE 0 END) AS strike, bit_or(CASE WHEN rk <= ms THEN {BIT1} << j ELSE 0 END) AS mute FROM {units}_o GROUP BY ALL),
{units}_s AS (SELECT {by}, rep, slot, count(*) AS n, sum((strike >> slot) & 1) AS k, sum((mute >> slot) & 1) AS m FROM {units}_c, (SELECT CAST(x AS INTEGER) AS slot FROM range(8) t(x)) GROUP BY ALL),
{units}_k AS (SELECT *, 3 * k > n AND k >= {support} AS kept FROM {units}_s),
{units}_r AS (SELECT *, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY {by}, rep) AS nk, row_number() OVER (PARTITION BY {by}, rep, kept ORDER BY k DESC, slot) AS rk FROM {units}_k),
{units}_w AS (SELECT {by}, rep, bit_or(CASE WHEN kept OR rk <= fl - nk THEN {BIT1} << slot ELSE 0 END) AS strike, bit_or(CASE WHEN kept AND 2 * m > k THEN {BIT1} << slot ELSE 0 END) AS mute
  FROM {units}_r JOIN {units}_fl USING ({by}) GROUP BY ALL),
{units}_cf AS (SELECT {', '.join('c.' + b.strip() for b in by.split(','))}, c.rep, round(avg({S.jac('c.', 'w.')}), 9) AS cf FROM {units}_c c JOIN {units}_w w USING ({by}, rep) GROUP BY ALL),
{out} AS (SELECT {by}, (count(*) FILTER (cf >= ob) + 1) / 1001.0::DOUBLE AS chance_p FROM {units}_cf JOIN {units}_ob USING ({by}) GROUP BY {by})"""


@query("permutation_test", f"""WITH {S.UNITS}, {copies_sql('units', 'cp')} SELECT track_id, section, round(chance_p, 6) AS chance_p FROM cp""")
def permutation_test(spark, sf):
    return C.chance_p(share_rows(V.units_of_bars(bars_of(spark, sf))), 8, seed=seed()).select(*SEC, r6("chance_p"))


@query("structure_test", f"""WITH {S.UNITS}, {copies_sql('units', 'cp')}, f AS (SELECT u.track_id, u.section, sum(bit_count(u.strike)) / CAST(sum(u.width) AS DOUBLE) AS density, bool_and(bit_count(v.strike) = 8) AS full_vote
  FROM units u JOIN units_v v USING (track_id, section) GROUP BY 1, 2)
SELECT track_id, section, round(density, 6) AS density, full_vote, round(CASE WHEN NOT full_vote THEN chance_p END, 6) AS chance_p, CASE WHEN full_vote THEN density >= 0.6 ELSE chance_p <= 0.05 END AS structured
FROM f JOIN cp USING (track_id, section)""")
def structure_test(spark, sf):
    units = share_rows(V.units_of_bars(bars_of(spark, sf)))
    fig = V.vote_figures(units, V.section_vote(units))
    return C.structure_test(units, fig, 8, seed=seed()).select(*SEC, r6("density"), "full_vote", r6("chance_p"), "structured")


@query("two_best_units", f"""WITH {S.UNITS}, {medoid_sql('units', 'm')},
rs AS (SELECT u.*, j.score FROM units u JOIN m_j j USING (track_id, section, pos)),
sec AS (SELECT * FROM (SELECT rs.*, row_number() OVER (PARTITION BY rs.track_id, rs.section ORDER BY round(rs.score, 9) DESC, rs.pos) AS rn2, m.strike AS s1, m.mute AS m1 FROM rs JOIN m USING (track_id, section)
  WHERE rs.strike <> m.strike OR rs.mute <> m.mute) WHERE rn2 = 1)
SELECT track_id, section, 1 AS place, {S.cells('strike', 'mute', 'width')} AS cells FROM m
UNION ALL SELECT m.track_id, m.section, 2, {S.cells('coalesce(sec.strike, m.strike)', 'coalesce(sec.mute, m.mute)', 'm.width')} FROM m LEFT JOIN sec USING (track_id, section)""")
def two_best_units(spark, sf):
    t = V.two_best(V.agreement_sums(V.units_of_bars(bars_of(spark, sf))))
    return t.select(*SEC, "place", R.cells(F.col("strike"), F.col("mute"), F.col("width")).alias("cells"))


RAW = choose_sql().replace("bit_count(vm.strike & ~vm.mute) >= 2 AS use_m", "bit_count(vm.strike & ~vm.mute) >= 2 AS use_m")


def cand_set(u: str, v: str, md: str, rank: int, where: str = "true") -> str:
    return f"""SELECT a.track_id, a.section, {rank} AS o, {v}.width, {v}.strike, {v}.mute, avg({S.jac('a.', v + '.')}) AS score FROM {u} a JOIN {v} USING (track_id, section) WHERE {where} GROUP BY ALL
UNION ALL SELECT a.track_id, a.section, {rank + 1}, {md}.width, {md}.strike, {md}.mute, avg({S.jac('a.', md + '.')}) FROM {u} a JOIN {md} USING (track_id, section) WHERE {where} GROUP BY ALL"""


@query("candidate_top2", f"""WITH {S.UNITS}, {RAW}, {S.vote('units', 'bv')},
two AS (SELECT track_id, section FROM ph WHERE two),
vr AS (SELECT vu.*, vm_j.score FROM vu JOIN vm_j USING (track_id, section, pos)),
sec AS (SELECT * FROM (SELECT vr.*, row_number() OVER (PARTITION BY vr.track_id, vr.section ORDER BY round(vr.score, 9) DESC, vr.pos) AS r2 FROM vr JOIN vm USING (track_id, section) WHERE vr.strike <> vm.strike OR vr.mute <> vm.mute) WHERE r2 = 1),
cd AS ({cand_set('units', 'bv', 'm', 0)} UNION ALL {cand_set('vu', 'v', 'vm', 2, '(a.track_id, a.section) IN (SELECT (track_id, section) FROM two)')}
  UNION ALL SELECT a.track_id, a.section, 4, vm.width, vm.strike, vm.mute, avg({S.jac('a.', 'vm.')}) FROM vu a JOIN vm USING (track_id, section) GROUP BY ALL
  UNION ALL SELECT a.track_id, a.section, 5, sec.width, sec.strike, sec.mute, avg({S.jac('a.', 'sec.')}) FROM vu a JOIN sec USING (track_id, section) GROUP BY ALL),
pr AS (SELECT track_id, section, s, m, vwidth FROM ch1),
mk AS (SELECT cd.*, cd.width = vwidth AND strike = s AND mute = m AS same FROM cd JOIN pr USING (track_id, section)),
ps AS (SELECT track_id, section, max(score) FILTER (same) AS own FROM mk GROUP BY 1, 2),
rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, section ORDER BY round(score, 9) DESC, o) AS r FROM mk WHERE NOT same) WHERE r = 1)
SELECT ps.track_id, ps.section, round(own - score, 6) AS margin, CASE WHEN score IS NOT NULL THEN {S.cells('strike', 'mute', 'width')} END AS rival FROM ps LEFT JOIN rv USING (track_id, section)""")
def candidate_top2(spark, sf):
    units = share_rows(V.units_of_bars(bars_of(spark, sf)))
    sums = share_rows(V.agreement_sums(units))
    phases = share_rows(V.unit_and_phase(V.medoid(sums), V.best_pair(units, sums)))
    chosen = share_rows(V.choose_from(units, phases))
    c = V.candidate_margin(units, phases, chosen)
    rival = F.when(F.col("rival_width").isNotNull(), R.cells(F.col("rival_strike"), F.col("rival_mute"), F.coalesce("rival_width", F.lit(1))))
    return c.select(*SEC, r6("margin"), rival.alias("rival"))


HALF = "((CASE WHEN ({o}) % c.unit = 1 THEN c.{m} >> 8 ELSE c.{m} END) & 255)"


def halves(o: str) -> tuple[str, str]:
    return HALF.format(o=o, m="strike"), HALF.format(o=o, m="mute")


def vs(o: str) -> str:
    s, m = halves(o)
    return S.jac("u.strike", s, "u.mute", m)


@query("member_figures", f"""WITH {S.UNITS}, {choose_sql()}
SELECT u.track_id, u.section, round(avg({vs('u.pos')}), 6) AS confidence, round(coalesce(sum(bit_count(u.strike & {halves('u.pos')[0]})) / nullif(CAST(sum(bit_count(u.strike)) AS DOUBLE), 0), 0), 6) AS explained
FROM units u JOIN ch c USING (track_id, section) GROUP BY 1, 2""")
def member_figures(spark, sf):
    bars = bars_of(spark, sf)
    votes = V.choose_pattern(bars).select(*SEC, "unit", F.col("strike").alias("v_strike"), F.col("mute").alias("v_mute"))
    return M.member_figures(V.units_of_bars(bars), votes).select(*SEC, r6("confidence"), r6("explained"))


@query("section_offset", f"""WITH {S.UNITS}, {choose_sql()},
fit AS (SELECT u.track_id, u.section, any_value(c.unit) AS unit, avg({vs('u.pos')}) AS f0, avg({vs('u.pos + 1')}) AS f1 FROM units u JOIN ch c ON c.track_id = u.track_id AND c.section = 0 WHERE u.section = 2 GROUP BY 1, 2),
ofs AS (SELECT track_id, CASE WHEN unit = 2 AND round(f1, 9) > round(f0, 9) THEN 1 ELSE 0 END AS o FROM fit)
SELECT ofs.track_id, o AS "offset", round({S.jac('(w.strike & 255)', HALF.format(o='o', m='strike'), '(w.mute & 255)', HALF.format(o='o', m='mute'))}, 6) AS agreement
FROM ofs JOIN ch w ON w.track_id = ofs.track_id AND w.section = 2 JOIN ch c ON c.track_id = ofs.track_id AND c.section = 0""")
def section_offset(spark, sf):
    bars = bars_of(spark, sf)
    ch = share_rows(V.choose_pattern(bars))
    longest = ch.where("section = 0").select("track_id", "unit", F.col("strike").alias("v_strike"), F.col("mute").alias("v_mute"))
    units = V.units_of_bars(bars.where("section = 2"))
    ofs = M.section_offset(units, longest, ["track_id"])
    own = ch.where("section = 2").select("track_id", F.col("strike").alias("own_strike"), F.col("mute").alias("own_mute"), F.col("slots_per_bar").alias("width"))
    j = M.aligned_agreement(F.col("own_strike"), F.col("own_mute"), "v_strike", "v_mute", "unit", "width", F.col("offset"))
    return ofs.join(own, "track_id").join(longest, "track_id").select("track_id", "offset", r6(j, "agreement"))


# the strum job: a bar rests when it has no strike at all, or when its day number and track say so
RESTS = "(strike = 0 OR (track_id + bar) % 11 = 0)"
def job_sql(support: str = "2") -> str:
    return f"""{S.QUANT}, allu AS (SELECT track_id, section, width, strike, mute, bar, {RESTS} AS rests, row_number() OVER (PARTITION BY track_id, section ORDER BY bar) - 1 AS pos FROM masks),
units AS (SELECT track_id, section, width, strike, mute, bar, row_number() OVER (PARTITION BY track_id, section ORDER BY bar) - 1 AS pos FROM allu WHERE NOT rests),
{choose_sql(support=support)}, {copies_sql('units', 'cp', support=support)}, hb AS (SELECT track_id, section, min(pos) AS fp FROM allu WHERE NOT rests GROUP BY 1, 2),
alls AS (SELECT a.track_id, a.section, a.pos, a.width, a.strike, a.mute FROM allu a JOIN hb USING (track_id, section)), {copies_sql('alls', 'cpa', support=support)},
own AS (SELECT u.track_id, u.section, avg({vs('u.pos')}) AS confidence, coalesce(sum(bit_count(u.strike & {halves('u.pos')[0]})) / nullif(CAST(sum(bit_count(u.strike)) AS DOUBLE), 0), 0) AS explained,
  sum(bit_count(u.strike)) / CAST(sum(u.width) AS DOUBLE) AS density, any_value(bit_count(c.strike) = c.width) AS full_vote FROM units u JOIN ch c USING (track_id, section) GROUP BY 1, 2),
whl AS (SELECT u.track_id, u.section, avg({vs('u.pos + fp')}) AS confidence, sum(bit_count(u.strike)) / CAST(sum(u.width) AS DOUBLE) AS density FROM alls u JOIN hb USING (track_id, section) JOIN ch c USING (track_id, section) GROUP BY 1, 2),
job AS (SELECT track_id, section, c.unit, c.candidate, own.confidence, own.explained, CASE WHEN NOT full_vote THEN cp.chance_p END AS chance_p, whl.confidence AS confidence_all, CASE WHEN NOT full_vote THEN cpa.chance_p END AS chance_p_all,
  c.n_units * c.unit AS n_voted, round(own.confidence, 9) < 0.45 OR round(own.explained, 9) < 0.6 OR NOT CASE WHEN full_vote THEN own.density >= 0.6 ELSE cp.chance_p <= 0.05 END OR round(whl.confidence, 9) < 0.45
  OR NOT CASE WHEN full_vote THEN whl.density >= 0.6 ELSE cpa.chance_p <= 0.05 END OR c.n_units * c.unit < 4 AS uncertain, c.strike, c.mute, c.width
  FROM ch c JOIN own USING (track_id, section) JOIN whl USING (track_id, section) JOIN cp USING (track_id, section) JOIN cpa USING (track_id, section))"""


JOB = job_sql()


def job_bars(spark, sf):
    return bars_of(spark, sf).withColumn("rests", (F.col("strike") == 0) | ((F.col("track_id") + F.col("bar")) % 11 == 0))


@query("strums_job", f"""WITH {JOB} SELECT track_id, section, unit, candidate, round(confidence, 6) AS confidence, round(explained, 6) AS explained, round(chance_p, 6) AS chance_p,
  round(confidence_all, 6) AS confidence_all, round(chance_p_all, 6) AS chance_p_all, n_voted, uncertain, {S.printed('strike', 'mute', 'width')} AS printed FROM job""")
def strums_job(spark, sf):
    j = P.vote_sections(job_bars(spark, sf), 8, seed=seed())
    return j.select(*SEC, "unit", "candidate", r6("confidence"), r6("explained"), r6("chance_p"), r6("confidence_all"), r6("chance_p_all"), "n_voted", "uncertain",
                    R.printed(F.col("strike"), F.col("mute"), F.col("slots_per_bar") * F.col("unit")).alias("printed"))


RECORDS = f"""hf AS (SELECT track_id, section, min(bar) AS fb FROM allu WHERE NOT rests GROUP BY 1, 2),
rec AS (SELECT a.track_id, a.section, a.bar, a.rests, j.unit, j.uncertain, coalesce(CASE WHEN a.rests THEN 0 WHEN (a.bar - fb) % j.unit = 1 THEN (j.strike >> 8) & 255 ELSE j.strike & 255 END, 0) AS ps,
  coalesce(CASE WHEN a.rests THEN 0 WHEN (a.bar - fb) % j.unit = 1 THEN (j.mute >> 8) & 255 ELSE j.mute & 255 END, 0) AS pm FROM allu a LEFT JOIN hf USING (track_id, section) LEFT JOIN job j USING (track_id, section))"""


@query("bar_records", f"""WITH {JOB}, {RECORDS}
SELECT track_id, bar, rests, CASE WHEN rests THEN false ELSE coalesce(uncertain, true) END AS uncertain, {S.printed('ps', 'pm', '8')} AS printed FROM rec""")
def bar_records(spark, sf):
    bars = share_rows(job_bars(spark, sf))
    rec = P.bar_records(bars, P.vote_sections(bars, 8, seed=seed()))
    return rec.select("track_id", "bar", "rests", "uncertain", R.printed(F.col("p_strike"), F.col("p_mute"), F.col("width")).alias("printed"))


@query("certainty_rule", f"""WITH {S.EV}, p AS (SELECT event_id, k / 100.0 AS conf, value / 100.0 AS expl, event_type <> 'error' AS st, k % 7 AS nv FROM ev)
SELECT event_id, conf < 0.45 OR round(expl, 9) < 0.6 OR NOT st OR conf < 0.45 OR NOT st OR nv < 4 AS uncertain FROM p""")
def certainty_rule(spark, sf):
    ev = B.events(spark, sf).select("event_id", (F.col("k") / 100.0).alias("confidence"), (F.col("value") / 100.0).alias("explained"), (F.col("event_type") != "error").alias("structured"),
                                    (F.col("k") % 7).alias("n_voted"), F.lit(False).alias("gate"))
    ev = ev.withColumn("confidence_all", F.col("confidence")).withColumn("structured_all", F.col("structured"))
    return ev.select("event_id", P.certainty(0.45, 4).alias("uncertain"))


@query("recall_gate", f"""WITH {S.ONSETS}, {S.BARS}, ob AS (SELECT onsets.track_id, onset_id, onsets.t, false AS muted, 0 AS zcr FROM onsets JOIN ev ON ev.event_id = onset_id AND ev.track_id = onsets.track_id AND event_type <> 'view' AND event_type <> 'click' SELECT_END""".replace(" SELECT_END", ")") + f""",
silent AS (SELECT b.track_id, b.bar, sqrt(coalesce(avg(e.value * e.value), 0)) < 0.25 * median(sqrt(coalesce(avg(e.value * e.value), 0))) OVER (PARTITION BY b.track_id, b.section) AS silent FROM bars b LEFT JOIN ev e
  ON e.track_id = b.track_id AND e.t >= b.start AND e.t < b."end" GROUP BY b.track_id, b.section, b.bar),
xx AS (SELECT ev.track_id, event_id AS onset_id, ev.t FROM ev JOIN bars b ON b.track_id = ev.track_id AND ev.t >= b.start - 5400 AND ev.t < b."end" - 5400 JOIN silent s ON s.track_id = b.track_id AND s.bar = b.bar AND NOT silent
  WHERE event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM ob WHERE ob.track_id = ev.track_id AND abs(ob.t - ev.t) <= 3600)),
un AS (SELECT track_id, onset_id, t, 0 AS w FROM ob UNION ALL SELECT *, 0 FROM xx),
rd AS (SELECT 'b' AS w, track_id, onset_id, t FROM ob UNION ALL SELECT 'a', track_id, onset_id, t FROM un),
sl AS (SELECT DISTINCT w, b.track_id, b.section, b.bar, CAST(greatest(0, least(floor((r.t - b.start) / 10800 + 0.5), 7)) AS INTEGER) AS slot FROM rd r JOIN bars b ON b.track_id = r.track_id AND r.t >= b.start - 5400 AND r.t < b."end" - 5400),
ws AS (SELECT unnest(['a', 'b']) AS w),
mk AS (SELECT ws.w, b.track_id, b.section, b.bar, 8 AS width, coalesce(bit_or({BIT1} << slot), 0) AS strike, CAST(0 AS BIGINT) AS mute FROM bars b CROSS JOIN ws LEFT JOIN sl ON sl.w = ws.w AND sl.track_id = b.track_id AND sl.bar = b.bar GROUP BY 1, 2, 3, 4),
{S.vote('mk', 'vv', 'w, track_id, section')},
fg AS (SELECT m.w, m.track_id, m.section, avg({S.jac('m.', 'v.')}) AS ag, avg(bit_count(m.strike)) AS st, count(*) AS nb FROM mk m JOIN vv v USING (w, track_id, section) GROUP BY 1, 2, 3),
rw AS (SELECT w, b.track_id, b.section, count(*) AS raw FROM rd r JOIN bars b ON b.track_id = r.track_id AND r.t >= b.start - 5400 AND r.t < b."end" - 5400 GROUP BY 1, 2, 3),
ft AS (SELECT w, b.track_id, b.section, avg(CASE WHEN abs((r.t - b.start) / 10800 - floor((r.t - b.start) / 10800 + 0.5)) <= 0.15 THEN 1.0 ELSE 0.0 END) AS fit FROM rd r JOIN bars b ON b.track_id = r.track_id AND r.t >= b.start AND r.t < b."end" GROUP BY 1, 2, 3),
sf AS (SELECT b.track_id, avg(CASE WHEN abs((r.t - b.start) / 10800 - floor((r.t - b.start) / 10800 + 0.5)) <= 0.15 THEN 1.0 ELSE 0.0 END) AS sfit FROM ob r JOIN bars b ON b.track_id = r.track_id AND r.t >= b.start AND r.t < b."end" GROUP BY 1),
d AS (SELECT b.track_id, b.section, b.st AS bs, a.st AS sa, CASE WHEN coalesce(rb.raw, 0) = 0 THEN 'no onsets' WHEN b.st * b.nb >= 0.4 * 8 * b.nb - 1e-9 THEN 'dense' WHEN round(a.st - b.st, 9) < 1 THEN 'gain' WHEN round(a.ag - b.ag, 9) < 0 THEN 'jaccard'
   WHEN ra.raw / CAST(a.nb AS DOUBLE) > 8 THEN 'raw' WHEN round(coalesce(fa.fit, 0) - sfit + 0.05, 9) < 0 THEN 'fit' ELSE 'accepted' END AS reason
  FROM fg b JOIN fg a ON a.track_id = b.track_id AND a.section = b.section AND a.w = 'a' AND b.w = 'b' LEFT JOIN rw rb ON rb.w = 'b' AND rb.track_id = b.track_id AND rb.section = b.section LEFT JOIN rw ra ON ra.w = 'a' AND ra.track_id = b.track_id AND ra.section = b.section
  LEFT JOIN ft fa ON fa.w = 'a' AND fa.track_id = b.track_id AND fa.section = b.section LEFT JOIN sf ON sf.track_id = b.track_id)
SELECT track_id, section, reason = 'accepted' AS accepted, round(bs, 6) AS "before", round(CASE WHEN reason IN ('no onsets', 'dense') THEN bs ELSE sa END, 6) AS "after", reason FROM d""")
def recall_gate(spark, sf):
    from stavework.catalog.grid import levels
    from stavework.operators.ordered import exact_median
    ev = B.events(spark, sf)
    on = share_rows(ev.select("track_id", F.col("event_id").alias("onset_id"), "t", "event_type"))
    base = on.where("event_type not in ('view', 'click')").drop("event_type")
    extra = on.where("event_type in ('view', 'click')").drop("event_type")
    bars = B.bars(spark, sf)
    lv = share_rows(levels(spark, sf))
    silent = lv.join(exact_median(lv, SEC, "rms", "m"), SEC).select("track_id", "bar", (F.col("rms") < 0.25 * F.col("m")).alias("silent"))
    fit = Q.grid_fit(base, bars, DAY)
    return recall.gate_sections(base, extra, bars, silent, fit, 3600.0, DAY).select(*SEC, "accepted", r6("before"), r6("after"), "reason")
