"""Queries over quantised bars: placement, votes, figures, structure tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.functions import rhythm as R
from stavework.session import share_rows
from stavework.operators import quantise as Q, votes as V

DAY = B.DAY
SEC = ["track_id", "section"]
QUERIES, ORACLES = {}, {}


def query(key: str, oracle: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn
    return add


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


def bars_of(spark: SparkSession, sf: str) -> DataFrame:
    return share_rows(Q.quantise(B.onsets(spark, sf), B.bars(spark, sf), DAY))


@query("onset_to_bar", f"""WITH {S.ONSETS}, {S.BARS}
SELECT o.track_id, o.onset_id, b.bar, round((o.t - b.start) / (b."end" - b.start) * b.width, 6) AS pos
FROM onsets o JOIN bars b ON o.track_id = b.track_id AND o.t >= b.start AND o.t < b."end" """)
def onset_to_bar(spark, sf):
    return Q.onset_positions(B.onsets(spark, sf), B.bars(spark, sf), DAY).select("track_id", "onset_id", "bar", r6("pos"))


@query("onset_to_bar_shifted", f"""WITH {S.ONSETS}, {S.BARS}
SELECT o.track_id, o.onset_id, max(b.bar) AS bar FROM onsets o JOIN bars b ON o.track_id = b.track_id
  AND o.t >= b.start - 5400 AND o.t < b."end" - 5400 GROUP BY ALL""")
def onset_to_bar_shifted(spark, sf):
    placed = Q.onset_to_shifted_bar(B.onsets(spark, sf), B.bars(spark, sf), DAY)
    return Q.later_bar(placed).select("track_id", "onset_id", "bar")


@query("quantise_bar", f"""WITH {S.QUANT}
SELECT track_id, section, bar, {S.cells('strike', 'mute', 'width')} AS cells FROM masks""")
def quantise_bar(spark, sf):
    return bars_of(spark, sf).select("track_id", "section", "bar", R.cells(F.col("strike"), F.col("mute"), F.col("width")).alias("cells"))


@query("slot_owners", f"""WITH {S.ONSETS}, {S.BARS}, {S.OWNERS}
SELECT track_id, bar, slot, onset_id, CASE WHEN muted THEN 'x' ELSE 'S' END AS kind FROM owners""")
def slot_owners(spark, sf):
    own = Q.slot_owners(B.onsets(spark, sf), B.bars(spark, sf), DAY)
    return own.select("track_id", "bar", "slot", "onset_id", F.when(F.col("muted"), "x").otherwise("S").alias("kind"))


@query("directions", f"""WITH {S.QUANT}
SELECT track_id, bar, {S.printed('strike', 'mute', 'width')} AS printed FROM masks""")
def directions(spark, sf):
    return bars_of(spark, sf).select("track_id", "bar", R.printed(F.col("strike"), F.col("mute"), F.col("width")).alias("printed"))


@query("mute_mask", f"""WITH {S.ONSETS}, med AS (SELECT track_id, median(centroid) AS mc, median(zcr) AS mz FROM onsets GROUP BY 1)
SELECT track_id, onset_id, centroid < 0.85 * mc AND zcr < 0.65 * mz AS muted FROM onsets JOIN med USING (track_id)""")
def mute_mask(spark, sf):
    return Q.mute_mask(B.onsets(spark, sf)).select("track_id", "onset_id", "muted")


@query("grid_fit", f"""WITH {S.ONSETS}, {S.BARS}, p AS (SELECT o.track_id, (o.t - b.start) / (b."end" - b.start) * b.width AS pos
  FROM onsets o JOIN bars b ON o.track_id = b.track_id AND o.t >= b.start AND o.t < b."end")
SELECT track_id, round(avg(CASE WHEN abs(pos - floor(pos + 0.5)) <= 0.15 THEN 1.0 ELSE 0.0 END), 6) AS grid_fit FROM p GROUP BY 1""")
def grid_fit(spark, sf):
    return Q.grid_fit(B.onsets(spark, sf), B.bars(spark, sf), DAY).select("track_id", r6("grid_fit"))


@query("choose_slots", f"""WITH {S.ONSETS}, {S.BARS}, p AS (SELECT o.track_id, (o.t - b.start) / (b."end" - b.start) * 16 AS pos
  FROM onsets o JOIN bars b ON o.track_id = b.track_id AND o.t >= b.start AND o.t < b."end"),
odd AS (SELECT track_id, avg(CASE WHEN CAST(floor(pos + 0.5) AS BIGINT) % 2 = 1 THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY 1),
tempo AS (SELECT track_id, 60.0 + track_id % 120 AS bpm FROM tracks)
SELECT track_id, round(s, 6) AS odd_share, CAST(CASE WHEN 60000.0 / bpm / 4 < 105 OR s IS NULL OR s <= 0.25 THEN 8 ELSE 16 END AS BIGINT) AS slots
FROM tempo LEFT JOIN odd USING (track_id)""")
def choose_slots(spark, sf):
    tempo = B.tracks(spark, sf).withColumn("bpm", 60.0 + F.col("track_id") % 120)
    return Q.choose_slots(B.onsets(spark, sf), B.bars(spark, sf), tempo, 4, DAY).select("track_id", r6("odd_share"), "slots")


@query("slot_majority", f"""WITH {S.UNITS}, c AS (SELECT track_id, section, slot, count(*) AS n, sum((strike >> slot) & 1) AS k,
  sum((mute >> slot) & 1) AS m FROM (SELECT *, CAST(unnest(range(8)) AS INTEGER) AS slot FROM units) GROUP BY 1, 2, 3)
SELECT track_id, section, string_agg(CASE WHEN NOT (3 * k > n AND k >= 2) THEN '-' WHEN 2 * m > k THEN 'x' ELSE 'S' END, '' ORDER BY slot) AS vote
FROM c GROUP BY 1, 2""")
def slot_majority(spark, sf):
    v = V.section_majority(bars_of(spark, sf))
    return v.select(*SEC, R.cells(F.col("vote_strike"), F.col("vote_mute"), F.col("width")).alias("vote"))


@query("topped_vote", f"""WITH {S.UNITS}, {S.vote('units', 'v')}
SELECT track_id, section, {S.cells('strike', 'mute', 'width')} AS vote, {S.printed('strike', 'mute', 'width')} AS printed FROM v""")
def topped_vote(spark, sf):
    v = V.section_vote(bars_of(spark, sf))
    masks = (F.col("vote_strike"), F.col("vote_mute"), F.col("width"))
    return v.select(*SEC, R.cells(*masks).alias("vote"), R.printed(*masks).alias("printed"))


@query("vote_figures", f"""WITH {S.UNITS}, {S.vote('units', 'v')},
f AS (SELECT u.track_id, u.section, avg({S.jac('u.', 'v.')}) AS confidence,
  coalesce(sum(bit_count(u.strike & v.strike)) / nullif(CAST(sum(bit_count(u.strike)) AS DOUBLE), 0), 0.0) AS explained,
  sum(bit_count(u.strike)) / CAST(sum(u.width) AS DOUBLE) AS density, bool_and(bit_count(v.strike) = v.width) AS full_vote
  FROM units u JOIN v USING (track_id, section) GROUP BY 1, 2),
r AS (SELECT a.track_id, a.section, avg({S.jac('a.', 'b.')}) AS bar_repeat FROM units a JOIN units b
  ON a.track_id = b.track_id AND a.section = b.section AND b.pos = a.pos + 1 GROUP BY 1, 2)
SELECT track_id, section, round(confidence, 6) AS confidence, round(explained, 6) AS explained, round(density, 6) AS density,
  full_vote, round(coalesce(bar_repeat, 0), 6) AS bar_repeat FROM f LEFT JOIN r USING (track_id, section)""")
def vote_figures(spark, sf):
    units = V.units_of_bars(bars_of(spark, sf))
    fig = V.vote_figures(units, V.section_vote(units)).join(V.bar_repeat(units), SEC)
    return fig.select(*SEC, r6("confidence"), r6("explained"), r6("density"), "full_vote", r6("bar_repeat"))


@query("strike_jaccard", f"""WITH {S.UNITS} SELECT a.track_id, a.bar, round({S.jac('a.', 'b.')}, 6) AS agreement
FROM units a JOIN units b ON a.track_id = b.track_id AND a.section = b.section AND b.pos = a.pos + 1""")
def strike_jaccard(spark, sf):
    units = V.units_of_bars(bars_of(spark, sf))
    nxt = V.with_neighbour(units, SEC, ["pos"], V.BAR_CHUNK, {"n_strike": "strike", "n_mute": "mute"}, ahead=True)
    j = R.agreement(F.col("strike"), F.col("mute"), F.col("n_strike"), F.col("n_mute"))
    return nxt.where("n_strike is not null").select("track_id", "bar", r6(j, "agreement"))


@query("swap_distance", f"""WITH {S.UNITS}, pos AS (SELECT track_id, section, pos, bar, slot,
   row_number() OVER (PARTITION BY track_id, bar ORDER BY slot) AS r FROM
   (SELECT *, CAST(unnest(range(8)) AS INTEGER) AS slot FROM units) WHERE (strike >> slot) & 1 = 1),
pr AS (SELECT a.track_id, a.section, a.bar, a.pos, bit_count(a.strike) AS ca, bit_count(b.strike) AS cb FROM units a JOIN units b
  ON a.track_id = b.track_id AND a.section = b.section AND b.pos = a.pos + 1),
d AS (SELECT a.track_id, a.bar, sum(abs(a.slot - b.slot)) AS d FROM pos a JOIN pos b
  ON a.track_id = b.track_id AND a.section = b.section AND b.pos = a.pos + 1 AND a.r = b.r GROUP BY 1, 2)
SELECT track_id, bar, CAST(CASE WHEN ca <> cb THEN 8 ELSE coalesce(d, 0) END AS BIGINT) AS swap FROM pr LEFT JOIN d USING (track_id, bar)""")
def swap_distance(spark, sf):
    units = V.units_of_bars(bars_of(spark, sf))
    nxt = V.with_neighbour(units, SEC, ["pos"], V.BAR_CHUNK, {"n_strike": "strike"}, ahead=True)
    d = R.swap_distance(F.col("strike"), F.col("n_strike"), F.col("width"))
    return nxt.where("n_strike is not null").select("track_id", "bar", d.alias("swap"))


LOO_SQL = """lo AS (SELECT a.track_id, a.section, a.pos AS me, b.width, b.strike, b.mute FROM {u} a JOIN {u} b
  ON a.track_id = b.track_id AND a.section = b.section AND a.pos <> b.pos),
{vote},
whole AS (SELECT {u}.track_id, {u}.section, {u}.pos, {v1}.strike, {v1}.mute FROM {u} JOIN {v1} USING (track_id, section) WHERE {v1}.n = 1),
rest AS (SELECT track_id, section, me AS pos, strike, mute FROM lv UNION ALL SELECT * FROM whole)"""


def loo(u: str = "units", v1: str = "v", support: str = "2") -> str:
    return LOO_SQL.format(u=u, v1=v1, vote=S.vote("lo", "lv", "track_id, section, me", support))


@query("majority_loo", f"""WITH {S.UNITS}, {S.vote('units', 'v')}, {loo()}
SELECT u.track_id, u.section, round(avg({S.jac('u.', 'r.')}), 6) AS score FROM units u JOIN rest r USING (track_id, section, pos) GROUP BY 1, 2""")
def majority_loo(spark, sf):
    return V.majority_loo(bars_of(spark, sf)).select(*SEC, r6("score_majority", "score"))


def medoid_sql(u: str, out: str) -> str:
    return f"""{out}_j AS (SELECT a.track_id, a.section, a.pos, coalesce(avg({S.jac('a.', 'b.')}) FILTER (a.pos <> b.pos), 1.0) AS score
  FROM {u} a JOIN {u} b ON a.track_id = b.track_id AND a.section = b.section GROUP BY 1, 2, 3),
{out} AS (SELECT * FROM (SELECT {u}.*, score, row_number() OVER (PARTITION BY track_id, section ORDER BY round(score, 9) DESC, pos) AS rn
  FROM {u} JOIN {out}_j USING (track_id, section, pos)) WHERE rn = 1)"""


@query("medoid", f"""WITH {S.UNITS}, {medoid_sql('units', 'm')}
SELECT track_id, section, pos AS medoid_pos, round(score, 6) AS score, {S.cells('strike', 'mute', 'width')} AS cells FROM m""")
def medoid(spark, sf):
    m = V.medoid(V.agreement_sums(V.units_of_bars(bars_of(spark, sf))))
    return m.select(*SEC, "medoid_pos", r6("score_medoid", "score"),
                    R.cells(F.col("medoid_strike"), F.col("medoid_mute"), F.col("width")).alias("cells"))


def pair_sql(u: str = "units", need: str = "3") -> str:
    return f"""cnt AS (SELECT track_id, section, count(*) AS n FROM {u} GROUP BY 1, 2),
pj AS (SELECT p.track_id, p.section, p.pos, least(bit_count(p.strike), bit_count(q.strike)) AS fewest,
  avg(CASE WHEN (k.pos - p.pos) % 2 = 0 THEN {S.jac('k.', 'p.')} ELSE {S.jac('k.', 'q.')} END) AS score
  FROM {u} p JOIN {u} q ON p.track_id = q.track_id AND p.section = q.section AND q.pos = p.pos + 1
  JOIN {u} k ON k.track_id = p.track_id AND k.section = p.section AND k.pos NOT IN (p.pos, p.pos + 1)
  JOIN cnt ON cnt.track_id = p.track_id AND cnt.section = p.section AND cnt.n >= 4 GROUP BY 1, 2, 3, 4),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, section ORDER BY round(score, 9) DESC, pos) AS rn FROM pj) WHERE rn = 1),
{medoid_sql(u, 'm')},
ph AS (SELECT m.track_id, m.section, n, m.score AS ms, bp.pos AS pair_pos, bp.score AS ps, coalesce(bp.score - m.score, 0.0) AS margin,
  coalesce(round(bp.score - m.score, 9) >= 0.10 AND (n - bp.pos % 2) // 2 >= {need} AND fewest >= 2, false) AS two
  FROM m JOIN cnt USING (track_id, section) LEFT JOIN bp USING (track_id, section))"""


@query("best_pair", f"""WITH {S.UNITS}, {pair_sql()}
SELECT track_id, section, pair_pos, round(ps, 6) AS score_pair, round(margin, 6) AS period_margin,
  CASE WHEN two THEN 2 ELSE 1 END AS unit, CAST(CASE WHEN two THEN pair_pos % 2 ELSE 0 END AS INTEGER) AS phase FROM ph""")
def best_pair(spark, sf):
    units = V.units_of_bars(bars_of(spark, sf))
    sums = V.agreement_sums(units)
    ph = V.unit_and_phase(V.medoid(sums), V.best_pair(units, sums))
    return ph.select(*SEC, "pair_pos", r6("score_pair"), r6("period_margin"), "unit", "phase")


def choose_sql(u: str = "units", need: str = "3", support: str = "2") -> str:
    return f"""{pair_sql(u, need)},
vu AS (SELECT u.track_id, u.section, u.pos, u.width, u.strike, u.mute FROM {u} u JOIN ph USING (track_id, section) WHERE NOT two
  UNION ALL SELECT a.track_id, a.section, (a.pos - pair_pos % 2) // 2, 2 * a.width, a.strike | (b.strike << a.width), a.mute | (b.mute << a.width)
  FROM {u} a JOIN ph USING (track_id, section) JOIN {u} b ON b.track_id = a.track_id AND b.section = a.section AND b.pos = a.pos + 1
  WHERE two AND a.pos >= pair_pos % 2 AND (a.pos - pair_pos % 2) % 2 = 0),
{S.vote('vu', 'v', support=support)}, {loo('vu', 'v', support)},
loos AS (SELECT u.track_id, u.section, avg({S.jac('u.', 'r.')}) AS loo FROM vu u JOIN rest r USING (track_id, section, pos) GROUP BY 1, 2),
{medoid_sql('vu', 'vm')},
ch0 AS (SELECT ph.track_id, ph.section, two, CASE WHEN two THEN pair_pos % 2 ELSE 0 END AS phase, ph.n AS n_bars, v.n AS n_units,
  loo, vm.score AS med, round(vm.score - loo, 9) >= 0.04 AND bit_count(vm.strike & ~vm.mute) >= 2 AS use_m, vm.width AS vwidth,
  v.strike AS vs, v.mute AS vmu, vm.strike AS s2, vm.mute AS m2
  FROM ph JOIN v USING (track_id, section) JOIN vm USING (track_id, section) JOIN loos USING (track_id, section)),
ch1 AS (SELECT *, CASE WHEN use_m THEN s2 ELSE vs END AS s, CASE WHEN use_m THEN m2 ELSE vmu END AS m FROM ch0),
ch AS (SELECT track_id, section, CASE WHEN two THEN 2 ELSE 1 END AS unit, CAST(phase AS INTEGER) AS phase, n_bars, n_units, vwidth AS width,
  CASE WHEN use_m THEN 'medoid' ELSE 'majority' END AS candidate, loo, med,
  CASE WHEN two AND phase = 1 THEN (s >> (vwidth // 2)) | ((s & ((CAST(1 AS BIGINT) << (vwidth // 2)) - 1)) << (vwidth // 2)) ELSE s END AS strike,
  CASE WHEN two AND phase = 1 THEN (m >> (vwidth // 2)) | ((m & ((CAST(1 AS BIGINT) << (vwidth // 2)) - 1)) << (vwidth // 2)) ELSE m END AS mute
  FROM ch1)"""


@query("choose_pattern", f"""WITH {S.UNITS}, {choose_sql()}
SELECT track_id, section, unit, phase, n_bars, n_units, candidate, round(loo, 6) AS score_majority, round(med, 6) AS score_medoid,
  {S.printed('strike', 'mute', 'width')} AS printed FROM ch""")
def choose_pattern(spark, sf):
    c = V.choose_pattern(bars_of(spark, sf))
    return c.select(*SEC, "unit", "phase", "n_bars", "n_units", "candidate", r6("score_majority"), r6("score_medoid"),
                    R.printed(F.col("strike"), F.col("mute"), F.col("slots_per_bar") * F.col("unit")).alias("printed"))
