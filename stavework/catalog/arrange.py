"""Queries of the arrangement, the score and run comparison. Shapes come from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r3, r6
from stavework.catalog.harmony import CE, events
from stavework.catalog.rhythm import bars_of
from stavework.catalog.truth import PRINT, printed, records
from stavework.functions import harte as H, rhythm as R
from stavework.operators import arrange as A, harmony_spans as HS, rules, truth as T, votes as V
from stavework.operators.ordered import exact_median, with_neighbour
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS, SEC = ["track_id"], ["track_id", "section"]
DAY = B.DAY

SHAPES = f"""sh0 AS (SELECT {H.FLATS}[CAST(substr(p_brand, 7) AS INTEGER) % 12 + 1] AS root, CASE p_type WHEN 'ECONOMY' THEN 'major' WHEN 'STANDARD' THEN 'minor' WHEN 'SMALL' THEN '7' WHEN 'MEDIUM' THEN 'm7' WHEN 'LARGE' THEN 'sus4' ELSE 'dim7' END AS suffix,
  p_partkey AS pos, [p_size % 5, p_size // 5 % 4, p_size % 3, p_size // 7 % 5] AS frets, [p_size % 4, p_size // 3 % 4, p_size % 5, p_size // 11 % 4] AS fingers, p_size % 6 + 1 AS base_fret, p_size % 7 = 0 AS barre FROM part),
sh1 AS (SELECT *, list_filter(frets, lambda f: f > 0) AS ft FROM sh0),
sh2 AS (SELECT *, CAST(CASE WHEN barre THEN 1.5 ELSE 0 END + 0.4 * len(ft) + 0.6 * (base_fret - 1) + CASE WHEN len(ft) >= 2 THEN 0.5 * (list_max(ft) - list_min(ft)) ELSE 0 END + 0.4 * greatest(0, len(list_distinct(list_filter(fingers, lambda f: f > 0))) - 3) AS DOUBLE) AS cost FROM sh1),
shp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, suffix ORDER BY round(cost, 9), pos) AS r FROM sh2) WHERE r = 1)"""
DBKEY = "{r}"


def shapes(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    s = F.col("p_size")
    div = lambda n: F.floor(s / n).cast("int")
    suffix = F.coalesce(F.try_element_at(H.literal_map({"ECONOMY": "major", "STANDARD": "minor", "SMALL": "7", "MEDIUM": "m7", "LARGE": "sus4"}), F.col("p_type")), F.lit("dim7"))
    return p.select(
        F.element_at(F.array(*map(F.lit, H.FLATS)), (F.substring("p_brand", 7, 9).cast("int") % 12 + 1)).alias("root"), suffix.alias("suffix"), F.col("p_partkey").alias("pos"),
        F.array(s % 5, div(5) % 4, s % 3, div(7) % 5).alias("frets"), F.array(s % 4, div(3) % 4, s % 5, div(11) % 4).alias("fingers"), (s % 6 + 1).alias("base_fret"),
        F.when(s % 7 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("barres"))


@query("shape_cost", f"WITH {SHAPES} SELECT pos, root, suffix, round(cost, 6) AS cost FROM sh2")
def shape_cost(spark, sf):
    c = A.shape_cost(F.col("frets"), F.col("fingers"), F.col("base_fret"), F.col("barres"))
    return shapes(spark, sf).select("pos", "root", "suffix", r6(c, "cost"))


@query("cheapest_shape", f"WITH {SHAPES} SELECT root, suffix, pos, round(cost, 6) AS cost FROM shp")
def cheapest_shape(spark, sf):
    return A.cheapest_shapes(shapes(spark, sf)).select("root", "suffix", "pos", r6("cost"))


FLATOF = f"{H.FLATS}[pc + 1]"
SFX = "CASE q WHEN 'maj' THEN 'major' WHEN 'min' THEN 'minor' ELSE q END"
CQ = f"""{CE}, cq AS (SELECT ce.*, {H.FLATS}[pc + 1] AS root, split_part(label, ':', 2) AS q, {H.SHARPS}[pc + 1] AS written FROM ce)"""


@query("shape_lookup", f"""WITH {CQ}, {SHAPES} SELECT c.track_id, c.event, CASE WHEN s.pos IS NOT NULL THEN round(s.cost, 6) END AS cost, CASE WHEN c.pc IS NULL THEN label ELSE written || CASE q WHEN 'maj' THEN '' WHEN 'min' THEN 'm' ELSE q END END AS name
FROM cq c LEFT JOIN shp s ON s.root = c.root AND s.suffix = {SFX}""")
def shape_lookup(spark, sf):
    root, suffix = A.shape_key(F.col("label"))
    best = A.cheapest_shapes(shapes(spark, sf)).select("root", "suffix", "cost")
    ev = events(spark, sf).withColumn("root", root).withColumn("suffix", suffix)
    return ev.join(F.broadcast(best), ["root", "suffix"], "left").select("track_id", "event", r6("cost"), A.display_name(F.col("label")).alias("name"))


@query("simplify_for_tier", f"""WITH {CQ}, {SHAPES} SELECT c.track_id, c.event, CASE WHEN c.pc IS NULL THEN label WHEN s.pos IS NOT NULL THEN label WHEN t.pos IS NOT NULL THEN written || ':' || tq ELSE 'N' END AS chosen,
 CASE WHEN c.pc IS NULL OR s.pos IS NOT NULL THEN NULL WHEN t.pos IS NOT NULL THEN 'no shape for ' || q ELSE 'no shape; left blank' END AS reason
FROM cq c LEFT JOIN shp s ON s.root = c.root AND s.suffix = {SFX} LEFT JOIN shp t ON t.root = c.root AND t.suffix = CASE tq WHEN 'maj' THEN 'major' WHEN 'min' THEN 'minor' ELSE tq END""")
def simplify_for_tier(spark, sf):
    return A.simplify_for_tier(events(spark, sf), A.cheapest_shapes(shapes(spark, sf)), False).select("track_id", "event", "chosen", "reason")


@query("passing_labels", f"""WITH {CE}, h AS (SELECT track_id, label, sum(dur) AS t, max(dur) AS l FROM ch GROUP BY 1, 2), r AS (SELECT *, t < 0.02 * sum(t) OVER (PARTITION BY track_id) AND l <= 86400 AS rare FROM h),
x AS (SELECT *, 3 - count(*) FILTER (NOT rare) OVER (PARTITION BY track_id) AS short, row_number() OVER (PARTITION BY track_id ORDER BY rare DESC, round(t, 6) DESC, label) AS rk FROM r)
SELECT track_id, label, rare AND rk > short AS passing FROM x""")
def passing_labels(spark, sf):
    return A.passing_labels(events(spark, sf).where("end > start"), DAY)


CAPO = f"""{CQ}, {SHAPES}, d AS (SELECT DISTINCT track_id, pc, q FROM cq WHERE pc IS NOT NULL), cs AS (SELECT d.track_id, CAST(c AS INTEGER) AS capo, avg(coalesce(s.cost, 5.0)) + 0.2 * c AS score FROM d CROSS JOIN range(6) r(c)
  LEFT JOIN shp s ON s.root = {H.FLATS}[(pc - c + 12) % 12 + 1] AND s.suffix = {SFX} GROUP BY d.track_id, c)"""


@query("capo_scores", f"WITH {CAPO} SELECT track_id, capo, round(score, 6) AS score FROM cs")
def capo_scores(spark, sf):
    return A.capo_scores(events(spark, sf), A.cheapest_shapes(shapes(spark, sf))).select("track_id", "capo", r6("score"))


@query("choose_capo", f"""WITH {CAPO}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9), capo) AS r FROM cs) SELECT a.track_id, a.capo, round(b.score - a.score, 6) AS margin FROM r a JOIN r b ON a.track_id = b.track_id AND a.r = 1 AND b.r = 2""")
def choose_capo(spark, sf):
    return A.choose_capo(A.capo_scores(events(spark, sf), A.cheapest_shapes(shapes(spark, sf)))).select("track_id", "capo", r6("margin"))


VC = f"""{CQ}, {SHAPES}, cc AS (SELECT c.track_id, c.event, c.start, c.label, s.frets, s.base_fret AS bf, s.cost FROM cq c JOIN shp s ON s.root = c.root AND s.suffix = {SFX}),
tr AS (SELECT *, lead(frets) OVER w AS nf, lead(bf) OVER w AS nb FROM cc WINDOW w AS (PARTITION BY track_id ORDER BY start, event)),
mv AS (SELECT track_id, cost, CASE WHEN nf IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 5), lambda i: abs(CASE WHEN frets[i] <= 0 THEN frets[i] ELSE frets[i] + bf - 1 END - CASE WHEN nf[i] <= 0 THEN nf[i] ELSE nf[i] + nb - 1 END))) END AS m FROM tr)"""


@query("transition_cost", f"WITH {VC} SELECT track_id, round(sum(cost) + 0.1 * sum(m), 6) AS cost FROM mv GROUP BY 1")
def transition_cost(spark, sf):
    ev = share(events(spark, sf))
    root, suffix = A.shape_key(F.col("label"))
    labels = ev.select("label").distinct().withColumn("root", root).withColumn("suffix", suffix)
    choice = share(labels.join(A.cheapest_shapes(shapes(spark, sf)), ["root", "suffix"]).select("label", "frets", "base_fret", "cost"))
    return A.voicing_cost(ev, choice, B.EVENT_CHUNK).select("track_id", r6("cost"))


@query("select_voicings")
def select_voicings(spark, sf):
    return A.select_voicings(share(events(spark, sf)), shapes(spark, sf), B.EVENT_CHUNK)


PLACE = f"""{CE}, {S.BARS}, pl AS (SELECT c.track_id, c.event, c.label, c."end", b.bar, greatest(0, CAST(round_even((c.start - b.start) / (b."end" - b.start) * 8, 0) AS INTEGER)) AS raw FROM ce c JOIN bars b ON b.track_id = c.track_id AND c.start >= b.start - 1e-6 AND c.start < b."end" - 1e-6),
p2 AS (SELECT track_id, event, label, "end", CASE WHEN raw >= 8 THEN bar + 1 ELSE bar END AS bar, CASE WHEN raw >= 8 THEN 0 ELSE raw END AS slot FROM pl),
p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, bar, slot ORDER BY event DESC) AS r FROM p2 WHERE bar < 30) WHERE r = 1),
cy AS (SELECT b.track_id, b.bar, (SELECT arg_max(event, bar * 100 + slot) FROM p3 WHERE p3.track_id = b.track_id AND p3.bar < b.bar) AS ev, b.start FROM bars b WHERE NOT EXISTS (SELECT 1 FROM p3 WHERE p3.track_id = b.track_id AND p3.bar = b.bar AND p3.slot = 0)),
ps AS (SELECT track_id, bar, slot, event, label FROM p3 WHERE label <> 'N' UNION ALL SELECT cy.track_id, cy.bar, 0, c.event, c.label FROM cy JOIN ce c ON c.track_id = cy.track_id AND c.event = cy.ev WHERE c."end" > cy.start + 1e-6 AND c.label <> 'N')"""


@query("event_placement", f"WITH {PLACE} SELECT track_id, CAST(bar AS INTEGER) AS bar, CAST(slot AS INTEGER) AS slot, event, label FROM ps")
def event_placement(spark, sf):
    ev = B.spans(spark, sf).withColumnRenamed("span_id", "event")
    return A.place_events(ev, B.bars(spark, sf), 8, DAY)


@query("diagram_dedup", f"""WITH {CQ}, d AS (SELECT track_id, written || CASE q WHEN 'maj' THEN '' WHEN 'min' THEN 'm' ELSE q END AS name, k % 3 AS shape, min(event) AS first_use, bool_and(k % 2 = 0) AS passing, bool_or(k % 17 = 0) AS power FROM cq WHERE pc IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY first_use) AS place FROM d""")
def diagram_dedup(spark, sf):
    ev = events(spark, sf).where("pc is not null").join(B.events(spark, sf).select(F.col("event_id").alias("event"), "k"), "event")
    a = ev.select("track_id", "event", A.display_name(F.col("label")).alias("name"), (F.col("k") % 3).alias("shape"), (F.col("k") % 2 == 0).alias("passing"), (F.col("k") % 17 == 0).alias("power"))
    return A.diagrams(a).withColumn("place", F.col("place").cast("long"))


@query("pickup_columns", f"""WITH {S.EV} SELECT k % 8 AS j, 1 + k % 7 AS n_cols, CAST(8 - (1 + k % 7) + ((k % 8) * (1 + k % 7)) // 8 AS INTEGER) AS col, CASE WHEN k % 5 < 4 AND k % 2 = 0 THEN CAST(greatest(1, least(7, (k % 5) * 2)) AS DOUBLE) END AS slots, count(*) AS n FROM ev GROUP BY ALL""")
def pickup_columns(spark, sf):
    k = F.col("k")
    cols = (k % 8, F.lit(8), 1 + k % 7)
    return B.events(spark, sf).groupBy((k % 8).alias("j"), (1 + k % 7).alias("n_cols"), A.pickup_column(*cols).alias("col"),
        A.pickup_slots(k % 2 == 0, k % 5, 4, F.lit(8)).cast("double").alias("slots")).agg(F.count("*").alias("n"))


@query("section_state", f"""WITH {S.EV} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'no strummed instrument detected' WHEN k % 11 = 0 THEN 'guitar not separated here' WHEN k % 7 = 0 THEN 'riff' WHEN k % 5 = 0 THEN 'riff heard, not transcribed' WHEN k % 3 = 0 THEN 'pattern uncertain' ELSE '' END AS state FROM ev""")
def section_state(spark, sf):
    k = F.col("k")
    return B.events(spark, sf).select("event_id", rules.section_state(F.col("event_type") == "signup", k % 11 == 0, k % 7 == 0, k % 5 == 0, k % 3 == 0).alias("state"))


LINES = f"{S.QUANT}, ln AS (SELECT track_id, CAST(bar // 2 AS INTEGER) AS line, string_agg(CASE WHEN strike = 0 THEN '.' ELSE 'o' END, '' ORDER BY bar) AS text FROM masks GROUP BY 1, 2)"


@query("fold_repeats", f"""WITH {LINES}, c AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY track_id ORDER BY line) THEN 0 ELSE 1 END AS ch FROM ln), g AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY line) AS run FROM c)
SELECT track_id, text, min(line) AS line, count(*) AS times FROM g GROUP BY track_id, run, text""")
def fold_repeats(spark, sf):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", F.when(F.col("strike") == 0, ".").otherwise("o").alias("c")))), lambda x: x["c"]), "")
    lines = bars_of(spark, sf).groupBy("track_id", F.floor(F.col("bar") / 2).cast("int").alias("line")).agg(text.alias("text"))
    return A.fold_repeats(lines, KEYS)


@query("score_job", f"""WITH {PRINT}, sp AS (SELECT * FROM (SELECT track_id, event_id AS event, t AS start, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS "end", {S.LABEL} AS label FROM ev) WHERE "end" IS NOT NULL), ce AS (SELECT * FROM sp), {PLACE.split('pl AS', 1)[1].join(['pl AS', ''])},
nm AS (SELECT track_id, bar, string_agg(label || '@' || slot, ' ' ORDER BY slot) AS chords FROM ps GROUP BY 1, 2)
SELECT p.track_id, p.section, string_agg(coalesce(chords, 'N.C.') || ' ' || {S.printed('ps', 'pm', '8')} || CASE WHEN uncertain THEN '?' ELSE '' END, ' | ' ORDER BY p.bar) AS bars FROM pr p LEFT JOIN nm ON nm.track_id = p.track_id AND nm.bar = p.bar GROUP BY 1, 2""")
def score_job(spark, sf):
    placed = A.place_events(B.spans(spark, sf).withColumnRenamed("span_id", "event"), B.bars(spark, sf), 8, DAY)
    chords = placed.groupBy("track_id", "bar").agg(F.array_sort(F.collect_list(F.struct("slot", "label"))).alias("c"))  # one per slot
    text = F.array_join(F.transform("c", lambda x: F.concat(x["label"], F.lit("@"), x["slot"].cast("string"))), " ")
    rec = printed(spark, sf).join(chords, ["track_id", "bar"], "left")
    line = F.concat(F.coalesce(text, F.lit("N.C.")), F.lit(" "), R.printed(F.col("p_strike"), F.col("p_mute"), F.col("width")), F.when(F.col("uncertain"), "?").otherwise(""))
    per = rec.select(*SEC, "bar", line.alias("line")).groupBy(*SEC).agg(F.array_sort(F.collect_list(F.struct("bar", "line"))).alias("b"))  # one section's bars
    return per.select(*SEC, F.array_join(F.transform("b", lambda x: x["line"]), " | ").alias("bars"))


# --- run comparison: run B hears no views
def run_of(spark, sf, drop):
    from stavework.operators import quantise as Q
    on = B.onsets(spark, sf)
    if drop:
        views = B.events(spark, sf).where("event_type = 'view'").select(F.col("event_id").alias("onset_id"))
        on = on.join(views, "onset_id", "left_anti")
    return share(Q.quantise(on, B.bars(spark, sf), DAY))


def diag(bars):
    vote = share(V.section_vote(bars))
    fig = V.vote_figures(bars, vote)
    strikes = bars.groupBy(*SEC).agg(F.avg(F.bit_count("strike")).alias("strikes_per_bar"))
    rest = vote.select(*SEC, (1 - F.bit_count("vote_strike") / F.col("width")).alias("rest_share"), "vote_strike", "vote_mute")
    return fig.select(*SEC, "confidence", "explained").join(strikes, SEC).join(rest, SEC)


def run_sql(tag: str, cond: str) -> str:
    return f"""on_{tag} AS (SELECT o.* FROM onsets o JOIN ev e ON e.event_id = o.onset_id WHERE {cond}),
sl_{tag} AS (SELECT *, row_number() OVER (PARTITION BY track_id, bar, slot ORDER BY muted, t, onset_id) AS rn FROM (SELECT b.track_id, b.bar, o.muted, o.t, o.onset_id, CAST(greatest(0, least(floor((o.t - b.start) / 10800 + 0.5), 7)) AS INTEGER) AS slot
  FROM on_{tag} o JOIN bars b ON b.track_id = o.track_id AND o.t >= b.start - 5400 AND o.t < b."end" - 5400)),
u_{tag} AS (SELECT b.track_id, b.section, b.bar, 8 AS width, coalesce(bit_or(CAST(1 AS BIGINT) << slot), 0) AS strike, coalesce(bit_or(CASE WHEN muted THEN CAST(1 AS BIGINT) << slot ELSE 0 END), 0) AS mute FROM bars b LEFT JOIN sl_{tag} s ON s.track_id = b.track_id AND s.bar = b.bar AND rn = 1 GROUP BY 1, 2, 3),
{S.vote('u_' + tag, 'v_' + tag)},
d_{tag} AS (SELECT u.track_id, u.section, avg({S.jac('u.', 'v.')}) AS confidence, coalesce(sum(bit_count(u.strike & v.strike)) / nullif(CAST(sum(bit_count(u.strike)) AS DOUBLE), 0), 0) AS explained, avg(bit_count(u.strike)) AS spb, any_value(1 - bit_count(v.strike) / 8.0) AS rest_share, any_value(v.strike) AS vs, any_value(v.mute) AS vm
  FROM u_{tag} u JOIN v_{tag} v USING (track_id, section) GROUP BY 1, 2)"""


RUNS = f"{S.ONSETS}, {S.BARS}, {run_sql('a', 'true')}, {run_sql('b', chr(39) + 'view' + chr(39) + ' <> e.event_type')}"


@query("section_diag", f"""WITH {RUNS}, rs AS (SELECT track_id, section, string_agg(CAST(bar AS VARCHAR), ',' ORDER BY bar) AS resting FROM u_a WHERE strike = 0 GROUP BY 1, 2)
SELECT d.track_id, d.section, round(spb, 6) AS strikes_per_bar, round(explained, 6) AS explained, CAST(round(rest_share, 6) AS DOUBLE) AS rest_share, coalesce(resting, '') AS resting FROM d_a d LEFT JOIN rs USING (track_id, section)""")
def section_diag(spark, sf):
    bars = run_of(spark, sf, False)
    resting = bars.where("strike = 0").groupBy(*SEC).agg(F.array_join(F.array_sort(F.collect_list("bar")), ",").alias("resting"))  # one section's bars
    return diag(bars).join(resting, SEC, "left").select(*SEC, r6("strikes_per_bar"), r6("explained"), r6("rest_share"), F.coalesce("resting", F.lit("")).alias("resting"))


@query("boxes_mostly_rests", f"""WITH {RUNS} SELECT track_id, count(*) FILTER (confidence >= 0.2 AND rest_share >= 0.75) AS boxes FROM d_a GROUP BY 1""")
def boxes_mostly_rests(spark, sf):
    return diag(run_of(spark, sf, False)).groupBy("track_id").agg(F.count_if((F.round("confidence", 9) >= 0.2) & (F.col("rest_share") >= 0.75)).alias("boxes"))


@query("section_pairing", f"""WITH {S.EV}, a AS (SELECT track_id, CAST(floor(t / 86400) AS INTEGER) AS start, count(*) AS na FROM ev WHERE event_type <> 'click' GROUP BY 1, 2), b AS (SELECT track_id, CAST(floor(t / 86400) AS INTEGER) AS start, count(*) AS nb FROM ev WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT coalesce(a.track_id, b.track_id) AS track_id, coalesce(a.start, b.start) AS start, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b ON a.track_id = b.track_id AND a.start = b.start""")
def section_pairing(spark, sf):
    ev = B.events(spark, sf)
    def side(name, n):
        return ev.where(F.col("event_type") != name).groupBy("track_id", F.floor(F.col("t") / DAY).cast("int").alias("start")).agg(F.count("*").alias(n))
    return side("click", "na").join(side("view", "nb"), ["track_id", "start"], "full").na.fill(0)


@query("run_diff", f"""WITH {RUNS} SELECT a.track_id, a.section, count(*) FILTER ((a.strike = 0) <> (b.strike = 0)) AS rest_changes, count(*) FILTER (a.strike <> b.strike OR a.mute <> b.mute) AS pattern_changes FROM u_a a JOIN u_b b USING (track_id, bar) GROUP BY 1, 2""")
def run_diff(spark, sf):
    a, b = run_of(spark, sf, False), run_of(spark, sf, True)
    j = a.join(b.select("track_id", "bar", F.col("strike").alias("b_strike"), F.col("mute").alias("b_mute")), ["track_id", "bar"])
    return j.groupBy(*SEC).agg(F.count_if((F.col("strike") == 0) != (F.col("b_strike") == 0)).alias("rest_changes"),
                               F.count_if((F.col("strike") != F.col("b_strike")) | (F.col("mute") != F.col("b_mute"))).alias("pattern_changes"))


@query("compare_job", f"""WITH {RUNS} SELECT a.track_id, a.section, round(b.spb - a.spb, 6) AS d_strikes, round(b.explained - a.explained, 6) AS d_explained, CAST(round(b.rest_share - a.rest_share, 6) AS DOUBLE) AS d_rest, a.vs <> b.vs OR a.vm <> b.vm AS pattern_changed, (round(a.confidence, 9) < 0.3) <> (round(b.confidence, 9) < 0.3) AS certainty_changed FROM d_a a JOIN d_b b USING (track_id, section)""")
def compare_job(spark, sf):
    a, b = diag(run_of(spark, sf, False)), diag(run_of(spark, sf, True))
    b = b.select(*SEC, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in SEC])
    return a.join(b, SEC).select(
        *SEC, r6(F.col("b_strikes_per_bar") - F.col("strikes_per_bar"), "d_strikes"), r6(F.col("b_explained") - F.col("explained"), "d_explained"), r6(F.col("b_rest_share") - F.col("rest_share"), "d_rest"),
        ((F.col("vote_strike") != F.col("b_vote_strike")) | (F.col("vote_mute") != F.col("b_vote_mute"))).alias("pattern_changed"),
        ((F.round("confidence", 9) < 0.3) != (F.round("b_confidence", 9) < 0.3)).alias("certainty_changed"))


CD = f"""{S.SPANS}, {S.BARS}, b AS (SELECT *, lag(label) OVER (PARTITION BY track_id ORDER BY start, span_id) AS pl FROM spans),
nsh AS (SELECT track_id, sum(CASE WHEN label = 'N' THEN "end" - start ELSE 0 END) / nullif(sum("end" - start), 0) AS n_share FROM spans GROUP BY 1),
aln AS (SELECT b.track_id, count(*) AS all_n FROM (SELECT b.track_id, b.bar, coalesce(bool_and(s.label = 'N'), true) AS an FROM bars b LEFT JOIN spans s ON s.track_id = b.track_id AND least(s."end", b."end") - greatest(s.start, b.start) > 1e-9 GROUP BY 1, 2) b WHERE an GROUP BY 1),
chg AS (SELECT track_id, count(*) AS n, count(*) FILTER (abs(start - 86400 * floor(start / 86400 + 0.5)) <= 3600 AND floor(start / 86400 + 0.5) < 30) AS onb FROM b WHERE pl <> label GROUP BY 1),
md AS (SELECT track_id, median("end" - start) AS m FROM spans GROUP BY 1), sb AS (SELECT track_id, count(*) FILTER ("end" - start < 0.5 * m) AS sub FROM spans JOIN md USING (track_id) GROUP BY 1)"""


def chord_diag(spark, sf):
    from stavework.operators import diagnostics as D
    return D.chord_diagnostics(share(B.spans(spark, sf)), B.bars(spark, sf), DAY, B.EVENT_CHUNK, 3600.0, 0.5)


@query("chord_diagnostics", f"""WITH {CD} SELECT t.track_id, round(n_share, 6) AS n_share, coalesce(all_n, 0) AS all_n_bars, round(onb / CAST(n AS DOUBLE), 6) AS changes_on_bar, sub AS sub_beat_events FROM tracks t LEFT JOIN nsh USING (track_id) LEFT JOIN aln USING (track_id) LEFT JOIN chg USING (track_id) LEFT JOIN sb USING (track_id)""")
def chord_diagnostics(spark, sf):
    return chord_diag(spark, sf).select("track_id", r6("n_share"), "all_n_bars", r6("changes_on_bar"), "sub_beat_events")


@query("evaluate_job", f"""WITH {CD.replace(S.SPANS + ', ' + S.BARS, RUNS + ', ' + S.SPANS.split('spans AS', 1)[1].join(['spans AS', '']))},
m AS (SELECT track_id, 'n_share' AS metric, n_share AS value FROM nsh UNION ALL SELECT track_id, 'changes_on_bar', onb / CAST(n AS DOUBLE) FROM chg UNION ALL SELECT track_id, 'sub_beat_events', sub FROM sb
 UNION ALL SELECT track_id, 'confidence', avg(confidence) FROM d_a GROUP BY 1 UNION ALL SELECT track_id, 'explained', avg(explained) FROM d_a GROUP BY 1 UNION ALL SELECT track_id, 'strikes_per_bar', avg(spb) FROM d_a GROUP BY 1 UNION ALL SELECT track_id, 'rest_share', avg(rest_share) FROM d_a GROUP BY 1)
SELECT track_id, metric, CAST(round(value, 6) AS DOUBLE) AS value FROM m""")
def evaluate_job(spark, sf):
    from stavework.operators import diagnostics as D
    d = diag(run_of(spark, sf, False)).groupBy("track_id").agg(*[F.avg(c).alias(c) for c in ("confidence", "explained", "strikes_per_bar", "rest_share")])
    chords = chord_diag(spark, sf).drop("all_n_bars").withColumn("sub_beat_events", F.col("sub_beat_events").cast("double"))
    return D.metric_rows(d).unionByName(D.metric_rows(chords)).where("value is not null").select("track_id", "metric", r6("value"))
