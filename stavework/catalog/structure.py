"""Queries over sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import grid as GR, sql as S
from stavework.catalog.common import Registry, r6
from stavework.operators import grid as G, harmony_spans as H, segment as M, structure as T
from stavework.params import HarmonyParams
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS, SEC = ["track_id"], ["track_id", "section"]
LOOSE = HarmonyParams(bridge_novel_chords=0.3)

BT = f"""{S.SPANS}, {S.BARS},
bt AS (SELECT DISTINCT b.track_id, b.section, b.bar, replace(s.label, ':7', ':maj') AS triad FROM bars b JOIN spans s ON s.track_id = b.track_id AND s.start < b."end" - 1e-6 AND s."end" > b.start + 1e-6 WHERE s.label <> 'N'),
st AS (SELECT DISTINCT track_id, section, triad FROM bt), ns AS (SELECT track_id, triad, count(*) AS n FROM st GROUP BY 1, 2),
nv AS (SELECT b.track_id, b.section, coalesce(count(DISTINCT bt.bar) FILTER (n = 1) / nullif(CAST(count(DISTINCT bt.bar) AS DOUBLE), 0), 0) AS novelty FROM bars b LEFT JOIN bt ON bt.track_id = b.track_id AND bt.bar = b.bar LEFT JOIN ns ON ns.track_id = bt.track_id AND ns.triad = bt.triad GROUP BY 1, 2)"""


def bar_triads(spark, sf):
    sp = B.spans(spark, sf).withColumn("triad", F.regexp_replace("label", ":7$", ":maj"))
    return share(H.chords_over_bars(sp, B.bars(spark, sf), B.DAY).select(*SEC, "bar", "triad_set"))


@query("novelty", f"WITH {BT} SELECT track_id, section, round(novelty, 6) AS novelty FROM nv")
def novelty(spark, sf):
    return T.section_novelty(bar_triads(spark, sf)).select(*SEC, r6("novelty"))


@query("elsewhere_set", f"""WITH {BT}, o AS (SELECT track_id, section, string_agg(triad, '+' ORDER BY triad) AS own FROM st GROUP BY 1, 2),
e AS (SELECT s.track_id, s.section, string_agg(DISTINCT st.triad, '+' ORDER BY st.triad) AS elsewhere FROM (SELECT DISTINCT track_id, section FROM bars) s LEFT JOIN st ON st.track_id = s.track_id AND st.section <> s.section GROUP BY 1, 2),
n AS (SELECT st.track_id, section, string_agg(st.triad, '+' ORDER BY st.triad) AS novel FROM st JOIN ns ON ns.track_id = st.track_id AND ns.triad = st.triad AND n = 1 GROUP BY 1, 2)
SELECT e.track_id, e.section, coalesce(own, '') AS own, coalesce(elsewhere, '') AS elsewhere, coalesce(novel, '') AS novel FROM e LEFT JOIN o USING (track_id, section) LEFT JOIN n USING (track_id, section)""")
def elsewhere_set(spark, sf):
    return T.elsewhere_sets(bar_triads(spark, sf)).select(*SEC, *[F.array_join(c, "+").alias(c) for c in ("own", "elsewhere", "novel")])


@query("pair_novelty", f"""WITH {BT}, p AS (SELECT DISTINCT a.track_id, a.section AS f, b.section AS n FROM bars a JOIN bars b ON a.track_id = b.track_id AND abs(a.section - b.section) = 1)
SELECT p.track_id, f AS fragment, n AS neighbour, round(coalesce(count(DISTINCT bt.bar) FILTER (st.triad IS NULL) / nullif(CAST(count(DISTINCT bt.bar) AS DOUBLE), 0), 0), 6) AS novelty
FROM p LEFT JOIN bt ON bt.track_id = p.track_id AND bt.section = f LEFT JOIN st ON st.track_id = p.track_id AND st.section = n AND st.triad = bt.triad GROUP BY 1, 2, 3""")
def pair_novelty(spark, sf):
    s = B.sections(spark, sf).select("track_id", F.col("section").alias("fragment"))
    pairs = s.select("track_id", "fragment", F.explode(F.array(F.col("fragment") - 1, F.col("fragment") + 1)).alias("neighbour")).where("neighbour between 0 and 3")
    return T.pair_novelty(bar_triads(spark, sf), pairs).select("track_id", "fragment", "neighbour", r6("novelty"))


REFINE = f"""{BT}, vs AS (SELECT track_id, section, avg(CASE WHEN (track_id + bar) % 3 > 0 THEN 1.0 ELSE 0 END) AS v FROM bars GROUP BY 1, 2), {S.SECTIONS},
cd AS (SELECT s.track_id, s.section, s.label, s.start_bar, s.end_bar, s.section IN (1, 2) AND novelty >= 0.3 AND v >= 0.5 AS c FROM sections s JOIN nv USING (track_id, section) JOIN vs USING (track_id, section)),
rl AS (SELECT track_id, section, start_bar, end_bar, CASE WHEN c AND sum(CAST(c AS INTEGER)) OVER (PARTITION BY track_id) = 1 THEN 'bridge' ELSE label END AS label FROM cd)"""


@query("refine_labels", f"WITH {REFINE} SELECT track_id, section, label FROM rl")
def refine_labels(spark, sf):
    vs = B.bars(spark, sf).groupBy(*SEC).agg(F.avg(((F.col("track_id") + F.col("bar")) % 3 > 0).cast("double")).alias("vocal_share"))
    return T.refine_labels(B.sections(spark, sf), T.section_novelty(bar_triads(spark, sf)), vs, LOOSE).select(*SEC, "label")


def tokens(spark, sf):
    return bar_triads(spark, sf).groupBy(*SEC).agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "triad_set"))), lambda x: x["triad_set"]).alias("sets"))


@query("containment_distance")
def containment_distance(spark, sf):
    t = share(tokens(spark, sf))
    a = t.select("track_id", F.col("section").alias("a_section"), F.col("sets").alias("a"))
    b = t.select("track_id", F.col("section").alias("b_section"), F.col("sets").alias("b"))
    return T.containment(a.join(b, KEYS).where("a_section < b_section")).select("track_id", "a_section", "b_section", r6("distance"))


@query("one_loop_share")
def one_loop_share(spark, sf):
    loose = HarmonyParams(chord_match_distance=0.75)
    return T.one_loop_share(B.sections(spark, sf), tokens(spark, sf), loose).select("track_id", r6("one_loop_share"))


@query("section_plan")
def section_plan(spark, sf):
    return T.section_plan(B.sections(spark, sf).select(*SEC, "label"), bar_triads(spark, sf))


ENDS = f"""{S.SPANS}, {S.BARS}, fl AS (SELECT b.track_id, b.bar, arg_min(label, s.start) AS f, arg_max(label, s.start) AS l FROM bars b JOIN spans s ON s.track_id = b.track_id AND s.start >= b.start AND s.start < b."end" GROUP BY 1, 2),
en AS (SELECT b.track_id, b.section, b.bar, coalesce(f, 'N') AS f, coalesce(l, 'N') AS l FROM bars b LEFT JOIN fl USING (track_id, bar)),
cb AS (SELECT track_id, bar FROM (SELECT *, lag(l) OVER (PARTITION BY track_id ORDER BY bar) AS p FROM en) WHERE p IS NOT NULL AND f <> p)"""


def ends(spark, sf):
    from stavework.operators.intervals import point_in_span
    sp = B.spans(spark, sf).select("track_id", F.col("start").alias("t"), "label")
    placed = point_in_span(sp, B.bars(spark, sf).select("track_id", "bar", "start", "end"), KEYS, "t", "start", "end", B.DAY)
    fl = placed.groupBy("track_id", "bar").agg(F.min_by("label", "t").alias("first"), F.max_by("label", "t").alias("last"))
    return B.bars(spark, sf).join(fl, ["track_id", "bar"], "left").select("track_id", "bar", F.coalesce("first", F.lit("N")).alias("first"), F.coalesce("last", F.lit("N")).alias("last"))


@query("chord_change_bars", f"WITH {ENDS} SELECT * FROM cb")
def chord_change_bars(spark, sf):
    return T.chord_change_bars(ends(spark, sf))


@query("aligned_starts", f"""WITH RECURSIVE {ENDS}, {S.SECTIONS}, cc AS (SELECT * FROM cb),
ct AS (SELECT s.track_id, s.section, s.start_bar, s.end_bar, count(c.bar) AS n, count(c.bar) FILTER ((c.bar - s.start_bar) % 2 = 1) AS odd FROM sections s LEFT JOIN cc c ON c.track_id = s.track_id AND c.bar >= s.start_bar AND c.bar < s.end_bar GROUP BY ALL),
wk AS (SELECT track_id, section, start_bar, end_bar, 0 AS shifted FROM ct WHERE section = 0 UNION ALL
 SELECT c.track_id, c.section, c.start_bar + CASE WHEN c.odd >= 4 AND c.odd >= 0.75 * c.n AND c.end_bar - c.start_bar - 1 >= 4 AND c.start_bar + 1 - w.start_bar >= 4 THEN 1 ELSE 0 END, c.end_bar,
   CASE WHEN c.odd >= 4 AND c.odd >= 0.75 * c.n AND c.end_bar - c.start_bar - 1 >= 4 AND c.start_bar + 1 - w.start_bar >= 4 THEN 1 ELSE 0 END FROM wk w JOIN ct c ON c.track_id = w.track_id AND c.section = w.section + 1)
SELECT track_id, section, start_bar, CASE WHEN lead(shifted) OVER (PARTITION BY track_id ORDER BY section) = 1 THEN lead(start_bar) OVER (PARTITION BY track_id ORDER BY section) ELSE end_bar END AS end_bar, shifted FROM wk""")
def aligned_starts(spark, sf):
    ch = T.chord_change_bars(ends(spark, sf))
    return T.aligned_starts(B.sections(spark, sf).select(*SEC, "start_bar", "end_bar"), ch)


@query("insert_vocal_boundaries")
def insert_vocal_boundaries(spark, sf):
    flags = B.bars(spark, sf).select("track_id", "bar", ((F.col("track_id") * 7 + F.floor(F.col("bar") / 5)) % 3 > 0).alias("vocal"))
    b = B.sections(spark, sf).select("track_id", "start_bar", F.lit(30).alias("n_bars"))
    return T.insert_vocal_boundaries(b, G.vocal_runs(flags))


@query("display_names", f"""WITH {REFINE} SELECT track_id, section, upper(label[1]) || label[2:] || CASE WHEN count(*) OVER (PARTITION BY track_id, label) > 1 THEN ' ' || row_number() OVER (PARTITION BY track_id, label ORDER BY section) ELSE '' END AS name FROM rl""")
def display_names(spark, sf):
    vs = B.bars(spark, sf).groupBy(*SEC).agg(F.avg(((F.col("track_id") + F.col("bar")) % 3 > 0).cast("double")).alias("vocal_share"))
    r = T.refine_labels(B.sections(spark, sf), T.section_novelty(bar_triads(spark, sf)), vs, LOOSE)
    return T.display_names(r).select(*SEC, "name")


@query("longest_member", f"""WITH {REFINE} SELECT track_id, label, start_bar, end_bar FROM (SELECT *, row_number() OVER (PARTITION BY track_id, label ORDER BY end_bar - start_bar DESC, start_bar) AS r FROM rl) WHERE r = 1""")
def longest_member(spark, sf):
    vs = B.bars(spark, sf).groupBy(*SEC).agg(F.avg(((F.col("track_id") + F.col("bar")) % 3 > 0).cast("double")).alias("vocal_share"))
    r = T.refine_labels(B.sections(spark, sf), T.section_novelty(bar_triads(spark, sf)), vs, LOOSE)
    return T.longest_member(r, ["track_id", "label"])


FEAT = """ft AS (SELECT CAST(label AS BIGINT) AS track_id, CAST(vec_id // 20 AS BIGINT) AS bar, CAST(i - 1 AS INTEGER) AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT *, unnest(range(1, 13)) AS i FROM embeddings) GROUP BY 1, 2, 3),
fz AS (SELECT *, avg(x) OVER (PARTITION BY track_id, dim) AS mu, stddev_pop(x) OVER (PARTITION BY track_id, dim) AS sd FROM ft)"""


def feats(spark, sf):
    fr = B.chroma(spark, sf).select("track_id", F.floor(F.col("vec_id") / 20).alias("bar"), F.col("chroma").alias("v"))
    return T.bar_features(fr, None, KEYS, 12)


@query("bar_features", f"WITH {FEAT} SELECT track_id, bar, dim, round(CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0 END, 6) AS z FROM fz")
def bar_features(spark, sf):
    return feats(spark, sf).select("track_id", "bar", "dim", r6("z"))


APART = "round(list_sum(list_transform(list_zip({}, {}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"
NEXT_SEED = """c{n} AS (SELECT * FROM c{k} UNION ALL SELECT track_id, {k} AS c, bar, f FROM (SELECT v.track_id, v.bar, v.f, min({apart}) AS d FROM v JOIN c{k} c ON c.track_id = v.track_id GROUP BY 1, 2, 3)
 QUALIFY d > 0 AND row_number() OVER (PARTITION BY track_id ORDER BY d DESC, bar) = 1)"""
SEEDS = f"""{FEAT}, v AS (SELECT track_id, bar, list(round(CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0 END, 9) ORDER BY dim) AS f FROM fz GROUP BY 1, 2),
c1 AS (SELECT track_id, 0 AS c, bar, f FROM v QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(list_sum(list_transform(f, lambda x: x * x)), 9) DESC, bar) = 1),
""" + ",\n".join(NEXT_SEED.format(k=k, n=k + 1, apart=APART.format("v.f", "c.f")) for k in range(1, 6))


@query("bar_seeds", f"WITH {SEEDS} SELECT track_id, CAST(c AS INTEGER) AS c, bar FROM c6")
def bar_seeds(spark, sf):
    return M.seeds(share(M.bar_vectors(feats(spark, sf), KEYS)), KEYS).select("track_id", F.posexplode("bars").alias("c", "bar"))


@query("bar_assignment", f"""WITH {SEEDS}, d AS (SELECT v.track_id, k, v.bar, c, {APART.format("v.f", "c6.f")} AS d FROM v JOIN c6 ON c6.track_id = v.track_id, unnest(range(3, 7)) u(k) WHERE c < k AND k <= (SELECT count(*) FROM c6 s WHERE s.track_id = v.track_id))
SELECT track_id, CAST(k AS INTEGER) AS k, bar, CAST(c AS INTEGER) AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY track_id, k, bar ORDER BY d, c) = 1""")
def bar_assignment(spark, sf):
    vectors = share(M.bar_vectors(feats(spark, sf), KEYS))
    return M.assigned(vectors, M.openings(vectors, KEYS), KEYS).select("track_id", "k", "bar", "cluster")


@query("bar_segmentation")
def bar_segmentation(spark, sf):
    return M.segment_bars(feats(spark, sf), KEYS)
