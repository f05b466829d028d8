"""Queries over text records, credits, names and run lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework import binding as B
from stavework.catalog import sql as S
from stavework.catalog.common import Registry, r6
from stavework.catalog.rhythm import bars_of
from stavework.functions import rhythm as R, titles as T
from stavework.operators import lineage as L, validate as VA, votes as V
from stavework.sources import artifacts as AR, records as RC
from stavework.session import share

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
SEC = ["track_id", "section"]


def read(spark, sf, t):
    return spark.read.parquet(f"{sf}/{t}.parquet")


@query("truth_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS raw, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS line FROM documents),
r AS (SELECT doc_id, line, regexp_replace(regexp_replace(raw, '(^|\s)#.*', ''), '^\s+|\s+$', '', 'g') AS record FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, record FROM r WHERE record <> ''""")
def truth_lines(spark, sf):
    return RC.truth_lines(read(spark, sf, "documents"), "text", ["doc_id"])


TL = f"""{S.EV}, tx AS (SELECT event_id, k, CASE WHEN k % 17 = 0 THEN 'x' ELSE CAST(k % 28 AS VARCHAR) END AS s, CAST(k % 28 + event_id % 5 - 1 AS VARCHAR) AS e, ['YES','MOSTLY','NO','MAYBE'][k % 4 + 1] AS v, CASE WHEN k % 3 = 0 THEN ' D-DU-UDU' WHEN k % 3 = 1 THEN ' D-qU' ELSE '' END AS f,
 ['riff','strum','rest','play','loud'][k % 5 + 1] AS l FROM ev)"""


def typed_lines(spark, sf, what):
    k, e = F.col("k"), F.col("event_id")
    head = F.concat(F.when(k % 17 == 0, "x").otherwise((k % 28).cast("string")), F.lit("\t"), (k % 28 + e % 5 - 1).cast("string"), F.lit("  "))
    verdict = F.element_at(F.array(*map(F.lit, ["YES", "MOSTLY", "NO", "MAYBE"])), (k % 4 + 1).cast("int"))
    fig = F.when(k % 3 == 0, " D-DU-UDU").when(k % 3 == 1, " D-qU").otherwise("")
    label = F.element_at(F.array(*map(F.lit, ["riff", "strum", "rest", "play", "loud"])), (k % 5 + 1).cast("int"))
    text = F.concat(head, F.concat(verdict, fig) if what == "patterns" else label, F.lit("  # heard\n\n# a comment"))
    return RC.truth_lines(B.events(spark, sf).select("event_id", text.alias("text")), "text", ["event_id"])


RANGE_BAD = "WHEN k % 17 = 0 THEN 'expected start and end bar numbers' WHEN event_id % 5 - 1 <= 0 THEN 'expected 0 <= start < end'"


@query("truth_patterns_read", f"""WITH {TL} SELECT event_id, CASE {RANGE_BAD} WHEN v = 'MAYBE' THEN 'expected a verdict YES, MOSTLY or NO' WHEN f = ' D-qU' THEN 'expected a figure of D, U, x and -' END AS reject, v AS verdict, trim(f) AS figure FROM tx""")
def truth_patterns_read(spark, sf):
    r = RC.read_patterns(typed_lines(spark, sf, "patterns"))
    return r.select("event_id", "reject", "verdict", F.coalesce(F.array_join("figure", " "), F.lit("")).alias("figure"))


@query("truth_ranges_read", f"""WITH {TL} SELECT event_id, CASE {RANGE_BAD} WHEN l = 'loud' THEN 'expected a label' END AS reject, l AS label FROM tx""")
def truth_ranges_read(spark, sf):
    return RC.read_labels(typed_lines(spark, sf, "labels")).select("event_id", "reject", "label")


@query("truth_keys_read", f"""WITH {S.EV}, l AS (SELECT track_id, event_id, k, row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS place FROM ev)
SELECT track_id, event_id AS line, CASE WHEN place > 2 THEN 'expected at most two key lines' WHEN k % 5 = 0 THEN 'not a key: mode is not major or minor' END AS reject FROM l""")
def truth_keys_read(spark, sf):
    ev = B.events(spark, sf)
    name = F.element_at(F.array(*map(F.lit, B.SHARPS)), (F.col("k") % 12 + 1).cast("int"))
    lines = ev.select("track_id", F.col("event_id").alias("line"), F.concat(name, F.when(F.col("k") % 5 == 0, " dorian").otherwise(" major"), F.lit(" book")).alias("record"))
    return RC.read_keys(lines, ["track_id"]).select("track_id", "line", "reject")


@query("truth_credits_read", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS raw, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS line FROM documents),
r AS (SELECT doc_id, line, regexp_replace(regexp_replace(raw, '(^|\s)#.*', ''), '^\s+|\s+$', '', 'g') AS record FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM r WHERE record <> '')
SELECT doc_id, max(record) FILTER (n = 1) AS title, max(record) FILTER (n = 2) AS artist, CASE WHEN max(n) < 2 THEN 'expected the artist on a second line' WHEN max(n) > 2 THEN 'expected only a title line and an artist line' END AS reject FROM f GROUP BY 1""")
def truth_credits_read(spark, sf):
    return RC.read_credits(share(RC.truth_lines(read(spark, sf, "documents"), "text", ["doc_id"])), ["doc_id"])


@query("lab_spans_scan", f"""WITH {S.SPANS} SELECT track_id, span_id, CASE WHEN span_id % 9 = 0 THEN 'expected ''start end label'' (tab-separated)' WHEN span_id % 9 = 1 THEN 'expected start and end times in seconds' END AS reject, CASE WHEN span_id % 9 <> 0 THEN label END AS label FROM spans""")
def lab_spans_scan(spark, sf):
    s = F.col("span_id")
    text = F.concat(F.when(s % 9 == 1, "soon").otherwise(F.format_string("%.3f", "start")), F.lit("\t"), F.format_string("%.3f", "end"), F.when(s % 9 == 0, "").otherwise(F.concat(F.lit("\t"), F.col("label"))))
    lines = B.spans(spark, sf).select("track_id", "span_id", text.alias("record"))
    return RC.read_spans(lines).select("track_id", "span_id", "reject", "label")


@query("beats_scan", f"""WITH {S.EV} SELECT track_id, event_id, CASE WHEN event_id % 13 = 0 THEN 'expected a beat time in seconds' END AS reject, event_type = 'purchase' AS is_downbeat FROM ev""")
def beats_scan(spark, sf):
    ev = B.events(spark, sf)
    text = F.concat(F.when(F.col("event_id") % 13 == 0, "beat").otherwise(F.format_string("%.4f", "t")), F.when(F.col("event_type") == "purchase", "\t1").otherwise(""))
    return RC.read_beats(ev.select("track_id", "event_id", text.alias("record"))).select("track_id", "event_id", "reject", "is_downbeat")


@query("beat_file_sink", f"""WITH {S.TRACKS}, {S.RBEATS} SELECT track_id, printf('%.4f', start) || chr(9) || (i + 1) || chr(9) || (beat + 1) AS line FROM rbeats""")
def beat_file_sink(spark, sf):
    b = B.regular_beats(spark, sf)
    return b.select("track_id", RC.beat_file_line(F.col("start"), F.col("i") + 1, F.col("beat") + 1).alias("line"))


@query("onset_label_sink", f"""WITH {S.EV} SELECT event_id, printf('%.3f', t) || chr(9) || printf('%.3f', t) || chr(9) || CASE WHEN event_type = 'error' THEN 'x' ELSE 'S' END || CASE WHEN event_type = 'view' THEN '+' ELSE '' END AS line FROM (SELECT event_id, event_type, floor(t * 8) / 8 AS t FROM ev)""")
def onset_label_sink(spark, sf):
    ev = B.events(spark, sf).withColumn("t", F.floor(F.col("t") * 8) / 8)
    return ev.select("event_id", RC.onset_label_line(F.col("t"), F.col("event_type") == "error", F.col("event_type") == "view").alias("line"))


@query("shape_dim_load", """SELECT DISTINCT p_brand AS root, p_type AS suffix, CAST(0 AS INTEGER) AS pos, p_size % 5 AS first_fret, 1 AS base_fret FROM part""")
def shape_dim_load(spark, sf):
    p = read(spark, sf, "part")
    text = F.concat(F.lit('{"chords": {"'), F.col("p_brand"), F.lit('": [{"suffix": "'), F.col("p_type"), F.lit('", "positions": [{"frets": ['), (F.col("p_size") % 5).cast("string"), F.lit(", 0, 2, 3]}]}]}}"))
    rows = AR.shape_rows(p.select(text.alias("json")))
    return rows.select("root", "suffix", "pos", F.element_at("frets", 1).alias("first_fret"), "base_fret").distinct()


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("meter_parse", f"""WITH {S.EV} SELECT event_id, CASE WHEN k % 7 > 0 THEN CAST(k % 7 AS DOUBLE) END AS numerator, CASE WHEN k % 7 > 0 THEN 4.0::DOUBLE END AS denominator FROM ev""")
def meter_parse(spark, sf):
    text = F.when(F.col("k") % 7 == 0, "four/4").otherwise(F.concat((F.col("k") % 7).cast("string"), F.lit("/4")))
    m = RC.meter(text)
    return B.events(spark, sf).select("event_id", m["numerator"].cast("double").alias("numerator"), m["denominator"].cast("double").alias("denominator"))


@query("slot_constraints", f"""WITH {S.EV}, r AS (SELECT event_id, repeat('-', CAST(6 + k % 4 AS INTEGER)) AS cells, k % 11 AS slot FROM ev)
SELECT event_id, length(cells) <> 8 AS bad_width, slot NOT BETWEEN 0 AND 7 AS bad_slot FROM r WHERE length(cells) <> 8 OR slot NOT BETWEEN 0 AND 7""")
def slot_constraints(spark, sf):
    ev = B.events(spark, sf).select("event_id", F.repeat(F.lit("-"), (6 + F.col("k") % 4).cast("int")).alias("cells"), F.array((F.col("k") % 11).cast("int")).alias("slots"))
    return VA.slot_constraints(ev, 8)


@query("cross_artifact_check", f"""WITH {S.BARS}, {S.SECTIONS}, st AS (SELECT track_id, section AS k, start_bar, CASE WHEN track_id % 6 = 1 AND section = 2 THEN end_bar - 1 ELSE end_bar END AS end_bar FROM sections WHERE NOT (track_id % 9 = 4 AND section = 3)), cu AS (SELECT track_id, section AS k, start_bar, end_bar FROM sections),
j AS (SELECT coalesce(st.track_id, cu.track_id) AS track_id, coalesce(st.k, cu.k) AS k FROM st FULL JOIN cu ON st.track_id = cu.track_id AND st.k = cu.k WHERE st.k IS NULL OR cu.k IS NULL OR st.start_bar <> cu.start_bar OR st.end_bar <> cu.end_bar)
SELECT track_id, CAST(min(k) AS INTEGER) AS first_difference, count(*) AS differences FROM j GROUP BY 1""")
def cross_artifact_check(spark, sf):
    now = B.sections(spark, sf).select("track_id", F.col("section").alias("k"), "start_bar", "end_bar")
    old = now.where("not (track_id % 9 = 4 and k = 3)").withColumn("end_bar", F.when((F.col("track_id") % 6 == 1) & (F.col("k") == 2), F.col("end_bar") - 1).otherwise(F.col("end_bar")))
    return VA.plan_differences(old, now)


# --- credits: pages are videos; artist and title come from part names
META = """meta AS (SELECT page_id, a.p_name AS artist, coalesce(b.p_name, 'untitled') AS song,
 CASE page_id % 6 WHEN 0 THEN a.p_name || ' - ' || coalesce(b.p_name, 'untitled') || ' (Official Video)' WHEN 1 THEN upper(coalesce(b.p_name, 'untitled')) || ' [HD]' WHEN 2 THEN '"' || coalesce(b.p_name, 'untitled') || '"'
   WHEN 3 THEN a.p_name || ': ' || coalesce(b.p_name, 'untitled') || ' - live' WHEN 4 THEN 'one two three four five - ' || coalesce(b.p_name, 'untitled') ELSE coalesce(b.p_name, 'untitled') || ' (2019 Remaster)' END AS title,
 CASE page_id % 4 WHEN 0 THEN a.p_name WHEN 1 THEN 'Some Label' WHEN 2 THEN NULL ELSE 'Fan' END AS uploader, CASE WHEN page_id % 3 = 0 THEN '@' || replace(a.p_name, ' ', '') || 'VEVO' ELSE '@other' END AS uploader_id,
 CASE WHEN page_id % 8 = 5 THEN 'X - Topic' ELSE 'channel' END AS channel, CASE WHEN page_id % 5 = 0 THEN coalesce(b.p_name, 'untitled') END AS track, CASE WHEN page_id % 5 = 0 THEN upper(a.p_name) END AS credited
 FROM pages JOIN part a ON a.p_partkey = page_id % 100 LEFT JOIN part b ON b.p_partkey = page_id % 97 + 3)"""
TAGRX = "|".join(T.TAGS)


def meta(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    a = p.select(F.col("p_partkey").alias("a_key"), F.col("p_name").alias("artist"))
    b = p.select(F.col("p_partkey").alias("b_key"), F.col("p_name").alias("b_name"))
    m = read(spark, sf, "pages").select("page_id", (F.col("page_id") % 100).alias("a_key"), (F.col("page_id") % 97 + 3).alias("b_key")).join(a, "a_key").join(b, "b_key", "left")
    m = m.withColumn("song", F.coalesce("b_name", F.lit("untitled")))
    i, song, artist = F.col("page_id"), F.col("song"), F.col("artist")
    title = (F.when(i % 6 == 0, F.concat(artist, F.lit(" - "), song, F.lit(" (Official Video)"))).when(i % 6 == 1, F.concat(F.upper(song), F.lit(" [HD]"))).when(i % 6 == 2, F.concat(F.lit('"'), song, F.lit('"')))
             .when(i % 6 == 3, F.concat(artist, F.lit(": "), song, F.lit(" - live"))).when(i % 6 == 4, F.concat(F.lit("one two three four five - "), song)).otherwise(F.concat(song, F.lit(" (2019 Remaster)"))))
    return m.select(
        "page_id", "artist", "song", title.alias("title"), F.when(i % 4 == 0, artist).when(i % 4 == 1, "Some Label").when(i % 4 == 3, "Fan").alias("uploader"),
        F.when(i % 3 == 0, F.concat(F.lit("@"), F.replace(artist, F.lit(" "), F.lit("")), F.lit("VEVO"))).otherwise("@other").alias("uploader_id"),
        F.when(i % 8 == 5, "X - Topic").otherwise("channel").alias("channel"), F.when(i % 5 == 0, song).alias("track"), F.when(i % 5 == 0, F.array(F.upper(artist))).alias("artists"))


CAP = "CASE WHEN upper({x}) = {x} AND regexp_matches(trim({x}), '\\S\\s+\\S') THEN array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE {x} END"


def tidy_sql(x: str) -> str:
    g = f"regexp_replace(regexp_replace({x}, '\\([^()]*\\b(?:{TAGRX})\\b[^()]*\\)|\\[[^\\[\\]]*\\b(?:{TAGRX})\\b[^\\[\\]]*\\]', '', 'gi'), '\\s{{2,}}', ' ', 'g')"
    q = f"trim(regexp_replace({g}, '^[\\s\"]+|[\\s\"]+$', '', 'g'))"
    return f"(SELECT {CAP.format(x='z')} FROM (SELECT {q} AS z))"


@query("title_clean", f"""WITH {META} SELECT page_id, {tidy_sql('title')} AS tidied, lower(regexp_replace(song, '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM meta""")
def title_clean(spark, sf):
    return T.with_tidy(meta(spark, sf), F.col("title"), "tidied").select("page_id", "tidied", T.title_slug(F.col("song")).alias("slug"))


@query("split_title", f"""WITH {META} SELECT page_id, CASE WHEN page_id % 6 = 0 AND len(string_split(artist, ' ')) <= 4 THEN artist END AS head, CASE WHEN page_id % 6 = 0 AND len(string_split(artist, ' ')) <= 4 THEN song || ' (Official Video)' END AS tail FROM meta""")
def split_title(spark, sf):
    return T.with_split(meta(spark, sf), "title", "head", "tail").select("page_id", "head", "tail")


@query("channel_is_artist", f"""WITH {META} SELECT page_id, page_id % 3 = 0 OR page_id % 8 = 5 AS own FROM meta""")
def channel_is_artist(spark, sf):
    return meta(spark, sf).select("page_id", T.channel_is_artist(F.col("uploader_id"), F.col("channel"), F.col("artist")).alias("own"))


RES = f"""{META}, rs AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'credited' WHEN page_id % 6 = 0 THEN 'title' WHEN uploader = artist AND page_id % 3 = 0 OR uploader IS NOT NULL AND page_id % 8 = 5 THEN 'channel' ELSE 'uploader' END AS src FROM meta),
r2 AS (SELECT *, CASE src WHEN 'credited' THEN (SELECT {CAP.format(x='z')} FROM (SELECT credited AS z)) WHEN 'title' THEN artist ELSE uploader END AS who FROM rs)"""


@query("resolve_credits", f"""WITH {RES} SELECT page_id, src AS artist_source, who AS artist, CASE WHEN src IN ('credited', 'title') AND uploader IS NOT NULL AND lower(uploader) <> lower(who) THEN uploader END AS uploader_note,
 CASE WHEN src IN ('credited', 'title') AND uploader IS NOT NULL AND lower(uploader) <> lower(who) AND NOT (page_id % 3 = 0 OR page_id % 8 = 5) THEN uploader END AS provenance FROM r2""")
def resolve_credits(spark, sf):
    r = T.resolve_credits(meta(spark, sf).drop("artist"))
    return r.select("page_id", "artist_source", F.col("r_artist").alias("artist"), "uploader_note", "provenance")


@query("score_credits", f"""WITH {RES} SELECT page_id, lower(song) = lower(regexp_replace(regexp_replace(title, ' ?\\((Official Video|2019 Remaster)\\)| ?\\[HD\\]|"', '', 'g'), CASE WHEN page_id % 6 = 0 THEN '^' || artist || ' - ' ELSE '^$' END, '')) OR page_id % 5 = 0 AS title_ok,
  coalesce(lower(who) = lower(artist), false) AS artist_ok FROM r2""")
def score_credits(spark, sf):
    m = meta(spark, sf).withColumnsRenamed({"artist": "true_artist", "song": "true_title"})
    r = T.resolve_credits(m)
    for name, source in (("t1", "true_title"), ("t2", "r_title"), ("a1", "true_artist"), ("a2", "r_artist")):
        r = T.with_credit(r, F.col(source), name)
    return r.select("page_id", (F.col("t1") == F.col("t2")).alias("title_ok"), (F.col("r_artist").isNotNull() & (F.col("a1") == F.col("a2"))).alias("artist_ok"))


@query("unique_name", f"""WITH {META}, n AS (SELECT page_id, song, lower(regexp_replace(song, '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM meta)
SELECT page_id, slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY page_id) > 1 THEN '-' || row_number() OVER (PARTITION BY slug ORDER BY page_id) ELSE '' END AS name FROM n""")
def unique_name(spark, sf):
    m = meta(spark, sf).select("page_id", T.title_slug(F.col("song")).alias("slug"))
    return L.unique_names(m, "slug", "page_id", 65536).select("page_id", "name")


@query("video_id", r"""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'v' || lpad(CAST(page_id AS VARCHAR), 10, '0') END AS video_id FROM pages""")
def video_id(spark, sf):
    i = F.concat(F.lit("v"), F.lpad(F.col("page_id").cast("string"), 10, "0"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), i)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), i)).otherwise(F.concat(F.lit("https://notyoutube.com/live/"), i))
    return read(spark, sf, "pages").select("page_id", T.video_id(url).alias("video_id"))


@query("slug_for", r"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(url, '[\\/]+$', ''), '([^\\/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages),
w AS (SELECT *, regexp_replace(regexp_replace(lower(stem), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS words FROM s)
SELECT page_id, CASE WHEN regexp_matches(url, 'youtu\.be/[A-Za-z0-9_-]{11}$') THEN lower(right(url, 11)) WHEN words = '' THEN 'song-' || substr(sha1(stem), 1, 8) ELSE words END AS slug FROM w""")
def slug_for(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.slug_for(F.col("url")).alias("slug"))


@query("find_run", """WITH w AS (SELECT page_id, 'https://youtu.be/v' || lpad(CAST(page_id % 50 AS VARCHAR), 10, '0') AS source FROM pages), r AS (SELECT page_id AS run, CASE WHEN page_id % 2 = 0 THEN 'https://youtu.be/' ELSE 'https://x.com/?v=' END || 'v' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS source, 'v' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS vid FROM pages)
SELECT page_id, CAST(coalesce((SELECT min(run) FROM r WHERE r.source = w.source), (SELECT min(run) FROM r WHERE r.vid = right(w.source, 11))) AS DOUBLE) AS run FROM w""")
def find_run(spark, sf):
    p = read(spark, sf, "pages")
    tag = lambda i: F.concat(F.lit("v"), F.lpad(i.cast("string"), 10, "0"))
    w = p.select("page_id", F.concat(F.lit("https://youtu.be/"), tag(F.col("page_id") % 50)).alias("source"))
    runs = p.select(F.col("page_id").alias("run"), F.concat(F.when(F.col("page_id") % 2 == 0, "https://youtu.be/").otherwise("https://x.com/?v="), tag(F.col("page_id"))).alias("source"), F.lit(None).cast("string").alias("video_id"))
    return L.find_run(w, runs).select("page_id", F.col("run").cast("double").alias("run"))


# --- lineage: customers are runs; each order priority is a stage's output
STAGES = ["ingest", "grid", "harmony", "strums", "score"]
REQ = {"grid": ["ingest"], "harmony": ["ingest", "grid"], "strums": ["grid", "harmony"], "score": ["harmony", "strums"]}
LIN = """o AS (SELECT o_custkey AS run, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS place, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS ok FROM orders GROUP BY 1, 2),
sg AS (SELECT * FROM (VALUES ('ingest', 0), ('grid', 1), ('harmony', 2), ('strums', 3), ('score', 4)) s(stage, place)),
rq AS (SELECT * FROM (VALUES ('grid', 1, 'ingest', 0), ('harmony', 2, 'ingest', 0), ('harmony', 2, 'grid', 1), ('strums', 3, 'grid', 1), ('strums', 3, 'harmony', 2), ('score', 4, 'harmony', 2), ('score', 4, 'strums', 3)) r(stage, place, key, pp)),
cur AS (SELECT run, stage AS key, printf('%.2f', price) AS hash FROM o JOIN sg USING (place)),
runs AS (SELECT DISTINCT run FROM o)"""


def lineage(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("place")).agg(
        F.max_by("o_totalprice", "o_orderkey").alias("price"), F.max("o_orderkey").alias("ok"))
    o = share(o)
    stages = spark.createDataFrame(list(zip(STAGES, range(5))), "stage string, place int")
    req = spark.createDataFrame([(s, STAGES.index(s), k, STAGES.index(k)) for s, ks in REQ.items() for k in ks], "stage string, place int, key string, producer_place int")
    cur = o.join(F.broadcast(stages), "place").select("run", F.col("stage").alias("key"), F.format_string("%.2f", "price").alias("hash"), "ok", "stage")
    return o.select("run").distinct(), stages, req, share(cur)


@query("status_job", f"""WITH {LIN}, rec AS (SELECT c.run, c.key AS stage, r.key, CASE WHEN o.ok % 4 = 0 THEN 'old' ELSE k.hash END AS hash FROM cur c JOIN sg ON sg.stage = c.key JOIN o ON o.run = c.run AND o.place = sg.place LEFT JOIN rq r ON r.stage = c.key LEFT JOIN cur k ON k.run = c.run AND k.key = r.key WHERE r.key IS NULL OR k.hash IS NOT NULL OR o.ok % 3 = 0),
se AS (SELECT run, stage, count(*) FILTER (rec.key IS NOT NULL AND hash IS DISTINCT FROM (SELECT hash FROM cur WHERE cur.run = rec.run AND cur.key = rec.key)) AS ch, count(DISTINCT rec.key) AS nk FROM rec GROUP BY 1, 2), nr AS (SELECT stage, count(*) AS n FROM rq GROUP BY 1)
SELECT r.run, sg.stage, CASE WHEN se.run IS NULL THEN 'missing' WHEN ch > 0 OR nk < coalesce(n, 0) THEN 'stale' ELSE 'done' END AS status FROM runs r CROSS JOIN sg LEFT JOIN se ON se.run = r.run AND se.stage = sg.stage LEFT JOIN nr ON nr.stage = sg.stage""")
def status_job(spark, sf):
    runs, stages, req, cur = lineage(spark, sf)
    inputs = cur.select("run", "stage", "ok").join(F.broadcast(req.select("stage", "key")), "stage", "left").join(cur.select("run", "key", "hash"), ["run", "key"], "left")
    rec = inputs.where("key is null or hash is not null or ok % 3 = 0").select("run", "stage", "key", F.when(F.col("ok") % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return L.status(runs, stages, share(rec), cur.select("run", "key", "hash"), req.select("stage", "key"))


@query("missing_inputs", f"""WITH {LIN} SELECT DISTINCT r.run, q.key, q.pp AS producer FROM runs r CROSS JOIN rq q WHERE q.place >= 2 AND q.pp < 2 AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.run = r.run AND cur.key = q.key)""")
def missing_inputs(spark, sf):
    runs, _, req, cur = lineage(spark, sf)
    m = L.missing_inputs(runs.withColumn("start", F.lit(2)), req.select("place", "key", "producer_place"), cur.select("run", "key"), 4)
    return m.select("run", "key", F.col("producer_place").alias("producer"))


@query("upstream_closure", f"""WITH RECURSIVE {LIN}, ab AS (SELECT r.run, sg.place, sg.stage FROM runs r CROSS JOIN sg WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.run = r.run AND cur.key = sg.stage)),
wk AS (SELECT run, 4 AS start, 0 AS d FROM runs UNION ALL SELECT w.run, (SELECT min(q.pp) FROM rq q JOIN ab ON ab.run = w.run AND ab.place = q.pp WHERE q.place >= w.start AND q.pp < w.start), d + 1 FROM wk w WHERE w.start IS NOT NULL AND d < 6)
SELECT run, min(start) AS start FROM wk GROUP BY 1""")
def upstream_closure(spark, sf):
    runs, _, req, cur = lineage(spark, sf)
    return L.earliest_start(runs.withColumn("start", F.lit(4)), req.select("place", "key", "producer_place"), cur.select("run", "key"), 4)


@query("intersect_songs", """SELECT user_id AS song FROM events INTERSECT SELECT l_suppkey FROM lineitem""")
def intersect_songs(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("song")).intersect(read(spark, sf, "lineitem").select("l_suppkey"))


@query("ingest_merge", """SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN 'easy' WHEN c_custkey % 2 = 0 THEN 'full' ELSE 'auto' END AS tier, CASE WHEN c_custkey % 5 = 0 THEN '3/4' ELSE '4/4' END AS meter FROM customer""")
def ingest_merge(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("run"))
    given = c.select("run", F.when(F.col("run") % 3 == 0, "easy").alias("tier"), F.when(F.col("run") % 5 == 0, "3/4").alias("meter"))
    saved = c.where("run % 2 = 0").select("run", F.lit("full").alias("tier"), F.lit(None).cast("string").alias("meter"))
    return L.overlay(given, saved, "run", ["tier", "meter"], {"tier": F.lit("auto"), "meter": F.lit("4/4")})


@query("backfill_bars", f"""WITH {S.UNITS}, {S.vote('units', 'v')} SELECT u.track_id, u.bar, {S.printed('v.strike', 'v.mute', '8')} AS pattern, CAST(bit_count(u.strike) AS BIGINT) AS strokes FROM units u JOIN v USING (track_id, section)""")
def backfill_bars(spark, sf):
    bars = share(bars_of(spark, sf))
    v = V.section_vote(bars).select(*SEC, R.printed(F.col("vote_strike"), F.col("vote_mute"), F.col("width")).alias("pattern"))
    pats = B.sections(spark, sf).join(v, SEC).withColumn("uncertain", F.lit(False)).withColumn("riff", F.lit(False))
    return L.backfill_bars(pats, bars).select("track_id", "bar", "pattern", F.bit_count("strike").cast("long").alias("strokes"))
