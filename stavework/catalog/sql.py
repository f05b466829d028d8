"""DuckDB building blocks for the oracles: the same binding, written the plain way."""

EV = """ev AS (SELECT user_id AS track_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
ONSETS = EV + """,
onsets AS (SELECT track_id, event_id AS onset_id, t, event_type = 'error' AS muted, value AS centroid, CAST(k AS DOUBLE) AS zcr FROM ev)"""
TRACKS = "tracks AS (SELECT DISTINCT user_id AS track_id FROM events)"


def bars(slots: int = 8) -> str:
    return TRACKS + f""",
bars AS (SELECT track_id, CASE WHEN bar < 7 THEN 0 WHEN bar < 14 THEN 1 WHEN bar < 21 THEN 2 ELSE 3 END AS section, bar,
  bar * 86400e0 AS start, (bar + 1) * 86400e0 AS "end", {slots} AS width
  FROM (SELECT track_id, CAST(unnest(range(30)) AS INTEGER) AS bar FROM tracks))"""


BARS = bars()
SECTIONS = """sections AS (SELECT track_id, s.section, s.label, s.start_bar, s.end_bar FROM tracks,
  (VALUES (0,'verse',0,7),(1,'chorus',7,14),(2,'verse',14,21),(3,'outro',21,30)) s(section,label,start_bar,end_bar))"""

# struck slots per bar: nearest slot of the half-slot-shifted window, a strike before a mute, then the first
OWNERS = """owners AS (
  SELECT * FROM (
    SELECT p.*, row_number() OVER (PARTITION BY track_id, bar, slot ORDER BY muted, t, onset_id) AS rn FROM (
      SELECT b.track_id, b.section, b.bar, b.width, o.muted, o.t, o.onset_id, o.zcr,
        CAST(greatest(0, least(floor((o.t - b.start) / ((b."end" - b.start) / b.width) + 0.5), b.width - 1)) AS INTEGER) AS slot
      FROM onsets o JOIN bars b ON o.track_id = b.track_id
        AND o.t >= b.start - (b."end" - b.start) / b.width / 2 AND o.t < b."end" - (b."end" - b.start) / b.width / 2) p)
  WHERE rn = 1)"""
MASKS = """masks AS (SELECT b.track_id, b.section, b.bar, b.width,
    coalesce(bit_or(CAST(1 AS BIGINT) << o.slot), 0) AS strike,
    coalesce(bit_or(CASE WHEN o.muted THEN CAST(1 AS BIGINT) << o.slot ELSE 0 END), 0) AS mute
  FROM bars b LEFT JOIN owners o ON o.track_id = b.track_id AND o.bar = b.bar
  GROUP BY b.track_id, b.section, b.bar, b.width)"""
QUANT = f"{ONSETS},\n{BARS},\n{OWNERS},\n{MASKS}"
UNITS = QUANT + """,
units AS (SELECT track_id, section, width, strike, mute, bar,
  row_number() OVER (PARTITION BY track_id, section ORDER BY bar) - 1 AS pos FROM masks)"""


def jac(a: str, b: str, am: str | None = None, bm: str | None = None) -> str:
    """Agreement of two masks: `a` and `b` are column prefixes like `x.` (or full mask expressions)."""
    if am is None:
        a, am, b, bm = f"{a}strike", f"{a}mute", f"{b}strike", f"{b}mute"
    return (
        f"(CASE WHEN ({a} | {b}) = 0 THEN 1.0 ELSE (CAST(bit_count({a} & {b}) AS DOUBLE) - 0.5 * "
        f"bit_count(xor({am}, {bm}) & {a} & {b})) / bit_count({a} | {b}) END)"
    )


def cells(strike: str, mute: str, width: str) -> str:
    return (
        f"list_aggregate(list_transform(range(CAST({width} AS BIGINT)), lambda j: CASE WHEN ({mute} >> j) & 1 = 1 THEN 'x' "
        f"WHEN ({strike} >> j) & 1 = 1 THEN 'S' ELSE '-' END), 'string_agg', '')"
    )


def printed(strike: str, mute: str, width: str) -> str:
    return (
        f"list_aggregate(list_transform(range(CAST({width} AS BIGINT)), lambda j: CASE WHEN ({mute} >> j) & 1 = 1 THEN 'x' "
        f"WHEN ({strike} >> j) & 1 = 0 THEN '-' WHEN j % 2 = 0 THEN 'D' ELSE 'U' END), 'string_agg', '')"
    )


def vote(units: str, out: str, by: str = "track_id, section", support: str = "2") -> str:
    """CTEs ending in `out`(by, width, n, strike, mute): the topped vote of each group of `units`."""
    return f"""{out}_s AS (SELECT {by}, width, slot, count(*) AS n, sum((strike >> slot) & 1) AS k, sum((mute >> slot) & 1) AS m
  FROM (SELECT *, CAST(unnest(range(width)) AS INTEGER) AS slot FROM {units}) GROUP BY {by}, width, slot),
{out}_f AS (SELECT {by}, CAST(round_even(0.6 * median(bit_count(strike)), 0) AS BIGINT) AS fl FROM {units} GROUP BY {by}),
{out}_k AS (SELECT *, 3 * k > n AND k >= {support} AS kept FROM {out}_s),
{out}_r AS (SELECT *, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY {by}) AS nk,
  row_number() OVER (PARTITION BY {by}, kept ORDER BY k DESC, slot) AS rk FROM {out}_k),
{out} AS (SELECT {by}, width, any_value(n) AS n,
  bit_or(CASE WHEN kept OR rk <= fl - nk THEN CAST(1 AS BIGINT) << slot ELSE 0 END) AS strike,
  bit_or(CASE WHEN kept AND 2 * m > k THEN CAST(1 AS BIGINT) << slot ELSE 0 END) AS mute
  FROM {out}_r JOIN {out}_f USING ({by}) GROUP BY {by}, width)"""


LABEL = """CASE WHEN event_type = 'signup' THEN 'N' ELSE
  ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][k % 12 + 1] || ':' ||
  CASE event_type WHEN 'view' THEN 'maj' WHEN 'click' THEN 'min' WHEN 'purchase' THEN '7' WHEN 'error' THEN 'dim' END END"""
SPANS = EV + f""",
spans AS (SELECT * FROM (SELECT track_id, event_id AS span_id, t AS start,
  lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS "end", {LABEL} AS label FROM ev) WHERE "end" IS NOT NULL)"""
RBEATS = """rbeats AS (SELECT track_id, i, i * 21600e0 AS start, (i + 1) * 21600e0 AS "end", i // 4 AS bar, i % 4 AS beat
  FROM (SELECT track_id, unnest(range(120)) AS i FROM tracks))"""
FRAMES = """frames AS (SELECT l_suppkey AS track_id, CASE l_returnflag WHEN 'A' THEN 'guitar' WHEN 'R' THEN 'bass' ELSE 'mix' END AS stem,
  CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, l_orderkey * 16 + l_linenumber AS frame,
  l_quantity AS n_samples, l_extendedprice AS sumsq, l_discount AS low_power, l_discount + l_tax AS total_power FROM lineitem)"""
FBARS = """fbars AS (SELECT track_id, bar // 7 AS section, bar, bar * 90e0 AS start, (bar + 1) * 90e0 AS "end", 8 AS width
  FROM (SELECT track_id, CAST(unnest(range(28)) AS INTEGER) AS bar FROM (SELECT DISTINCT l_suppkey AS track_id FROM lineitem)))"""
CHROMA = """chroma AS (SELECT CAST(label AS BIGINT) AS track_id, vec_id,
  list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS chroma FROM embeddings)"""
