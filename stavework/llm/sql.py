"""DuckDB SQL for the queries that SQL can express, each over whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

URLS = r"""WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, v DESC, rh || rp) AS k
 FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1"""

WARC = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to FROM f"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:(i + 4)], ' '))) AS sh FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.reach = e.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id
 LEFT JOIN (SELECT doc_id, min(reach) AS component FROM c GROUP BY doc_id) k ON k.doc_id = w.doc_id"""


def mixing_rows(documents: str = "documents") -> str:
    """The CTEs of the mix over a table with doc_id, text and source, ending in `mix` (doc_id, size, source_size, target, taken)."""
    def search(name: str, strata: str) -> str:
        return f"""{name}_u AS (SELECT s, c, any_value(budget) AS budget, u, sum(size) AS unit FROM d JOIN {strata} b ON d.src = b.s AND d.class = b.c WHERE size > 0 GROUP BY s, c, u),
{name}_r AS (SELECT *, sum(unit) OVER (PARTITION BY s, c ORDER BY u) AS upto, lead(u) OVER (PARTITION BY s, c ORDER BY u) IS NULL AS last FROM {name}_u),
{name} AS (SELECT s, c, any_value(budget) AS budget, min(u) AS prefix, arg_min(upto - unit, u) AS below, arg_min(unit, u) AS unit FROM {name}_r WHERE upto > budget OR last GROUP BY s, c)"""

    return rf"""d AS (SELECT doc_id, coalesce('s' || source, 'z') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS u, length(bin(CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT))) AS class FROM {documents}),
src AS (SELECT src AS s, sum(size) AS st FROM d GROUP BY src),
wt AS (SELECT s, st, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(s)) - 1) % 3 + 1] AS DOUBLE) AS w FROM src),
rk AS (SELECT s, st, w, 3 * st / w AS ratio, row_number() OVER (ORDER BY 3 * st / w, s) AS k FROM wt),
cm AS (SELECT *, coalesce(sum(3 * st) OVER b, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free, sum(st) OVER () AS whole FROM rk WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT CAST(arg_min(whole - capped, k) AS DOUBLE) / arg_min(free, k) AS level FROM cm WHERE CAST(whole - capped AS DOUBLE) / free <= ratio),
goal AS (SELECT s, st, least(3.0::DOUBLE * st, w * level) AS target, CASE WHEN st > 0 THEN CAST(least(floor(least(3.0::DOUBLE * st, w * level) / st), 3) AS BIGINT) ELSE 0 END AS copies FROM wt, lv),
strata AS (SELECT s, class AS c, sum(size) AS total, any_value((target - copies * st)) * CAST(sum(size) AS DOUBLE) / any_value(st) AS budget FROM d JOIN goal ON src = s GROUP BY s, class HAVING sum(size) > 0),
{search('f1', 'strata')},
un AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY unit DESC, c) AS k FROM f1),
g AS (SELECT s, 0::BIGINT AS k, CAST(sum(budget - below) AS DOUBLE) AS rest, -1::BIGINT AS c, false AS kept FROM f1 GROUP BY s
 UNION ALL SELECT un.s, un.k, CASE WHEN un.unit <= g.rest THEN g.rest - un.unit ELSE g.rest END, un.c, un.unit <= g.rest FROM g JOIN un ON un.s = g.s AND un.k = g.k + 1),
k1 AS (SELECT f1.s, f1.c, f1.prefix, g.kept, f1.below + CASE WHEN g.kept THEN f1.unit ELSE 0 END AS got, total FROM f1 JOIN g ON f1.s = g.s AND f1.c = g.c JOIN strata t ON t.s = f1.s AND t.c = f1.c),
rs AS (SELECT s, arg_max(rest, k) AS rest FROM g GROUP BY s),
mv AS (SELECT s, c, got + rest AS budget FROM (SELECT k1.*, rest, row_number() OVER (PARTITION BY k1.s ORDER BY (total - got < rest), CASE WHEN total - got >= rest THEN c ELSE got - total END, c) AS k FROM k1 JOIN rs ON rs.s = k1.s) WHERE k = 1),
{search('f2', 'mv')},
cut AS (SELECT k1.s, k1.c, coalesce(f2.prefix, k1.prefix) AS prefix, CASE WHEN f2.s IS NULL THEN k1.kept ELSE f2.unit <= 2 * (f2.budget - f2.below) END AS kept FROM k1 LEFT JOIN f2 ON f2.s = k1.s AND f2.c = k1.c),
mix AS (SELECT doc_id, size, CAST(st AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * (copies + CASE WHEN u < prefix OR (u = prefix AND kept) THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM d JOIN goal ON goal.s = src LEFT JOIN cut ON cut.s = src AND cut.c = class)"""


MIXING = f"WITH RECURSIVE {mixing_rows()} SELECT * FROM mix"


def merkle_rows(levels: int = 6, tops: int = 4) -> str:
    """The Merkle manifest for at most 16 ** levels rows a source and 16 ** tops sources."""
    digits = "list_reduce([x] || [0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: {digits.replace('[x]', '[xor(c, b)]')}))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        fields = [f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    def tree(name: str, first: str, depth: int) -> list[str]:
        out = [f"{name}0 AS (SELECT s, n, r, h FROM {first})"]
        for k in range(depth):
            out.append(f"{name}s{k} AS (SELECT s, r, coalesce(string_agg(h, '') OVER (PARTITION BY s, r // 16 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER (PARTITION BY s, r // 16 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT s, n, r // 16 AS r, CASE WHEN n > {16**k} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY s, n, r // 16)")
        return out

    def walk(name: str, first: str, siblings: str, depth: int, key: str, place: str, size: str) -> list[str]:
        out, before = [], first
        for k in range(depth):
            out.append(f"{name}{k} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN {size} > {16**k} THEN sha256(lft || f || rgt) ELSE f END AS f, CASE WHEN {size} > {16**k} THEN proof || lft || rgt ELSE proof END AS proof FROM {before} x JOIN {siblings}s{k} y ON x.{key} IS NOT DISTINCT FROM y.s AND x.{place} // {16**k} = y.r)")
            before = f"{name}{k}"
        return out

    parts = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS found FROM documents)",
        "d AS (SELECT *, source AS s, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM l)",
        *tree("t", "d", levels),
        f"u AS (SELECT 0 AS s, t.s AS source, h, row_number() OVER (ORDER BY encode(t.s) NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t{levels} t)",
        *tree("v", "u", tops),
        f"a AS (SELECT d.doc_id, d.leaf, d.source, d.r, d.n, u.s AS all_s, u.r AS sr, u.n AS sn, u.h AS subroot, coalesce(d.found, d.leaf) AS f, '' AS proof FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)",
        *walk("w", "a", "t", levels, "source", "r", "x.n"),
        *walk("z", f"w{levels - 1}", "v", tops, "all_s", "sr", "x.sn"),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, v.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = v.h AS verified FROM z{tops - 1}, v{tops} v"


MERKLE = merkle_rows()

PHRASES = r"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:(i + k - 1)], ' '))) AS phrase FROM p, unnest(range(1, 6)) u(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
 FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[(cut + 1):], ' ') JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT DISTINCT lang, a, unnest(flatten(list_transform(range(2, k), lambda z: list_transform(range(1, k - z + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:(i + z - 1)], ' '))))) AS phrase FROM f WHERE k > 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m
 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.a >= 100 * m.a)) WHERE rank <= 2000"""
