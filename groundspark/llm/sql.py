"""DuckDB SQL for those of the registered queries that SQL can express."""

from __future__ import annotations

from groundspark.llm.queries import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_OP6 = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP7 = rf"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES {_RULES}),
m AS (
  SELECT p.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(v, length(rhost || rpath)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda a: w[a:a + 12])) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS a, w FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT DISTINCT doc_id, a, n, item_id FROM (SELECT doc_id, n, a, w[a:a + n - 1] AS win FROM dw) x JOIN iw USING (win)),
hw AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS pos FROM hits) y GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(sid, ',' ORDER BY sid) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS sid FROM hits) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def _matches(name: str, kind: int, regex: str, part: str, least: int) -> str:
    """Matches of a regex with their places: lengths of gaps and hits before each, added up."""
    rx = regex.replace("'", "''")
    return rf"""
{name}_m AS (
  SELECT doc_id, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS hits, regexp_extract_all(t, '{rx}', {part}) AS parts
  FROM d WHERE regexp_matches(t, '{rx}')),
{name} AS (
  SELECT doc_id, {kind} AS kind, p AS start, p + length(hit) AS stop FROM (
    SELECT doc_id, hits[i] AS hit, parts[i] AS part,
           CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS p
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m) u) v
  WHERE length(part) >= {least})"""


_OP10 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + _matches("ma", 0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "2", 8)
    + ","
    + _matches("mk", 1, "AKIA[A-Z0-9]+", "0", 16)
    + ","
    + _matches("mh", 2, "[0-9a-f]{32,}", "0", 32)
    + """,
a AS (SELECT * FROM ma UNION ALL SELECT * FROM mk UNION ALL SELECT * FROM mh),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS s
  FROM a GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
)

_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
f AS (
  SELECT t.doc_id, part,
         [len(w) < 100,
          100 * len(list_distinct(w)) < 80 * len(w),
          100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
          regexp_matches(x, '[#$%&*|]'),
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] AS bad,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order
  FROM letters a, letters b, letters d, letters e, letters g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, instr('ABCDE', filter_order[step]) AS own,
         list_transform(range(1, step), lambda k: instr('ABCDE', filter_order[k])) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
patterns AS (
  SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY part, bad),
e AS (
  SELECT part, filter_order, step, own, n, g, x, bad[own] AS fails, list_bool_or(list_transform(before, lambda k: bad[k])) IS TRUE AS earlier,
         len(list_filter(bad, lambda b: b)) AS k
  FROM patterns, steps),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT earlier THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT earlier THEN x ELSE 0 END) AS toxic_lost
  FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

#: CRC-32, which DuckDB lacks: its table by the rule of its polynomial, and the sum over a text's bytes.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k - 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


#: Not registered, as its last column holds nothing but nulls; the tests compare it.
OP5 = rf"""
WITH {_CRC_TABLE},
t AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' ') AS octets
  FROM documents),
c AS (
  SELECT doc_id, source, size,
         CAST(xor(list_reduce(list_transform(octets[:-2], lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM t, crc),
m AS (SELECT *, md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size) AS mix FROM c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS nth, count(*) OVER (PARTITION BY source) AS of_source FROM m),
f AS (
  SELECT *, (nth + CAST('0x' || substr(md5('interleave-1|' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296::DOUBLE) / of_source AS fraction FROM r),
p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard,
       CAST(place - ((place * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

_OP12 = rf"""
WITH {_CRC_TABLE},
w AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, {_WORDS} FROM benchmark),
f AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
known AS (
  SELECT f, {_crc32('f')} % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM f) x, crc),
o AS (SELECT kind, r, bucket FROM f JOIN known USING (f)),
c AS (
  SELECT bucket, CAST(count(*) FILTER (WHERE kind = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE kind = 'b') AS DOUBLE) AS t FROM o GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM c),
weights AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM o JOIN g USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (r) WHERE kind = 'd'),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

_OP13 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS sh
  FROM t),
x AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b USING (h)
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id <= coalesce(m, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) q ON s.doc_id = q.u
"""

ORACLES = {
    "op6_line_dedup": _OP6,
    "op7_url_filter": _OP7,
    "op8_decontamination": _OP8,
    "op10_secret_scan": _OP10,
    "op11_filter_audit": _OP11,
    "op12_importance": _OP12,
    "op13_minhash": _OP13,
}
