"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from groundspark.functions.text import ARCHITECTURE, CLAIM_PREFIXES, COMPARISON, MULTI_HOP, NEGATED, NEGATIONS, STOP_WORDS
from groundspark.operators.graph import CAPITALISED, RELATIONS, STOP_ENTITIES, TYPES

def build(whole: bool) -> dict[str, str]:
    """SQL of every query: for the names without a suffix, or for the ``whole`` job (original texts of all scripts, 384 numbers, graph channel)."""
    DIM = 384 if whole else 64
    #: White space, digits and word characters of all scripts; what a boundary is in ``marked`` text.
    SPACE, DIGIT = (r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]", r"\p{Nd}") if whole else (r"\s", r"\d")
    WORD_CHARS, MARK = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}", r"[\x02\x03]"
    TOKEN = rf"{MARK}(?:[a-zA-Z0-9_\-\.]{MARK}?)*[a-zA-Z0-9_\-\.]{MARK}" if whole else r"\b[a-zA-Z0-9_\-\.]+\b"
    NUMBER = rf"{MARK}\p{{Nd}}+(?:\x03\.\x02\p{{Nd}}+)?{MARK}" if whole else r"\b\d+(?:\.\d+)?\b"
    NAME = rf"{MARK}[A-Z](?:{MARK}?[a-zA-Z0-9_\-])+(?:{MARK}?{SPACE}+{MARK}?[A-Z](?:{MARK}?[a-zA-Z0-9_\-])+)*{MARK}" if whole else CAPITALISED
    ANY_WORD = f"[{WORD_CHARS}]+" if whole else r"\b\w+\b"


    def _list(words) -> str:
        return ", ".join(f"'{w}'" for w in words)


    def clean(c: str) -> str:
        if whole:
            return f"coalesce({c}, '')"
        return rf"regexp_replace(regexp_replace(coalesce({c}, ''), '[^\x00-\x7F]', ' ', 'g'), '[\r\x0b\f\x1c-\x1f]', ' ', 'g')"


    def rule(p: str) -> str:
        """A pattern of words between word boundaries, for ``marked`` text."""
        if not whole:
            return p
        return p.replace(r"\b", MARK).replace(r"\s+", rf"\x03{SPACE}+\x02").replace(" ", r"\x03 \x02")


    def marked(c: str) -> str:
        """Text with chr(2) before and chr(3) after every run of word characters of any script, which are RE2's missing word boundaries."""
        return rf"regexp_replace({c}, '([{WORD_CHARS}]+)', chr(2) || '\1' || chr(3), 'g')" if whole else c


    def bare(c: str) -> str:
        return f"replace(replace({c}, chr(2), ''), chr(3), '')" if whole else c


    def found(c: str, pattern: str) -> str:
        """All matches of a pattern for marked text."""
        return f"list_transform(regexp_extract_all({marked(c)}, '{pattern}'), lambda z: {bare('z')})" if whole else f"regexp_extract_all({c}, '{pattern}')"


    def tokens(c: str) -> str:
        return found(f"lower({c})", TOKEN)


    def strip(c: str) -> str:
        return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


    def words(c: str) -> str:
        return rf"(CASE WHEN {strip(c)} = '' THEN 0 ELSE len(string_split_regex({strip(c)}, '{SPACE}+')) END)"


    def estimate(c: str) -> str:
        return f"greatest({words(c)}, length({c}) // 4)"


    def lines(c: str) -> str:
        """Text with all line breaks of any kind as line feeds."""
        return rf"regexp_replace({c}, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')" if whole else c


    def sents(c: str, follow: str = "[A-Z0-9]") -> str:
        return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?]){SPACE}+({follow})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


    def plain_sents(c: str) -> str:
        return rf"string_split(regexp_replace({c}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1))"


    def stems(c: str) -> str:
        stem = "CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN w[:-4]" + "".join(f" WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 2} THEN w[:-{len(s) + 1}]" for s in ("ed", "es", "s")) + " ELSE w END"
        spaced = f"regexp_replace({c}, '[-_]', ' ', 'g')"
        return f"list_sort(list_distinct(list_transform(list_filter({tokens(spaced)}, lambda w: length(w) > 2 AND w NOT IN ({_list(NEGATIONS)})), lambda w: {stem})))"


    def nums(c: str) -> str:
        return f"list_sort(list_distinct({found(c, NUMBER)}))"


    def canon(c: str) -> str:
        kept = SPACE[1:-1] if whole else r"\s"
        return rf"regexp_replace(lower({strip(rf"regexp_replace(regexp_replace({c}, '[-_]', ' ', 'g'), '[^a-zA-Z0-9{kept}]', '', 'g')")}), '{SPACE}+', '_', 'g')"


    def bucket(feature: str, salt: str, dim: int) -> str:
        h = f"md5({feature} || ':' || {salt})"
        w = [f"CAST(('0x' || substr({h}, {8 * k + 1}, 8)) AS BIGINT)" for k in range(4)]
        out = f"({w[0]} % {dim})"
        for k in (1, 2, 3):
            out = f"(({out} * {2**32 % dim} + {w[k]}) % {dim})"
        return out


    def sign(feature: str, salt: str) -> str:
        return f"(CASE WHEN substr(md5({feature} || ':' || {salt}), 25, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


    DOCS = f"docs AS (SELECT doc_id, lang, source, {clean('text')} AS text FROM documents)"
    BENCH = f"bench AS (SELECT item_id AS query_id, {clean('text')} AS query FROM benchmark)"


    def embedding(name: str, source: str, dim: int = DIM) -> str:
        """Sparse unit vectors ``name (id, bucket, value)`` of ``source (id, text)``."""
        stop = _list(STOP_WORDS)
        return f"""
    {name}_t AS (SELECT id, {tokens('text')} AS ws FROM {source}),
    {name}_w AS (SELECT id, i - 1 AS i, ws[i] AS w, ws[i + 1] AS w2, ws[i] IN ({stop}) AS stop, ws[i + 1] IN ({stop}) AS stop2
                 FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM {name}_t)),
    {name}_f AS (
      SELECT id, w AS f, '1' AS salt, (CASE WHEN stop THEN 0.2 ELSE 1.0 END)::DOUBLE * (1 + 1::DOUBLE / (i + 1)) AS wt FROM {name}_w
      UNION ALL SELECT id, substr(w, k, 3), '3', 0.35::DOUBLE FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS k FROM {name}_w WHERE NOT stop AND length(w) >= 3)
      UNION ALL SELECT id, substr(w, k, 4), '4', 0.35::DOUBLE FROM (SELECT id, w, unnest(range(1, length(w) - 2)) AS k FROM {name}_w WHERE NOT stop AND length(w) >= 4)
      UNION ALL SELECT id, w || '_' || w2, '7', 0.75::DOUBLE FROM {name}_w WHERE w2 IS NOT NULL AND NOT (stop AND stop2)),
    {name}_g AS (SELECT id, f, salt, sum(wt) AS wt FROM {name}_f GROUP BY ALL),
    {name}_h AS (SELECT f, salt, {bucket('f', 'salt', dim)} AS bucket, {sign('f', 'salt')} AS sg FROM (SELECT DISTINCT f, salt FROM {name}_g)),
    {name}_c AS (SELECT id, bucket, sum(wt * sg) AS v FROM {name}_g JOIN {name}_h USING (f, salt) GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_c GROUP BY id HAVING sqrt(sum(v * v)) > 1e-9),
    {name} AS (
      SELECT id, bucket, v / norm AS value FROM {name}_c JOIN {name}_n USING (id)
      UNION ALL SELECT id, unnest(range({dim})) AS bucket, {dim**-0.5} AS value FROM (SELECT DISTINCT id FROM {source}) WHERE id NOT IN (SELECT id FROM {name}_n))"""


    POSTS = f"posts AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM docs) GROUP BY ALL)"


    def bm25(k: int) -> str:
        return f"""
    lens AS (SELECT doc_id, len({tokens('text')}) AS dl FROM docs),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    {POSTS},
    idf AS (SELECT term, greatest(ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 0.01) AS idf FROM posts, st GROUP BY term, n),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM bench) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, sum(times * (idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))))) AS score
           FROM q JOIN posts USING (term) JOIN idf USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


    def bm25_head(k: int) -> str:
        return f"WITH {DOCS}, {BENCH}, {bm25(k)}"


    _TYPE = "CASE " + " ".join(f"WHEN regexp_matches(canonical_id, '{'|'.join(m)}') THEN '{t}'" for t, m in TYPES) + " ELSE 'CONCEPT' END"
    MENTIONS = f"""
    names AS (SELECT DISTINCT doc_id, unnest({found('text', NAME)}) AS name FROM docs),
    cands AS (SELECT doc_id, name, {canon('name')} AS canonical_id FROM names WHERE length(name) >= 3 AND lower(name) NOT IN ({_list(STOP_ENTITIES)})),
    ment AS (SELECT doc_id, canonical_id, min(name) AS name, {_TYPE} AS entity_type FROM cands
             WHERE length(canonical_id) >= 2 AND canonical_id NOT IN ({_list(STOP_ENTITIES)}) GROUP BY doc_id, canonical_id)"""

    PARTS = f"""
            se AS (SELECT doc_id, i - 1 AS sentence, lower(ps[i]) AS s FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {plain_sents('text')} AS ps FROM docs))),
            hit AS ({' UNION ALL '.join(f"SELECT doc_id, sentence, s, '{r}' AS relation, length({bare(f"string_split_regex({marked('s')}, '{rule(p)}')[1]")}) + 1 AS pos FROM se WHERE regexp_matches({marked('s')}, '{rule(p)}')" for p, r in RELATIONS)}),
            pl AS (SELECT h.*, canonical_id, CASE WHEN instr(s, lower(name)) > 0 THEN instr(s, lower(name)) ELSE instr(s, replace(canonical_id, '_', ' ')) END AS p FROM hit h JOIN ment USING (doc_id)),
            be AS (SELECT doc_id, sentence, relation, canonical_id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence, relation ORDER BY p DESC, canonical_id) AS rn FROM pl WHERE p > 0 AND p < pos) WHERE rn = 1),
            af AS (SELECT doc_id, sentence, relation, canonical_id AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence, relation ORDER BY p, canonical_id) AS rn FROM pl WHERE p > pos) WHERE rn = 1)"""

    SEEDS = rf"""
    en AS (SELECT canonical_id, lower(arg_min(name, doc_id)) AS name FROM ment GROUP BY 1),
    asks AS (SELECT query_id, ts, array_to_string(ts, ' ') AS t FROM (SELECT query_id, list_filter(string_split_regex(lower(query), '{SPACE}+'), lambda x: x <> '') AS ts FROM bench)),
    seeds AS (SELECT query_id, canonical_id FROM asks, en WHERE contains(t, name) OR list_contains(ts, canonical_id) OR list_has_any(ts, list_filter(string_split_regex(name, '{SPACE}+'), lambda w: length(w) > 3)))"""

    TRIPLES = """
    tri AS (
      SELECT *, source_id || '-' || target_id AS triple_id FROM (
        SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id, 'LOCATED_IN' AS relation, c_mktsegment AS chunk_id FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', 'supplier' FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', 'nation' FROM nation)),
    ends AS (SELECT source_id AS node FROM tri UNION SELECT target_id FROM tri)"""

    SYMMETRIC = "sym AS (SELECT source_id AS a, target_id AS b FROM tri UNION SELECT target_id, source_id FROM tri)"
    SUBGRAPH = f"""{TRIPLES}, {SYMMETRIC},
    d0 AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'n' || n_nationkey AS node, 0 AS depth FROM nation),
    d1 AS (SELECT DISTINCT query_id, b AS node, 1 AS depth FROM d0 JOIN sym ON node = a WHERE (query_id, b) NOT IN (SELECT (query_id, node) FROM d0)),
    d2 AS (SELECT DISTINCT query_id, b AS node, 2 AS depth FROM d1 JOIN sym ON node = a
           WHERE (query_id, b) NOT IN (SELECT (query_id, node) FROM d0) AND (query_id, b) NOT IN (SELECT (query_id, node) FROM d1)),
    alln AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2),
    nod AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, node) AS rn FROM alln) WHERE depth = 0 OR rn <= 30),
    edg AS (SELECT a.query_id, tri.* FROM tri JOIN nod a ON a.node = source_id JOIN nod b ON b.node = target_id AND a.query_id = b.query_id)"""


    STEPS = f"""{TRIPLES.replace('tri AS', 'WITH RECURSIVE tri AS', 1)}, {SYMMETRIC},
    walk AS (SELECT 'n' || n_nationkey AS source, 'n' || n_nationkey AS node, ['n' || n_nationkey] AS path FROM nation
             UNION ALL SELECT source, b, list_append(path, b) FROM walk JOIN sym ON node = a WHERE NOT list_contains(path, b)),
    best AS (SELECT source, node AS target, path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS rn FROM walk)
             WHERE rn = 1 AND source < node AND node IN (SELECT 'n' || n_nationkey FROM nation)),
    st AS (SELECT source, target, i - 1 AS hop, path[i] AS from_id, path[i + 1] AS to_id FROM (SELECT *, unnest(range(1, len(path))) AS i FROM best)),
    nm AS (SELECT source_id, target_id, arg_min(relation, triple_id) AS r FROM tri GROUP BY ALL),
    steps AS (SELECT source, target, hop, from_id, to_id, coalesce(x.r, y.r, 'CONNECTS') AS relation FROM st
        LEFT JOIN nm x ON x.source_id = from_id AND x.target_id = to_id LEFT JOIN nm y ON y.source_id = to_id AND y.target_id = from_id)"""
    NAMED = """
    named AS (SELECT 'c' || c_custkey AS canonical_id, c_name AS name, 'CUSTOMER' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'SUPPLIER' FROM supplier
              UNION ALL SELECT 'n' || n_nationkey, n_name, 'NATION' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'REGION' FROM region)"""

    def _pagerank(rounds: int, then: str | None = None, halt: bool = whole) -> str:
        parts = [f"WITH {TRIPLES}", "n AS (SELECT count(*) AS n FROM ends)", "od AS (SELECT source_id, count(*)::DOUBLE AS total FROM tri GROUP BY 1)",
                 "lk AS (SELECT source_id, target_id, count(*)::DOUBLE / total AS share FROM tri JOIN od USING (source_id) GROUP BY source_id, target_id, total)", "p0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM ends, n)"]
        for i in range(1, rounds + 1):
            parts.append(
                f"p{i} AS MATERIALIZED (SELECT e.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS score FROM ends e LEFT JOIN (SELECT target_id, sum(score * share) AS got FROM p{i - 1} JOIN lk ON node = source_id GROUP BY 1) g ON e.node = g.target_id, n, "
                f"(SELECT coalesce(sum(score), 0) AS lost FROM p{i - 1} WHERE node NOT IN (SELECT source_id FROM od)) l)"
            )
        if not halt:
            return ", ".join(parts) + (then or f" SELECT node, round(score, 9) AS score FROM p{rounds}")
        # Every fifth round may be the last.
        ends = range(5, rounds + 1, 5)
        moved = " UNION ALL ".join(f"SELECT {i} AS i, (SELECT sum(abs(a.score - b.score)) FROM p{i} a JOIN p{i - 1} b USING (node)) AS d" for i in ends)
        parts.append(f"halt AS (SELECT coalesce(min(i) FILTER (WHERE d < n * 1e-6), {rounds}) AS i FROM ({moved}) x, n)")
        return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT node, round(score, 9) AS score FROM p{i} WHERE (SELECT i FROM halt) = {i}" for i in ends)


    CONV = f"turns AS (SELECT conv_id, turn, role, {clean('text')} AS text FROM conversations)"
    ANSWERS = "ans AS (SELECT conv_id || '-' || turn AS query_id, conv_id, turn, text AS answer FROM turns WHERE role = 'assistant')"
    CONTEXTS = """
    usr AS (SELECT conv_id, text AS content, conv_id || '#' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM turns WHERE role = 'user'),
    ctx AS (SELECT query_id, rank, chunk_id, content FROM ans JOIN usr USING (conv_id))"""


    def _claims() -> str:
        bullet = rf"^{SPACE}*[-*•{DIGIT}+\.]{SPACE}*" if whole else r"^\s*[-*\d+\.]\s*"
        dots = "•" if whole else ""
        cleaned = rf"regexp_replace({strip(rf"regexp_replace({strip('x')}, '{bullet}', '')")}, '[*_`]', '', 'g')"
        for p in CLAIM_PREFIXES:
            cleaned = strip(f"regexp_replace({cleaned}, '(?i){p.replace(chr(92) + 's', SPACE)}', '')")
        parts = rf"string_split(regexp_replace(c, '([.!?]){SPACE}+([A-Z0-9\-\*{dots}])', '\1' || chr(1) || '\2', 'g'), chr(1))"
        final = rf"regexp_replace({strip(rf"regexp_replace(s, '{bullet}', '')")}, '[.,;:]+$', '')"
        return rf"""
    ln AS (SELECT query_id, i, ls[i] AS x FROM (SELECT query_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM
           (SELECT query_id, string_split({lines(rf"regexp_replace(answer, '{SPACE}+[-*{dots}]{SPACE}+', chr(10), 'g')")}, chr(10)) AS ls FROM ans)) WHERE {strip('ls[i]')} <> ''),
    cl AS (SELECT query_id, i, {cleaned} AS c FROM ln),
    sp AS (SELECT query_id, i, j, ps[j] AS s FROM (SELECT query_id, i, ps, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT query_id, i, {parts} AS ps FROM cl))),
    fin AS (SELECT query_id, i, j, {final} AS claim FROM sp),
    claims AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i, j) - 1 AS BIGINT) AS claim_ord, claim
               FROM fin WHERE claim <> '' AND NOT ends_with(claim, '?') AND {words('claim')} >= 4)"""


    ALIGN = f"""WITH {CONV}, {ANSWERS}, {CONTEXTS}, {_claims()},
    txt AS (SELECT DISTINCT claim AS id, claim AS text FROM claims UNION SELECT DISTINCT substr(content, 1, 512), substr(content, 1, 512) FROM ctx),
    {embedding('e', 'txt')},
    pairs AS (SELECT DISTINCT claim, substr(content, 1, 512) AS head FROM claims JOIN ctx USING (query_id)),
    cs AS (SELECT claim, head, coalesce(sum(a.value * b.value), 0) AS cosine FROM pairs LEFT JOIN e a ON a.id = claim LEFT JOIN e b ON b.id = head AND b.bucket = a.bucket GROUP BY ALL),
    cst AS (SELECT claim, {stems('claim')} AS cst, {nums('claim')} AS cn FROM (SELECT DISTINCT claim FROM claims)),
    xst AS (SELECT content, {stems('content')} AS xst, {nums('content')} AS xn FROM (SELECT DISTINCT content FROM ctx)),
    al0 AS (SELECT query_id, claim_ord, claim, rank, chunk_id, cosine, cst, cn, xn, CAST(len(list_intersect(cst, xst)) AS BIGINT) AS shared
            FROM claims JOIN ctx USING (query_id) JOIN cst USING (claim) JOIN xst USING (content) JOIN cs ON cs.claim = claims.claim AND cs.head = substr(content, 1, 512)),
    al AS (SELECT *, CASE WHEN len(cst) > 0 THEN shared::DOUBLE / len(cst) ELSE 0 END AS recall,
           shared >= 3 AND ((len(cn) > 0 AND len(xn) > 0 AND NOT list_has_any(cn, xn)) OR regexp_matches({marked('lower(claim)')}, '{rule(NEGATED)}')) AS contradicts FROM al0),
    alg AS (SELECT *, 0.6::DOUBLE * cosine + 0.4::DOUBLE * recall AS score FROM al),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_ord ORDER BY round(score, 10) DESC, rank) AS rn FROM alg WHERE round(score, 10) > 0) WHERE rn = 1),
    per AS (SELECT query_id, claim_ord, bool_or(contradicts) AS against, arg_min(chunk_id, rank) FILTER (WHERE contradicts) AS against_id, count(*) AS n FROM alg GROUP BY ALL),
    ver AS (SELECT c.query_id, c.claim_ord, c.claim,
            CASE WHEN against THEN 'CONTRADICTION' WHEN coalesce(b.score, 0) >= 0.65 THEN 'ENTAILED' ELSE 'NEUTRAL' END AS status,
            CASE WHEN n IS NULL THEN 0.1 WHEN against THEN 0.88 WHEN coalesce(b.score, 0) >= 0.65 THEN round(least(b.score, 0.99), 3) ELSE round(coalesce(b.score, 0), 3) END::DOUBLE AS confidence,
            CASE WHEN against THEN against_id WHEN coalesce(b.score, 0) > 0.4 THEN b.chunk_id END AS cited_chunk_id
            FROM claims c LEFT JOIN per USING (query_id, claim_ord) LEFT JOIN best b USING (query_id, claim_ord)),
    fth AS (SELECT a.query_id, round(coalesce(avg(CASE WHEN status IS NULL THEN NULL WHEN status = 'ENTAILED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1.0), 3) AS faithfulness, count(status) AS n_claims
            FROM ans a LEFT JOIN ver v ON a.query_id = v.query_id GROUP BY a.query_id),
    cit AS (SELECT query_id, cited_chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(claim_ord)) AS number FROM ver WHERE cited_chunk_id IS NOT NULL GROUP BY query_id, cited_chunk_id)"""

    ASKED = "asked AS (SELECT a.query_id, a.turn, a.answer, u.text AS query FROM ans a JOIN turns u ON u.role = 'user' AND u.conv_id = a.conv_id AND u.turn + 1 = a.turn)"
    REL = f"""
    rt AS (SELECT query_id || 'q' AS id, query AS text FROM asked UNION ALL SELECT query_id || 'a', substr(answer, 1, 512) FROM asked),
    {embedding('r', 'rt')},
    rel AS (SELECT query_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round((coalesce(sum(x.value * y.value), 0) + 1) / 2, 3))) AS relevance
            FROM asked LEFT JOIN r x ON x.id = query_id || 'q' LEFT JOIN r y ON y.id = query_id || 'a' AND y.bucket = x.bucket GROUP BY query_id)"""
    RECALL = f"""
    tru AS (SELECT query_id, turn, answer, list_distinct(list_transform({found('query', NAME)}, lambda x: {canon('x')})) AS truth FROM asked),
    rec AS (SELECT query_id, turn, CASE WHEN len(truth) > 0 THEN len(list_filter(truth, lambda t: contains(lower(answer), replace(t, '_', ' '))))::DOUBLE / len(truth) ELSE 0 END AS entity_recall FROM tru)"""

    FUSE = f"""{bm25_head(8)},
    qw AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS term FROM bench),
    ov AS (SELECT query_id, doc_id, count(*) AS n FROM qw JOIN posts USING (term) GROUP BY ALL),
    ovr AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM ov) WHERE rank <= 8),
    rk AS (SELECT query_id, doc_id, rank, 'bm25' AS m FROM bm UNION ALL SELECT query_id, doc_id, rank, 'dense' FROM ovr),
    fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE m = 'dense') AS dense_rank, max(rank) FILTER (WHERE m = 'bm25') AS bm25_rank FROM rk GROUP BY ALL)"""


    def rerank(source: str, k: int, channels: tuple[str, ...] = ("dense", "bm25")) -> str:
        ranks = " + ".join(f"({m}_rank IS NOT NULL)::INT" for m in channels)
        short = lambda c: f"list_distinct(list_filter({tokens(c)}, lambda t: length(t) > 2))"
        return f"""
    rr AS (SELECT query_id, doc_id, rrf_score, {short('query')} AS q, {short('text')} AS c, lower(coalesce(lang, '')) AS crumbs, {ranks} AS ch
           FROM {source} JOIN docs USING (doc_id) JOIN bench USING (query_id)),
    rs AS (SELECT query_id, doc_id, CASE WHEN len(q) > 0 THEN 10 * rrf_score + 0.4::DOUBLE * len(list_intersect(q, c)) / greatest(len(q), 1) + 0.15::DOUBLE * least(len(list_filter(q, lambda t: contains(crumbs, t))), 3) + 0.25::DOUBLE * greatest(ch - 1, 0) ELSE rrf_score END AS score FROM rr),
    rx AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS BIGINT) AS rank, round(score, 6) AS score FROM rs)
    SELECT * FROM rx WHERE rank <= {k}"""


    # The three channels over documents as chunks: title source, breadcrumb lang.
    CHANNELS = f"""WITH {DOCS.replace('docs AS', 'docs0 AS')}, docs AS (SELECT doc_id, lang, source, coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || text AS text FROM docs0), {BENCH}, {bm25(8)},
    ds AS (SELECT doc_id AS id, coalesce(source, '') || ': ' || text AS text FROM docs0), {embedding('dv', 'ds')}, qs AS (SELECT query_id AS id, query AS text FROM bench), {embedding('qv', 'qs')},
    dp AS (SELECT q.id AS query_id, v.id AS doc_id, sum(q.value * v.value) AS s FROM qv q JOIN dv v USING (bucket) GROUP BY ALL),
    de AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM dp) WHERE rank <= 8),
    {MENTIONS.replace('FROM docs', 'FROM docs0')}, {PARTS.replace('FROM docs', 'FROM docs0')},
    gt AS (SELECT doc_id, source_id, target_id FROM be JOIN af USING (doc_id, sentence, relation) WHERE source_id <> target_id),
    {SEEDS},
    gy AS (SELECT source_id AS a, target_id AS b FROM gt UNION SELECT target_id, source_id FROM gt),
    g0 AS (SELECT DISTINCT query_id, canonical_id AS node, 0 AS depth FROM seeds),
    g1 AS (SELECT query_id, node, 1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS rn FROM (
             SELECT DISTINCT query_id, b AS node FROM g0 JOIN gy ON node = a ANTI JOIN g0 z ON z.query_id = g0.query_id AND z.node = b)) WHERE rn <= 25),
    g2 AS (SELECT query_id, node, 2 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS rn FROM (
             SELECT DISTINCT query_id, b AS node FROM g1 JOIN gy ON node = a ANTI JOIN g0 z ON z.query_id = g1.query_id AND z.node = b ANTI JOIN g1 y ON y.query_id = g1.query_id AND y.node = b)) WHERE rn <= 25),
    gn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, node) AS rn FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)) WHERE depth = 0 OR rn <= 25),
    gs AS (SELECT query_id, doc_id, sum(s) AS score FROM (
             SELECT query_id, doc_id, CASE WHEN depth = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS s FROM gn JOIN ment ON canonical_id = node
             UNION ALL SELECT x.query_id, doc_id, 1.5::DOUBLE FROM gt JOIN gn x ON x.node = source_id JOIN gn y ON y.node = target_id AND y.query_id = x.query_id) GROUP BY ALL),
    gr AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gs) WHERE rank <= 8),
    rk AS (SELECT query_id, doc_id, rank, 'bm25' AS m FROM bm UNION ALL SELECT query_id, doc_id, rank, 'dense' FROM de UNION ALL SELECT query_id, doc_id, rank, 'graph' FROM gr),
    fu AS (SELECT query_id, doc_id, sum(CASE WHEN m = 'graph' THEN 1.25 ELSE 1.0 END::DOUBLE / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE m = 'dense') AS dense_rank, max(rank) FILTER (WHERE m = 'bm25') AS bm25_rank,
           max(rank) FILTER (WHERE m = 'graph') AS graph_rank FROM rk GROUP BY ALL)"""
    _UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


    def _topk(where: str) -> str:
        return f"""
    WITH v AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.u) + 1), lambda i: q.u[i] * v.u[i])) AS s FROM v q, v WHERE q.vec_id % 50 = 0 {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 8"""


    _FITS = rf"(NOT (a.stopped AND a.context = x.context) AND length(x.s) >= 25 AND NOT list_contains(a.kept, x.s) AND (list_has_any(ws, regexp_extract_all(lower(x.s), '{ANY_WORD}')) OR len(a.kept) < 3))"
    SALIENT = rf"""{bm25_head(5)},
    cx AS (SELECT query_id, list(text ORDER BY rank) AS cs FROM bm JOIN docs USING (doc_id) GROUP BY query_id),
    fl AS (SELECT query_id, cs, flatten(list_transform(range(1, least(len(cs), 3) + 1), lambda i: list_transform({plain_sents('cs[i]')}, lambda s: {{'kept': []::VARCHAR[], 'context': i, 'stopped': false, 's': {strip('s')}}}))) AS xs FROM cx),
    qw AS (SELECT query_id, query, list_filter(list_distinct(regexp_extract_all(lower(query), '{ANY_WORD}')), lambda w: length(w) > 2) AS ws FROM bench),
    fo AS (SELECT query_id, query, cs, list_reduce(xs, lambda a, x: {{
             'kept': CASE WHEN {_FITS} THEN list_append(a.kept, x.s) ELSE a.kept END, 'context': x.context,
             'stopped': (a.stopped AND a.context = x.context) OR ({_FITS} AND len(a.kept) >= 4), 's': ''}}, {{'kept': []::VARCHAR[], 'context': 0::BIGINT, 'stopped': false, 's': ''}}).kept AS kept
           FROM qw LEFT JOIN fl USING (query_id))
    SELECT query_id, CASE WHEN cs IS NULL THEN 'No verified information regarding ' || chr(39) || query || chr(39) || ' was found in the indexed corpus. Please ingest relevant documents to query this topic.'
           WHEN len(kept) = 0 THEN {strip('substr(cs[1], 1, 400)')} || '...' ELSE array_to_string(kept, ' ') END AS answer FROM fo"""


    CHUNKS = rf"""
    WITH RECURSIVE {DOCS},
    hd AS (SELECT doc_id, text, ls, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches({strip('x')}, '^#{{1,6}}{SPACE}') THEN i END), lambda i: i IS NOT NULL) AS hs
           FROM (SELECT doc_id, text, string_split({lines('text')}, chr(10)) AS ls FROM docs WHERE {strip('text')} <> '')),
    sx AS (SELECT doc_id, sec, coalesce(array_to_string(ls[coalesce(hs[sec], 0) + 1:coalesce(hs[sec + 1], len(ls) + 1) - 1], chr(10)), '') AS body FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS sec FROM hd)),
    sy AS (SELECT doc_id, sec, {strip('body')} AS body FROM sx WHERE {strip('body')} <> ''),
    sz AS (SELECT * FROM sy UNION ALL SELECT doc_id, 0, {strip('text')} FROM hd WHERE doc_id NOT IN (SELECT doc_id FROM sy)),
    s AS (SELECT doc_id, sec, {sents('body')} AS ss FROM sz),
    n AS (SELECT doc_id, sec, ss, list_transform(ss, lambda x: CAST({estimate('x')} AS BIGINT)) AS n FROM s WHERE len(ss) > 0),
    p AS (SELECT doc_id, sec, ss, n, list_transform(range(1, len(n) + 2), lambda k: coalesce(list_sum(n[1:k - 1]), 0)::BIGINT) AS p FROM n),
    f AS (
      SELECT doc_id, sec, 1::BIGINT AS j, 1::BIGINT AS first, n[1]::BIGINT AS size, NULL::BIGINT AS ef, NULL::BIGINT AS el, NULL::BIGINT AS et FROM p
      UNION ALL
      SELECT doc_id, sec, j + 1, nf, CASE WHEN fl THEN p[j + 1] - p[nf] ELSE size END + n[j + 1], CASE WHEN fl THEN first END, CASE WHEN fl THEN j END, CASE WHEN fl THEN size END
      FROM (SELECT f.doc_id, f.sec, j, first, size, n, p, size + n[j + 1] > 384 AND size >= 40 AS fl,
                   CASE WHEN size + n[j + 1] > 384 AND size >= 40 THEN list_filter(range(first, j + 2), lambda k: p.p[j + 1] - p.p[k] <= 64)[1] ELSE first END AS nf
            FROM f JOIN p USING (doc_id, sec) WHERE j < len(n)) x),
    e AS (
      SELECT doc_id, sec, ef AS a, el AS b, et AS t FROM f WHERE ef IS NOT NULL
      UNION ALL SELECT f.doc_id, f.sec, first, j, size FROM f JOIN p USING (doc_id, sec) WHERE j = len(n) AND {words("array_to_string(ss[first:j], ' ')")} >= 4)
    SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.sec, a, b) - 1 AS BIGINT) AS chunk_index, CAST(t AS BIGINT) AS token_count, sha256(array_to_string(ss[a:b], ' ')) AS content_sha256
    FROM e JOIN p USING (doc_id, sec)"""

    _KINDS = "WITH k AS (SELECT p_partkey, lower(p_brand) AS a, ['bft', 'grpc', 'postgres', 'attack', 'leaders', 'plain'][p_partkey % 6 + 1] || ' ' || lower(p_type) AS b FROM part)"
    TITLE = "('Conversation ' || string_split(b.chunk_id, '#')[1])"
    _BODY = "replace(text, '#', ' ')"
    _FILE = "coalesce(source, 'x') || '_' || doc_id || '.md'"

    out: dict[str, str] = {
        "token_estimate": f"WITH {DOCS} SELECT doc_id, CAST({estimate('text')} AS BIGINT) AS n_tokens FROM docs",
        "sentence_split": f"WITH {DOCS} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, sha256(coalesce(array_to_string(s, chr(1)), '')) AS sentences_sha256 FROM (SELECT doc_id, {sents('text')} AS s FROM docs)",
        "semantic_chunks": CHUNKS,
        "markdown_sections": f"""WITH {DOCS}, b AS (SELECT doc_id, coalesce(lang, 'x') AS l, coalesce(source, 'x') AS s, {strip(lines(_BODY))} AS t FROM docs)
            SELECT doc_id, 0::BIGINT AS section_index, l AS crumbs, sha256(t) AS text_sha256 FROM b WHERE t <> '' UNION ALL SELECT doc_id, 1::BIGINT, l || ' > ' || s, sha256(t) FROM b WHERE t <> ''""",
        "doc_registry": f"""SELECT {_FILE} AS filename, upper(substr(coalesce(source, 'x'), 1, 1)) || substr(coalesce(source, 'x'), 2) || ' ' || doc_id AS title, 'text/markdown' AS mime_type,
            CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS file_size_bytes, sha256(coalesce(text, '')) AS checksum_sha256 FROM documents""",
        "ingest_dedupe": f"SELECT sha256(coalesce(text, '')) AS checksum_sha256, min({_FILE}) AS filename FROM documents GROUP BY 1",
        "stem_tokens": f"WITH {DOCS} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_stems, sha256(coalesce(array_to_string(s, ' '), '')) AS stems_sha256 FROM (SELECT doc_id, {stems('text')} AS s FROM docs)",
        "extract_numbers": f"WITH {DOCS} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_numbers, coalesce(array_to_string(s, ' '), '') AS numbers FROM (SELECT doc_id, {nums('text')} AS s FROM docs)",
        "canonicalize": f"SELECT p_partkey, {canon("concat_ws('-', p_name, p_brand, p_type)")} AS canonical_id FROM part",
        "hash_bucket_sign": f"WITH {BENCH}, t AS (SELECT DISTINCT unnest({tokens('query')}) AS token FROM bench) SELECT token, CAST({bucket('token', "'1'", 384)} AS BIGINT) AS bucket, {sign('token', "'1'")} AS sign FROM t",
        "hash_embedding": f"WITH {BENCH}, src AS (SELECT query_id AS id, query AS text FROM bench), {embedding('e', 'src')} SELECT id AS item_id, CAST(bucket AS BIGINT) AS bucket, round(value, 6) AS value FROM e WHERE round(value, 6) <> 0",
        "vector_upsert": f"WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, {_UNIT} AS u FROM embeddings) SELECT vec_id, CASE WHEN label = 1 THEN label + 100 ELSE label END AS label, round(u[1], 6) AS first FROM v",
        "vector_delete": "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label IS DISTINCT FROM 1",
        "dense_topk": _topk(""),
        "dense_topk_filtered": _topk("AND v.label = 1"),
        "bm25_postings": f"WITH {DOCS}, {POSTS} SELECT term, doc_id, tf FROM posts",
        "bm25_corpus_stats": f"WITH {DOCS} SELECT count(*) AS n, round(avg(len({tokens('text')})), 6) AS avgdl FROM docs",
        "bm25_topk": f"{bm25_head(8)} SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm",
        "bm25_index_topk": f"{bm25_head(8)} SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm",
        "entity_candidates": f"WITH {DOCS}, {MENTIONS} SELECT doc_id, canonical_id, name, entity_type FROM ment",
        "entity_type": f"WITH {DOCS}, {MENTIONS} SELECT entity_type, count(*) AS n FROM ment GROUP BY 1",
        "entity_merge": f"WITH {DOCS}, {MENTIONS} SELECT canonical_id, arg_min(name, doc_id) AS name, arg_min(entity_type, doc_id) AS entity_type, count(DISTINCT doc_id) AS n_chunks FROM ment GROUP BY 1",
        "relation_triples": f"""WITH {DOCS}, {MENTIONS}, {PARTS}
            SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, relation, source_id, target_id FROM be JOIN af USING (doc_id, sentence, relation) WHERE source_id <> target_id""",
        "entity_kinds": f"""{_KINDS} SELECT p_partkey, {canon('a')} AS canonical_id, 'CONCEPT' AS entity_type FROM k
            UNION ALL SELECT p_partkey, {canon('b')}, ['ALGORITHM', 'PROTOCOL', 'SYSTEM', 'VULNERABILITY', 'ROLE', 'CONCEPT'][p_partkey % 6 + 1] FROM k""",
        "relation_kinds": f"""{_KINDS} SELECT p_partkey, ['PREVENTS', 'IMPLEMENTS', 'REQUIRES', 'ELECTS', 'REPLICATES_TO', 'ENFORCES', 'CONTAINS', 'LEADS_TO', 'IS_A', 'COMMUNICATES_WITH'][p_partkey % 10 + 1] AS relation,
            {canon('a')} AS source_id, {canon('b')} AS target_id FROM k""",
        "seed_match": f"WITH {DOCS}, {BENCH}, {MENTIONS}, {SEEDS} SELECT query_id, canonical_id FROM seeds",
        "k_hop_subgraph": f"""WITH {SUBGRAPH}, dg AS (SELECT query_id, node, count(*) AS degree FROM (SELECT query_id, source_id AS node FROM edg UNION ALL SELECT query_id, target_id FROM edg) GROUP BY ALL)
            SELECT query_id, node, CAST(depth AS BIGINT) AS depth, depth = 0 AS is_seed, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM nod LEFT JOIN dg USING (query_id, node)""",
        "graph_chunk_score": f"""WITH {SUBGRAPH}, ec AS (SELECT DISTINCT source_id AS node, chunk_id FROM tri),
            t AS (SELECT query_id, chunk_id, CASE WHEN depth = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS s FROM nod JOIN ec USING (node) UNION ALL SELECT query_id, chunk_id, 1.5::DOUBLE FROM edg),
            g AS (SELECT query_id, chunk_id, sum(s) AS score FROM t GROUP BY ALL)
            SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g) WHERE rank <= 8""",
        "graph_fact_sentence": f"""WITH {SUBGRAPH}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY triple_id) AS rn FROM edg)
            SELECT query_id, 'According to the knowledge graph, ' || string_agg(upper(substr(source_id, 1, 1)) || substr(source_id, 2) || ' ' || lower(replace(relation, '_', ' ')) || ' ' || upper(substr(target_id, 1, 1)) || substr(target_id, 2), ', while ' ORDER BY rn) || '.' AS fact
            FROM f WHERE rn <= 5 GROUP BY query_id""",
        "shortest_path": f"{STEPS} SELECT source, target, CAST(hop AS BIGINT) AS hop, from_id, to_id, relation FROM steps",
        "path_names": f"""{STEPS}, {NAMED} SELECT source, target, CAST(hop AS BIGINT) AS hop, a.name AS from_name, b.name AS to_name, relation
            FROM steps JOIN named a ON a.canonical_id = from_id JOIN named b ON b.canonical_id = to_id""",
        "subgraph_described": f"""WITH {SUBGRAPH}, {NAMED}, ec AS (SELECT source_id AS node, count(DISTINCT chunk_id) AS n_chunks FROM tri GROUP BY 1),
            dg AS (SELECT query_id, node, count(*) AS degree FROM (SELECT query_id, source_id AS node FROM edg UNION ALL SELECT query_id, target_id FROM edg) GROUP BY ALL)
            SELECT query_id, node, name, type, CAST(coalesce(degree, 0) AS BIGINT) AS degree, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks
            FROM nod JOIN named ON canonical_id = node LEFT JOIN dg USING (query_id, node) LEFT JOIN ec USING (node)""",
        "central_entities": _pagerank(10, f""", {NAMED} SELECT row_number() OVER (ORDER BY round(score, 12) DESC, node) AS place, canonical_id, name, type, round(score, 4) AS score
            FROM p10 JOIN named ON canonical_id = node ORDER BY place LIMIT 10""", False),
        "pagerank": _pagerank(100 if whole else 10),
        "degree_centrality": f"WITH {TRIPLES}, d AS (SELECT node, count(*) AS d FROM (SELECT source_id AS node FROM tri UNION ALL SELECT target_id FROM tri) GROUP BY 1) SELECT node, round(d::DOUBLE / (SELECT count(*) - 1 FROM ends), 9) AS centrality FROM ends JOIN d USING (node)",
        "graph_stats": f"""{TRIPLES.replace('tri AS', 'WITH RECURSIVE tri AS', 1)}, {SYMMETRIC}, c AS (SELECT count(*) AS n FROM ends), m AS (SELECT count(*) AS m FROM tri),
            reach AS (SELECT node AS root, node FROM ends UNION SELECT root, b FROM reach JOIN sym ON node = a),
            least AS (SELECT root, min(node) AS first FROM reach GROUP BY root)
            SELECT n AS n_nodes, m AS n_edges, round(m::DOUBLE / (n * (n - 1)), 4) AS density, (SELECT count(*) FROM least WHERE root = first) AS n_components FROM c, m""",
        "graph_delete_document": f"WITH {TRIPLES}, k AS (SELECT * FROM tri WHERE chunk_id <> 'supplier') SELECT source_id AS canonical_id FROM k UNION SELECT target_id FROM k",
        "rrf_fuse": f"{FUSE} SELECT query_id, doc_id, round(rrf_score, 9) AS rrf_score, CAST(coalesce(dense_rank, 0) AS BIGINT) AS dense_rank, CAST(coalesce(bm25_rank, 0) AS BIGINT) AS bm25_rank FROM fu",
        "rerank": f"{FUSE}, {rerank('fu', 5)}",
        "hybrid_search": f"""WITH {DOCS.replace('docs AS', 'docs0 AS')}, docs AS (SELECT doc_id, lang, source, coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || text AS text FROM docs0), {BENCH}, {bm25(8)},
            ds AS (SELECT doc_id AS id, coalesce(source, '') || ': ' || text AS text FROM docs0), {embedding('dv', 'ds')}, qs AS (SELECT query_id AS id, query AS text FROM bench), {embedding('qv', 'qs')},
            dp AS (SELECT q.id AS query_id, v.id AS doc_id, sum(q.value * v.value) AS s FROM qv q JOIN dv v USING (bucket) GROUP BY ALL),
            de AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM dp) WHERE rank <= 8),
            rk AS (SELECT query_id, doc_id, rank, 'bm25' AS m FROM bm UNION ALL SELECT query_id, doc_id, rank, 'dense' FROM de),
            fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE m = 'dense') AS dense_rank, max(rank) FILTER (WHERE m = 'bm25') AS bm25_rank FROM rk GROUP BY ALL),
            {rerank('fu', 5).replace('JOIN docs USING', 'JOIN docs0 USING')}""",
        "route_strategy": f"WITH {CONV} SELECT conv_id, turn, CASE WHEN regexp_matches({marked('text')}, '(?i){rule(COMPARISON)}') THEN 'comparison' WHEN regexp_matches({marked('text')}, '(?i){rule(MULTI_HOP)}') THEN 'multi_hop' WHEN regexp_matches({marked('text')}, '(?i){rule(ARCHITECTURE)}') THEN 'architecture' ELSE 'factual' END AS strategy FROM turns",
        "route_subqueries": f"""WITH {CONV}, q AS (SELECT conv_id, turn, {strip("'Compare ' || role || ' versus ' || text")} AS q FROM turns),
            g AS (SELECT conv_id, turn, list_transform(string_split_regex({marked('q')}, '(?i){rule(COMPARISON)}'), lambda z: {bare('z')}) AS g, {found('q', '(?i)' + rule(COMPARISON))} AS m FROM q),
            p AS (SELECT conv_id, turn, list_filter(list_transform(flatten(list_transform(range(1, len(g) + 1), lambda i: [g[i], coalesce(m[i], '')])), lambda x: {strip('x')}), lambda x: length(x) > 3) AS p FROM g)
            SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_parts, sha256(array_to_string(p, chr(1))) AS parts_sha256 FROM p""",
        "context_prompt": f"""{bm25_head(5)},
            ex AS (SELECT query_id, string_agg(chr(10) || '[Source #' || rank || ': ' || coalesce(source, '') || ' | Section: ' || coalesce(lang, '') || ']:' || chr(10) || {strip('text')}, chr(10) ORDER BY rank) AS ex FROM bm JOIN docs USING (doc_id) GROUP BY 1),
            pr AS (SELECT query_id, 'User Query: ' || query || chr(10) || chr(10) || '=== VERIFIED SOURCE CONTEXT ===' || coalesce(chr(10) || chr(10) || '[Document Excerpts]:' || chr(10) || ex, '')
                   || chr(10) || chr(10) || chr(10) || '=== INSTRUCTIONS ===' || chr(10) || 'Synthesize a clear, direct, and factual answer based ONLY on the evidence above. Organize your thoughts into distinct declarative statements so they can be verified.' AS prompt
                   FROM bench LEFT JOIN ex USING (query_id))
            SELECT query_id, sha256(prompt) AS prompt_sha256, CAST(length(prompt) AS BIGINT) AS n_chars FROM pr""",
        "salient_sentences": SALIENT,
        "claim_split": f"WITH {CONV}, {ANSWERS}, {_claims()} SELECT query_id, claim_ord, claim FROM claims",
        "contradiction": f"{ALIGN} SELECT query_id, claim_ord, chunk_id, shared, contradicts FROM alg",
        "claim_alignment": f"{ALIGN} SELECT query_id, claim_ord, chunk_id, round(recall, 6) AS recall, round(cosine, 6) + 0.0::DOUBLE AS cosine, round(score, 6) + 0.0::DOUBLE AS score FROM alg",
        "best_evidence": f"{ALIGN} SELECT query_id, claim_ord, chunk_id, round(score, 6) AS score FROM best",
        "claim_status": f"{ALIGN} SELECT query_id, claim_ord, status, confidence + 0.0::DOUBLE AS confidence, cited_chunk_id FROM ver",
        "claim_reasoning": f"""{ALIGN}, ag AS (SELECT query_id, claim_ord, arg_min(cn, rank) AS cn, arg_min(xn, rank) AS xn FROM alg WHERE contradicts GROUP BY ALL)
            SELECT v.query_id, v.claim_ord,
                   CASE WHEN p.n IS NULL THEN 'No context passages available for verification.'
                        WHEN status = 'CONTRADICTION' AND len(ag.cn) > 0 AND len(ag.xn) > 0 AND NOT list_has_any(ag.cn, ag.xn)
                          THEN 'Numerical discrepancy: Claim cites {{' || array_to_string(ag.cn, ', ') || '}} vs Context {{' || array_to_string(ag.xn, ', ') || '}}'
                        WHEN status = 'CONTRADICTION' THEN 'Polarity conflict: claim negates a fact affirmed in the context'
                        WHEN status = 'ENTAILED' THEN 'Aligned with ' || chr(39) || {TITLE} || chr(39) || ' (Chunk ' || substr(b.chunk_id, 1, 8) || ') [Cosine: ' || printf('%.2f', round_even(b.cosine, 2)) || ', Token Recall: ' || printf('%.2f', round_even(b.recall, 2)) || ']'
                        ELSE 'Claim contains facts not fully corroborated by retrieved context.' END AS reasoning,
                   CASE status WHEN 'CONTRADICTION' THEN '❌ CONTRADICTION' WHEN 'ENTAILED' THEN '✅ Verified [' || {TITLE} || ']' ELSE '⚠️ UNVERIFIED' END AS citation_badge
            FROM ver v LEFT JOIN per p USING (query_id, claim_ord) LEFT JOIN best b USING (query_id, claim_ord) LEFT JOIN ag USING (query_id, claim_ord)""",
        "faithfulness": f"{ALIGN} SELECT query_id, faithfulness, n_claims FROM fth",
        "citation_numbering": f"{ALIGN} SELECT query_id, cited_chunk_id, CAST(number AS BIGINT) AS number FROM cit",
        "attributed_answer": f"""{ALIGN}, sh AS (SELECT query_id, string_agg(claim || coalesce(' [' || number || ']', '') || CASE status WHEN 'ENTAILED' THEN ' ✓' WHEN 'CONTRADICTION' THEN ' ⚠️ [Contradiction Detected]' ELSE '' END, ' ' ORDER BY claim_ord) AS response
            FROM ver LEFT JOIN cit USING (query_id, cited_chunk_id) GROUP BY query_id)
            SELECT query_id, sha256(coalesce(response, '')) AS response_sha256, CAST(length(coalesce(response, '')) AS BIGINT) AS n_chars FROM ans LEFT JOIN sh USING (query_id)""",
        "answer_relevance": f"WITH {CONV}, {ANSWERS}, {ASKED}, {REL} SELECT query_id, relevance FROM rel",
        "entity_recall": f"WITH {CONV}, {ANSWERS}, {ASKED}, {RECALL} SELECT query_id, round(entity_recall, 6) AS entity_recall FROM rec",
        "benchmark_summary": f"""{ALIGN}, {ASKED}, {REL}, {RECALL}
            SELECT 'turn ' || turn AS arm, round(avg(faithfulness), 3) AS faithfulness, round(avg(relevance), 3) AS relevance, round(avg(round(entity_recall, 6)), 3) AS entity_recall
            FROM rec JOIN fth USING (query_id) JOIN rel USING (query_id) GROUP BY turn""",
    }
    if whole:
        all_ = ("dense", "bm25", "graph")
        shown = ", ".join(f"CAST(coalesce({m}_rank, 0) AS BIGINT) AS {m}_rank" for m in all_)
        best = f"{CHANNELS}, {rerank('fu', 5, all_).replace('JOIN docs USING', 'JOIN docs0 USING')}"
        out |= {"rrf_fuse": f"{CHANNELS} SELECT query_id, doc_id, round(rrf_score, 9) AS rrf_score, {shown} FROM fu", "rerank": best, "hybrid_search": best}
    return out


ORACLES = build(False)
#: The whole jobs' SQL by the plain names.
WHOLE = build(True)
