"""Statements of the search queries."""

from __future__ import annotations

from quillon.plans.oracle import BASE
from quillon.plans.oracle_text import CJK, trim

FIELD = r"list_filter(regexp_split_to_array(CASE WHEN regexp_matches({0}, '[À-ɏḀ-ỿ]') THEN {1} ELSE {0} END, '[^\pL\pN\x{{E000}}-\x{{F8FF}}]+'), lambda t: t <> '')"


def fold(x: str) -> str:
    low = f"regexp_replace(lower({x}), '[̀-ͯ]', '', 'g')"
    bare = f"array_to_string(list_transform(string_split({low}, ''), lambda c: CASE WHEN regexp_matches(c, '[À-ɏḀ-ỿ]') THEN strip_accents(c) ELSE c END), '')"
    return f"list_filter(regexp_split_to_array(CASE WHEN regexp_matches({low}, '[À-ɏḀ-ỿ]') THEN {bare} ELSE {low} END, '[^\\pL\\pN\\x{{E000}}-\\x{{F8FF}}]+'), lambda t: t <> '')"


def posts(chunks: str) -> str:
    return f"""
, fld AS MATERIALIZED (SELECT chunk_id, 0 AS field, {fold("coalesce(text, '')")} AS l FROM {chunks} UNION ALL SELECT chunk_id, 1, {fold("chunk_id")} FROM {chunks}),
post AS MATERIALIZED (SELECT chunk_id, field, unnest(l) AS term, unnest(range(len(l))) AS pos FROM fld),
size AS (SELECT chunk_id, sum(len(l)) AS length FROM fld GROUP BY chunk_id),
stat AS (SELECT count(*) AS n, avg(length) AS mean FROM size)
"""


def bm25(chunks: str) -> str:
    return posts(chunks) + f"""
, ask AS (SELECT entity_no AS query, name FROM ent WHERE entity_no % 50 = 0),
wrd AS (SELECT query, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT query, list_filter(regexp_split_to_array(regexp_replace(name, '["*()\\-]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS l FROM ask)),
phr AS (SELECT query, p, {fold("w")} AS l FROM wrd),
wanted AS (SELECT query, l, count(*) AS times FROM phr WHERE len(l) > 0 GROUP BY ALL),
part AS (SELECT l, unnest(l) AS term, unnest(range(len(l))) AS k FROM (SELECT DISTINCT l FROM wanted)),
hit AS (SELECT l, chunk_id, field, pos - k AS start FROM post JOIN part USING (term) GROUP BY ALL HAVING count(*) = len(l)),
freq AS (SELECT l, chunk_id, count(*) AS f FROM hit GROUP BY ALL),
dfs AS (SELECT l, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM freq, stat GROUP BY l, n),
sco AS (SELECT query, f.chunk_id, sum(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) * times) AS score
  FROM freq f JOIN dfs USING (l) JOIN size s ON s.chunk_id = f.chunk_id JOIN wanted USING (l), stat GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), chunk_id) AS rank FROM sco) WHERE rank <= 15)
"""


VEC = """
, vec AS (SELECT chunk_id, chunk_no, chunk_type, entity_id, embedding::DOUBLE[] AS v FROM chunk WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
NODES = BASE + VEC + """
, enn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM (
    SELECT a.chunk_no AS query, b.chunk_no AS id, b.entity_id, list_distance(a.v, b.v) AS distance FROM vec a JOIN vec b ON a.chunk_no <> b.chunk_no
    WHERE a.chunk_type = 'entity' AND b.chunk_type = 'entity' AND a.chunk_no % 50 = 0)) WHERE rank <= 10)
"""
SHOWN = """
, cn AS (SELECT DISTINCT chunk_id, name FROM (SELECT chunk_id, unnest(entities) AS name FROM search_results WHERE chunk_id IS NOT NULL) WHERE name <> '')
"""
HITS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_no ORDER BY received_at) AS r FROM search_results) WHERE r = 1)"

def embedding(key: str, rows: str) -> str:
    return f"""
, t AS ({rows}),
w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS w FROM t),
d AS (SELECT {key}, CAST(('0x' || substr(md5(w), 1, 4))::BIGINT % 64 AS INTEGER) AS dim, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
SELECT {key}, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY {key})), 8) AS value FROM d"""


SAID = f"""SELECT id AS entity_id, {trim("entity_type || ': ' || name || '. ' || coalesce(array_to_string(list_filter(observations, lambda o: o IS NOT NULL AND NOT regexp_matches(o, '^(Source:|Created:|Type:|Tags:|Content length:)')), '. '), '')")} AS text FROM ent"""

PAIRED = r"""
, pairs AS (SELECT name AS term, min(native) AS other FROM (SELECT name, trim(regexp_extract(o, '한국어명:\s*(.+)', 1)) AS native FROM (SELECT name, unnest(observations) AS o FROM ent)) WHERE native <> '' GROUP BY name)
"""


def hashed(name: str, rows: str) -> str:
    """CTE ``name`` (k..., v): hashed word counts of (k, text), scaled to length 1; keys without words are missing."""
    return f"""
, {name}_w AS (SELECT k, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS w FROM ({rows})),
{name}_d AS MATERIALIZED (SELECT k, CAST(('0x' || substr(md5(w), 1, 4))::BIGINT % 64 AS INTEGER) AS dim, count(*)::DOUBLE AS n FROM {name}_w GROUP BY ALL),
{name} AS MATERIALIZED (SELECT k, dim, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM {name}_d)
"""


def summed(rows: str, names: str, near: str, join: str) -> str:
    """CTE ``told`` (query, chunk_id, summary, highlight, score) of candidates, by their best sentences."""
    return f"""
, cand AS MATERIALIZED ({rows}), cname AS MATERIALIZED ({names}),
sen AS MATERIALIZED (SELECT query, chunk_id, chunk_type, CAST(n AS INTEGER) AS n, regexp_replace(s, '^[-•]\\s*', '') AS s FROM (SELECT query, chunk_id, chunk_type, unnest(l) AS s, unnest(range(len(l))) AS n FROM (
    SELECT query, chunk_id, chunk_type, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {trim("s")}), lambda s: length(s) > 10) AS l FROM cand))),
held AS (SELECT sen.query, sen.chunk_id, sen.n, count(*) AS h FROM sen JOIN cname c ON c.query = sen.query AND c.chunk_id = sen.chunk_id AND contains(lower(s), lower(c.name)) GROUP BY ALL),
sc AS MATERIALIZED (SELECT sen.*, round({near} + 0.1 * coalesce(h, 0) + CASE WHEN regexp_matches(sen.s, '(^|[^0-9A-Za-z_])[0-9]+') THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN regexp_matches(lower(sen.s), 'important|key|main|primary|essential|critical|significant') THEN 0.03 ELSE 0 END::DOUBLE, 9) AS score FROM sen LEFT JOIN held USING (query, chunk_id, n) {join}),
best AS (SELECT query, chunk_id, first(chunk_type) AS kind, first(s ORDER BY score DESC, n) AS s1, first(n ORDER BY score DESC, n) AS n1, max(score) AS score FROM sc GROUP BY ALL),
second AS (SELECT sc.query, sc.chunk_id, first(sc.s ORDER BY sc.score DESC, sc.n) AS s2, first(sc.n ORDER BY sc.score DESC, sc.n) AS n2 FROM sc JOIN best b ON b.query = sc.query AND b.chunk_id = sc.chunk_id AND abs(sc.n - b.n1) > 1 AND kind <> 'relationship' GROUP BY ALL),
told AS (SELECT c.query, c.chunk_id, CASE WHEN b.s1 IS NULL THEN substr(text, 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END WHEN s2 IS NULL THEN s1 WHEN n1 < n2 THEN s1 || ' [...] ' || s2 ELSE s2 || ' [...] ' || s1 END AS summary,
    coalesce(s1, substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END) AS highlight, coalesce(score, 0.1::DOUBLE) AS score
  FROM cand c LEFT JOIN best b ON b.query = c.query AND b.chunk_id = c.chunk_id LEFT JOIN second s ON s.query = c.query AND s.chunk_id = c.chunk_id)
"""


ASKED = "'Represent this sentence for searching relevant passages: ' || text"
TERMS = r"list_filter(regexp_extract_all({0}, '\b[A-Z][a-z]+(?:[ \t\n\x{{0b}}\f\r]+[A-Z][a-z]+)*\b'), lambda t: length(t) >= 3) || regexp_extract_all({0}, '\b[A-Z]{{2,}}\b') || regexp_extract_all({0}, '[가-힣]{{2,}}')"
HYBRID = (
    BASE + PAIRED + ", tchunk AS (SELECT * FROM chunk WHERE text IS NOT NULL)" + """
, q0 AS (SELECT entity_no AS query, 0 AS variant, name AS text FROM ent WHERE entity_no % 50 = 0),
asks AS MATERIALIZED (SELECT * FROM q0 UNION ALL SELECT query, 1, replaced FROM (SELECT query, q0.text, replace(q0.text, p.term, p.other) AS replaced, row_number() OVER (PARTITION BY query ORDER BY length(p.term) DESC, p.term) AS r
    FROM q0 JOIN pairs p ON contains(q0.text, p.term) AND list_contains(regexp_split_to_array(q0.text, '\\s+'), regexp_split_to_array(p.term, '\\s+')[1])) WHERE r = 1 AND replaced <> text)
""" + bm25("tchunk").replace("ask AS (SELECT entity_no AS query, name FROM ent WHERE entity_no % 50 = 0)", "ask AS (SELECT query * 64 + variant AS query, text AS name FROM asks)")
    + hashed("qv", f"SELECT query * 64 + variant AS k, {ASKED} AS text FROM asks") + hashed("cv", "SELECT chunk_id AS k, text FROM tchunk") + hashed("ev", SAID.replace("id AS entity_id", "id AS k"))
    + """
, cdot AS (SELECT q.k AS ask, c.k AS chunk_id, sum(q.x * c.x) AS dot FROM qv q JOIN cv c ON c.dim = q.dim GROUP BY ALL),
cdist AS (SELECT a.query, a.query * 64 + a.variant AS ask, c.chunk_id, CASE WHEN (SELECT count(*) FROM cv WHERE cv.k = c.chunk_id) = 0 THEN 1.0 ELSE sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))) END AS distance
  FROM asks a CROSS JOIN tchunk c LEFT JOIN cdot d ON d.ask = a.query * 64 + a.variant AND d.chunk_id = c.chunk_id),
near AS (SELECT query, chunk_id, min(distance) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY round(distance, 9), chunk_id) AS r FROM cdist) WHERE r <= 15 GROUP BY ALL),
fts AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY variant, rank, chunk_id) AS rank FROM (
    SELECT query // 64 AS query, chunk_id, query % 64 AS variant, rank, row_number() OVER (PARTITION BY query // 64, chunk_id ORDER BY query % 64, rank) AS r FROM lex) WHERE r = 1),
pool AS MATERIALIZED (SELECT query, chunk_id, coalesce(near.distance, 2.0) AS distance, fts.rank FROM near FULL JOIN fts USING (query, chunk_id)),
edot AS (SELECT q.k AS ask, e.k AS id, sum(q.x * e.x) AS dot FROM qv q JOIN ev e ON e.dim = q.dim GROUP BY ALL),
edist AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY round(distance, 9), id) AS r FROM (
    SELECT a.query, a.query * 64 + a.variant AS ask, e.id, sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))) AS distance FROM asks a CROSS JOIN ent e LEFT JOIN edot d ON d.ask = a.query * 64 + a.variant AND d.id = e.id)),
meant AS MATERIALIZED (SELECT query, id FROM edist WHERE r <= 10 GROUP BY ALL HAVING greatest(0, 1 - round(min(distance), 9) / 2) > 0.4),
matched AS MATERIALIZED (SELECT DISTINCT query, name FROM meant JOIN ent USING (id)),
connected AS MATERIALIZED (SELECT DISTINCT m.query, e.name FROM meant m JOIN twoway t ON t.a = m.id JOIN ent e ON e.id = t.b),
pc AS MATERIALIZED (SELECT c.* FROM chunk c WHERE chunk_id IN (SELECT chunk_id FROM pool)),
"""
    + f"""nm AS (SELECT id AS entity_id, name AS own, lower(name) AS name, regexp_matches(lower(name), '{CJK}') AS cjk FROM ent),
al AS (SELECT DISTINCT id AS entity_id, lower(a) AS alias FROM (SELECT id, unnest(regexp_extract_all(o, '[0-9A-Za-z_\\-]+\\.[0-9A-Za-z_]{{1,4}}\\b')) AS a FROM (SELECT id, unnest(observations) AS o FROM ent) WHERE o IS NOT NULL) WHERE length(a) >= 4),
lk AS MATERIALIZED (SELECT chunk_id, n.own AS name FROM pc JOIN nm n ON contains(lower(text), n.name) WHERE chunk_type = 'document' AND length(n.name) >= CASE WHEN n.cjk THEN 2 ELSE 4 END
      AND (n.cjk OR regexp_matches(lower(text), '\\b' || regexp_escape(n.name) || '\\b'))
    UNION SELECT chunk_id, n.own FROM pc JOIN al ON contains(lower(text), alias) JOIN nm n ON n.entity_id = al.entity_id AND length(n.name) >= CASE WHEN n.cjk THEN 2 ELSE 4 END WHERE chunk_type = 'document'
    UNION SELECT chunk_id, e.name FROM pc JOIN ent e ON e.id = pc.entity_id WHERE chunk_type = 'entity'),
"""
    + f"""es AS (SELECT p.query, p.chunk_id, CASE WHEN EXISTS (SELECT 1 FROM matched m WHERE m.query = p.query AND m.name = lk.name) THEN 0.3
      WHEN list_contains(list_transform({TERMS.format("a.text")}, lambda t: lower(t)), lower(lk.name)) THEN 0.3
      WHEN contains(lower(a.text), lower(lk.name)) OR contains(lower(lk.name), lower(a.text)) THEN 0.2
      WHEN len(list_filter(regexp_split_to_array(lower(lk.name), '\\s+'), lambda w: length(w) >= 3 AND contains(lower(a.text), w))) > 0 THEN 0.15 ELSE 0 END::DOUBLE
      + CASE WHEN EXISTS (SELECT 1 FROM connected c WHERE c.query = p.query AND c.name = lk.name) THEN 0.15 ELSE 0 END::DOUBLE AS s
    FROM pool p JOIN lk ON lk.chunk_id = p.chunk_id JOIN q0 a ON a.query = p.query),
eb AS (SELECT query, chunk_id, least(0.4, sum(s * pow(0.5, r - 1))) AS boost FROM (SELECT *, row_number() OVER (PARTITION BY query, chunk_id ORDER BY s DESC) AS r FROM es WHERE s > 0) GROUP BY ALL)
"""
    + summed(
        "SELECT p.query, p.chunk_id, chunk_type, text FROM pool p JOIN pc ON pc.chunk_id = p.chunk_id", "SELECT DISTINCT p.query, p.chunk_id, lk.name FROM pool p JOIN lk ON lk.chunk_id = p.chunk_id", "coalesce(dot, 0)",
        "LEFT JOIN (SELECT q.k // 64 AS query, v.k AS s, sum(q.x * v.x) AS dot FROM qv q JOIN sv v ON v.dim = q.dim WHERE q.k % 64 = 0 GROUP BY ALL) d ON d.query = sen.query AND d.s = sen.s",
    ).replace("held AS (SELECT sen.query", hashed("sv", "SELECT DISTINCT s AS k, s AS text FROM sen").strip().removeprefix(",") + ", held AS (SELECT sen.query", 1)
    + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT p.query, p.chunk_id, greatest(0, 1 - distance / 2) AS similarity, CASE WHEN chunk_type = 'entity' THEN 0.15 ELSE 0 END::DOUBLE + coalesce(boost, 0) AS boost,
      greatest(greatest(0, 1 - distance / 2), t.score) + CASE WHEN chunk_type = 'entity' THEN 0.15 ELSE 0 END::DOUBLE + coalesce(boost, 0) + coalesce(1.0::DOUBLE / (60 + p.rank), 0) AS score,
      CASE WHEN chunk_type = 'document' THEN coalesce(nullif(json_extract_string(d.metadata, '$.title'), ''), nullif(json_extract_string(d.metadata, '$.name'), ''), nullif(pc.document_id, ''), 'Unknown Document') ELSE 'Knowledge Graph Entity' END AS title
    FROM pool p JOIN pc ON pc.chunk_id = p.chunk_id JOIN told t ON t.query = p.query AND t.chunk_id = p.chunk_id LEFT JOIN eb ON eb.query = p.query AND eb.chunk_id = p.chunk_id LEFT JOIN doc d ON d.id = pc.document_id))
"""
)

SQL = {
    "knn_top5": """SELECT query, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM (
          SELECT a.vec_id AS query, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""",
    "search_nodes": NODES + "SELECT query, entity_id, CAST(rank AS INTEGER) AS rank, round(greatest(0, 1 - distance / 2), 6) AS similarity FROM enn",
    "matched_and_connected": NODES + """, near AS (SELECT DISTINCT query, entity_id FROM enn WHERE greatest(0, 1 - round(distance, 9) / 2) > 0.4)
        SELECT DISTINCT query, name, 'matched' AS how FROM near JOIN ent ON ent.id = entity_id
        UNION ALL SELECT DISTINCT query, e.name, 'connected' FROM near n JOIN ent s ON s.id = n.entity_id JOIN twoway t ON t.a = n.entity_id JOIN ent e ON e.id = t.b""",
    "temporal_filter": NODES + "SELECT query, entity_id, created_at FROM enn JOIN ent ON ent.id = entity_id WHERE created_at >= '2024-06-01' AND created_at <= '2024-12-31'",
    "list_documents": BASE + "SELECT id, created_at, metadata FROM doc ORDER BY created_at DESC NULLS LAST, id",
    "best_per_chunk": """SELECT session_id, chunk_id, distance, result_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY distance, result_no) AS r
        FROM search_results WHERE session_id IS NOT NULL AND chunk_id IS NOT NULL AND distance IS NOT NULL) WHERE r = 1""",
    "similarity_threshold": f"SELECT result_no, round(greatest(0, 1 - distance / 2), 6) AS similarity FROM {HITS} WHERE greatest(0, 1 - distance / 2) > 0.4",
    "session_top5": f"""SELECT session_id, CAST(rank AS INTEGER) AS rank, result_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hybrid_score DESC, result_no) AS rank
        FROM {HITS} WHERE session_id IS NOT NULL AND hybrid_score IS NOT NULL) WHERE rank <= 5""",
    "bm25_top15": BASE + bm25("chunk") + "SELECT query, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lex",
    "lexical_boost": BASE + bm25("chunk") + "SELECT query, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS boost FROM lex",
    "document_frequencies": BASE + posts("chunk") + "SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS n FROM post GROUP BY term",
    "graph_boost": BASE + r"""SELECT c.chunk_id, round(0.15::DOUBLE + least(0.4, CASE WHEN NOT regexp_matches(e.name, '^$') THEN 0.3 - CASE WHEN list_contains(list_transform(terms, lambda t: lower(t)), lower(e.name)) THEN 0 ELSE 0.1 END ELSE 0 END::DOUBLE
          + CASE WHEN EXISTS (SELECT 1 FROM twoway t JOIN ent n ON n.id = t.b WHERE t.a = e.id AND n.name = e.name) THEN 0.15 ELSE 0 END::DOUBLE), 9) AS boost
        FROM chunk c JOIN (SELECT *, list_filter(regexp_extract_all(name, '\\b[A-Z][a-z]+(?:[ \\t\\n\\x{0b}\\f\\r]+[A-Z][a-z]+)*\\b'), lambda t: length(t) >= 3) || regexp_extract_all(name, '\\b[A-Z]{2,}\\b') || regexp_extract_all(name, '[가-힣]{2,}') AS terms FROM ent) e
          ON e.id = c.entity_id WHERE c.chunk_type = 'entity'""".replace("\\\\", "\\"),
    "hybrid_search": HYBRID + "SELECT query, CAST(rank AS INTEGER) AS rank, chunk_id, title, round(similarity, 6) AS similarity, round(boost, 6) AS graph_boost, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "nodes_near": HYBRID + """, nn AS (SELECT query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(min(distance), 9), id) AS r FROM edist WHERE r <= 20 GROUP BY query, id) WHERE r <= 10)
        SELECT a.query, rel.id FROM rel JOIN nn a ON a.id = rel.source_entity JOIN nn b ON b.id = rel.target_entity AND b.query = a.query""",
    "content_summaries": BASE + SHOWN + summed("SELECT 0 AS query, chunk_id, chunk_type, text FROM chunk WHERE chunk_type = 'document' AND text IS NOT NULL", "SELECT DISTINCT 0 AS query, chunk_id, name FROM cn", "0.0::DOUBLE", "") + """
        SELECT chunk_id, summary AS text, highlight, score FROM told""",
    "query_variants": BASE + PAIRED + """SELECT id, 0 AS variant, 'about ' || name AS text FROM ent UNION ALL
        SELECT id, 1, replaced FROM (SELECT e.id, 'about ' || e.name AS text, replace('about ' || e.name, p.term, p.other) AS replaced, row_number() OVER (PARTITION BY e.id ORDER BY length(p.term) DESC, p.term) AS r
          FROM ent e JOIN pairs p ON contains('about ' || e.name, p.term) AND list_contains(regexp_split_to_array('about ' || e.name, '\\s+'), regexp_split_to_array(p.term, '\\s+')[1])) WHERE r = 1 AND replaced <> text""",
    "embed_chunks": BASE + embedding("chunk_id", "SELECT chunk_id, text FROM chunk WHERE text IS NOT NULL"),
    "embed_entities": BASE + embedding("entity_id", SAID),
    "connected_by_terms": BASE + "SELECT DISTINCT k.name, e.name AS connected FROM ent k JOIN twoway t ON t.a = k.id JOIN ent e ON e.id = t.b WHERE k.name IN (SELECT name FROM shown) AND e.name <> k.name",
    "native_names": BASE + r"""SELECT DISTINCT trim(regexp_extract(o, '한국어명:\s*(.+)', 1)) AS native, name FROM (SELECT name, unnest(observations) AS o FROM ent) WHERE trim(regexp_extract(o, '한국어명:\s*(.+)', 1)) <> ''""",
}
