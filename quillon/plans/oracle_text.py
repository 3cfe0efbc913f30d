"""Statements of the text queries."""

from __future__ import annotations

from quillon.plans.oracle import BASE

CJK = "[　-鿿가-힯＀-￯]"
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}|{BLANK}$', '', 'g')"


OBS = BASE + ", obs AS (SELECT id, name, entity_type, list_filter(observations, lambda o: o IS NOT NULL) AS observations FROM ent)"
TOKENS = r"regexp_extract_all(content, '[\pL\pN]+|[^\pL\pN]')"


def windows(size: int, overlap: int) -> str:
    return BASE + f"""
, tok AS (SELECT id, content, unnest({TOKENS}) AS t, unnest(range(len({TOKENS}))) AS k FROM doc WHERE length(content) > 0),
stops AS (SELECT id, k, sum(length(t)) OVER (PARTITION BY id ORDER BY k) AS e FROM tok),
num AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
win AS (SELECT id, n, unnest(range(0, n, {size - overlap})) AS a FROM num),
placed AS (SELECT w.id, w.a // {size - overlap} AS chunk_index, w.a AS start_token, least(w.a + {size}, w.n) AS end_token, coalesce(s.e, 0) AS start_pos, e.e AS end_pos
  FROM win w LEFT JOIN stops s ON s.id = w.id AND s.k = w.a - 1 JOIN stops e ON e.id = w.id AND e.k = least(w.a + {size}, w.n) - 1)
"""


ALIAS = BASE + r"""
, word AS (SELECT DISTINCT id AS entity_id, lower(a) AS alias FROM (
    SELECT id, unnest(regexp_extract_all(o, '[0-9A-Za-z_\-]+\.[0-9A-Za-z_]{1,4}\b')) AS a FROM (SELECT id, unnest(observations) AS o FROM ent) WHERE o IS NOT NULL) WHERE length(a) >= 4)
"""
NAMES = BASE + f"""
, nm AS (SELECT id AS entity_id, lower(name) AS name, regexp_matches(lower(name), '{CJK}') AS cjk FROM ent),
named AS (SELECT DISTINCT c.chunk_id, n.entity_id FROM chunk c JOIN nm n ON contains(lower(c.text), n.name)
  WHERE length(n.name) >= CASE WHEN n.cjk THEN 2 ELSE 4 END AND (n.cjk OR regexp_matches(lower(c.text), '\\b' || regexp_escape(n.name) || '\\b')))
"""

SQL = {
    "slugify": r"""SELECT name, 'entity_' || regexp_replace(lower(name), '[^\pL\pN]', '_', 'g') AS id
        FROM (SELECT from_name AS name FROM relations UNION SELECT to_name FROM relations) WHERE name IS NOT NULL""",
    "strip_dates": BASE + r"""SELECT id, CAST(n AS INTEGER) AS n, regexp_replace(o, '^\[\d{4}-\d{2}-\d{2}\]\s*', '') AS plain,
        CASE WHEN regexp_matches(o, '^\[\d{4}-\d{2}-\d{2}\]') THEN o ELSE '[2025-01-31] ' || o END AS stamped
        FROM (SELECT id, unnest(observations) AS o, unnest(range(len(observations))) AS n FROM ent) WHERE o IS NOT NULL""",
    "embedding_texts": OBS + f"""SELECT id, {trim("entity_type || ': ' || name || '. ' || coalesce(array_to_string(list_filter(observations, lambda o: NOT regexp_matches(o, '^(Source:|Created:|Type:|Tags:|Content length:)')), '. '), '')")} AS text FROM obs""",
    "extract_terms": BASE + r"""SELECT id, coalesce(array_to_string(list_distinct_in_order, '|'), '') AS terms FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (
        SELECT id, list_filter(regexp_extract_all(content, '\b[A-Z][a-z]+(?:[ \t\n\x{0b}\f\r]+[A-Z][a-z]+)*\b'), lambda t: length(t) >= 3) || regexp_extract_all(content, '\b[A-Z]{2,}\b') || regexp_extract_all(content, '[가-힣]{2,}') AS l
        FROM doc))""",
    "sentences": BASE + f"""SELECT id, CAST(n AS INTEGER) AS n, regexp_replace(s, '^[-•]\\s*', '') AS sentence FROM (
        SELECT id, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), lambda s: {trim("s")}), lambda s: length(s) > 10) AS l FROM doc))""",
    "character_classes": BASE + f"""SELECT id, regexp_matches(content, '[가-힣]') AS korean, regexp_matches(content, '^[\\x00-\\x7F]*$') AS ascii, regexp_matches(content, '{CJK}') AS cjk FROM doc""",
    "normalised_queries": BASE + f"""SELECT id, {trim(f"regexp_replace(name, '{BLANK}', ' ', 'g')")} AS query,
        {trim(f"regexp_replace(regexp_replace(name, '[^\\x00-\\x7F]+', ' ', 'g'), '{BLANK}', ' ', 'g')")} AS ascii_query FROM ent""",
    "chunk_windows": windows(100, 20) + """SELECT p.id, CAST(chunk_index AS INTEGER) AS chunk_index, substr(content, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT)) AS text, CAST(start_pos AS INTEGER) AS start_pos,
        CAST(end_pos AS INTEGER) AS end_pos, CAST(start_token AS INTEGER) AS start_token, CAST(end_token AS INTEGER) AS end_token FROM placed p JOIN doc ON doc.id = p.id""",
    "chunk_windows_default": windows(800, 160) + "SELECT id, count(*) AS windows, CAST(max(end_pos) AS INTEGER) AS end_pos, CAST(max(end_token) AS INTEGER) AS end_token FROM placed GROUP BY id",
    "entity_chunks": OBS + """, c AS (SELECT id, name || ' is a ' || entity_type || '. ' || CASE WHEN len(observations) > 0 THEN array_to_string(observations, '. ') ELSE 'No additional information available.' END AS text FROM obs)
        SELECT 'kg_entity_' || id AS chunk_id, 'entity' AS chunk_type, id AS entity_id, text, 0 AS start_pos, CAST(length(text) AS INTEGER) AS end_pos FROM c""",
    "relationship_chunks": BASE + """, c AS (SELECT rel.id, a.name || ' ' || replace(lower(relation_type), '_', ' ') || ' ' || b.name AS text FROM rel JOIN ent a ON a.id = source_entity JOIN ent b ON b.id = target_entity)
        SELECT 'kg_relationship_' || id AS chunk_id, 'relationship' AS chunk_type, id AS relationship_id, text, 0 AS start_pos, CAST(length(text) AS INTEGER) AS end_pos FROM c""",
    "detailed_context": BASE + """, own AS (SELECT * FROM chunk WHERE chunk_type = 'document' AND document_id IS NOT NULL AND chunk_index IS NOT NULL),
        near AS (SELECT document_id, chunk_index, arg_min(text, chunk_id) AS text FROM own GROUP BY ALL)
        SELECT o.chunk_id, o.document_id, o.chunk_index, b.text AS before, a.text AS after, coalesce(nullif(json_extract_string(d.metadata, '$.title'), ''), nullif(json_extract_string(d.metadata, '$.name'), ''), nullif(o.document_id, ''), 'Unknown Document') AS title
        FROM own o LEFT JOIN doc d ON d.id = o.document_id LEFT JOIN near b ON b.document_id = o.document_id AND b.chunk_index = o.chunk_index - 1
        LEFT JOIN near a ON a.document_id = o.document_id AND a.chunk_index = o.chunk_index + 1""",
    "orphan_chunks": BASE + """SELECT chunk_id, 'document' AS lost FROM chunk WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM doc)
        UNION ALL SELECT chunk_id, 'entity' FROM chunk WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT id FROM ent)""",
    "entity_links": NAMES + "SELECT * FROM named",
    "linked_entities": NAMES + ALIAS.removeprefix(BASE) + """, both_ AS (SELECT * FROM named UNION SELECT c.chunk_id, w.entity_id FROM chunk c JOIN word w ON contains(lower(c.text), w.alias)
        JOIN nm n ON n.entity_id = w.entity_id AND length(n.name) >= CASE WHEN n.cjk THEN 2 ELSE 4 END)
        SELECT entity_id, count(*) AS chunks FROM both_ GROUP BY entity_id""",
    "alias_links": ALIAS + "SELECT DISTINCT c.chunk_id, w.entity_id FROM chunk c JOIN word w ON contains(lower(c.text), w.alias)",
}
