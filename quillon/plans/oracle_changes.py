"""Statements of the queries over changes."""

from __future__ import annotations

from quillon.plans.oracle import BASE
from quillon.plans.oracle_text import ALIAS, NAMES

PLAIN = r"regexp_replace({0}, '^\[\d{{4}}-\d{{2}}-\d{{2}}\]\s*', '')"
OBS = BASE + ", obs AS (SELECT id, name, entity_type, entity_no, created_at, list_filter(observations, lambda o: o IS NOT NULL) AS observations FROM ent)"
# an item's new observations are those that neither the entity nor an earlier item of it holds
UPSERT = OBS + r"""
, held AS (SELECT * FROM obs WHERE created_at < '2025-01-01'),
item AS (SELECT entity_no AS n, 'entity_' || regexp_replace(lower(name), '[^\pL\pN]', '_', 'g') AS id, name, coalesce(nullif(entity_type, ''), 'CONCEPT') AS kind, coalesce(observations, []) AS observations
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_no ORDER BY ingested_at) AS r FROM entities WHERE name IS NOT NULL) WHERE r = 1),
said AS (SELECT id, n, k, o, regexp_replace(o, '^\[\d{4}-\d{2}-\d{2}\]\s*', '') AS p FROM (
    SELECT id, n, unnest(observations) AS o, unnest(range(len(observations))) AS k FROM item) WHERE o IS NOT NULL),
old AS (SELECT id, k, o, regexp_replace(o, '^\[\d{4}-\d{2}-\d{2}\]\s*', '') AS p FROM (SELECT id, unnest(observations) AS o, unnest(range(len(observations))) AS k FROM held)),
new AS (SELECT s.* FROM said s WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = s.id AND old.p = s.p) AND NOT EXISTS (SELECT 1 FROM said e WHERE e.id = s.id AND e.p = s.p AND e.n < s.n)),
every AS (SELECT id, -1 AS n, k, o FROM old UNION ALL SELECT id, n, k, CASE WHEN regexp_matches(o, '^\[\d{4}-\d{2}-\d{2}\]') THEN o ELSE '[2026-01-01] ' || o END FROM new),
agg AS (SELECT id, count(*) AS n, string_agg(o, '|' ORDER BY n, k) AS observations FROM every GROUP BY id),
ids AS (SELECT id FROM held UNION SELECT id FROM item),
kinds AS (SELECT id, arg_max(kind, n) AS kind FROM item WHERE kind <> 'CONCEPT' GROUP BY id),
firsts AS (SELECT id, arg_min(name, n) AS name FROM item GROUP BY id),
done AS (SELECT ids.id, coalesce(h.name, f.name) AS name, coalesce(k.kind, h.entity_type, 'CONCEPT') AS entity_type, CAST(coalesce(agg.n, 0) AS INTEGER) AS n, coalesce(agg.observations, '') AS observations,
    h.id IS NULL OR coalesce(agg.n, 0) > len(h.observations) OR coalesce(k.kind, h.entity_type) <> h.entity_type AS changed
  FROM ids LEFT JOIN held h ON h.id = ids.id LEFT JOIN firsts f ON f.id = ids.id LEFT JOIN kinds k ON k.id = ids.id LEFT JOIN agg ON agg.id = ids.id)
"""

LINKED = NAMES + ALIAS.removeprefix(BASE) + """, links AS (SELECT * FROM named UNION SELECT c.chunk_id, w.entity_id FROM chunk c JOIN word w ON contains(lower(c.text), w.alias)
        JOIN nm n ON n.entity_id = w.entity_id AND length(n.name) >= CASE WHEN n.cjk THEN 2 ELSE 4 END)
"""

SQL = {
    "create_entities": UPSERT + "SELECT id, name, entity_type, n, observations FROM done",
    "changed_entities": UPSERT + "SELECT id FROM done WHERE changed",
    "delete_observations": OBS + r""", d AS (SELECT id, name, entity_type, list_filter(observations, lambda o: NOT o LIKE '[2024-%') AS l FROM obs)
        SELECT id, name, entity_type, CAST(len(l) AS INTEGER) AS n, coalesce(array_to_string(l, '|'), '') AS observations FROM d""",
    "create_relations": BASE + r""", back AS (SELECT rel_no, lower('rel_' || target_entity || '_' || relation_type || '_' || source_entity) AS id, relation_type FROM rraw WHERE confidence < 0.5)
        SELECT id, arg_min(relation_type, rel_no) AS relation_type FROM back WHERE id NOT IN (SELECT id FROM rel) GROUP BY id""",
    "update_relations": BASE + "SELECT id, CASE WHEN id IN (SELECT rid FROM rraw WHERE confidence > 1) THEN 1.0 ELSE confidence END::DOUBLE AS confidence FROM rel",
    "delete_entities": BASE + """, gone AS (SELECT 'entity_' || regexp_replace(lower(name), '[^\\pL\\pN]', '_', 'g') AS id FROM ent WHERE entity_type = 'FILE')
        SELECT 'entity' AS what, id FROM ent WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'relation', id FROM rel WHERE source_entity NOT IN (SELECT id FROM gone) AND target_entity NOT IN (SELECT id FROM gone)""",
    "delete_relations": BASE + """SELECT id, relation_type FROM rel WHERE (source_entity, target_entity, relation_type) NOT IN
        (SELECT (source_entity, target_entity, relation_type) FROM rraw WHERE relation_type = lower(relation_type))""",
    "store_documents": BASE + """, gl AS (SELECT id, arg_max(text, doc_id) AS text FROM documents WHERE source = 'glossary' GROUP BY id)
        SELECT 'document' AS what, doc.id, md5(coalesce(gl.text || ' (stored again)', content)) AS digest FROM doc LEFT JOIN gl ON gl.id = doc.id
        UNION ALL SELECT 'chunk', chunk_id, NULL FROM chunk WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gl)""",
    "delete_documents": BASE + "SELECT DISTINCT document_id AS id, document_id IN (SELECT id FROM doc) AS deleted FROM chunks WHERE document_id IS NOT NULL",
    "import_merge": BASE + """, h AS (SELECT * FROM ent WHERE created_at < '2025-01-01'),
        ne AS (SELECT * FROM ent WHERE id NOT IN (SELECT id FROM h) AND name NOT IN (SELECT name FROM h)),
        hr AS (SELECT id FROM rel WHERE source_entity IN (SELECT id FROM h) AND target_entity IN (SELECT id FROM h))
        SELECT 'entities' AS what, (SELECT count(*) FROM ne) AS imported, (SELECT count(*) FROM ent) - (SELECT count(*) FROM ne) AS skipped
        UNION ALL SELECT 'relations', (SELECT count(*) FROM okrel WHERE id NOT IN (SELECT id FROM hr)), (SELECT count(*) FROM okrel WHERE id IN (SELECT id FROM hr))
        UNION ALL SELECT 'documents', (SELECT count(*) FROM doc), 0""",
    "auto_link": LINKED + "SELECT chunk_id, entity_id FROM links",
    "delete_cascade": LINKED + """, gd AS (SELECT id FROM documents WHERE source = 'glossary'), ge AS (SELECT id FROM ent WHERE entity_type = 'FILE'),
        gc AS (SELECT chunk_id FROM chunk WHERE document_id IN (SELECT id FROM gd))
        SELECT 'link' AS what, chunk_id || '>' || entity_id AS id FROM links WHERE entity_id NOT IN (SELECT id FROM ge) AND chunk_id NOT IN (SELECT chunk_id FROM gc)
        UNION ALL SELECT 'vector', id FROM ent WHERE id NOT IN (SELECT id FROM ge) UNION ALL SELECT 'chunk', chunk_id FROM chunk WHERE chunk_id NOT IN (SELECT chunk_id FROM gc)""",
    "import_replace": BASE + "SELECT 'chunk' AS what, chunk_id AS id FROM chunk WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM doc)",
    "clean_graph_chunks": LINKED + """, kept AS (SELECT chunk_id FROM chunk WHERE chunk_type IS NULL OR chunk_type NOT IN ('entity', 'relationship'))
        SELECT 'link' AS what, chunk_id || '>' || entity_id AS id FROM links WHERE chunk_id IN (SELECT chunk_id FROM kept)
        UNION ALL SELECT 'vector', id FROM ent UNION ALL SELECT 'chunk', chunk_id FROM kept""",
    "update_report": BASE + """, u AS (SELECT rel_no, source_entity AS s, target_entity AS t, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY rel_no ORDER BY ingested_at) AS k FROM rraw WHERE confidence > 1) WHERE k = 1),
        w AS (SELECT lower('rel_' || s || '_' || relation_type || '_' || t) AS id FROM u UNION ALL SELECT lower('rel_' || t || '_' || relation_type || '_' || s) FROM u)
        SELECT count(*) FILTER (id IN (SELECT id FROM rel)) AS updated, count(*) FILTER (id NOT IN (SELECT id FROM rel)) AS not_found FROM w""",
    "export_rows": BASE + "SELECT 'entity' AS kind, count(*) AS n FROM ent UNION ALL SELECT 'relation', count(*) FROM rel UNION ALL SELECT 'document', count(*) FROM doc",
    "latest_deliveries": " UNION ALL ".join(
        f"SELECT '{name}' AS name, {key} AS n, count(*) AS times, min({at}) AS first, max({at}) AS last FROM {name} GROUP BY {key} HAVING count(*) > 1"
        for name, key, at in (("chunks", "chunk_no", "ingested_at"), ("entities", "entity_no", "ingested_at"), ("relations", "rel_no", "ingested_at"), ("search_results", "result_no", "received_at"))
    ),
}
