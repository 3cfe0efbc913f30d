"""DuckDB statements equivalent to the registered queries."""

from __future__ import annotations

BASE = r"""
WITH RECURSIVE ent AS (
  SELECT id, name, coalesce(entity_type, 'CONCEPT') AS entity_type, coalesce(observations, []) AS observations,
         coalesce(metadata, '{}') AS metadata, created_at, entity_no
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entity_no, ingested_at) AS r FROM entities WHERE id IS NOT NULL AND name IS NOT NULL) WHERE r = 1),
rraw AS (
  SELECT *, lower('rel_' || source_entity || '_' || relation_type || '_' || target_entity) AS rid FROM (
    SELECT *, 'entity_' || regexp_replace(lower(from_name), '[^\pL\pN]', '_', 'g') AS source_entity,
              'entity_' || regexp_replace(lower(to_name), '[^\pL\pN]', '_', 'g') AS target_entity
    FROM relations WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND relation_type IS NOT NULL)),
rel AS (
  SELECT rid AS id, source_entity, target_entity, relation_type, coalesce(confidence, 1.0) AS confidence, coalesce(metadata, '{}') AS metadata, created_at, rel_no
  FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY rel_no, ingested_at) AS r FROM rraw) WHERE r = 1),
doc AS (
  SELECT id, text AS content, coalesce(metadata, '{}') AS metadata, created_at, doc_id
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, ingested_at) AS r FROM documents WHERE id IS NOT NULL) WHERE r = 1),
chunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no, ingested_at) AS r FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1),
twoway AS (SELECT source_entity AS a, target_entity AS b, relation_type FROM rel UNION ALL SELECT target_entity, source_entity, relation_type FROM rel),
shown AS (SELECT DISTINCT name FROM (SELECT unnest(entities) AS name FROM search_results) WHERE name <> ''),
seed AS (SELECT arg_min(id, entity_no) AS id FROM ent WHERE upper(entity_type) = 'PERSON'),
okrel AS (SELECT * FROM rel WHERE source_entity IN (SELECT id FROM ent) AND target_entity IN (SELECT id FROM ent)),
okway AS (SELECT source_entity AS a, target_entity AS b, relation_type FROM okrel UNION ALL SELECT target_entity, source_entity, relation_type FROM okrel),
simple AS (
  SELECT lo, hi, relation_type FROM (
    SELECT least(source_entity, target_entity) AS lo, greatest(source_entity, target_entity) AS hi, relation_type,
           row_number() OVER (PARTITION BY least(source_entity, target_entity), greatest(source_entity, target_entity) ORDER BY rel_no) AS r
    FROM okrel WHERE source_entity <> target_entity) WHERE r = 1),
ends AS (SELECT lo AS a, hi AS b FROM simple UNION ALL SELECT hi, lo FROM simple),
deg AS (SELECT ent.id, ent.name, coalesce(k, 0) AS degree FROM ent LEFT JOIN (SELECT a, count(*) AS k FROM ends GROUP BY a) d ON d.a = ent.id)
"""


def walk(edges: str, depth: int) -> str:
    return f"""
, hop(node, depth) AS (
  SELECT id, 0 FROM seed WHERE id IS NOT NULL
  UNION SELECT e.b, h.depth + 1 FROM hop h JOIN {edges} e ON e.a = h.node WHERE h.depth < {depth}),
near AS (SELECT node AS id, min(depth) AS depth FROM hop GROUP BY node)
"""


def ranks(rounds: int) -> str:
    """PageRank as a chain of rounds; ``ranked`` holds the first one in which ranks move less than 1e-6 a node in all."""
    out = ", r0 AS MATERIALIZED (SELECT id, name, degree, 1.0::DOUBLE / (SELECT count(*) FROM ent) AS r FROM deg)"
    for k in range(1, rounds + 1):
        out += f"""
, g{k} AS (SELECT e.b AS id, sum(p.r / p.degree) AS got FROM ends e JOIN r{k - 1} p ON p.id = e.a GROUP BY e.b)
, r{k} AS MATERIALIZED (SELECT p.id, p.name, p.degree, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE degree = 0) / (SELECT count(*) FROM ent))
          + 0.15 / (SELECT count(*) FROM ent) AS r FROM r{k - 1} p LEFT JOIN g{k} g ON g.id = p.id)"""
    moved = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(a.r - b.r)) FROM r{k} a JOIN r{k - 1} b USING (id)) AS e" for k in range(1, rounds + 1))
    out += f", stops AS (SELECT coalesce(min(k), {rounds}) AS k FROM ({moved}) WHERE e < (SELECT count(*) FROM ent) * 1e-6)"
    return out + ", ranked AS (" + " UNION ALL ".join(f"SELECT r{k}.* FROM r{k}, stops WHERE stops.k = {k}" for k in range(1, rounds + 1)) + ")"


COMPONENT = """
, reach(id, c) AS (SELECT id, id FROM ent UNION SELECT e.b, r.c FROM reach r JOIN ends e ON e.a = r.id WHERE e.b > r.c),
comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id)
"""

CLUSTER = """
, tri AS (SELECT x.a AS id, count(*) AS t FROM ends x JOIN ends y ON x.a = y.a AND x.b < y.b JOIN simple s ON s.lo = x.b AND s.hi = y.b GROUP BY x.a),
clus AS (SELECT d.id, coalesce(t, 0) / (d.degree * (d.degree - 1) / 2.0) AS score FROM deg d LEFT JOIN tri ON tri.id = d.id WHERE d.degree >= 2)
"""

#: Rounds of the chain; more than the ranks of the test data need.
ROUNDS = 40
DEPTH = 12
DISTANCES = """
, hop(seed, node, depth) AS (
  SELECT id, id, 0 FROM ent
  UNION SELECT h.seed, e.b, h.depth + 1 FROM hop h JOIN ends e ON e.a = h.node WHERE h.depth < 12),
dist AS MATERIALIZED (SELECT seed, node, min(depth) AS d FROM hop GROUP BY seed, node)
"""
# paths between all pairs, level by level, and the share of them that each third node lies on
BETWEEN = (
    DISTANCES + ", s0 AS (SELECT seed, node, d, 1.0::DOUBLE AS p FROM dist WHERE d = 0)"
    + "".join(f", s{k} AS MATERIALIZED (SELECT t.seed, t.node, t.d, sum(s.p) AS p FROM s{k - 1} s JOIN ends e ON e.a = s.node JOIN dist t ON t.seed = s.seed AND t.node = e.b AND t.d = {k} GROUP BY ALL)" for k in range(1, DEPTH + 1))
    + ", paths AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(DEPTH + 1)) + """),
btw AS (SELECT a.node AS id, sum(a.p * b.p / w.p) AS s FROM paths a JOIN paths b ON b.seed = a.node JOIN paths w ON w.seed = a.seed AND w.node = b.node AND w.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.node),
between_ AS (SELECT ent.id, ent.name, coalesce(s, 0) / greatest(1, (SELECT (count(*) - 1) * (count(*) - 2) FROM ent)) AS score FROM ent LEFT JOIN btw USING (id)),
close_ AS (SELECT seed AS id, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d)::DOUBLE ELSE 0 END AS score FROM dist GROUP BY seed)
"""
)

GRAPH = {
    "stats_by_type": BASE + "SELECT entity_type, count(*) AS n FROM ent GROUP BY ROLLUP (entity_type)",
    "relation_stats": BASE + "SELECT relation_type, count(*) AS n FROM rel GROUP BY ROLLUP (relation_type)",
    "totals": BASE + """SELECT 'entities' AS what, count(*) AS n FROM ent UNION ALL SELECT 'relationships', count(*) FROM rel
        UNION ALL SELECT 'documents', count(*) FROM doc UNION ALL SELECT 'chunks', count(*) FROM chunk""",
    "read_graph": BASE + """SELECT rel.id, a.name AS from_name, relation_type, b.name AS to_name, confidence FROM rel
        JOIN ent a ON a.id = source_entity JOIN ent b ON b.id = target_entity""",
    "list_entities": BASE + "SELECT id, name, entity_type, CAST(len(observations) AS INTEGER) AS observations FROM ent",
    "open_nodes": BASE + "SELECT id, name, entity_type FROM ent WHERE name IN (SELECT name FROM shown)",
    "open_nodes_edges": BASE + """, ids AS (SELECT id FROM ent WHERE name IN (SELECT name FROM shown))
        SELECT id, source_entity, relation_type, target_entity FROM rel WHERE source_entity IN (SELECT id FROM ids) AND target_entity IN (SELECT id FROM ids)""",
    "one_hop_connected": BASE + "SELECT DISTINCT t.a AS id, e.name AS connected FROM twoway t JOIN ent e ON e.id = t.b WHERE t.a IN (SELECT id FROM ent)",
    "relation_touches": BASE + "SELECT e.id, count(r.id) AS n FROM ent e LEFT JOIN rel r ON r.source_entity = e.id OR r.target_entity = e.id GROUP BY e.id",
    "neighbors_depth3": BASE + walk("okway", 3) + "SELECT n.id, e.name, n.depth FROM near n JOIN ent e ON e.id = n.id",
    "neighbors_edges_depth2": BASE + walk("okway", 2) + """SELECT r.id, greatest(a.depth, b.depth) AS depth FROM okrel r
        JOIN near a ON a.id = r.source_entity JOIN near b ON b.id = r.target_entity""",
    "neighbors_by_type": BASE + ", uses AS (SELECT * FROM okway WHERE relation_type = 'USES')" + walk("uses", 4) + "SELECT n.id, e.name, n.depth FROM near n JOIN ent e ON e.id = n.id",
    "shortest_paths": BASE + """, p0 AS (SELECT id, 0 AS depth, [id] AS path FROM seed),
        p1 AS (SELECT t.b AS id, 1 AS depth, min(list_append(p0.path, t.b)) AS path FROM p0 JOIN twoway t ON t.a = p0.id WHERE t.b NOT IN (SELECT id FROM p0) GROUP BY t.b),
        p2 AS (SELECT t.b AS id, 2 AS depth, min(list_append(p1.path, t.b)) AS path FROM p1 JOIN twoway t ON t.a = p1.id
               WHERE t.b NOT IN (SELECT id FROM p0) AND t.b NOT IN (SELECT id FROM p1) GROUP BY t.b)
        SELECT id, depth, array_to_string(path, '>') AS path FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""",
    "simple_edges": BASE + "SELECT * FROM simple",
    "degree_centrality": BASE + "SELECT id, name, round(degree / CAST(greatest(1, (SELECT count(*) FROM ent) - 1) AS DOUBLE), 8) AS score FROM deg",
    "pagerank": BASE + ranks(ROUNDS) + "SELECT id, name, round(r, 10) AS score FROM ranked",
    "connected_components": BASE + COMPONENT + "SELECT id, component FROM comp",
    "clustering": BASE + CLUSTER + "SELECT id, round(score, 8) AS score FROM clus",
    "degree_distribution": BASE + "SELECT degree, count(*) AS n FROM deg GROUP BY degree",
    "relation_histogram": BASE + "SELECT coalesce(nullif(relation_type, ''), 'UNKNOWN') AS relation_type, count(*) AS n FROM simple GROUP BY 1",
    "structure": BASE.replace("WITH RECURSIVE", "WITH RECURSIVE") + COMPONENT + CLUSTER + """
        , k AS (SELECT component, count(*) AS n FROM comp GROUP BY component), s AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM simple)::DOUBLE AS e FROM ent)
        SELECT 'nodes' AS measure, n AS value FROM s UNION ALL SELECT 'edges', e FROM s UNION ALL SELECT 'density', round(2 * e / (n * (n - 1)), 4) FROM s
        UNION ALL SELECT 'degree_min', min(degree)::DOUBLE FROM deg UNION ALL SELECT 'degree_max', max(degree)::DOUBLE FROM deg
        UNION ALL SELECT 'degree_avg', round(avg(degree), 2) FROM deg
        UNION ALL SELECT 'degree_median', degree::DOUBLE FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS r FROM deg) WHERE r = (SELECT count(*) // 2 + 1 FROM deg)
        UNION ALL SELECT 'components', count(*)::DOUBLE FROM k UNION ALL SELECT 'largest', max(n)::DOUBLE FROM k
        UNION ALL SELECT 'isolated', count(*)::DOUBLE FROM deg WHERE degree = 0 UNION ALL SELECT 'clustering', round(avg(score), 4) FROM clus""",
    "modularity_by_type": BASE + """, p AS (SELECT a.entity_type AS ca, b.entity_type AS cb FROM simple s JOIN ent a ON a.id = s.lo JOIN ent b ON b.id = s.hi),
        d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM p UNION ALL SELECT cb FROM p) GROUP BY c), l AS (SELECT ca AS c, count(*) AS l FROM p WHERE ca = cb GROUP BY ca),
        m AS (SELECT count(*)::DOUBLE AS m FROM simple)
        SELECT (SELECT round(sum(coalesce(l.l, 0) / m - pow(d.d / (2 * m), 2)), 4) FROM d LEFT JOIN l USING (c), m) AS modularity,
               (SELECT count(*) FROM p WHERE ca <> cb) AS cross_edges, (SELECT count(DISTINCT entity_type) FROM ent) AS communities""",
    "closeness": BASE + BETWEEN + "SELECT id, round(score, 8) AS score FROM close_",
    "betweenness": BASE + BETWEEN + "SELECT id, round(score, 8) AS score FROM between_",
    "component_sizes": BASE + COMPONENT + "SELECT component, count(*) AS size, count(*) = 1 AS isolated FROM comp GROUP BY component",
    "top_metrics": BASE + ranks(ROUNDS) + BETWEEN + """, x AS (SELECT 'degree' AS metric, name, round(degree / CAST(greatest(1, (SELECT count(*) FROM ent) - 1) AS DOUBLE), 9) AS score FROM deg
        UNION ALL SELECT 'pagerank', name, round(r, 9) FROM ranked UNION ALL SELECT 'closeness', name, round(score, 9) FROM close_ JOIN ent USING (id) UNION ALL SELECT 'betweenness', name, round(score, 9) FROM between_)
        SELECT metric, CAST(rank AS INTEGER) AS rank, name, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, name) AS rank FROM x) WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    from quillon.plans import oracle_changes, oracle_search, oracle_text

    return GRAPH | oracle_text.SQL | oracle_search.SQL | oracle_changes.SQL
