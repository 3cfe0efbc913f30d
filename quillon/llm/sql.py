"""DuckDB statements for the queries that SQL can express."""

# Fixed values of the statement for look-alikes, its own: soft hyphen, zero-width and byte-order marks; spaces of other or no-break kind.
HIDDEN = r"\x{ad}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}"
SPACES = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}"
EMOJI = r"[\x{2190}-\x{2bff}\x{fe0f}\x{1f000}-\x{1faff}]"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "
# Cyrillic and Greek letters, and the Latin ones they look like.
ALIKE = "асеорхуіјѕһԁԛԝӏѵАВЕКМНОРСТУХІЈЅԚԜοναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aceopxyijshdqwlvABEKMHOPCTYXIJSQWovaipukABEZHIKMNOPTYX"

P1_FOUND = r"""
WITH long AS (SELECT doc_id, text FROM documents WHERE length(text) > 1200),
runs AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k
  FROM (SELECT doc_id, regexp_extract_all(text,
    '[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]+|[^\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]+') AS parts
    FROM long)),
placed AS (
  SELECT doc_id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM runs)
SELECT doc_id, CAST(-1 AS BIGINT) AS start_pos FROM long
UNION
SELECT doc_id, CAST(place AS BIGINT) FROM placed
WHERE length(part) > 1200
  AND NOT regexp_matches(part, '^[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]')
"""


P5 = """
WITH r AS (SELECT result_no, any_value(entities) AS entities FROM search_results GROUP BY result_no),
x AS (SELECT DISTINCT result_no, name FROM (SELECT result_no, unnest(entities) AS name FROM r) WHERE name <> ''),
c AS (SELECT name, count(*) AS k FROM x GROUP BY name),
p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS n_ab FROM x a JOIN x b ON a.result_no = b.result_no AND a.name < b.name GROUP BY ALL),
f AS (SELECT name_a, name_b, n_ab, ca.k AS n_a, cb.k AS n_b, (SELECT count(*) FROM r) AS n
      FROM p JOIN c ca ON ca.name = name_a JOIN c cb ON cb.name = name_b)
"""

P5_PAIRS = P5 + """
SELECT *, round(n_ab * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift FROM f
"""

P5_FOUND = P5 + """
SELECT name_a, name_b FROM f WHERE n_ab >= 8 AND n_ab * n >= 6 * n_a * n_b
"""


P2 = """
WITH c AS (SELECT chunk_no, any_value(embedding)::DOUBLE[] AS v FROM chunks GROUP BY chunk_no),
g AS (SELECT chunk_no, v FROM c WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT chunk_no, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM g)
"""

P2_KNN = P2 + """
, d AS (SELECT a.chunk_no, b.chunk_no AS neighbour, sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v))) AS distance
        FROM u a JOIN u b ON a.chunk_no <> b.chunk_no WHERE a.chunk_no % 50 = 0)
SELECT chunk_no, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY round(distance, 6), neighbour) AS rank FROM d) WHERE rank <= 10
"""

P2_FOUND = P2 + """
SELECT a.chunk_no AS chunk_a, b.chunk_no AS chunk_b FROM u a JOIN u b ON a.chunk_no < b.chunk_no
WHERE sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v))) <= 0.30
"""


P6_FOUND = f"""
WITH c AS (SELECT chunk_no, any_value(text) AS t FROM chunks WHERE text IS NOT NULL GROUP BY chunk_no),
j AS (SELECT chunk_no, t, regexp_replace(regexp_replace(t, '({EMOJI})\\x{{200d}}({EMOJI})', '\\1\\2', 'g'), '({EMOJI})\\x{{200d}}({EMOJI})', '\\1\\2', 'g') AS u FROM c),
odd AS (SELECT chunk_no FROM j WHERE regexp_matches(u, '[０-９Ａ-Ｚａ-ｚ{HIDDEN}{SPACES}]') OR nfc_normalize(t) <> t
  OR regexp_matches(u, '\\p{{Latin}}[\\p{{Greek}}\\p{{Cyrillic}}]|[\\p{{Greek}}\\p{{Cyrillic}}]\\p{{Latin}}')),
e AS (SELECT DISTINCT entity_no, name FROM entities WHERE name IS NOT NULL),
k AS (SELECT entity_no, name, trim(translate(nfc_normalize(translate(regexp_replace(regexp_replace(name, '[{HIDDEN}]', '', 'g'), '[{SPACES}]', ' ', 'g'), '{WIDE}', '{NARROW}')), '{ALIKE}', '{LATIN}')) AS s FROM e)
SELECT 'entity' AS rec_kind, a.entity_no AS key_a, b.entity_no AS key_b FROM k a JOIN k b ON a.s = b.s AND a.entity_no < b.entity_no AND a.name <> b.name
UNION SELECT 'chunk', chunk_no, chunk_no FROM odd
"""

P7_FOUND = r"""
WITH t AS (
  SELECT 'document' AS rec_kind, doc_id AS key, text AS t, 0 AS k FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'entity', entity_no, regexp_replace(o, '^\[\d{4}-\d{2}-\d{2}\]\s*', ''), k FROM (
    SELECT entity_no, unnest(observations) AS o, unnest(range(len(observations))) AS k FROM (SELECT entity_no, any_value(observations) AS observations FROM entities GROUP BY entity_no)) WHERE o IS NOT NULL),
w AS (SELECT rec_kind, key, list_filter(list_transform(regexp_split_to_array(lower(t), '[ \t\n]+'), lambda x: regexp_replace(x, '[^\pL\pN]+', '', 'g')), lambda x: x <> '') AS w FROM t),
s AS MATERIALIZED (SELECT DISTINCT rec_kind, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT rec_kind, key, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 20),
p AS (SELECT a.rec_kind, a.key AS key_a, b.key AS key_b, count(*) AS c FROM s a JOIN s b ON a.rec_kind = b.rec_kind AND a.s = b.s AND a.key < b.key GROUP BY ALL)
SELECT p.rec_kind, key_a, key_b FROM p JOIN n x ON x.rec_kind = p.rec_kind AND x.key = key_a JOIN n y ON y.rec_kind = p.rec_kind AND y.key = key_b WHERE 10 * c >= 6 * (x.n + y.n - c)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_knn": P2_KNN, "p2_found": P2_FOUND, "p5_pairs": P5_PAIRS, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
