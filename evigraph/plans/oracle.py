"""DuckDB SQL of the graph queries, over the same Parquet tables."""
from evigraph.sources.texts import CREDENTIALS

BASE = """WITH RECURSIVE raw AS (
  SELECT CAST(r_regionkey AS BIGINT) AS k, 'region' AS kind, r_name AS name, 'confirmed' AS status, 'self' AS ns FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'nation', n_name, 'confirmed', 'self' FROM nation
  UNION ALL SELECT c_custkey, 'customer', c_name, 'confirmed', CASE c_nationkey % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'a' ELSE 'b' END FROM customer
  UNION ALL SELECT s_suppkey, 'supplier', s_name, 'confirmed', 'self' FROM supplier
  UNION ALL SELECT p_partkey, 'part', p_name, 'confirmed', 'self' FROM part WHERE p_partkey % 97 <> 0
  UNION ALL SELECT o_orderkey, 'order', 'order ' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'proposed' ELSE 'archived' END, 'self' FROM orders),
nodes AS (SELECT ns, kind || ':' || k AS id, kind, k, name, CASE WHEN k % 7 <> 0 THEN 'about ' || name END AS summary, status, CASE WHEN k % 5 = 0 THEN 'agent' ELSE 'reviewed' END AS trust, (k % 10) / 10 AS conf, CASE WHEN k % 4 = 0 THEN 'alt ' || name END AS alias FROM raw),
attrs AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, 'segment' AS field, '"' || c_mktsegment || '"' AS value FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'brand', '"' || p_brand || '"' FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 13 <> 0
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'type', '"' || p_type || '"' FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 17 <> 0
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'priority', '"' || o_orderpriority || '"' FROM orders WHERE o_orderkey % 19 <> 0),
linked AS (
  SELECT 'nation:' || n_nationkey AS src, 'part_of' AS rel, 'region:' || n_regionkey AS dst, CAST(NULL AS VARCHAR) AS key, 'confirmed' AS status, FALSE AS background, CAST(n_nationkey AS BIGINT) AS k FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, NULL, 'confirmed', FALSE, c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, NULL, 'confirmed', FALSE, s_suppkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, NULL, 'confirmed', FALSE, o_orderkey FROM orders
  UNION ALL SELECT DISTINCT ON (l_orderkey, l_partkey, l_linenumber) 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, CAST(l_linenumber AS VARCHAR), CASE WHEN l_linestatus = 'O' AND l_linenumber >= 5 THEN 'proposed' WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'archived' ELSE 'confirmed' END, FALSE, l_orderkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, NULL, 'confirmed', (l_suppkey + l_partkey) % 5 = 0, l_suppkey FROM lineitem
  UNION ALL SELECT 'part:' || near, 'same_as', 'part:' || p_partkey, NULL, CASE WHEN p_partkey % 6 = 0 THEN 'proposed' ELSE 'confirmed' END, FALSE, p_partkey
    FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS near FROM part WHERE p_partkey % 97 <> 0) WHERE p_partkey - near <= 20),
edges AS (SELECT 'e-' || substr(sha256(src || chr(31) || rel || chr(31) || dst || chr(31) || coalesce(key, '')), 1, 12) AS id, src, rel, dst, key, status, (k % 10) / 10 AS conf, background FROM linked),
cited AS (
  SELECT record_id, k, unnest(range(1, k % 3 + 1)) AS ord FROM (
    SELECT 'customer:' || c_custkey AS record_id, c_custkey AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_suppkey FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_partkey FROM part WHERE p_partkey % 97 <> 0) WHERE k % 3 > 0),
prov AS (
  SELECT record_id, ord, CASE WHEN k % 23 = 0 THEN 'src-000000000000' ELSE 'src-' || substr(sha256(text), 1, 12) END AS src, CASE WHEN k % 29 = 0 THEN 'L1-L99999' ELSE 'L1-L1' END AS loc,
         substr(split_part(text, chr(10), 1), 1, 40) || CASE WHEN k % 5 = 0 THEN 'x' ELSE '' END AS quote
  FROM cited JOIN documents ON doc_id = (k * 31 + ord * 17) % (SELECT count(*) FROM documents)),
texts AS (SELECT DISTINCT 'src-' || substr(sha256(text), 1, 12) AS id, text FROM documents),
answers AS (SELECT event_id AS seq, 'q' || (event_id % 7) AS q, 'user:' || user_id AS node, CASE event_type WHEN 'view' THEN 'answered' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'later' WHEN 'signup' THEN 'na' ELSE 'answered' END AS status, ts FROM events),
reviews AS (
  SELECT 'prop-' || CAST(doc_id // 10 AS BIGINT) AS prop_id, CAST(doc_id % 10 AS INTEGER) AS n, CASE WHEN doc_id % 4 = 0 THEN 'add_edge' ELSE 'add_node' END AS op, CASE doc_id % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'order' ELSE 'customer' END AS kind, (doc_id % 10) / 10 AS conf,
         CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'draft' END AS verdict FROM labels),
decisions AS (
  SELECT 'dec-' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'customer:' || c_custkey ELSE 'customer:' || c_custkey || '#attrs.segment' END AS scope, CASE WHEN c_custkey % 10 < 2 THEN 'superseded' ELSE 'active' END AS status,
         CASE WHEN c_custkey % 10 < 2 THEN 'dec-' || (c_custkey + 1) END AS superseded_by FROM customer WHERE c_custkey % 10 < 3),
captured AS (SELECT doc_id, 'file' AS kind, 'title ' || (doc_id % 300) AS title, CASE WHEN doc_id % 2 = 0 THEN 'http://s/' || (doc_id % 200) END AS url, text, 1704067200 + doc_id * 3600 AS captured, CASE WHEN doc_id % 3 = 0 THEN doc_id % 20 END AS stale_after_days FROM documents),
rels(rel, inverse, both_ways) AS (VALUES ('part_of', 'has_part', FALSE), ('located_in', 'location_of', FALSE), ('placed_by', 'placed', FALSE), ('contains', 'contained_in', FALSE), ('supplies', 'supplied_by', FALSE), ('same_as', 'same_as', TRUE)),
gone AS (SELECT id FROM nodes WHERE status = 'archived'),
expanded AS (
  SELECT src AS id, dst AS other, rel AS label, 'out' AS direction, id AS edge_id, rel, background, conf FROM edges WHERE status <> 'archived' AND dst NOT IN (SELECT id FROM gone)
  UNION ALL SELECT dst, src, inverse, 'in', id, rel, background, conf FROM edges JOIN rels USING (rel) WHERE status <> 'archived' AND src NOT IN (SELECT id FROM gone) AND NOT (both_ways AND src = dst)),
pairs AS (SELECT src AS a, dst AS b FROM edges WHERE rel = 'same_as' UNION SELECT dst, src FROM edges WHERE rel = 'same_as'),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
classes AS (SELECT a AS id, least(a, min(b)) AS class_id FROM reach GROUP BY a),
degrees AS (SELECT id, count(*) AS degree FROM expanded WHERE NOT background GROUP BY id),
hubs AS (SELECT id FROM nodes WHERE kind IN ('region', 'nation')),
links AS (SELECT coalesce(x.class_id, e.id) AS a, coalesce(y.class_id, e.other) AS b, background, label FROM expanded e LEFT JOIN classes x ON x.id = e.id LEFT JOIN classes y ON y.id = e.other WHERE coalesce(x.class_id, e.id) <> coalesce(y.class_id, e.other)),
steps AS (SELECT a, b, min(background) AS background FROM links GROUP BY a, b),
own AS (SELECT n.*, coalesce(c.class_id, n.id) AS class_id FROM nodes n LEFT JOIN classes c USING (id) WHERE n.status <> 'archived'),
class_links AS (SELECT coalesce(c.class_id, e.id) AS class_id, rel, direction, count(*) AS n FROM expanded e LEFT JOIN classes c USING (id) WHERE NOT background AND rel <> 'same_as' GROUP BY ALL),
facts AS (
  SELECT o.*, coalesce(d.degree, 0) AS degree, coalesce(p.n_src, 0) AS n_src, coalesce(l.links, 0) AS links, coalesce(a.n, 0) AS n_attrs
  FROM own o LEFT JOIN degrees d USING (id) LEFT JOIN (SELECT record_id AS id, count(DISTINCT src) AS n_src FROM prov GROUP BY 1) p USING (id) LEFT JOIN (SELECT class_id, sum(n) AS links FROM class_links GROUP BY 1) l ON l.class_id = o.class_id
  LEFT JOIN (SELECT id, count(*) AS n FROM attrs GROUP BY 1) a ON a.id = o.id),
wanted_fields(kind, field) AS (VALUES ('customer', 'segment'), ('part', 'brand'), ('part', 'type'), ('order', 'priority')),
wanted_rels(kind, rel, direction, least_n) AS (VALUES ('customer', 'located_in', 'out', 1), ('order', 'placed_by', 'out', 1), ('order', 'contains', 'out', 2), ('supplier', 'supplies', 'out', 2), ('part', 'contains', 'in', 1)),
gaps AS (
  SELECT id, 'unconfirmed_hub' AS gap, 7 AS severity, '' AS detail FROM facts WHERE status = 'proposed' AND degree >= 3
  UNION ALL SELECT o.id, 'missing_field', 6, w.field FROM own o JOIN wanted_fields w USING (kind) LEFT JOIN attrs a ON a.id = o.id AND a.field = w.field WHERE a.value IS NULL
  UNION ALL SELECT o.id, 'missing_relation', 6, w.rel || ' ' || w.direction FROM own o JOIN wanted_rels w USING (kind) LEFT JOIN class_links c ON c.class_id = o.class_id AND c.rel = w.rel AND c.direction = w.direction WHERE coalesce(c.n, 0) < least_n
  UNION ALL SELECT id, 'orphan', 5, '' FROM facts WHERE links = 0 AND kind NOT IN ('region', 'nation')
  UNION ALL SELECT id, 'thin', 5, '' FROM facts WHERE summary IS NULL AND n_attrs = 0
  UNION ALL SELECT id, 'no_provenance', 5, '' FROM facts WHERE status = 'proposed' AND n_src = 0
  UNION ALL SELECT id, 'single_source', 4, '' FROM facts WHERE n_src = 1
  UNION ALL SELECT id, 'low_confidence', 4, '' FROM facts WHERE conf < 0.5
  UNION ALL SELECT id, 'draft', 3, '' FROM facts WHERE status = 'proposed'),
dims(dimension, target) AS (VALUES ('geography', 50), ('market', 4000), ('supply', 150), ('catalogue', 5000)),
coverage AS (
  SELECT dimension, n, target, least(1.0::DOUBLE, n / target) AS coverage FROM (SELECT d.dimension, d.target, count(n.id) AS n FROM dims d LEFT JOIN (
    SELECT f.id, CASE kind WHEN 'region' THEN 'geography' WHEN 'nation' THEN 'geography' WHEN 'customer' THEN 'market' WHEN 'order' THEN 'market' WHEN 'supplier' THEN 'supply' ELSE 'catalogue' END AS dimension
    FROM facts f WHERE summary IS NOT NULL AND degree >= 1 AND id IN (SELECT record_id FROM prov)) n USING (dimension) GROUP BY ALL)),
snapshot AS (SELECT id, name, status, conf FROM nodes),
ours AS (SELECT id, name, CASE WHEN conf > 0.75 THEN 'confirmed' ELSE status END AS status, conf FROM nodes WHERE conf > 0.05 OR name LIKE 'S%'),
theirs AS (SELECT id, CASE WHEN conf > 0.65 AND conf < 0.85 THEN upper(name) ELSE name END AS name, CASE WHEN conf > 0.85 THEN 'confirmed' ELSE status END AS status, conf FROM nodes),
store AS (
  SELECT *, lag(id) OVER (PARTITION BY coalesce(url, kind || chr(31) || title) ORDER BY captured, id) AS supersedes FROM (
    SELECT 'src-' || substr(h, 1, 12) AS id, count(*) OVER (PARTITION BY h) AS copies, row_number() OVER (PARTITION BY h ORDER BY captured, doc_id) AS r, * FROM (
      SELECT sha256(t) AS h, strlen(t) AS bytes, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) END AS lines, * FROM (SELECT CASE WHEN text = '' OR ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS t, * FROM captured))) WHERE r = 1),
points AS (SELECT event_type AS key, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL),
dangling AS (SELECT e.id, u.e AS "end", u.m AS missing FROM edges e, LATERAL (SELECT 'src' AS e, src AS m UNION ALL SELECT 'dst', dst) u WHERE e.status <> 'archived' AND u.m NOT IN (SELECT id FROM nodes)),
violations AS (SELECT e.id, e.rel, s.kind AS src_kind, d.kind AS dst_kind FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE e.status <> 'archived' AND e.rel <> 'same_as'
  AND (e.rel, s.kind, d.kind) NOT IN (VALUES ('part_of', 'nation', 'region'), ('located_in', 'customer', 'nation'), ('placed_by', 'order', 'customer'), ('contains', 'order', 'part'), ('supplies', 'supplier', 'part'))),
touch AS (SELECT DISTINCT e.id, u.m AS archived_end FROM edges e, LATERAL (SELECT src AS m UNION ALL SELECT dst) u WHERE e.status <> 'archived' AND u.m IN (SELECT id FROM gone)),
aliased AS (SELECT DISTINCT id, lower(trim(alias)) AS alias FROM nodes WHERE status <> 'archived' AND alias IS NOT NULL),
collisions AS (SELECT x.alias, f.a, x.id AS b FROM aliased x JOIN (SELECT alias, min(id) AS a FROM aliased GROUP BY alias HAVING count(*) > 1) f USING (alias) WHERE x.id <> f.a),
prov_bad AS (SELECT record_id, ord, CASE WHEN t.id IS NULL THEN 'unknown_source' WHEN CAST(substr(loc, 5) AS BIGINT) > len(string_split(t.text, chr(10))) THEN 'span' END AS problem FROM prov p LEFT JOIN texts t ON t.id = p.src),
merges AS (SELECT src AS keep, dst AS drop_ FROM edges WHERE rel = 'same_as'),
ups(a, b) AS (SELECT drop_, keep FROM merges UNION SELECT u.a, m.keep FROM ups u JOIN merges m ON m.drop_ = u.b),
targets AS (SELECT a AS drop_, b AS keep FROM ups WHERE b NOT IN (SELECT drop_ FROM merges)),
dec_up(a, b, n) AS (SELECT id, id, 0 FROM decisions UNION ALL SELECT u.a, d.superseded_by, u.n + 1 FROM dec_up u JOIN decisions d ON d.id = u.b WHERE d.superseded_by IS NOT NULL)
"""

SQL = {
    "degree": "SELECT * FROM degrees",
    "directed_links": "SELECT id, other, label, direction, edge_id FROM expanded",
    "relation_groups": "SELECT id, label, other, count(*) AS repeats, max(conf) AS conf FROM expanded WHERE NOT background GROUP BY ALL",
    "status_counts": "SELECT kind, count(*) AS n, count(*) FILTER (status = 'proposed') AS drafts, count(*) FILTER (status = 'archived') AS archived FROM nodes GROUP BY kind",
    "breakdown_kind_status": "SELECT kind, status, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((kind), (status), ())",
    "namespace_bridges": "SELECT least(s.ns, d.ns) AS a, greatest(s.ns, d.ns) AS b, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE e.rel = 'located_in' AND s.ns <> d.ns GROUP BY ALL",
    "dangling_endpoints": "SELECT * FROM dangling",
    "signature_violations": "SELECT * FROM violations",
    "archived_touch": "SELECT * FROM touch",
    "alias_collisions": "SELECT * FROM collisions",
    "provenance_problems": "SELECT * FROM prov_bad WHERE problem IS NOT NULL",
    "quote_check": r"SELECT record_id, ord, contains(trim(regexp_replace(CASE WHEN loc = 'L1-L1' THEN split_part(text, chr(10), 1) ELSE text END, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS found FROM prov JOIN texts ON texts.id = prov.src",
    "provenance_index": "SELECT src, count(*) AS citations, count(DISTINCT record_id) AS records FROM prov GROUP BY src",
    "field_errors": "SELECT id, field, CASE field WHEN 'segment' THEN 'enum' WHEN 'brand' THEN 'pattern' ELSE 'maxLength' END AS keyword FROM attrs WHERE (field = 'segment' AND value NOT IN ('\"BUILDING\"', '\"MACHINERY\"')) OR (field = 'brand' AND NOT regexp_full_match(value, '\"Brand#[1-3][0-9]\"')) OR (field = 'type' AND length(value) > 20)",
    "validate": "SELECT 'P09' AS code, count(*) AS n FROM (SELECT id FROM violations UNION ALL SELECT id FROM edges WHERE rel = 'same_as' AND src > dst) UNION ALL SELECT 'P10', count(*) FROM dangling UNION ALL SELECT 'P11', count(*) FROM prov_bad WHERE problem IS NOT NULL UNION ALL SELECT 'P13', count(*) FROM touch UNION ALL SELECT 'P06', count(*) FROM collisions",
    "needs_gaps": "SELECT * FROM gaps",
    "ranked_gaps": "SELECT g.id, gap, severity, detail, coalesce(d.degree, 0) AS degree, row_number() OVER (ORDER BY severity DESC, coalesce(d.degree, 0) DESC, gap, g.id, detail) AS place FROM gaps g LEFT JOIN degrees d USING (id) ORDER BY place LIMIT 500",
    "dimension_coverage": "SELECT dimension, n, target, round(coverage, 6) AS coverage FROM coverage",
    "richness": """, parts AS (
      SELECT round((SELECT avg(coverage) FROM coverage), 4) AS coverage,
        round(1 - (SELECT count(*) FROM gaps WHERE gap = 'missing_field') / (SELECT count(*) FROM own JOIN wanted_fields USING (kind)), 4) AS completeness,
        round((1 - (SELECT count(*) FROM gaps WHERE gap = 'missing_relation') / (SELECT count(*) FROM own JOIN wanted_rels USING (kind))) * (1 - (SELECT count(*) FROM gaps WHERE gap = 'orphan') / (SELECT count(*) FROM own)), 4) AS connectivity,
        round((SELECT avg(least(2, coalesce(n, 0)) / 2) FROM (SELECT id FROM own UNION ALL SELECT id FROM edges WHERE status <> 'archived' AND NOT background) LEFT JOIN (SELECT record_id AS id, count(DISTINCT src) AS n FROM prov GROUP BY 1) USING (id)), 4) AS evidence,
        round((SELECT count(*) FILTER (status = 'confirmed') / count(*) FILTER (status IN ('confirmed', 'proposed')) FROM own), 4) AS confirmation,
        round(1 - pow(2, -(SELECT sum(least(2, coalesce(n, 0)) / 2) FROM (SELECT id FROM own UNION ALL SELECT id FROM edges WHERE status <> 'archived' AND NOT background) LEFT JOIN (SELECT record_id AS id, count(DISTINCT src) AS n FROM prov GROUP BY 1) USING (id)) / (SELECT sum(target) FROM dims)), 4) AS depth),
      scored AS (SELECT *, CAST(floor(round(100 * (30 * coverage + (20 * completeness + 15 * connectivity + 20 * evidence + 15 * confirmation) * coverage * depth) / 100, 6) + 0.5) AS BIGINT) AS score FROM parts)
      SELECT *, CASE WHEN score < 20 THEN 'seed' WHEN score < 40 THEN 'sketch' WHEN score < 60 THEN 'working' WHEN score < 80 THEN 'rich' ELSE 'deep' END AS band FROM scored""",
    "calibration": "SELECT kind, count(*) AS n, round(avg((conf - o) ** 2), 6) AS brier, round(avg(conf), 6) AS mean_conf, round(avg(o), 6) AS mean_outcome, count(*) FILTER (o = 1) AS accepted FROM (SELECT kind, conf, CASE verdict WHEN 'reject' THEN 0.0 ELSE 1.0 END::DOUBLE AS o FROM reviews WHERE verdict IN ('accept', 'reject')) GROUP BY ROLLUP (kind)",
    "class_conflicts": "SELECT class_id, field, len(v) AS n_values, array_to_string(v, '|') AS values FROM (SELECT class_id, field, list_sort(list(DISTINCT value)) AS v FROM attrs JOIN classes USING (id) WHERE id IN (SELECT id FROM own) GROUP BY ALL) WHERE len(v) > 1",
    "same_as_classes": "SELECT * FROM classes",
    "confirmed_classes": ", p2 AS (SELECT src AS a, dst AS b FROM edges WHERE rel = 'same_as' AND status = 'confirmed' UNION SELECT dst, src FROM edges WHERE rel = 'same_as' AND status = 'confirmed'), r2(a, b) AS (SELECT a, b FROM p2 UNION SELECT r.a, p.b FROM r2 r JOIN p2 p ON r.b = p.a) SELECT a AS id, least(a, min(b)) AS class_id FROM r2 GROUP BY a",
    "neighbours_2hop": ", one AS (SELECT s.id AS start, t.b AS id, t.background FROM (SELECT id FROM nodes WHERE kind = 'customer') s JOIN steps t ON t.a = s.id), two AS (SELECT DISTINCT o.start, t.b AS id FROM one o JOIN steps t ON t.a = o.id WHERE NOT o.background AND o.id NOT IN (SELECT id FROM hubs)) SELECT start, id, min(depth) AS depth FROM (SELECT start, id, 1 AS depth FROM one UNION ALL SELECT start, id, 2 FROM two WHERE start <> id) GROUP BY ALL",
    "goal_reach": ", g AS (SELECT id FROM nodes WHERE kind = 'supplier'), one AS (SELECT t.b AS id, min(t.background) AS background FROM g JOIN steps t ON t.a = g.id GROUP BY ALL), two AS (SELECT t.b AS id FROM one o JOIN steps t ON t.a = o.id WHERE NOT o.background AND o.id NOT IN (SELECT id FROM hubs)) SELECT id FROM g UNION SELECT id FROM one UNION SELECT id FROM two",
    "related_records": "SELECT id, start, depth FROM (SELECT t.b AS id, s.id AS start, 1 AS depth, row_number() OVER (PARTITION BY t.b ORDER BY s.k) AS r FROM nodes s JOIN steps t ON t.a = s.id WHERE s.kind = 'supplier') WHERE r = 1",
    "k_paths": """, walk AS (SELECT a, b FROM steps WHERE NOT background), z AS (SELECT 'supplier:' || s_suppkey AS a, 'customer:' || s_suppkey AS z FROM supplier), ways AS (
      SELECT z.a, z.z, 1 AS cost, [z.a, z.z] AS t FROM z JOIN walk w ON w.a = z.a AND w.b = z.z
      UNION ALL SELECT z.a, z.z, 2, [z.a, w.b, z.z] FROM z JOIN walk w ON w.a = z.a JOIN walk v ON v.a = w.b AND v.b = z.z WHERE w.b NOT IN (SELECT id FROM hubs) AND w.b <> z.z
      UNION ALL SELECT z.a, z.z, 3, [z.a, w.b, u.b, z.z] FROM z JOIN walk w ON w.a = z.a JOIN walk u ON u.a = w.b JOIN walk v ON v.a = u.b AND v.b = z.z WHERE w.b NOT IN (SELECT id FROM hubs) AND u.b NOT IN (SELECT id FROM hubs) AND u.b <> z.a AND w.b <> z.z)
      SELECT a, z, place, cost, array_to_string(t, '>') AS trail FROM (SELECT *, row_number() OVER (PARTITION BY a, z ORDER BY cost, t) AS place FROM ways) WHERE place <= 3""",
    "supersession_chains": "SELECT u.a AS id, 'active' AS state, u.b AS \"end\", u.n AS steps FROM dec_up u JOIN decisions d ON d.id = u.b WHERE d.superseded_by IS NULL UNION ALL SELECT u.a, 'missing', u.b, u.n FROM dec_up u WHERE u.b NOT IN (SELECT id FROM decisions)",
    "resolve_text": """, q AS (SELECT DISTINCT upper(p_name) AS q FROM part UNION SELECT 'Customer:' || c_custkey FROM customer UNION SELECT 'alt ' || n_name FROM nation),
      hits AS (
        SELECT q, id, 0 AS tier, 0 AS r FROM q JOIN nodes ON lower(trim(q)) = lower(id) UNION ALL SELECT q, id, 1, CASE status WHEN 'archived' THEN 1 ELSE 0 END FROM q JOIN nodes ON lower(trim(q)) = lower(trim(alias))
        UNION ALL SELECT q, id, 2, 0 FROM q JOIN nodes ON lower(trim(q)) = CAST(k AS VARCHAR) UNION ALL SELECT q, id, 3, 0 FROM q JOIN nodes ON trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))),
      best AS (SELECT q, min((tier, r)) AS m FROM hits GROUP BY q)
      SELECT q, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, tier, count(DISTINCT id) > 1 AS ambiguous FROM hits JOIN best USING (q) WHERE (tier, r) = m GROUP BY q, tier""",
    "bridge_candidates": """, l AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM nodes WHERE status <> 'archived'), c AS (SELECT DISTINCT record_id, src FROM prov),
      k AS (SELECT id, ns, kind, key AS own, key FROM l UNION SELECT id, ns, kind, key, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) FROM l WHERE alias IS NOT NULL AND NOT contains(alias, ':')),
      m AS (SELECT *, regexp_replace(key, '[0-9]+', '#', 'g') AS mask, list_distinct(string_split(key, ' ')) AS words FROM l WHERE key <> ''), ends AS (SELECT ns, kind, min(mask) AS lo, max(mask) AS hi FROM m GROUP BY ALL),
      xs AS MATERIALIZED (SELECT m.* FROM m JOIN ends e ON e.kind = m.kind AND m.ns = 'a' AND e.ns = 'b' WHERE lo <> mask OR hi <> mask), ys AS MATERIALIZED (SELECT m.* FROM m JOIN ends e ON e.kind = m.kind AND m.ns = 'b' AND e.ns = 'a' WHERE lo <> mask OR hi <> mask),
      alike AS (SELECT x.id AS a, y.id AS b, damerau_levenshtein(x.key, y.key) AS d, length(x.key) >= 6 AND length(y.key) >= 6 AS long, len(list_intersect(x.words, y.words)) AS met, len(x.words) + len(y.words) AS total FROM xs x JOIN ys y ON x.kind = y.kind AND x.mask <> y.mask),
      found AS (SELECT x.id AS a, y.id AS b, CASE WHEN x.kind = y.kind THEN 1.0 ELSE 0.7 END::DOUBLE AS score, 'name' AS why FROM l x JOIN l y ON x.key = y.key AND x.key <> '' AND x.ns = 'a' AND y.ns = 'b'
        UNION ALL SELECT x.id, y.id, 1.0::DOUBLE, 'alias' FROM k x JOIN k y ON x.key = y.key AND x.kind = y.kind AND x.key <> '' AND x.own <> y.own AND x.ns = 'a' AND y.ns = 'b'
        UNION ALL SELECT a, b, round(greatest(0.5, 0.8 - 0.1 * least(d, 3)), 4)::DOUBLE, 'fuzzy' FROM alike WHERE (d <= 2 AND long) OR 5 * met >= 3 * (total - met)
        UNION ALL SELECT x.id, y.id, 0.5::DOUBLE, 'source' FROM l x JOIN c p ON p.record_id = x.id JOIN c q ON q.src = p.src JOIN l y ON y.id = q.record_id AND x.kind = y.kind WHERE x.ns = 'a' AND y.ns = 'b')
      SELECT a, b, max(score) AS score, arg_max(why, (score, why <> 'source')) AS why FROM found GROUP BY a, b""",
    "vocabulary": "SELECT word, count(*) AS n FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', id, name)), '([a-z0-9]+)', 1))) AS word FROM nodes) WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY word",
    "budget_prefix": "SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS subject, turn AS rank, length(text) + 1 AS size, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1200",
    "scope_overlaps": "SELECT c.id, d.id AS scope_id FROM nodes c JOIN decisions d ON c.kind = 'customer' AND (d.scope = c.id OR starts_with(d.scope, c.id || '#'))",
    "answer_fold": """, f AS (SELECT q, node, arg_max(struct_pack(seq := seq, status := status), (ts, seq)) AS l, arg_max(struct_pack(seq := seq, status := status), (ts, seq)) FILTER (status NOT IN ('skipped', 'later')) AS m, count(*) FILTER (status = 'skipped') AS skips, max(ts) AS asked FROM answers GROUP BY q, node)
      SELECT q, node, CASE WHEN m.status = 'answered' THEN m.status ELSE l.status END AS status, CASE WHEN m.status = 'answered' THEN m.seq ELSE l.seq END AS seq, skips, epoch_us(asked) AS asked FROM f""",
    "sessions": ", s AS (SELECT *, sum(o) OVER (PARTITION BY node ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY node ORDER BY ts, seq) <= 10800000000 THEN 0 ELSE 1 END AS o FROM answers)) SELECT node, session, count(*) AS n, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM s GROUP BY ALL",
    "activity_daily": "SELECT epoch_us(date_trunc('day', ts)) AS start, status, count(*) AS n FROM answers GROUP BY ALL",
    "activity_sliding_week": "SELECT epoch_us(date_trunc('day', ts)) - d * 86400000000 AS start, status, count(*) AS n FROM answers, range(7) t(d) GROUP BY ALL",
    "changes_since": "SELECT status, count(*) AS n FROM answers WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY status",
    "history_change": """, l AS (SELECT key, max(ts) AS ts, arg_max(value, ts) AS value FROM points GROUP BY key), c AS (SELECT l.*, p.ts AS base_at, p.value AS base, row_number() OVER (PARTITION BY l.key ORDER BY abs(epoch_us(l.ts) - 7 * 86400000000 - epoch_us(p.ts)), p.ts) AS r FROM l JOIN points p ON p.key = l.key AND epoch_us(l.ts) - epoch_us(p.ts) >= 3.5 * 86400000000)
      SELECT key, epoch_us(ts) AS "at", value, epoch_us(base_at) AS base_at, base, round(value - base, 6) AS delta FROM c WHERE r = 1""",
    "history_points": "SELECT key, epoch_us(ts) AS \"at\", value FROM (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY ts) AS b, row_number() OVER (PARTITION BY key ORDER BY ts) AS r FROM points) WHERE r = 1 OR value IS DISTINCT FROM b",
    "source_store": "SELECT id, bytes, lines, doc_id, copies, supersedes FROM store",
    "stale_sources": "SELECT id FROM store WHERE stale_after_days > 0 AND captured + stale_after_days * 86400 < 1704067200 + 86400 * 30 AND id NOT IN (SELECT supersedes FROM store WHERE supersedes IS NOT NULL)",
    "qualified_edges": "SELECT 'e-' || substr(sha256('x/' || src || chr(31) || rel || chr(31) || 'x/' || dst || chr(31) || coalesce(key, '')), 1, 12) AS id, id AS upstream, 'x/' || src AS src, 'x/' || dst AS dst, 'x' AS ns FROM edges",
    "merge_imported": ", u AS (SELECT id, status, 'a' AS ns FROM edges UNION ALL SELECT id, CASE WHEN conf > 0.65 THEN 'archived' ELSE status END, 'b' FROM edges WHERE conf > 0.35) SELECT id, arg_min(status, (status = 'archived', ns)) AS status, array_to_string(list_sort(list(DISTINCT ns)), ',') AS origins, count(DISTINCT status) > 1 AS disagree FROM u GROUP BY id",
    "snapshot_diff": "SELECT coalesce(s.id, o.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN o.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM snapshot s FULL JOIN ours o ON s.id = o.id WHERE s.id IS NULL OR o.id IS NULL OR (s.name, s.status, s.conf) IS DISTINCT FROM (o.name, o.status, o.conf)",
    "three_way_merge": """, m AS (SELECT b.id, (b.name, b.status, b.conf) AS b, CASE WHEN o.id IS NOT NULL THEN (o.name, o.status, o.conf) END AS o, (t.name, t.status, t.conf) AS t FROM snapshot b LEFT JOIN ours o USING (id) LEFT JOIN theirs t USING (id)),
      k AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t THEN 'ours' WHEN b IS NOT DISTINCT FROM o THEN 'theirs' WHEN b IS NOT DISTINCT FROM t THEN 'ours' ELSE 'conflict' END AS taken FROM m)
      SELECT id, taken, taken = 'conflict' AS conflict, CASE WHEN taken = 'theirs' THEN t IS NULL ELSE o IS NULL END AS removed FROM k""",
    "exported_edges": "SELECT id, src, dst FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE ns = 'b') AND dst NOT IN (SELECT id FROM nodes WHERE ns = 'b')",
    "exported_sources": "SELECT id FROM texts WHERE id IN (SELECT src FROM prov WHERE record_id IN (SELECT id FROM nodes WHERE ns <> 'b'))",
    "hidden_names": "SELECT DISTINCT lower(trim(name)) AS name FROM nodes WHERE kind = 'part' AND conf > 0.05 AND lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM nodes WHERE NOT (kind = 'part' AND conf > 0.05))",
    "extraction_eval": ", g AS (SELECT p_name, p_brand FROM part), f AS (SELECT p_name, CASE WHEN p_size > 25 THEN p_brand ELSE 'Brand#11' END AS p_brand FROM part), h AS (SELECT count(*) AS hit FROM (SELECT * FROM g INTERSECT ALL SELECT * FROM f)) SELECT hit, gold, found, round(hit / found, 6) AS precision, round(hit / gold, 6) AS recall, round(2 * hit / (gold + found), 6) AS f1 FROM h, (SELECT count(*) AS gold FROM g), (SELECT count(*) AS found FROM f)",
    "merge_targets": "SELECT drop_ AS drop, keep FROM targets",
    "apply_archive": ", x AS (SELECT id FROM nodes WHERE trust = 'agent') SELECT rel, CASE WHEN src IN (SELECT id FROM x) OR dst IN (SELECT id FROM x) THEN 'archived' ELSE status END AS status, count(*) AS n FROM edges GROUP BY ALL",
    "apply_merges_nodes": """, more AS (SELECT t.keep AS id, list(n.alias) FILTER (n.alias IS NOT NULL) AS al, list(n.name) AS nm FROM targets t JOIN nodes n ON n.id = t.drop_ GROUP BY 1)
      SELECT n.id, CASE WHEN t.keep IS NOT NULL THEN 'archived' ELSE n.status END AS status, t.keep AS superseded_by,
        coalesce(array_to_string(list_sort(CASE WHEN m.id IS NOT NULL THEN list_filter(list_distinct(list_concat(CASE WHEN n.alias IS NULL THEN []::VARCHAR[] ELSE [n.alias] END, coalesce(m.al, []::VARCHAR[]), m.nm)), lambda x: x <> n.name) ELSE CASE WHEN n.alias IS NULL THEN []::VARCHAR[] ELSE [n.alias] END END), '|'), '') AS aliases
      FROM nodes n LEFT JOIN more m USING (id) LEFT JOIN targets t ON t.drop_ = n.id""",
    "apply_updates": "SELECT id, CASE kind WHEN 'part' THEN upper(name) ELSE name END AS name, CASE kind WHEN 'part' THEN 'archived' ELSE status END AS status, array_to_string(list_sort(list_distinct(list_filter([alias, CASE WHEN kind = 'part' AND upper(name) <> name THEN name END], lambda x: x IS NOT NULL))), '|') AS aliases, CASE kind WHEN 'part' THEN '\"new\"' END AS brand, CAST(NULL AS VARCHAR) AS type FROM nodes",
    "upsert_edges": """, fresh AS (SELECT DISTINCT 'e-' || substr(sha256(least(src, dst) || chr(31) || rel || chr(31) || greatest(src, dst) || chr(31) || CASE WHEN conf > 0.45 THEN 'k' ELSE '' END), 1, 12) AS id, least(src, dst) AS src, greatest(src, dst) AS dst, CASE WHEN conf > 0.45 THEN 'k' END AS key FROM edges WHERE rel = 'same_as')
      SELECT id, src, dst, key, CASE WHEN id IN (SELECT id FROM fresh) THEN greatest(conf, 0.95) ELSE conf END AS conf FROM edges WHERE rel = 'same_as' UNION ALL SELECT id, src, dst, key, 0.95 FROM fresh WHERE id NOT IN (SELECT id FROM edges)""",
    "erase_quotes": "SELECT record_id, ord, src, loc, CASE WHEN record_id LIKE 'supplier:%' THEN NULL ELSE quote END AS quote FROM prov",
    "op_problems": """, o AS (SELECT prop_id, n, CASE WHEN n > 7 THEN 'archive' ELSE op END AS op, CASE WHEN n = 1 THEN 'r1' END AS ref, CASE n WHEN 2 THEN '$r1' WHEN 3 THEN '$r9' ELSE kind || ':' || (n * 40) END AS target, CASE WHEN n = 8 THEN 9 ELSE 36 END AS reason FROM reviews), h AS (SELECT DISTINCT prop_id FROM o WHERE ref = 'r1')
      SELECT * FROM (SELECT o.prop_id, n, CASE WHEN starts_with(target, '$') AND NOT (target = '$r1' AND o.prop_id IN (SELECT prop_id FROM h)) THEN 'open_handle' WHEN NOT starts_with(target, '$') AND x.id IS NULL THEN 'unknown_target' WHEN x.status = 'archived' THEN 'archived_target' WHEN op IN ('merge', 'archive') AND reason < 20 THEN 'short_reason' END AS problem FROM o LEFT JOIN nodes x ON x.id = target) WHERE problem IS NOT NULL""",
    "verdict_states": "SELECT kind, CASE verdict WHEN 'accept' THEN 'confirmed' WHEN 'draft' THEN 'proposed' END AS status, CASE verdict WHEN 'accept' THEN 'reviewed' WHEN 'draft' THEN 'agent' END AS trust, count(*) AS n FROM reviews GROUP BY ALL",
    "failed_expectations": "SELECT id, 'status' AS field FROM nodes WHERE status <> 'confirmed'",
    "csv_lines": "SELECT c_custkey, 'row ' || c_custkey || ': ' || concat_ws(' | ', 'c_name=' || c_name, CASE WHEN c_acctbal > 0 THEN 'c_mktsegment=' || c_mktsegment END, 'c_nationkey=' || c_nationkey) AS line FROM customer",
    "find_text": "SELECT 'events' AS \"table\", CAST(event_id AS VARCHAR) AS id, 'event_type' AS path FROM events WHERE event_type = 'purchase'",
    "redacted_notes": """, o AS (SELECT o_orderkey AS key, c_custkey AS k, c_name, r_name, c_nationkey % 3 = 2 AS hc, r_regionkey >= 3 AS hr, '[local record]' AS m
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT key, 'Placed by ' || CASE WHEN hc THEN m ELSE c_name END || ' as ' || CASE WHEN hc THEN m ELSE 'self/customer:' || k END || ', not x/customer:' || k || '; see ' || CASE WHEN hc THEN m ELSE 'customer:' || k END
    || '.txt, ' || CASE WHEN hc THEN m ELSE 'Customer-' || k END || ' and ' || CASE WHEN hc AND k % 4 = 0 THEN m WHEN hc THEN 'alt ' || m ELSE 'alt ' || c_name END || ', from ' || CASE WHEN hr THEN m ELSE r_name END
    || ' or ' || CASE WHEN hr AND contains(r_name, ' ') THEN m ELSE lower(r_name) END AS clean FROM o""",
    "canonical_lines": "SELECT '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' AS value FROM customer",
}

REVIEWED = """, reviewed AS (SELECT *, kind || ':' || k AS target FROM (
  SELECT prop_id, n, CASE WHEN n > 8 THEN 'merge' WHEN n > 7 THEN 'archive' WHEN n > 5 THEN 'update_node' ELSE op END AS op, kind, verdict, CAST(substr(prop_id, 6) AS BIGINT) * 10 + n AS k FROM reviews)),
asks AS (
  SELECT prop_id, n, target AS id, 'orphan' AS gap, NULL AS want FROM reviewed WHERE op = 'add_edge'
  UNION ALL SELECT prop_id, n, target, 'missing_relation', CASE kind WHEN 'order' THEN 'contains' WHEN 'customer' THEN 'located_in' ELSE 'same_as' END || ' out' FROM reviewed WHERE op = 'add_edge'
  UNION ALL SELECT prop_id, n, CASE kind WHEN 'order' THEN 'part:' || k WHEN 'customer' THEN 'nation:' || k % 25 ELSE 'part:' || (k + 1) END, 'orphan', NULL FROM reviewed WHERE op = 'add_edge'
  UNION ALL SELECT prop_id, n, CASE kind WHEN 'order' THEN 'part:' || k WHEN 'customer' THEN 'nation:' || k % 25 ELSE 'part:' || (k + 1) END, 'missing_relation', CASE kind WHEN 'order' THEN 'contains' WHEN 'customer' THEN 'located_in' ELSE 'same_as' END || ' in' FROM reviewed WHERE op = 'add_edge'
  UNION ALL SELECT prop_id, n, target, 'thin', NULL FROM reviewed WHERE op = 'update_node'
  UNION ALL SELECT prop_id, n, target, 'missing_field', CASE kind WHEN 'order' THEN 'priority' WHEN 'customer' THEN 'segment' ELSE 'brand' END FROM reviewed WHERE op = 'update_node' AND n <> 7),
closed AS (SELECT prop_id, n, a.id, a.gap, g.detail, g.severity FROM asks a JOIN gaps g ON g.id = a.id AND g.gap = a.gap AND (want IS NULL OR want = g.detail)),
props AS (SELECT prop_id, n_ops, drafts, CAST(coalesce(s, 0) + 3 * merges AS BIGINT) AS closes, CAST(10 * (coalesce(s, 0) + 3 * merges) + 5 * n_ops AS BIGINT) AS priority
  FROM (SELECT prop_id, count(*) AS n_ops, count(*) FILTER (verdict = 'draft') AS drafts, count(*) FILTER (op = 'merge') AS merges FROM reviewed GROUP BY prop_id) LEFT JOIN (SELECT prop_id, sum(severity) AS s FROM closed GROUP BY 1) USING (prop_id)),
waiting AS (SELECT count(*) FILTER (drafts > 0) AS pending, count(*) FILTER (drafts > 0) > 20 AS "over" FROM props)
"""
FULL_DECISIONS = ", told AS (SELECT d.*, 'which segment fits ' || lower(c_name) || '? ' || lower(c_mktsegment) AS hay, lower(c_mktsegment) AS chosen, c_custkey FROM decisions d JOIN customer ON d.id = 'dec-' || c_custkey)\n"

SQL |= {
    "split_namespaces": "SELECT ns || '/' || id AS id, ns, id AS local FROM nodes UNION ALL SELECT id, 'self', id FROM nodes",
    "effective_kinds": "SELECT DISTINCT u.id, coalesce(n.kind, split_part(u.id, ':', 1)) AS kind FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) u LEFT JOIN nodes n ON n.id = u.id",
    "record_marks": "SELECT id, concat_ws(' ', CASE WHEN trust = 'untrusted' THEN 'untrusted' END, CASE status WHEN 'proposed' THEN 'draft' WHEN 'archived' THEN 'archived' END) AS marks FROM nodes",
    "kind_filter": "SELECT id FROM nodes WHERE status <> 'archived' AND kind IN ('part', 'supplier', 'region')",
    "relation_filter": "SELECT id, other, label, edge_id FROM expanded WHERE label = 'contained_in' OR (rel = 'supplies' AND direction = 'out')",
    "decision_filter": FULL_DECISIONS + "SELECT id, chosen FROM told WHERE status = 'active' AND contains(hay, 'segment') AND contains(hay, 'fits') AND contains(hay, 'building')",
    "edge_counts": "SELECT count(*) AS edges, count(*) FILTER (status = 'proposed') AS drafts, count(*) FILTER (background) AS background, count(*) FILTER (status = 'archived') AS archived FROM edges",
    "breakdown_relations": "SELECT rel, status, count(*) AS n FROM edges GROUP BY ALL",
    "card_counts": "SELECT e.id, label, count(DISTINCT other) AS others FROM expanded e LEFT JOIN classes x ON x.id = e.id LEFT JOIN classes y ON y.id = e.other WHERE NOT background AND NOT (rel = 'same_as' AND coalesce(x.class_id = y.class_id, FALSE)) GROUP BY ALL",
    "record_views": """, src AS (SELECT record_id AS id, string_agg(src, ',' ORDER BY src) AS sources FROM (SELECT DISTINCT record_id, src FROM prov) GROUP BY 1),
      lacks AS (SELECT id, string_agg(gap, ',' ORDER BY gap) AS gaps FROM (SELECT DISTINCT id, gap FROM gaps) GROUP BY 1),
      decs AS (SELECT split_part(scope, '#', 1) AS id, string_agg(id, ',' ORDER BY id) AS decisions FROM decisions GROUP BY 1)
      SELECT n.id, name, status, coalesce(degree, 0) AS degree, coalesce(sources, '') AS sources, coalesce(gaps, '') AS gaps, coalesce(decisions, '') AS decisions
      FROM nodes n LEFT JOIN degrees USING (id) LEFT JOIN src USING (id) LEFT JOIN lacks USING (id) LEFT JOIN decs USING (id) WHERE kind = 'customer'""",
    "degree_page": "SELECT *, (SELECT count(*) FROM degrees) AS total FROM degrees ORDER BY degree DESC, id LIMIT 50 OFFSET 100",
    "history_page": "SELECT key, epoch_us(ts) AS at, value, (SELECT count(*) FROM points) AS total FROM points ORDER BY ts DESC, key LIMIT 20 OFFSET 10",
    "newest_decisions": FULL_DECISIONS + "SELECT id, (1704067200 + c_custkey * 600) * 1000000 AS at, status, (SELECT count(*) FROM decisions) AS total FROM told ORDER BY c_custkey DESC LIMIT 100",
    "next_questions": """, scored AS (SELECT g.id, gap, detail, round(30 + 100 * (1 - coalesce(c.coverage, 1)) + 20 * severity * log2(2 + coalesce(d.degree, 0)), 2) AS score FROM gaps g JOIN nodes n USING (id) LEFT JOIN degrees d USING (id)
      LEFT JOIN coverage c ON c.dimension = CASE n.kind WHEN 'region' THEN 'geography' WHEN 'nation' THEN 'geography' WHEN 'customer' THEN 'market' WHEN 'order' THEN 'market' WHEN 'supplier' THEN 'supply' ELSE 'catalogue' END)
      SELECT *, CAST(row_number() OVER (ORDER BY score DESC, gap, id, detail) AS INTEGER) AS place FROM scored ORDER BY place LIMIT 100""",
    "topic_gaps": REVIEWED + """SELECT 'missing_dimension' AS gap, dimension AS detail, 9 AS severity FROM coverage WHERE coverage < 0.5
      UNION ALL SELECT DISTINCT 'unbridged_import', ns, 6 FROM nodes WHERE ns NOT IN (SELECT unnest([s.ns, d.ns]) FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE rel = 'located_in' AND s.ns <> d.ns)
      UNION ALL SELECT 'uncited_source', id, 3 FROM texts WHERE id NOT IN (SELECT src FROM prov) UNION ALL SELECT 'pending_backlog', CAST(pending AS VARCHAR), 2 FROM waiting WHERE pending > 0""",
    "proposal_priorities": REVIEWED + "SELECT * FROM props",
    "pending_page": REVIEWED + "SELECT prop_id, priority, (SELECT count(*) FROM props WHERE drafts > 0) AS total FROM props WHERE drafts > 0 ORDER BY priority DESC, prop_id LIMIT 50",
    "backlog": REVIEWED + "SELECT * FROM waiting",
    "destructive_ops": REVIEWED + "SELECT prop_id, n, op, target FROM reviewed WHERE op IN ('archive', 'merge') OR (op = 'update_node' AND target IN (SELECT id FROM nodes WHERE status = 'confirmed'))",
    "undraftable_ops": REVIEWED + "SELECT prop_id, n, op FROM reviewed WHERE op IN ('archive', 'merge') AND verdict = 'draft'",
    "same_content": ", content AS (SELECT prop_id, string_agg(x, '|' ORDER BY x) AS c FROM (SELECT 'prop-' || l_orderkey || '-' || l_linenumber AS prop_id, l_returnflag || ' ' || CAST(floor(l_quantity / 10) AS BIGINT) || ' ' || l_partkey AS x FROM lineitem) GROUP BY 1) SELECT prop_id, f AS same_as FROM (SELECT prop_id, min(prop_id) OVER (PARTITION BY c) AS f FROM content) WHERE prop_id <> f",
    "closed_gaps": REVIEWED + "SELECT * FROM closed",
    "log_union": "SELECT DISTINCT seq, q, node, status FROM answers WHERE seq % 3 <> 0 OR seq % 2 = 0",
    "short_edge_ids": ", h AS (SELECT substr(id, 3, 12) AS id FROM edges), cut AS (SELECT id, l.n, substr(id, 1, l.n) AS p FROM h, (SELECT unnest([4, 6, 8, 10, 12]) AS n) l), alone AS (SELECT min(id) AS id, n FROM cut GROUP BY n, p HAVING count(*) = 1) SELECT h.id, substr(h.id, 1, CAST(coalesce(min(n), 12) AS BIGINT)) AS short FROM h LEFT JOIN alone USING (id) GROUP BY h.id",
    "warnings": REVIEWED + "SELECT 'W01' AS code, count(*) AS n FROM gaps WHERE gap = 'missing_field' UNION ALL SELECT 'W02', count(*) FROM gaps WHERE gap = 'orphan' UNION ALL SELECT 'W04', count(*) FROM touch UNION ALL SELECT 'W05', count(*) FROM (" + SQL["stale_sources"] + ") UNION ALL SELECT 'W06', count(*) FROM waiting WHERE \"over\"",
    "named_records": """, asked AS (SELECT DISTINCT upper(p_name) AS q FROM part UNION SELECT 'Alt-' || n_name FROM nation UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier),
      keys AS (SELECT id, 1 AS tier, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM nodes WHERE status <> 'archived' UNION ALL SELECT id, 2, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) FROM nodes WHERE status <> 'archived' AND alias IS NOT NULL UNION ALL SELECT id, 3, split_part(id, ':', 2) FROM nodes WHERE status <> 'archived'),
      hits AS (SELECT q, id, min(tier) AS tier FROM asked JOIN keys ON key = trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL)
      SELECT q, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM hits) WHERE tier = best""",
    "text_measures": r"SELECT doc_id, CAST(ceil(length(t) / 4) AS BIGINT) AS tokens, CASE WHEN length(o) > 60 THEN rtrim(substr(o, 1, 57)) || '...' ELSE o END AS brief FROM (SELECT doc_id, translate(text, chr(13) || chr(9), '  ') AS t, regexp_replace(translate(text, chr(13) || chr(9), '  '), '\s*\n\s*', ' ', 'g') AS o FROM documents)",
    "suggestions": f""", vocab AS ({SQL["vocabulary"]}), asked AS (SELECT DISTINCT substr(w, 1, 2) || substr(w, 4) AS q FROM (SELECT split_part(p_name, ' ', 1) AS w FROM part)),
      near AS (SELECT q, word, n, CAST(damerau_levenshtein(lower(q), word) AS INTEGER) AS d FROM asked, vocab WHERE abs(length(q) - length(word)) <= 2)
      SELECT q, word, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, abs(length(q) - length(word)), n DESC, word) AS r FROM near WHERE d <= CASE WHEN length(q) <= 5 THEN 1 ELSE 2 END) WHERE r = 1""",
    "secret_scan": r"""SELECT doc_id, CAST(line AS INTEGER) AS line, kind, substr(found, 1, 6) AS prefix FROM (SELECT doc_id, line, kind, unnest(regexp_extract_all(t, rule)) AS found FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM documents), (VALUES RULES) r(kind, rule))""",
}
CLAIMS = """, claims AS (
  SELECT 'part:' || l_partkey AS src, 'order:' || l_orderkey AS dst, CASE WHEN l_quantity > 35 THEN 'archived' ELSE 'confirmed' END AS status, l_quantity > 35 AND l_linenumber = 1 AS with_node FROM lineitem WHERE l_linenumber <= 2),
latest AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1),
alive AS (SELECT DISTINCT c.src, c.dst FROM claims c JOIN orders ON dst = 'order:' || o_orderkey WHERE c.status <> 'archived' AND o_orderstatus IN ('F', 'O')),
premises AS (SELECT DISTINCT c.src AS id, c.dst AS premise FROM claims c JOIN orders ON dst = 'order:' || o_orderkey JOIN latest USING (o_custkey) WHERE o_orderstatus = 'P' AND (c.status <> 'archived' OR with_node) AND (c.src, 'order:' || last) NOT IN (SELECT src, dst FROM alive)),
broken AS (SELECT e.id AS edge_id, u.id, u.other, CASE WHEN f.id IS NULL THEN 'absent' ELSE 'archived' END AS why FROM edges e, LATERAL (SELECT e.src AS id, e.dst AS other UNION ALL SELECT e.dst, e.src) u LEFT JOIN nodes f ON f.id = u.other
  WHERE e.status <> 'archived' AND NOT e.background AND (f.id IS NULL OR f.status = 'archived') AND u.id IN (SELECT id FROM own)),
drafted AS (SELECT DISTINCT x.id, x.other FROM expanded x JOIN edges e ON e.id = x.edge_id WHERE e.status = 'proposed' AND NOT x.background),
notes AS (SELECT id, concat_ws(', ', string_agg(other, ', ' ORDER BY other) FILTER (r <= 3), CASE WHEN max(r) > 3 THEN '+' || (max(r) - 3) || ' more' END) AS note FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) AS r FROM drafted) GROUP BY id),
stale AS (STALE),
loads AS (SELECT *, 0 AS line FROM snapshot UNION ALL SELECT *, 1 FROM ours UNION ALL SELECT id, name, status, conf, 2 FROM theirs)
""".replace("STALE", SQL["stale_sources"])
_op_rows, _op_bad = SQL["op_problems"].split("SELECT * FROM (SELECT o.prop_id", 1)
SQL |= {
    "archived_premises": CLAIMS + "SELECT * FROM premises",
    "broken_bridges": CLAIMS + "SELECT id, other, edge_id, why FROM broken",
    "draft_links": CLAIMS + "SELECT * FROM notes",
    "settled_conflicts": """, c AS (SELECT 'customer:' || c_custkey AS id, 'customer:' || CAST(c_custkey // 5 * 5 AS BIGINT) AS class_id FROM customer),
      torn AS (SELECT class_id, field FROM attrs JOIN c USING (id) GROUP BY ALL HAVING count(DISTINCT value) > 1)
      SELECT DISTINCT class_id, split_part(scope, '#attrs.', 2) AS field FROM decisions JOIN c ON c.id = split_part(scope, '#attrs.', 1) WHERE CAST(substr(decisions.id, 5) AS BIGINT) % 10 > 0 AND contains(scope, '#attrs.') AND (class_id, split_part(scope, '#attrs.', 2)) IN (SELECT class_id, field FROM torn)""",
    "linked_gaps": CLAIMS + """, torn AS (SELECT class_id, field FROM attrs JOIN classes USING (id) WHERE id IN (SELECT id FROM own) GROUP BY ALL HAVING count(DISTINCT value) > 1), pair AS (SELECT 'customer:' || c_custkey AS a, 'customer:' || (c_custkey + 1) AS b FROM customer WHERE c_custkey % 50 = 0),
      found AS (SELECT a AS id, 'contradiction' AS gap, 8 AS severity, b AS detail FROM pair UNION ALL SELECT b, 'contradiction', 8, a FROM pair UNION ALL SELECT id, 'conflict', 8, field FROM torn JOIN classes USING (class_id) UNION ALL SELECT id, 'archived_premise', 7, premise FROM premises
        UNION ALL SELECT DISTINCT id, 'dangling_bridge', 5, other FROM broken WHERE why = 'absent' UNION ALL SELECT id, 'draft_link', 3, note FROM notes UNION ALL SELECT DISTINCT record_id, 'stale_source', 3, src FROM prov WHERE src IN (SELECT id FROM stale))
      SELECT * FROM found WHERE id IN (SELECT id FROM own)""",
    "first_records": CLAIMS + "SELECT x.id, x.line, CASE WHEN x.name = f.name AND x.status = f.status AND x.conf = f.conf THEN 'P05' ELSE 'P06' END AS code FROM loads x JOIN (SELECT id, min(line) AS first FROM loads GROUP BY 1) m USING (id) JOIN loads f ON f.id = x.id AND f.line = m.first WHERE x.line <> m.first",
    "log_disorder": "SELECT seq FROM (SELECT seq, t, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT seq, CASE WHEN seq % 11 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS t FROM answers)) WHERE t < m",
    "missing_references": """, changes AS (SELECT 'chg-' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'prop-none' WHEN doc_id % 5 > 0 THEN 'prop-' || CAST(doc_id // 10 AS BIGINT) END AS proposal, unnest(['part:' || doc_id, 'order:' || doc_id]) AS record FROM labels)
      SELECT DISTINCT id, proposal AS missing FROM changes WHERE proposal IS NOT NULL AND proposal NOT IN (SELECT prop_id FROM reviews) UNION ALL SELECT id, record FROM changes WHERE record NOT IN (SELECT id FROM nodes)""",
    "narrowed_decisions": "SELECT 'dec-' || c_custkey AS id, 'dec-' || (c_custkey - 1) AS narrows FROM customer WHERE c_custkey % 10 = 2 AND 'dec-' || (c_custkey - 1) IN (SELECT id FROM decisions WHERE status = 'superseded')",
    "pending_block": "SELECT count(*) AS pending, CAST(max(DATE '2024-06-01' - created) AS INTEGER) AS oldest_days, count(*) > 20 AS \"over\" FROM (SELECT DISTINCT prop_id, DATE '2024-01-01' + CAST(CAST(substr(prop_id, 6) AS INTEGER) % 90 AS INTEGER) AS created FROM reviews WHERE verdict = 'draft')",
    "path_values": """, p(path) AS (VALUES ('attrs.brand'), ('attrs.segment'), ('name'), ('status'), ('summary'), ('gaps.x'))
      SELECT n.id, path, CASE path WHEN 'name' THEN n.name WHEN 'status' THEN n.status WHEN 'summary' THEN n.summary ELSE a.value END AS value FROM nodes n CROSS JOIN p LEFT JOIN attrs a ON a.id = n.id AND 'attrs.' || a.field = path""",
    "distinct_provenance": "SELECT record_id, CAST(min(ord) AS INTEGER) AS ord, src, loc, quote FROM prov GROUP BY record_id, src, loc, quote",
    "refresh_tools": """, own_tools AS (SELECT 'src-' || substr(sha256(text), 1, 12) AS src, doc_id FROM documents), offered AS (SELECT src, 'tool:' || (doc_id % 9) AS tool, 1 AS place FROM own_tools WHERE doc_id % 4 = 0 UNION ALL SELECT src, 'tool:' || (doc_id % 5), 2 FROM own_tools WHERE doc_id % 3 = 0
      UNION ALL SELECT src, 'tool:' || (CAST(substr(record_id, 10) AS BIGINT) % 6), 3 FROM prov WHERE starts_with(record_id, 'supplier:') AND src IN (SELECT src FROM own_tools)) SELECT src, tool, min(place) AS place FROM offered GROUP BY ALL""",
    "recited_proposals": REVIEWED + """SELECT prop_id, n, target, CASE n % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'v1' END AS pin, (CASE n % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, target) NOT IN (SELECT ns, id FROM nodes) AS stale FROM reviewed""",
    "risk_findings": """, rated AS (SELECT 'order:' || l_orderkey AS id, l_returnflag AS dimension, max(CAST(l_quantity AS BIGINT) % 5 + 1) FILTER (l_linenumber % 3 = 0) AS impact, max(CAST(l_quantity AS BIGINT) % 5 + 1) FILTER (l_linenumber % 3 = 1) AS inherent, max(CAST(l_quantity AS BIGINT) % 5 + 1) FILTER (l_linenumber % 3 = 2) AS residual FROM lineitem GROUP BY ALL),
      cover AS (SELECT 'order:' || l_orderkey AS id, bool_or(l_returnflag IN ('R', 'A')) AS covered, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS firm FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
      x AS (SELECT r.*, coalesce(covered, FALSE) AS covered, coalesce(firm, FALSE) AS firm FROM rated r LEFT JOIN cover USING (id))
      SELECT id, dimension, 'unrated' AS finding FROM x WHERE impact IS NULL OR inherent IS NULL OR residual IS NULL UNION ALL SELECT id, dimension, 'inherent over impact' FROM x WHERE inherent > impact UNION ALL SELECT id, dimension, 'residual over inherent' FROM x WHERE residual > inherent
      UNION ALL SELECT id, dimension, 'no control' FROM x WHERE residual < inherent AND NOT covered UNION ALL SELECT id, dimension, 'no automated control' FROM x WHERE inherent - residual >= 2 AND NOT firm""",
    "sound_proposals": f"{_op_rows}, bad AS (SELECT * FROM (SELECT o.prop_id{_op_bad}) SELECT prop_id, count(*) AS n FROM o WHERE prop_id NOT IN (SELECT prop_id FROM bad) GROUP BY 1",
    "cue_lines": r"""SELECT conv_id, turn, string_agg('T00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0') || ' ' || said, chr(10) ORDER BY i) AS cue FROM (
      SELECT conv_id, turn, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace('<v ' || role || '>' || line || '</v>', '<v(?:\.[^ >]*)? ([^>]+)>', '\1: ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS said
      FROM (SELECT conv_id, turn, role, unnest(string_split_regex(text, '\r\n?|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n?|\n'), 1) AS i FROM conversations)) GROUP BY ALL""",
    "apply_merges_edges": """, to_ AS (SELECT t.* FROM targets t JOIN nodes n ON n.id = t.keep WHERE n.status <> 'archived'),
      x AS (SELECT e.*, coalesce(a.keep, e.src) AS s, coalesce(b.keep, e.dst) AS d, a.keep IS NOT NULL OR b.keep IS NOT NULL AS touched FROM edges e LEFT JOIN to_ a ON a.drop_ = e.src LEFT JOIN to_ b ON b.drop_ = e.dst),
      moved AS (SELECT CASE WHEN rel = 'same_as' THEN least(s, d) ELSE s END AS src, rel, CASE WHEN rel = 'same_as' THEN greatest(s, d) ELSE d END AS dst, key, status, conf, background FROM x WHERE touched AND status <> 'archived' AND s <> d),
      every AS (SELECT id, src, rel, dst, CASE WHEN touched THEN 'archived' ELSE status END AS status, conf FROM x UNION ALL SELECT 'e-' || substr(sha256(src || chr(31) || rel || chr(31) || dst || chr(31) || coalesce(key, '')), 1, 12), src, rel, dst, status, conf FROM moved),
      best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END, conf DESC) AS r FROM every)
      SELECT rel, status, count(*) AS n, count(DISTINCT src) AS srcs, count(DISTINCT dst) AS dsts FROM best WHERE r = 1 GROUP BY ALL""",
}
_fold_rows, _fold_states = SQL["answer_fold"].rsplit("SELECT q, node", 1)
SQL["interview_progress"] = f"{_fold_rows}, folded AS (SELECT q, node{_fold_states}) SELECT q, count(*) FILTER (status IN ('answered', 'na')) AS answered, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'later') AS open, round(count(*) FILTER (status IN ('answered', 'na')) / count(*), 4) AS share FROM folded GROUP BY q"
_topic_rows, _topic_states = SQL["answer_fold"].replace("FROM answers", "FROM (SELECT * REPLACE ('topic' AS node) FROM answers)").rsplit("SELECT q, node", 1)
SQL["closed_dimensions"] = f"{_topic_rows}, folded AS (SELECT q, node{_topic_states}) SELECT DISTINCT dimension FROM folded JOIN (VALUES ('q0', 'geography'), ('q1', 'market'), ('q2', 'supply'), ('q3', 'catalogue'), ('q4', 'market'), ('q5', 'supply'), ('q6', 'people')) d(q, dimension) USING (q) WHERE status = 'na'"

_gap_rows, _gap_states = SQL["answer_fold"].replace("FROM answers", "FROM (SELECT 'customer:' || substr(node, 6) AS node, 'q.gap.' || ['single_source', 'low_confidence', 'thin', 'missing_field', 'missing_relation', 'orphan', 'draft'][CAST(substr(q, 2) AS INTEGER) + 1] AS q, status, seq, ts FROM answers)").rsplit("SELECT q, node", 1)
GAP_FOLD = f"{_gap_rows}, gap_fold AS (SELECT q, node{_gap_states})"
SQL["open_gaps"] = GAP_FOLD + " SELECT * FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM gap_fold f WHERE f.node = g.id AND f.q = 'q.gap.' || g.gap AND f.status IN ('answered', 'na') AND g.gap IN ('missing_field', 'missing_relation', 'orphan', 'thin', 'low_confidence', 'unconfirmed_hub', 'archived_premise'))"
SQL["paced_questions"] = GAP_FOLD + """, near AS (SELECT DISTINCT other AS id FROM expanded WHERE starts_with(id, 'supplier:')),
  scored AS (SELECT g.id, gap, detail, round(30 + 100 * (1 - coalesce(c.coverage, 1)) + 20 * severity * log2(2 + coalesce(d.degree, 0)) * CASE WHEN e.id IS NULL THEN 1 ELSE 2 END - 30 * coalesce(f.skips, 0) - CASE WHEN epoch_us(TIMESTAMP '2024-01-20 00:00:00') - f.asked <= 172800000000 THEN 300 ELSE 0 END, 2) AS score
    FROM gaps g JOIN nodes n USING (id) LEFT JOIN degrees d USING (id) LEFT JOIN near e USING (id) LEFT JOIN gap_fold f ON f.node = g.id AND f.q = 'q.gap.' || gap
    LEFT JOIN coverage c ON c.dimension = CASE n.kind WHEN 'region' THEN 'geography' WHEN 'nation' THEN 'geography' WHEN 'customer' THEN 'market' WHEN 'order' THEN 'market' WHEN 'supplier' THEN 'supply' ELSE 'catalogue' END)
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, gap, id, detail) AS INTEGER) AS place FROM scored ORDER BY place LIMIT 100"""
SQL["extracted_files"] = """SELECT 'd/' || doc_id || CASE WHEN doc_id % 3 = 2 THEN '.md' ELSE '.TXT' END AS path, CASE WHEN doc_id % 3 = 2 THEN 'md' ELSE 'txt' END AS kind, 'L' AS locator, text, CASE WHEN text IS NULL THEN 'missing' END AS problem FROM documents
  UNION ALL SELECT 'c/' || c_custkey || '.json', 'json', 'L', '{' || chr(10) || ' "name": "' || c_name || '",' || chr(10) || ' "at": [' || chr(10) || '  ' || c_nationkey || ',' || chr(10) || '  ' || c_custkey || '.50' || chr(10) || ' ],' || chr(10) || ' "none": {}' || chr(10) || '}' || chr(10), NULL FROM customer
  UNION ALL SELECT 's/' || s_suppkey || '.csv', 'csv', 'L', 'header: key | col2 | key (2)' || chr(10) || 'row 1: key=' || s_suppkey || ' | key (2)=' || s_name || ' | col4=past' || chr(10), NULL FROM supplier
  UNION ALL SELECT 'n/' || n_nationkey || '.txt', 'txt', 'L', NULL, 'binary' FROM nation"""


#: Words that share a stem with a word of the searches, checked by hand.
FORMS = {"customer#000000007": [], "spring": ["spring", "springs"], "autumn": ["autumn", "autumns"], "order": ["order", "orders", "ordered", "ordering"], "1": [], "part:12": [], "machinery": ["machinery", "machineries"],
         "alt": [], "europe": ["europe"], "regions": ["region", "regions"], "orders": ["order", "orders", "ordered", "ordering"], "77": [], "meated": ["meat", "meats", "meated", "meating"]}


def _asked(q: str) -> str:
    rows = [(q, alt.lower(), alt.lower().split()) for alt in q.split(" OR ")]
    return ", ".join(f"('{q}', '{alt}', {tokens}, [{', '.join(f'CAST({FORMS[t]} AS VARCHAR[])' for t in tokens)}])" for _, alt, tokens in rows)


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[a-z0-9]+')"


SQL["search_tiers"] = f""", asked(q, alt, tokens, forms) AS (VALUES {", ".join(_asked(q) for q in ["customer#000000007", "spring OR autumn", "order 1", "part:12", "machinery", "alt europe", "regions", "orders 77", "meated spring"])}),
  r AS (SELECT *, {_words('nid')} AS sid, {_words('lname')} AS sname, {_words('hay')} AS shay FROM (SELECT id, status, lower(id) AS nid, lower(name) AS lname, lower(concat_ws(' ', name, summary, coalesce(alias, ''))) AS hay, CASE kind WHEN 'customer' THEN 2 WHEN 'supplier' THEN 1 WHEN 'part' THEN 3 ELSE 0 END AS boost FROM nodes)),
  c AS (SELECT r.*, a.*, range(1, len(tokens) + 1) AS ks, list_sum(list_transform(tokens, lambda t: (length(hay) - length(replace(hay, t, ''))) // length(t))) AS n, list_sum(list_transform(tokens, lambda t: greatest(1, (length(hay) - length(replace(hay, t, ''))) // length(t)))) AS m FROM r CROSS JOIN asked a),
  l AS (SELECT *, CASE WHEN nid = alt THEN 1000 WHEN suffix(nid, ':' || alt) OR suffix(nid, '.' || alt) OR suffix(nid, '/' || alt) THEN 600 WHEN contains(nid, alt) THEN 400 WHEN len(list_filter(ks, lambda k: contains(nid, tokens[k]))) = len(ks) THEN 300 WHEN contains(lname, alt) THEN 250
      WHEN len(list_filter(ks, lambda k: contains(nid, tokens[k]) OR contains(lname, tokens[k]))) = len(ks) THEN 150 WHEN len(list_filter(ks, lambda k: contains(hay, tokens[k]))) = len(ks) THEN 20 + least(30, n) ELSE 0 END AS lit,
    CASE WHEN len(list_filter(ks, lambda k: contains(nid, tokens[k]) OR list_has_any(sid, forms[k]))) = len(ks) THEN 290 WHEN len(list_filter(ks, lambda k: contains(nid, tokens[k]) OR list_has_any(sid, forms[k]) OR contains(lname, tokens[k]) OR list_has_any(sname, forms[k]))) = len(ks) THEN 140
      WHEN len(list_filter(ks, lambda k: contains(hay, tokens[k]) OR list_has_any(shay, forms[k]))) = len(ks) THEN 10 + least(30, m) ELSE 0 END AS st FROM c),
  s AS (SELECT q, id, status, boost, max(CASE WHEN lit >= 290 THEN lit ELSE greatest(lit, st) END) AS s FROM l GROUP BY ALL)
  SELECT q, id, score, place FROM (SELECT q, id, CAST(s + 5 * boost AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY s + 5 * boost DESC, status = 'archived', length(id), id) AS INTEGER) AS place FROM s WHERE s > 0 AND (status <> 'archived' OR s >= 1000)) WHERE place <= 20"""
SQL["hidden_archived"] = SQL["search_tiers"].rsplit("  SELECT q, id, score, place", 1)[0] + "  SELECT q, count(*) AS hidden FROM s WHERE s > 0 AND status = 'archived' AND s + 5 * boost < 1000 GROUP BY q"


#: What is wrong with record lines: (every so many customers, but not each so many, field, problem).
_WRONG = [(7, (29,), "name", "text"), (17, (31,), "summary", "text"), (11, (37,), "aliases", "a list"), (13, (), "attrs", "an object"), (19, (), "prov", "a list"), (23, (), "archived", "an object")]
_SIGNS = [(29, "name", "a tab or line break U+000A"), (31, "summary", "the control character U+0007"), (37, "aliases", "the invisible formatting character U+202E"), (41, "", "U+D83D, half of a character")]
SQL["shape_problems"] = " UNION ALL ".join(
    ["SELECT 'P01' AS code, NULL AS id, '' AS path, 'is no JSON object' AS problem FROM customer WHERE c_custkey % 43 = 0"]
    + [f"SELECT 'P02', 'customer:' || c_custkey, '{field}', 'is not {want}; it reads as empty until the line is mended' FROM customer WHERE c_custkey % 43 <> 0 AND c_custkey % {n} = 0" + "".join(f" AND c_custkey % {m} <> 0" for m in but) for n, but, field, want in _WRONG]
    + [f"SELECT 'P02', 'customer:' || c_custkey, '{path}', 'holds {what}' FROM customer WHERE c_custkey % 43 <> 0 AND c_custkey % {n} = 0" for n, path, what in _SIGNS]
)
SQL["shaped_records"] = """SELECT 'customer:' || k AS id, CASE WHEN k % 29 = 0 THEN 'two' || chr(10) || 'lines' WHEN k % 7 = 0 OR k % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN k % 31 = 0 THEN 'bell' || chr(7) WHEN k % 17 = 0 THEN '' ELSE 'two' || chr(10) || 'lines' END AS summary,
  CAST(CASE WHEN k % 37 = 0 THEN 2 WHEN k % 11 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_aliases, CASE WHEN k % 13 <> 0 THEN '"' || c_mktsegment || '"' END AS segment, CAST(CASE WHEN k % 19 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_prov, CAST(NULL AS VARCHAR) AS archived
  FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 43 <> 0"""


SQL["redacted_contacts"] = """SELECT c_custkey, CASE WHEN c_custkey % 10 > 2 THEN 'mail [redacted:email] or [redacted:email], no key' || chr(10) || '{"phone": "[redacted:phone]", "size": 4.50}' END AS clean,
  CAST(2 AS INTEGER) AS emails, CASE WHEN c_custkey % 10 > 2 THEN '' ELSE 'credential' END AS refused FROM customer"""


SQL["fenced_texts"] = r"""SELECT doc_id, sha256('[untrusted src:' || doc_id || ' begins P]' || chr(10) || regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]', '', 'g')
  || chr(10) || '[(quoted) Untrusted  src:1 ends]' || chr(10) || 'then (quoted) untrusted src' || chr(10) || '[untrusted src:' || doc_id || ' ends]') AS sha256 FROM documents"""


SQL["stored_problems"] = """SELECT 'P14' AS code, id, CASE WHEN substr(id, 5, 1) <> '0' THEN 'sources/' || id || '.txt' END AS path, problem FROM (
    SELECT id, CASE WHEN substr(id, 5, 1) = '0' THEN 'has no text file' WHEN doc_id % 22 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'has another sha256 than the index' WHEN doc_id % 13 = 0 THEN 'has another size than the index' END AS problem FROM store) WHERE problem IS NOT NULL
  UNION ALL SELECT 'P14', NULL, 'sources/note-' || n_nationkey, 'is a file that the index does not list' FROM nation WHERE n_nationkey % 2 = 1"""


SQL["bundled_exports"] = """SELECT l_orderkey AS key, 'p' || l_partkey AS ns, CAST(1 AS INTEGER) AS depth, '' AS via, sha256('{"bundled":{},"nodes":[{"id":"part:' || l_partkey || '"}]}') AS sha256 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT l_orderkey, 's' || l_suppkey, 2, min('p' || l_partkey), sha256('{"bundled":{},"nodes":[{"id":"supplier:' || l_suppkey || '"}]}') FROM lineitem GROUP BY l_orderkey, l_suppkey"""
SQL["repaired_sources"] = """, own_ AS (SELECT id, h AS sha256, captured, doc_id % 4 AS k FROM store)
  SELECT id, sha256, CAST(captured - CASE WHEN k = 1 THEN 86400 ELSE 0 END AS BIGINT) * 1000000 AS captured, k = 2 AS erased FROM own_
  UNION ALL SELECT id, sha256(sha256), CAST(captured AS BIGINT) * 1000000, FALSE FROM own_ WHERE k = 3"""
SQL["repaired_edges"] = "SELECT id, src, dst FROM edges WHERE conf <= 0.45"


SQL["fresh_problems"] = """, s AS (SELECT s_suppkey AS k, s_suppkey % 5 AS n FROM supplier)
  SELECT 'P07' AS code, 'Supplier:' || k AS record_id, unnest(['id grammar', 'id of another kind']) AS message FROM s WHERE n = 0
  UNION ALL SELECT 'P07', 'x/supplier:' || k, unnest(['id grammar', 'id of another kind']) FROM s WHERE n = 1 UNION ALL SELECT 'P16', 'x/supplier:' || k, 'qualified id in local nodes' FROM s WHERE n = 1
  UNION ALL SELECT 'P08', 'gadget:' || k, 'unknown kind' FROM s WHERE n = 2 UNION ALL SELECT 'P06', 'supplier:' || k, 'reused' FROM s WHERE n = 3
  UNION ALL SELECT 'P09', e.id, 'kinds not allowed' FROM edges e JOIN s ON e.src = 'supplier:' || k WHERE n = 3 AND rel = 'located_in'
  UNION ALL SELECT 'P07', 'e-' || lpad(CAST(k AS VARCHAR), 12, '0'), 'edge id differs from its hash' FROM s WHERE n = 4 UNION ALL SELECT 'P09', 'e-' || lpad(CAST(k AS VARCHAR), 12, '0'), unnest(['unknown relation', 'kinds not allowed']) FROM s WHERE n = 4"""


def _hits(name: str, asked: str) -> str:
    """CTEs ``name`` (q, id, score, place) of searches for the texts (q) of ``asked``; plurals of the asked words stand for their singulars."""
    every = lambda test: f"len(list_filter(ks, lambda k: {test})) = len(ks)"
    at_id, at_name, at_text = (f"contains({raw}, tokens[k]) OR list_has_any({found}, forms[k])" for raw, found in (("nid", "sid"), ("lname", "sname"), ("hay", "shay")))
    return f"""{name}_asked AS (SELECT q, lower(q) AS alt, string_split(lower(q), ' ') AS tokens, list_transform(string_split(lower(q), ' '), lambda w: CASE WHEN length(w) > 4 AND suffix(w, 's') THEN [w, left(w, length(w) - 1)] WHEN length(w) > 3 THEN [w] ELSE [] END) AS forms FROM ({asked})),
  {name}_rows AS (SELECT r.*, a.*, range(1, len(tokens) + 1) AS ks, list_sum(list_transform(tokens, lambda t: (length(hay) - length(replace(hay, t, ''))) // length(t))) AS n, list_sum(list_transform(tokens, lambda t: greatest(1, (length(hay) - length(replace(hay, t, ''))) // length(t)))) AS m FROM searched r CROSS JOIN {name}_asked a),
  {name}_lit AS (SELECT *, CASE WHEN nid = alt THEN 1000 WHEN suffix(nid, ':' || alt) OR suffix(nid, '.' || alt) OR suffix(nid, '/' || alt) THEN 600 WHEN contains(nid, alt) THEN 400 WHEN {every("contains(nid, tokens[k])")} THEN 300 WHEN contains(lname, alt) THEN 250
      WHEN {every("contains(nid, tokens[k]) OR contains(lname, tokens[k])")} THEN 150 WHEN {every("contains(hay, tokens[k])")} THEN 20 + least(30, n) ELSE 0 END AS lit,
    CASE WHEN {every(at_id)} THEN 290 WHEN {every(f"{at_id} OR {at_name}")} THEN 140 WHEN {every(at_text)} THEN 10 + least(30, m) ELSE 0 END AS st FROM {name}_rows),
  {name} AS (SELECT q, id, score, place FROM (SELECT q, id, CAST(s + 5 * boost AS INTEGER) AS score, row_number() OVER (PARTITION BY q ORDER BY s + 5 * boost DESC, status = 'archived', length(id), id) AS place
    FROM (SELECT *, CASE WHEN lit >= 290 THEN lit ELSE greatest(lit, st) END AS s FROM {name}_lit) WHERE s > 0 AND (status <> 'archived' OR s >= 1000)) WHERE place <= 20)"""


SQL["phrase_scopes"] = f""", names AS (SELECT DISTINCT p_name AS n FROM part),
  phrases AS (SELECT n AS q FROM names UNION ALL SELECT n || 's' FROM names UNION ALL SELECT split_part(n, ' ', 2) || ' the ' || split_part(n, ' ', 1) || ' zzq' FROM names UNION ALL SELECT 'alt ' || n_name FROM nation UNION ALL SELECT 'qq' || r_name || ' xx' FROM region UNION ALL SELECT s_name FROM supplier),
  searched AS (SELECT *, {_words('nid')} AS sid, {_words('lname')} AS sname, {_words('hay')} AS shay FROM (SELECT id, status, lower(id) AS nid, lower(name) AS lname, lower(concat_ws(' ', name, summary, coalesce(alias, ''))) AS hay, CASE kind WHEN 'customer' THEN 2 WHEN 'supplier' THEN 1 WHEN 'part' THEN 3 ELSE 0 END AS boost FROM nodes)),
  {_hits("whole", "SELECT q FROM phrases WHERE NOT suffix(q, ' zzq') AND NOT starts_with(q, 'qq')")},
  pieces AS (SELECT q, unnest(list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) > 2 AND w <> 'the'))) AS w FROM phrases WHERE q NOT IN (SELECT q FROM whole)),
  {_hits("parted", "SELECT DISTINCT w AS q FROM pieces")},
  tally AS (SELECT p.q, id, count(*) * 1000 + sum(score) AS s FROM pieces p JOIN parted h ON h.q = p.w GROUP BY 1, 2),
  ranked AS (SELECT q, id, place, 'phrase' AS mode FROM whole UNION ALL SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, length(id), id), 'words' FROM tally),
  told AS (SELECT q, any_value(mode) AS mode, string_agg(id, ',' ORDER BY place) FILTER (place <= 3) AS "primary", greatest(0, count(*) - 3) AS more FROM ranked GROUP BY q),
  lost AS (SELECT q, string_agg(w, ' ' ORDER BY w) AS w FROM pieces WHERE w NOT IN (SELECT q FROM parted) GROUP BY q)
  SELECT p.q, coalesce(mode, 'none') AS mode, coalesce("primary", '') AS "primary", CAST(coalesce(more, 0) AS BIGINT) AS more, CASE WHEN mode = 'phrase' THEN '' WHEN mode = 'words' THEN coalesce(w, '') ELSE coalesce(w, p.q) END AS missing FROM phrases p LEFT JOIN told USING (q) LEFT JOIN lost USING (q)
  UNION ALL SELECT 'Customer:' || c_custkey, 'id', 'customer:' || c_custkey, 0, '' FROM customer UNION ALL SELECT 'customer:x' || c_custkey, 'missing', '', 0, 'customer:x' || c_custkey FROM customer"""


def _briefs(budgets: tuple[int, ...]) -> str:
    """Briefs of all customers: units, then what stands before the first that does not fit."""
    sections = ["primary", "decisions", "quotes", "gaps", "related", "bridges"]

    def foot(left: str) -> str:
        groups = "list_filter([" + ", ".join(f"{{'n': {left}_{x}, 's': '{x}'}}" for x in sections) + "], lambda g: g.n > 0)"
        told = f"list_transform({groups}[1:3], lambda g: g.n || ' ' || g.s)"
        rest = f"coalesce(list_sum(list_transform({groups}[4:], lambda g: g.n)), 0)"
        return f"CASE WHEN len({groups}) = 0 THEN '' ELSE 'left out to fit ' || budget || ' tokens: ' || array_to_string(list_concat({told}, CASE WHEN {rest} > 0 THEN [CAST({rest} AS BIGINT) || ' more'] ELSE [] END), '; ') END"

    each = lambda text: ", ".join(text.format(x=x) for x in sections)
    return f""", who AS (SELECT id AS subject FROM nodes WHERE kind = 'customer'),
  l AS (SELECT id AS subject, label, other, min(edge_id) AS edge_id, arg_min(direction, edge_id) AS direction, arg_min(rel, edge_id) AS rel FROM expanded WHERE NOT background AND id LIKE 'customer:%' GROUP BY 1, 2, 3),
  bl AS (SELECT subject, label, count(*) AS n, list_sort(list(other)) AS few, row_number() OVER (PARTITION BY subject ORDER BY label) AS k FROM l GROUP BY subject, label),
  rl AS (SELECT subject, string_agg(label || ' ' || CASE WHEN n <= 2 THEN array_to_string(few, ', ') ELSE CAST(n AS VARCHAR) END, '; ' ORDER BY k) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN '; +' || (count(*) - 5) || ' more labels' ELSE '' END AS rels FROM bl GROUP BY 1),
  sr AS (SELECT record_id AS subject, list_sort(list(DISTINCT src)) AS s FROM prov GROUP BY 1),
  og AS (SELECT id AS subject, gap, detail, severity, row_number() OVER (PARTITION BY id ORDER BY severity DESC, gap, detail) AS k FROM gaps WHERE id LIKE 'customer:%'),
  tn AS (SELECT subject, 'needs: ' || string_agg(gap, ', ' ORDER BY k) FILTER (k <= 2) AS needs FROM og GROUP BY 1),
  at_ AS (SELECT id AS subject, string_agg(field || '=' || value, '; ' ORDER BY field) AS a FROM attrs GROUP BY 1),
  sc AS ({SQL["scope_overlaps"]}),
  qu AS (SELECT record_id AS subject, 'quote ' || record_id || ': "' || quote || '" (' || src || ' ' || loc || ')' AS text, row_number() OVER (PARTITION BY record_id ORDER BY ord, src, loc) AS k FROM prov WHERE record_id LIKE 'customer:%' AND trim(quote) <> ''),
  one AS (SELECT subject, label, (row_number() OVER (PARTITION BY subject, label ORDER BY other) - 1) // 8 AS line, other FROM l JOIN bl USING (subject, label) WHERE n > 2),
  hop AS (SELECT DISTINCT subject, other AS via FROM l WHERE other NOT IN (SELECT id FROM hubs)),
  far AS (SELECT subject, e.other, min((e.label, via)) AS m FROM hop JOIN expanded e ON e.id = via WHERE NOT background AND e.other <> subject AND (subject, e.other) NOT IN (SELECT subject, other FROM l) GROUP BY 1, 2),
  two AS (SELECT subject, m[1] AS label, m[2] AS via, other, (row_number() OVER (PARTITION BY subject, m[1] ORDER BY other) - 1) // 8 AS line FROM far),
  units AS (
    SELECT n.id AS subject, 0.0 AS tier, 'primary' AS section, concat_ws(' | ', n.id || '  ' || kind || ', ' || status || ', conf ' || CAST(CAST(conf AS DOUBLE) AS VARCHAR), a, rels, CASE WHEN s IS NULL THEN 'no sources' ELSE len(s) || CASE WHEN len(s) = 1 THEN ' source: ' ELSE ' sources: ' END || array_to_string(s[1:2], ', ') END, needs)
      || chr(10) || '  ' || coalesce(summary, 'no summary') AS text, 1 AS n, ('', 0) AS o FROM nodes n LEFT JOIN rl ON rl.subject = n.id LEFT JOIN sr ON sr.subject = n.id LEFT JOIN tn ON tn.subject = n.id LEFT JOIN at_ ON at_.subject = n.id WHERE kind = 'customer'
    UNION ALL SELECT sc.id, 1, 'decisions', 'decision ' || scope_id || ': Which segment fits ' || c_name || '? -> ' || lower(c_mktsegment), 1, ('', -c_custkey) FROM sc JOIN decisions d ON d.id = scope_id AND status = 'active' JOIN customer ON d.id = 'dec-' || c_custkey
    UNION ALL SELECT subject, CASE WHEN k = 1 THEN 2 ELSE 7 END, 'quotes', text, 1, ('', k) FROM qu WHERE k <= 3
    UNION ALL SELECT subject, 8, 'quotes', 'quotes: +' || count(*) || ' more', count(*), ('', 0) FROM qu WHERE k > 3 GROUP BY 1
    UNION ALL SELECT subject, 3, 'gaps', 'open: ' || rtrim(gap || ' ' || detail) || ' (' || severity || ')', 1, ('', k) FROM og WHERE k <= 6
    UNION ALL SELECT subject, 4, 'gaps', 'open: +' || count(*) || ' more', count(*), ('', 0) FROM og WHERE k > 6 GROUP BY 1
    UNION ALL SELECT subject, 5, 'related', 'related 1 ' || label || ': ' || string_agg(other, ', ' ORDER BY other), count(*), (label, line) FROM one GROUP BY subject, label, line
    UNION ALL SELECT subject, 5.5, 'bridges', 'bridge ' || CASE WHEN direction = 'out' THEN subject || ' -' || rel || '-> ' || other ELSE other || ' -' || rel || '-> ' || subject END, 1, (edge_id, 0) FROM l JOIN nodes a ON a.id = subject JOIN nodes b ON b.id = other WHERE a.ns <> b.ns
    UNION ALL SELECT subject, 6, 'related', 'related 2 ' || label || ' via ' || any_value(w) || ': ' || string_agg(other, ', ' ORDER BY other), count(*), (label, line)
      FROM two JOIN (SELECT subject, label, CASE WHEN count(DISTINCT via) = 1 THEN min(via) ELSE count(DISTINCT via) || ' nodes' END AS w FROM two GROUP BY 1, 2) USING (subject, label) GROUP BY subject, label, line),
  placed AS (SELECT *, row_number() OVER s AS r, sum(length(text) + 1) OVER s AS used, {each("sum(CASE WHEN section = '{x}' THEN n ELSE 0 END) OVER (PARTITION BY subject) AS all_{x}, sum(CASE WHEN section = '{x}' THEN n ELSE 0 END) OVER (PARTITION BY subject) - sum(CASE WHEN section = '{x}' THEN n ELSE 0 END) OVER s AS left_{x}")}
    FROM units WINDOW s AS (PARTITION BY subject ORDER BY tier, o ROWS UNBOUNDED PRECEDING)),
  asked AS (SELECT *, budget * 4 AS most FROM placed, (SELECT unnest({list(budgets)}) AS budget)),
  weighed AS (SELECT *, {foot("left")} AS foot FROM asked),
  ends AS (SELECT subject, budget, min(r) FILTER (most > 0 AND used + CASE WHEN foot = '' THEN 0 ELSE length(foot) + 1 END > most) AS stop FROM weighed GROUP BY 1, 2),
  taken AS (SELECT w.subject, w.budget, any_value(most) AS most, count(*) FILTER (r < coalesce(stop, 1e9)) AS taken, string_agg(text, chr(10) ORDER BY r) FILTER (r < coalesce(stop, 1e9)) AS body, coalesce(max(used) FILTER (r < coalesce(stop, 1e9)), 0) AS used,
      {each("any_value(all_{x}) - coalesce(sum(n) FILTER (section = '{x}' AND r < coalesce(stop, 1e9)), 0) AS rest_{x}")} FROM weighed w JOIN ends e ON e.subject = w.subject AND e.budget = w.budget GROUP BY 1, 2),
  said AS (SELECT *, {foot("rest")} AS whole, {" + ".join(f"rest_{x}" for x in sections)} AS items FROM taken),
  texts_ AS (SELECT subject, CAST(budget AS INTEGER) AS budget, taken, concat_ws(chr(10), body, CASE WHEN most > 0 AND whole <> '' THEN CASE WHEN used + length(whole) + 1 > most THEN 'left out to fit ' || budget || ' tokens: ' || CAST(items AS BIGINT) || ' items' ELSE whole END END) AS text FROM said)
  SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM texts_"""


SQL["briefs"] = _briefs((0, 60, 200, 2000))


def _rules() -> str:
    return ", ".join("('{}', '{}')".format(kind, rule.replace("'", "''")) for kind, rule in CREDENTIALS.items())


SQL["secret_scan"] = SQL["secret_scan"].replace("RULES", _rules())


def oracle_sql() -> dict[str, str]:
    return {name: BASE + sql for name, sql in SQL.items()}
