"""SQL of the registered lineage queries, by other algorithms than the Spark plans.

Reachability is a recursive union, and an edit is really made: each graph is closed again
without the deleted edge or with the added one.  Path counts are never used; two paths or
more between a pair show as more edges on its paths than nodes less one.
"""

from __future__ import annotations

from edgeloom.plans.queries import DENSE, FK, MULTI

BASE = f"""
WITH RECURSIVE e AS (SELECT 'p' || project AS g, src::INT AS u, dst::INT AS v FROM ({MULTI})),
n AS (SELECT g, unnest(range(12))::INT AS x FROM (SELECT DISTINCT g FROM e)),
f AS (SELECT 'p' || project AS g, child::INT AS c, parent::INT AS p FROM ({FK}) WHERE 'p' || project IN (SELECT g FROM e)),
r(g, a, b) AS (SELECT g, u, v FROM e UNION SELECT r.g, r.a, e.v FROM r JOIN e ON e.g = r.g AND e.u = r.b),
r0 AS (SELECT g, a, b FROM r UNION ALL SELECT g, x, x FROM n),
w(g, b, k) AS (SELECT g, x, 0 FROM n UNION SELECT w.g, e.v, k + 1 FROM w JOIN e ON e.g = w.g AND e.u = w.b),
lv AS (SELECT g, b AS x, max(k) AS level FROM w GROUP BY g, b),
adds AS (SELECT a.g, a.x AS u, b.x AS v FROM lv a JOIN lv b ON a.g = b.g AND a.level < b.level WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = a.g AND e.u = a.x AND e.v = b.x)),
ci AS (SELECT DISTINCT g, a, x FROM (SELECT g, a, b AS x FROM r UNION ALL SELECT r0.g, r0.a, f.c FROM r0 JOIN f ON f.g = r0.g AND f.p = r0.b) WHERE a <> x),
ops AS (
  SELECT g, 'direct_downstream' AS op, u AS a, v AS x FROM e UNION ALL SELECT g, 'direct_upstream', v, u FROM e
  UNION ALL SELECT g, 'transitive_downstream', a, b FROM r UNION ALL SELECT g, 'transitive_upstream', b, a FROM r UNION ALL SELECT g, 'combined_impact', a, x FROM ci
),
multi2 AS (
  -- pairs with two paths or more: the edges on their paths are as many as the nodes, or more
  SELECT r.g, r.a, r.b FROM r
  WHERE (SELECT count(*) FROM e JOIN r0 h ON h.g = e.g AND h.b = e.u AND h.a = r.a JOIN r0 t ON t.g = e.g AND t.a = e.v AND t.b = r.b WHERE e.g = r.g)
     >= (SELECT count(*) FROM r0 h JOIN r0 t ON t.g = h.g AND t.a = h.b WHERE h.g = r.g AND h.a = r.a AND t.b = r.b)
),
cases AS (
  SELECT g, 'forward' AS s, u AS a, v AS x FROM e UNION ALL SELECT g, 'reverse', v, u FROM e
  UNION ALL SELECT g, 'transitive', a, b FROM r WHERE EXISTS (SELECT 1 FROM r q WHERE q.g = r.g AND q.a = r.a AND NOT EXISTS (SELECT 1 FROM e WHERE e.g = q.g AND e.u = q.a AND e.v = q.b))
  UNION ALL SELECT g, 'combined_impact', a, x FROM ci WHERE EXISTS (SELECT 1 FROM e WHERE e.g = ci.g AND e.u = ci.a) AND EXISTS (SELECT 1 FROM ci q WHERE q.g = ci.g AND q.a = ci.a AND NOT EXISTS (SELECT 1 FROM r WHERE r.g = q.g AND r.a = q.a AND r.b = q.x))
  UNION ALL SELECT g, 'multi_source', v, u FROM e WHERE (SELECT count(*) FROM e q WHERE q.g = e.g AND q.v = e.v) >= 3
)"""

#: Each graph closed again after each deletion, and the pairs it loses.
CUT = (
    BASE
    + """,
left_(g, u, v, a, b) AS (
  SELECT d.g, d.u, d.v, e.u, e.v FROM e d JOIN e ON e.g = d.g AND NOT (e.u = d.u AND e.v = d.v)
  UNION SELECT l.g, l.u, l.v, l.a, e.v FROM left_ l JOIN e ON e.g = l.g AND e.u = l.b AND NOT (e.u = l.u AND e.v = l.v)
),
lost AS (SELECT e.g, e.u, e.v, r.a, r.b FROM e JOIN r ON r.g = e.g WHERE NOT EXISTS (SELECT 1 FROM left_ l WHERE l.g = e.g AND l.u = e.u AND l.v = e.v AND l.a = r.a AND l.b = r.b)),
sev AS (
  SELECT e.g, e.u, e.v, count(l.a) AS lost, coalesce(sum((l.a <> e.u)::INT + (l.b <> e.v)::INT), 0) AS severity,
         coalesce(sum((l.a = e.u)::INT), 0) AS from_u, coalesce(sum((l.b = e.v)::INT), 0) AS to_v,
         EXISTS (SELECT 1 FROM left_ q WHERE q.g = e.g AND q.u = e.u AND q.v = e.v AND q.a = e.u AND q.b = e.v) AS alternate_path
  FROM e LEFT JOIN lost l ON l.g = e.g AND l.u = e.u AND l.v = e.v GROUP BY e.g, e.u, e.v
)"""
)

#: Every edit made, all answers given again, and the elements that changed.
REDO = (
    BASE
    + """,
edits AS (SELECT g, 'delete' AS kind, u, v FROM e UNION ALL SELECT g, 'add', u, v FROM adds),
ee AS (
  SELECT d.*, e.u AS s, e.v AS t FROM edits d JOIN e ON e.g = d.g WHERE NOT (d.kind = 'delete' AND e.u = d.u AND e.v = d.v)
  UNION ALL SELECT d.*, d.u, d.v FROM edits d WHERE d.kind = 'add'
),
rr(g, kind, u, v, a, b) AS (SELECT g, kind, u, v, s, t FROM ee UNION SELECT rr.g, rr.kind, rr.u, rr.v, rr.a, ee.t FROM rr JOIN ee ON ee.g = rr.g AND ee.kind = rr.kind AND ee.u = rr.u AND ee.v = rr.v AND ee.s = rr.b),
rr0 AS (SELECT g, kind, u, v, a, b FROM rr UNION ALL SELECT d.g, d.kind, d.u, d.v, n.x, n.x FROM edits d JOIN n ON n.g = d.g),
again AS (
  SELECT g, kind, u, v, 'direct_downstream' AS op, s AS a, t AS x FROM ee UNION ALL SELECT g, kind, u, v, 'direct_upstream', t, s FROM ee
  UNION ALL SELECT g, kind, u, v, 'transitive_downstream', a, b FROM rr UNION ALL SELECT g, kind, u, v, 'transitive_upstream', b, a FROM rr
  UNION ALL SELECT DISTINCT g, kind, u, v, 'combined_impact', a, x FROM (SELECT g, kind, u, v, a, b AS x FROM rr UNION ALL SELECT q.g, q.kind, q.u, q.v, q.a, f.c FROM rr0 q JOIN f ON f.g = q.g AND f.p = q.b) WHERE a <> x
),
before AS (SELECT d.*, o.op, o.a, o.x FROM edits d JOIN ops o ON o.g = d.g),
diff AS (
  SELECT coalesce(b.g, c.g) AS g, coalesce(b.kind, c.kind) AS kind, coalesce(b.u, c.u) AS u, coalesce(b.v, c.v) AS v, coalesce(b.op, c.op) AS op, coalesce(b.a, c.a) AS a,
         count(*) FILTER (b.x IS NOT NULL AND c.x IS NOT NULL) AS tp, count(*) FILTER (b.x IS NULL) AS fp, count(*) FILTER (c.x IS NULL) AS fn
  FROM before b FULL JOIN again c ON b.g = c.g AND b.kind = c.kind AND b.u = c.u AND b.v = c.v AND b.op = c.op AND b.a = c.a AND b.x = c.x GROUP BY ALL
),
scored AS (
  SELECT *, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) END AS f1 FROM diff
),
probes AS (
  SELECT d.*, o.op, n.x AS a, coalesce(s.tp, 0) AS tp, coalesce(s.fp, 0) AS fp, coalesce(s.fn, 0) AS fn, coalesce(s.f1, 1.0::DOUBLE) AS f1
  FROM edits d JOIN n ON n.g = d.g CROSS JOIN (SELECT unnest(['direct_downstream', 'direct_upstream', 'transitive_downstream', 'transitive_upstream', 'combined_impact']) AS op) o
  LEFT JOIN scored s ON s.g = d.g AND s.kind = d.kind AND s.u = d.u AND s.v = d.v AND s.op = o.op AND s.a = n.x
),
buckets AS (
  SELECT *, 'local' AS bucket FROM probes WHERE (op = 'direct_downstream' AND a = u) OR (op = 'direct_upstream' AND a = v)
  UNION ALL SELECT *, 'propagated' FROM probes WHERE (op IN ('transitive_downstream', 'combined_impact') AND a <> u) OR (op = 'transitive_upstream' AND a <> v)
  UNION ALL SELECT *, 'null_gold' FROM probes WHERE tp + fn = 0
)"""
)

MEASURES = "count(*) AS probes, count(*) FILTER (fp + fn > 0) AS distorted, round(count(*) FILTER (fp + fn > 0) / count(*)::DOUBLE, 9) AS adr, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(fp + fn)::BIGINT AS incorrect, round(sum(f1) / count(*), 9) AS mean_f1"

#: Betweenness by shortest paths, counted level by level.
BETWEEN = (
    CUT
    + """,
dist AS (SELECT g, a, b, min(k) AS d FROM (
  WITH RECURSIVE s(g, a, b, k) AS (SELECT g, x, x, 0 FROM n UNION SELECT s.g, s.a, e.v, k + 1 FROM s JOIN e ON e.g = s.g AND e.u = s.b) SELECT * FROM s
) GROUP BY g, a, b),
sp(g, a, b, path) AS (SELECT g, x, x, x::VARCHAR FROM n UNION ALL SELECT sp.g, sp.a, e.v, sp.path || '>' || e.v FROM sp JOIN e ON e.g = sp.g AND e.u = sp.b JOIN dist p ON p.g = sp.g AND p.a = sp.a AND p.b = sp.b JOIN dist q ON q.g = sp.g AND q.a = sp.a AND q.b = e.v AND q.d = p.d + 1),
sig AS (SELECT g, a, b, count(*) AS s FROM sp GROUP BY g, a, b),
eb AS (
  SELECT e.g, e.u, e.v, coalesce(sum(CASE WHEN h.d + 1 + t.d = p.d THEN hs.s * ts.s / ps.s::DOUBLE END), 0) AS raw
  FROM e JOIN dist h ON h.g = e.g AND h.b = e.u JOIN sig hs ON hs.g = h.g AND hs.a = h.a AND hs.b = h.b
  JOIN dist t ON t.g = e.g AND t.a = e.v JOIN sig ts ON ts.g = t.g AND ts.a = t.a AND ts.b = t.b
  JOIN dist p ON p.g = e.g AND p.a = h.a AND p.b = t.b JOIN sig ps ON ps.g = p.g AND ps.a = p.a AND ps.b = p.b GROUP BY e.g, e.u, e.v
),
feat AS (
  SELECT s.g, s.u, s.v, s.severity AS impact, round(eb.raw / 132.0::DOUBLE, 12) AS edge_betweenness,
         (SELECT count(*) FROM e q WHERE q.g = s.g AND q.u = s.u) * (SELECT count(*) FROM e q WHERE q.g = s.g AND q.v = s.v) AS degree_product,
         (SELECT count(*) FROM r0 WHERE r0.g = s.g AND r0.a = s.v) AS downstream_closure, (SELECT count(*) FROM r0 WHERE r0.g = s.g AND r0.b = s.u) AS upstream_closure
  FROM sev s JOIN eb USING (g, u, v)
),
rho AS (
  SELECT g, count(*) AS edges, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS rho
  FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY impact) + (count(*) OVER (PARTITION BY g, impact) - 1) / 2.0::DOUBLE AS x,
               rank() OVER (PARTITION BY g ORDER BY edge_betweenness) + (count(*) OVER (PARTITION BY g, edge_betweenness) - 1) / 2.0::DOUBLE AS y FROM feat) GROUP BY g
),
mp AS (SELECT g, (SELECT count(*) FROM r WHERE r.g = x.g) AS pairs, (SELECT count(*) FROM multi2 m WHERE m.g = x.g) AS multi FROM (SELECT DISTINCT g FROM n) x),
rel AS (SELECT mp.g, round(CASE WHEN pairs > 0 THEN multi / pairs::DOUBLE ELSE 0 END, 15) AS x, round(1 - round(rho, 9), 9) AS y FROM mp JOIN rho USING (g) WHERE rho IS NOT NULL)"""
)

RISK = (
    BETWEEN
    + """,
elig AS (SELECT g FROM e GROUP BY g HAVING count(*) >= 5 AND (SELECT max(level) FROM lv WHERE lv.g = e.g) >= 2),
scen AS (SELECT f.*, s.scenario, CASE s.scenario WHEN 'anti_impact_degree' THEN 1.0::DOUBLE / (1 + degree_product) WHEN 'pro_betweenness' THEN 0.25::DOUBLE + edge_betweenness END AS raw
  FROM feat f JOIN elig USING (g) CROSS JOIN (SELECT unnest(['uniform_10pct', 'anti_impact_degree', 'pro_betweenness']) AS scenario) s),
risk AS (SELECT * EXCLUDE (raw), CASE WHEN scenario = 'uniform_10pct' THEN 0.1::DOUBLE ELSE least(0.95::DOUBLE, greatest(0.001::DOUBLE, raw * (0.1::DOUBLE / avg(raw) OVER (PARTITION BY g, scenario)))) END AS prob FROM scen),
exp AS (SELECT *, prob * impact AS expected_risk FROM risk),
keyed AS (UNPIVOT (SELECT g, u, v, scenario, impact AS imp, expected_risk AS er, impact::DOUBLE AS impact, round(expected_risk, 12) AS expected_risk, edge_betweenness, degree_product::DOUBLE AS degree_product, downstream_closure::DOUBLE AS downstream_closure, upstream_closure::DOUBLE AS upstream_closure FROM exp)
  ON impact, expected_risk, edge_betweenness, degree_product, downstream_closure, upstream_closure INTO NAME strategy VALUE score),
placed AS (SELECT *, row_number() OVER (PARTITION BY g, scenario, strategy ORDER BY score DESC, imp DESC, u DESC, v DESC) AS i, count(*) OVER (PARTITION BY g, scenario, strategy) AS m FROM keyed),
curves AS (
  SELECT g AS graph_id, scenario, strategy, b.label AS budget, round(CASE WHEN sum(er) > 0 THEN coalesce(sum(er) FILTER (i <= greatest(1, ceil(b.x * m))), 0) / sum(er) ELSE 0 END, 9) AS removed_risk
  FROM placed CROSS JOIN (VALUES (0.05::DOUBLE, '5pct'), (0.1::DOUBLE, '10pct'), (0.2::DOUBLE, '20pct'), (0.3::DOUBLE, '30pct')) b(x, label) GROUP BY g, scenario, strategy, b.label, b.x
)"""
)

FILES = (
    BASE
    + """,
m AS (
  SELECT n.g AS project, n.x, 't' || lpad(n.x::VARCHAR, 2, '0') AS model, (SELECT count(*) FROM e WHERE e.g = n.g AND e.v = n.x) AS k FROM n
),
refs AS (SELECT e.g AS project, 't' || lpad(e.v::VARCHAR, 2, '0') AS model, 't' || lpad(e.u::VARCHAR, 2, '0') AS ref FROM e UNION ALL SELECT project, model, 'gone' FROM m WHERE x = 11 AND project IN ('p1', 'p7')),
srcs AS (SELECT project, model, 'source:raw.' || model AS source FROM m WHERE x % 3 = 0),
stat AS (SELECT project, 'model:' || ref AS src, 'model:' || model AS dst FROM refs WHERE ref <> 'gone' UNION SELECT project, source, 'model:' || model FROM srcs),
nodes2 AS (SELECT project, 'model:' || model AS x FROM m UNION SELECT project, src FROM stat),
walk(project, b, k) AS (SELECT project, x, 0 FROM nodes2 UNION SELECT w.project, s.dst, k + 1 FROM walk w JOIN stat s ON s.project = w.project AND s.src = w.b),
far2 AS (SELECT DISTINCT a.project, a.src FROM stat a JOIN (WITH RECURSIVE q(project, a, b, k) AS (SELECT project, x, x, 0 FROM nodes2 UNION SELECT q.project, q.a, s.dst, q.k + 1 FROM q JOIN stat s ON s.project = q.project AND s.src = q.b)
  SELECT project, a, b, min(k) AS d FROM q GROUP BY project, a, b) t ON t.project = a.project AND t.a = a.src AND t.d >= 2),
weak(project, x, y) AS (SELECT project, x, x FROM nodes2 UNION SELECT w.project, w.x, CASE WHEN s.src = w.y THEN s.dst ELSE s.src END FROM weak w JOIN stat s ON s.project = w.project AND (s.src = w.y OR s.dst = w.y)),
census AS (
  SELECT p.project, (SELECT count(*) FROM m WHERE m.project = p.project) AS models, (SELECT count(*) FROM stat s WHERE s.project = p.project) AS lineage_edges, (SELECT count(*) FROM srcs s WHERE s.project = p.project) AS sources,
         (SELECT count(DISTINCT c) FROM (SELECT x, min(y) AS c FROM weak w WHERE w.project = p.project GROUP BY x)) AS weak_components,
         (SELECT count(*) FROM far2 WHERE far2.project = p.project) AS multi_hop_anchors, (SELECT count(*) FROM refs r WHERE r.project = p.project AND ref = 'gone') AS unresolved_refs,
         CASE WHEN p.project IN ('p2', 'p3', 'p5') THEN 2 ELSE 0 END::BIGINT AS relationship_tests, CASE WHEN p.project IN ('p2', 'p3', 'p5') THEN 2 ELSE 0 END::BIGINT AS relationship_to_ref_tests,
         (SELECT max(k) FROM walk w WHERE w.project = p.project) AS max_depth, true AS acyclic
  FROM (SELECT DISTINCT g AS project FROM n) p
),
classed AS (
  SELECT *, CASE WHEN models = 0 OR lineage_edges = 0 OR unresolved_refs > 0 THEN 'excluded' WHEN max_depth >= 2 AND relationship_tests > 0 THEN 'combined-impact-eligible' WHEN max_depth >= 2 THEN 'lineage-only-eligible' ELSE 'direct-only-control' END AS classification FROM census
)"""
)

NAME = "'t' || lpad({}::VARCHAR, 2, '0')"
LIST = "coalesce(string_agg('t' || lpad(o.x::VARCHAR, 2, '0'), ',' ORDER BY o.x), '')"

QUESTION_TEXT = """CASE s WHEN 'forward' THEN 'Which tables in the data warehouse are directly derived from ' || name || '?'
  WHEN 'reverse' THEN 'What are all the source tables that ' || name || ' is derived from?'
  WHEN 'transitive' THEN 'If the schema of ' || name || ' changes, which tables are directly or indirectly affected through data lineage?'
  WHEN 'combined_impact' THEN 'If ' || name || ' changes, which tables are affected either through direct/indirect data lineage OR because they have a foreign key dependency on an affected table?'
  ELSE name || ' integrates data from multiple sources. List ALL source tables that feed into ' || name || '.' END"""

ASKED = (
    BASE
    + f""",
asked AS (
  SELECT o.g, s, o.a, {NAME.format("o.a")} AS name, string_agg({NAME.format("o.x")}, ',' ORDER BY o.x) AS answer, list_position(['forward', 'reverse', 'transitive', 'combined_impact', 'multi_source'], s) AS part
  FROM cases o GROUP BY o.g, s, o.a
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY part, a) - 1 AS k FROM asked)"""
)

CONC = """
conc AS (
  SELECT grp, count(*) AS items, CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (count(*) * sum(x))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE ELSE 0 END AS gini,
         CASE WHEN sum(x) > 0 THEN sum(x) FILTER (j <= greatest(1, ceil(0.1::DOUBLE * m))) / sum(x)::DOUBLE ELSE 0 END AS top_share
  FROM (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, row_number() OVER (PARTITION BY grp ORDER BY x DESC) AS j, count(*) OVER (PARTITION BY grp) AS m FROM (SELECT g AS grp, severity AS x FROM sev UNION ALL SELECT '*', severity FROM sev)) GROUP BY grp
),
summ AS (
  SELECT g AS graph_id, count(*) AS edges, sum(severity)::BIGINT AS total, round(avg(severity), 9) AS mean, max(severity)::BIGINT AS max, count(*) FILTER (severity = 0) AS zero, count(*) FILTER (alternate_path) AS redundant,
         any_value(round(c.gini, 9)) AS gini, any_value(round(c.top_share, 9)) AS top_share FROM sev JOIN conc c ON c.grp = g GROUP BY g
)"""

FROZEN = (
    REDO
    + """,
size AS (SELECT g, s, a, CASE s WHEN 'forward' THEN 'direct_downstream' WHEN 'transitive' THEN 'transitive_downstream' WHEN 'combined_impact' THEN 'combined_impact' ELSE 'direct_upstream' END AS op FROM cases GROUP BY g, s, a),
frozen AS (SELECT p.g, p.kind, p.u, p.v, c.s, count(*) AS cases, count(*) FILTER (p.fp + p.fn > 0) AS distorted, sum(p.fp + p.fn)::BIGINT AS incorrect, round(sum(p.f1) / count(*), 9) AS mean_f1
  FROM probes p JOIN size c ON c.g = p.g AND c.op = p.op AND c.a = p.a GROUP BY p.g, p.kind, p.u, p.v, c.s)"""
)

ORACLES: dict[str, str] = {
    "deletion_severity": CUT + " SELECT g AS graph_id, u, v, lost, severity::BIGINT AS severity, alternate_path FROM sev",
    "lost_pairs": CUT + " SELECT g AS graph_id, u, v, a, b FROM lost",
    **{op: BASE + f" SELECT n.g AS graph_id, {NAME.format('n.x')} AS anchor, count(o.x) AS n, {LIST} AS answer FROM n LEFT JOIN ops o ON o.g = n.g AND o.a = n.x AND o.op = '{op}' GROUP BY n.g, n.x" for op in ("direct_downstream", "direct_upstream", "transitive_downstream", "transitive_upstream", "combined_impact")},
    "multi_source": BASE + f" SELECT o.g AS graph_id, {NAME.format('o.a')} AS anchor, count(*) AS n, {LIST} AS answer FROM ops o WHERE op = 'direct_upstream' GROUP BY o.g, o.a HAVING count(*) >= 3",
    "frozen_cases": BASE + f" SELECT o.g AS graph_id, s AS subtype, {NAME.format('o.a')} AS anchor, count(*) AS n, {LIST} AS answer FROM cases o GROUP BY o.g, s, o.a",
    "probe_inventory": BASE + " SELECT n.g AS graph_id, q.op AS operation, count(*) AS probes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ops o WHERE o.g = n.g AND o.a = n.x AND o.op = q.op)) AS empty_gold FROM n CROSS JOIN (SELECT unnest(['direct_downstream', 'direct_upstream', 'transitive_downstream', 'transitive_upstream', 'combined_impact']) AS op) q GROUP BY n.g, q.op",
    "dag_levels": BASE + " SELECT g AS graph_id, x AS node_id, level FROM lv",
    "graph_depth": BASE + " SELECT g AS graph_id, count(*) AS n, (SELECT count(*) FROM e WHERE e.g = lv.g) AS m, max(level) AS depth FROM lv GROUP BY g",
    "multi_hop_anchors": BASE + " SELECT x.g AS graph_id, (SELECT count(DISTINCT r.a) FROM r WHERE r.g = x.g AND NOT EXISTS (SELECT 1 FROM e WHERE e.g = r.g AND e.u = r.a AND e.v = r.b)) AS anchors FROM (SELECT DISTINCT g FROM n) x",
    "path_multiplicity": BASE + " SELECT x.g AS graph_id, (SELECT count(*) FROM r WHERE r.g = x.g) AS reachable_pairs, (SELECT count(*) FROM multi2 m WHERE m.g = x.g) AS multi_path_pairs, round((SELECT count(*) FROM multi2 m WHERE m.g = x.g) / greatest(1, (SELECT count(*) FROM r WHERE r.g = x.g))::DOUBLE, 9) AS multi_path_fraction FROM (SELECT DISTINCT g FROM n) x",
    "admissible_false_edges": BASE + " SELECT g AS graph_id, u, v FROM adds",
    "graph_diagnostics": BASE
    + """ SELECT graph_id, n, m, fk_edges, depth, round(pairs / n::DOUBLE, 9) AS mean_descendants, round(fk_edges / (n * (n - 1))::DOUBLE, 9) AS fk_density, additions, shortcuts, round(CASE WHEN additions > 0 THEN shortcuts / additions::DOUBLE ELSE 0 END, 9) AS shortcut_fraction FROM (
  SELECT x.g AS graph_id, (SELECT count(*) FROM n WHERE n.g = x.g) AS n, (SELECT count(*) FROM e WHERE e.g = x.g) AS m, (SELECT count(*) FROM f WHERE f.g = x.g) AS fk_edges, (SELECT max(level) FROM lv WHERE lv.g = x.g) AS depth,
         (SELECT count(*) FROM r WHERE r.g = x.g) AS pairs, (SELECT count(*) FROM adds a WHERE a.g = x.g) AS additions, (SELECT count(*) FROM adds a JOIN r ON r.g = a.g AND r.a = a.u AND r.b = a.v WHERE a.g = x.g) AS shortcuts
  FROM (SELECT DISTINCT g FROM n) x)""",
    "edit_damage_by_bucket": REDO + f" SELECT g AS graph_id, kind, u, v, bucket, {MEASURES} FROM buckets GROUP BY g, kind, u, v, bucket",
    "edit_damage_by_operation": REDO + f" SELECT g AS graph_id, kind, u, v, op AS operation, {MEASURES} FROM probes GROUP BY g, kind, u, v, op",
    "frozen_damage": FROZEN + " SELECT g AS graph_id, kind, u, v, s AS subtype, cases, distorted, incorrect, mean_f1 FROM frozen",
    "top_damage": FROZEN
    + """ SELECT * FROM (SELECT g AS graph_id, kind, u, v, incorrect, distorted, row_number() OVER (PARTITION BY g, kind ORDER BY incorrect DESC, distorted DESC, CASE WHEN kind = 'add' THEN '(' || u || ', ' || v || ')' END, u, v)::INT AS place
  FROM (SELECT g, kind, u, v, sum(incorrect)::BIGINT AS incorrect, sum(distorted)::BIGINT AS distorted FROM frozen GROUP BY g, kind, u, v)) WHERE place <= 10""",
    "edit_summary": REDO
    + """, per AS (SELECT g, kind, u, v, bucket, count(*) FILTER (fp + fn > 0) AS d, sum(fp + fn) AS i FROM buckets GROUP BY g, kind, u, v, bucket)
SELECT g AS graph_id, kind, count(*) FILTER (bucket = 'propagated') AS edits, count(*) FILTER (bucket = 'propagated' AND d > 0) AS nonzero_propagated, round(avg(d) FILTER (bucket = 'propagated'), 9) AS mean_distorted, max(d) FILTER (bucket = 'propagated') AS max_distorted,
       round(avg(i) FILTER (bucket = 'propagated'), 9) AS mean_incorrect, max(i) FILTER (bucket = 'propagated')::BIGINT AS max_incorrect, count(*) FILTER (bucket = 'null_gold' AND d > 0) AS distorting_null_gold FROM per GROUP BY g, kind""",
    "exposure": REDO
    + """, s AS (SELECT d.*, 2 * (SELECT count(*) FROM r WHERE r.g = d.g AND r.b = d.u) + (SELECT count(*) FROM r WHERE r.g = d.g AND r.a = d.v) AS exposure FROM edits d)
SELECT s.g AS graph_id, s.kind, s.u, s.v, any_value(exposure) AS exposure, round(CASE WHEN any_value(exposure) > 0 THEN count(*) FILTER (fp + fn > 0) / any_value(exposure)::DOUBLE ELSE 0 END, 9) AS damage_per_exposure
FROM s JOIN buckets b ON b.g = s.g AND b.kind = s.kind AND b.u = s.u AND b.v = s.v AND b.bucket = 'propagated' GROUP BY s.g, s.kind, s.u, s.v""",
    "structural_features": BASE
    + """, c AS (SELECT DISTINCT g, s, a FROM cases)
SELECT e.g AS graph_id, e.u, e.v, x.level AS source_level, y.level AS target_level, y.level - x.level AS level_gap, (SELECT count(*) FROM r0 WHERE r0.g = e.g AND r0.a = e.v) AS downstream_closure_size,
       (SELECT count(*) FROM c JOIN r0 ON r0.g = c.g AND r0.a = c.a AND r0.b = e.u WHERE c.g = e.g AND c.s IN ('forward', 'transitive', 'combined_impact')) AS upstream_anchor_count,
       (SELECT count(*) FROM c WHERE c.g = e.g AND c.a = e.v AND c.s IN ('reverse', 'multi_source')) AS reverse_anchor_count,
       (SELECT count(DISTINCT f.c) FROM f JOIN r0 ON r0.g = f.g AND r0.b = f.p AND r0.a = e.v WHERE f.g = e.g AND f.c NOT IN (SELECT q.b FROM r0 q WHERE q.g = e.g AND q.a = e.v)) AS downstream_fk_fanout
FROM e JOIN lv x ON x.g = e.g AND x.x = e.u JOIN lv y ON y.g = e.g AND y.x = e.v""",
    "edge_betweenness": BETWEEN + " SELECT g AS graph_id, u, v, round(raw, 9) AS betweenness, round(raw / 132.0::DOUBLE, 9) AS normalised FROM eb",
    "lemma_check": BETWEEN
    + """ SELECT s.g AS graph_id, s.u, s.v, s.lost, round(eb.raw, 9) AS betweenness, m.multi, s.severity::BIGINT AS severity, eb.raw - s.lost >= -1e-10 AND eb.raw - s.lost <= m.multi + 1e-10 AS bounds_hold, 2 * s.lost - s.from_u - s.to_v = s.severity AS identity_holds
FROM sev s JOIN eb USING (g, u, v) JOIN (SELECT e.g, e.u, e.v, count(p.a) AS multi FROM e LEFT JOIN (SELECT p.*, h.b AS hu, t.a AS tv FROM multi2 p JOIN r0 h ON h.g = p.g AND h.a = p.a JOIN r0 t ON t.g = p.g AND t.b = p.b) p ON p.g = e.g AND p.hu = e.u AND p.tv = e.v GROUP BY e.g, e.u, e.v) m ON m.g = s.g AND m.u = s.u AND m.v = s.v""",
    "severity_concentration": CUT + "," + CONC + " SELECT * FROM summ",
    "corpus_summary": CUT
    + ","
    + CONC
    + """, dp AS (SELECT s.*, (SELECT max(level) FROM lv WHERE lv.g = s.graph_id) AS depth FROM summ s), top AS (SELECT * FROM dp ORDER BY edges DESC, graph_id LIMIT 1)
SELECT count(*) AS graphs, sum(d.edges)::BIGINT AS edges, sum(d.total)::BIGINT AS severity, count(*) FILTER (d.depth >= 3) AS depth_3, count(*) FILTER (d.depth >= 4) AS depth_4, round(quantile_cont(d.gini, 0.5), 7) AS median_gini, min(d.gini) AS min_gini, max(d.gini) AS max_gini, round(quantile_cont(d.top_share, 0.5), 7) AS median_top_share,
       (SELECT round(gini, 9) FROM conc WHERE grp = '*') AS pooled_gini, (SELECT round(top_share, 9) FROM conc WHERE grp = '*') AS pooled_top_share, (SELECT graph_id FROM top) AS largest,
       (sum(d.edges) - (SELECT edges FROM top))::BIGINT AS edges_without_largest, (sum(d.total) - (SELECT total FROM top))::BIGINT AS severity_without_largest FROM dp d""",
    "impact_betweenness_spearman": BETWEEN + " SELECT g AS graph_id, edges, round(rho, 9) AS spearman, round(1 - round(rho, 9), 9) AS gap FROM rho",
    "leave_one_out_spearman": BETWEEN
    + """, pairs2 AS (SELECT a.g AS left_out, b.x, b.y FROM rel a JOIN rel b ON a.g <> b.g),
rk AS (SELECT left_out, rank() OVER (PARTITION BY left_out ORDER BY x) + (count(*) OVER (PARTITION BY left_out, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY left_out ORDER BY y) + (count(*) OVER (PARTITION BY left_out, y) - 1) / 2.0::DOUBLE AS y FROM pairs2)
SELECT left_out, count(*) AS items, round(CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 9) AS rho FROM rk GROUP BY left_out""",
    "edge_features": BETWEEN + " SELECT g AS graph_id, u, v, impact::BIGINT AS impact, round(edge_betweenness, 9) AS edge_betweenness, degree_product, downstream_closure, upstream_closure FROM feat",
    "error_scenarios": RISK + " SELECT g AS graph_id, scenario, u, v, round(prob, 9) AS error_probability, round(expected_risk, 9) AS expected_risk FROM exp",
    "budget_curves": RISK + " SELECT * FROM curves",
    "scenario_macro": RISK + " SELECT scenario, strategy, budget, count(*) AS projects, round(avg(removed_risk), 8) AS mean, round(quantile_cont(removed_risk, 0.5), 7) AS median, min(removed_risk) AS min, max(removed_risk) AS max FROM curves GROUP BY scenario, strategy, budget",
    "pairwise_wins": RISK
    + """ SELECT a.scenario, a.budget, round(avg(a.removed_risk - b.removed_risk), 8) AS mean_delta, count(*) FILTER (a.removed_risk - b.removed_risk > 1e-12) AS wins, count(*) FILTER (abs(a.removed_risk - b.removed_risk) <= 1e-12) AS ties, count(*) FILTER (a.removed_risk - b.removed_risk < -1e-12) AS losses
FROM curves a JOIN curves b ON a.graph_id = b.graph_id AND a.scenario = b.scenario AND a.budget = b.budget WHERE a.strategy = 'impact' AND b.strategy = 'edge_betweenness' GROUP BY a.scenario, a.budget""",
    "priority_rank_correlation": RISK + " SELECT count(*) AS projects, round(quantile_cont(rho, 0.5), 9) AS median, round(min(rho), 9) AS min, round(max(rho), 9) AS max FROM rho JOIN elig USING (g) WHERE rho IS NOT NULL",
    "rank_sensitivities": BETWEEN
    + """, lf AS (SELECT f.*, s.lost FROM feat f JOIN sev s USING (g, u, v)),
lr AS (SELECT g, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(1 - round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 9), 9) END AS lost_gap FROM (
  SELECT g, rank() OVER (PARTITION BY g ORDER BY lost) + (count(*) OVER (PARTITION BY g, lost) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY g ORDER BY edge_betweenness) + (count(*) OVER (PARTITION BY g, edge_betweenness) - 1) / 2.0::DOUBLE AS y FROM lf) GROUP BY g),
cr AS (SELECT rho.g, edges, round(edges / 12.0::DOUBLE, 12) AS density, round(x, 12) AS mult, y AS gap, lost_gap FROM rho JOIN rel USING (g) JOIN lr USING (g)),
v AS (SELECT 'all' AS variant, mult AS x, gap AS y FROM cr UNION ALL SELECT 'larger', mult, gap FROM cr WHERE edges >= 6 UNION ALL SELECT 'without_prefix', mult, gap FROM cr WHERE NOT starts_with(g, 'p1')
  UNION ALL SELECT 'many_paths', mult, gap FROM cr WHERE mult > 0.05::DOUBLE UNION ALL SELECT 'density', density, gap FROM cr UNION ALL SELECT 'lost_pairs', mult, lost_gap FROM cr WHERE lost_gap IS NOT NULL),
rv AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2.0::DOUBLE AS y FROM v)
SELECT variant, count(*) AS graphs, round(CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 9) AS rho FROM rv GROUP BY variant""",
    "priority_advantage": RISK
    + """ SELECT count(*) AS projects, count(*) FILTER (abs(d) <= 1e-8) AS ties, count(*) FILTER (d > 1e-8) AS wins, round(avg(d), 6) AS mean_points, round(max(d), 6) AS max_points FROM (
  SELECT 100 * (a.removed_risk - b.removed_risk) AS d FROM curves a JOIN curves b ON a.graph_id = b.graph_id AND a.scenario = b.scenario AND a.budget = b.budget WHERE a.strategy = 'impact' AND b.strategy = 'edge_betweenness' AND a.scenario = 'uniform_10pct' AND a.budget = '10pct')""",
    "deepest_graphs": BASE + " SELECT * FROM (SELECT g AS graph_id, count(*) AS n, (SELECT count(*) FROM e WHERE e.g = lv.g) AS m, max(level) AS depth FROM lv GROUP BY g) ORDER BY depth DESC, m DESC, graph_id LIMIT 5",
    "lineage_questions": ASKED
    + f""" SELECT g || '_lineage_' || (['fwd', 'rev', 'trans', 'combined', 'multisrc'])[part] || '_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS id, g AS dataset, 'lineage_impact' AS type, s AS subtype, {QUESTION_TEXT} AS question, answer, 'list' AS answer_type, CASE WHEN part <= 2 THEN 'easy' ELSE 'hard' END AS difficulty FROM numbered""",
    "gold_parity": ASKED
    + """, made AS (SELECT g AS dataset, s AS subtype, name = 't07' OR false AS gone FROM numbered)
SELECT dataset, subtype, count(*) FILTER (NOT x) AS generated, count(*) FILTER (x OR NOT gone) AS gold, count(*) FILTER (NOT x AND gone) AS missing, count(*) FILTER (x) AS extra
FROM (SELECT dataset, subtype, gone, false AS x FROM made UNION ALL SELECT DISTINCT g, 'forward', false, true FROM n) GROUP BY dataset, subtype""",
    "ref_extraction": FILES + " SELECT project, model, ref FROM refs",
    "source_extraction": FILES + " SELECT project, model, source FROM srcs",
    "project_census": FILES + " SELECT * FROM classed",
    "gate": FILES
    + """, t AS (SELECT count(*) AS projects, count(*) FILTER (max_depth >= 2) AS multi_hop_projects, coalesce(sum(lineage_edges) FILTER (classification IN ('lineage-only-eligible', 'combined-impact-eligible')), 0)::BIGINT AS eligible_lineage_edges, count(*) FILTER (classification = 'combined-impact-eligible') AS combined_impact_projects, count(*) FILTER (unresolved_refs > 0) AS projects_with_unresolved_refs FROM classed)
SELECT *, multi_hop_projects >= 10 AS enough_multi_hop, eligible_lineage_edges > 60 AS enough_edges, combined_impact_projects > 0 AS some_combined, projects > 0 AS nonempty, multi_hop_projects >= 10 AND eligible_lineage_edges > 60 AND combined_impact_projects > 0 AND projects > 0 AS go FROM t""",
    "relationship_audit": FILES + " SELECT DISTINCT g AS project, CASE WHEN g IN ('p2', 'p3', 'p5') THEN 2 ELSE 1 END::BIGINT AS yaml_files, CASE WHEN g IN ('p2', 'p3', 'p5') THEN 2 ELSE 0 END::BIGINT AS relationship_mentions, CASE WHEN g IN ('p2', 'p3', 'p5') THEN 1 ELSE 0 END::BIGINT AS resolvable_relationship_targets, g IN ('p2', 'p3', 'p5') AS fk_capable FROM n",
    "project_audit": FILES + " SELECT project, (SELECT count(*) FROM refs r WHERE r.project = m.project AND ref = 'gone') AS unresolved_refs, count(*) AS models, count(*) AS sql_files, false AS has_package_file FROM m GROUP BY project",
    "manifest_diff": FILES
    + """, man AS (SELECT g AS project, 'model:t' || lpad(u::VARCHAR, 2, '0') AS src, 'model:t' || lpad(v::VARCHAR, 2, '0') AS dst FROM e WHERE u % 2 = 0 UNION SELECT DISTINCT g, 'source:raw.t00', 'model:t00' FROM n)
SELECT coalesce(s.project, m.project) AS project, count(s.src) AS static_edges, count(m.src) AS manifest_edges, count(*) FILTER (s.src IS NOT NULL AND m.src IS NOT NULL) AS shared_edges, count(*) FILTER (m.src IS NULL) AS static_only_edges, count(*) FILTER (s.src IS NULL) AS manifest_only_edges
FROM stat s FULL JOIN man m ON s.project = m.project AND s.src = m.src AND s.dst = m.dst GROUP BY 1""",
}
ORACLES["deletion_severity_dense"] = ORACLES["deletion_severity"].replace(MULTI, DENSE).replace("range(12)", "range(24)")

_ROUNDS = "".join(
    f""", l{i} AS (SELECT a.g, a.x, sha256(a.l || '/' || coalesce(q.near, '')) AS l FROM l{i - 1} a
  LEFT JOIN (SELECT e.g, e.u AS x, string_agg(b.l, '|' ORDER BY b.l) AS near FROM e JOIN l{i - 1} b ON b.g = e.g AND b.x = e.v GROUP BY e.g, e.u) q USING (g, x))"""
    for i in range(1, 6)
)
TOPOLOGY = (
    BASE
    + ", l0 AS (SELECT n.g, n.x, coalesce(c, 0)::VARCHAR AS l FROM n LEFT JOIN (SELECT g, x, count(*) AS c FROM (SELECT g, u AS x FROM e UNION ALL SELECT g, v FROM e) GROUP BY g, x) d USING (g, x))"
    + _ROUNDS
    + ", every_ AS ("
    + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(6))
    + """), counted AS (SELECT g, l || ':' || count(*) AS c FROM every_ GROUP BY g, l),
classes AS (SELECT g AS graph_id, substr(sha256(string_agg(c, ',' ORDER BY c)), 1, 32) AS topology_hash FROM counted GROUP BY g)"""
)
STATUS = (
    BASE
    + """, size AS (SELECT g, max(level) AS depth, (SELECT count(*) FROM e WHERE e.g = lv.g) AS m FROM lv GROUP BY g),
state AS (SELECT g AS graph_id, CASE WHEN g IN ('p1', 'p7') THEN 'unresolved-refs' WHEN m = 0 THEN 'direct-only-no-lineage' ELSE 'eligible' END AS replication,
  CASE WHEN g IN ('p1', 'p7') THEN 'unresolved-refs' WHEN m = 0 THEN 'no-lineage' ELSE 'eligible' END AS draft,
  CASE WHEN g IN ('p1', 'p7') THEN 'excluded' WHEN m < 5 OR depth < 2 THEN 'control-only' ELSE 'eligible' END AS priority FROM size)"""
)
DIRECT = (
    BASE
    + """, parts AS (SELECT r.g, r.a, r.b, EXISTS (SELECT 1 FROM e WHERE e.g = r.g AND e.u = r.a AND e.v = r.b) AS given FROM r),
dist AS (SELECT g, a, 0::BIGINT AS fp, count(*) FILTER (NOT given) AS fn, count(*) FILTER (given) AS tp FROM parts GROUP BY g, a)"""
)
ORACLES |= {
    "closure_severity": CUT + " SELECT g AS graph_id, u, v, severity::BIGINT AS closure_severity FROM sev",
    "leave_one_out_range": f"SELECT min(rho) AS min_rho, max(rho) AS max_rho FROM ({ORACLES['leave_one_out_spearman']})",
    "severity_percentiles": CUT + " SELECT g AS graph_id, round(quantile_cont(severity::DOUBLE, 0.025), 9) AS low, round(quantile_cont(severity::DOUBLE, 0.5), 9) AS middle, round(quantile_cont(severity::DOUBLE, 0.975), 9) AS high FROM sev GROUP BY g",
    "graph_statuses": STATUS + " SELECT * FROM state",
    "status_counts": STATUS + " SELECT replication, count(*) AS graphs FROM state GROUP BY replication",
    "census_summary": f"SELECT classification, count(*) AS projects, sum(lineage_edges)::BIGINT AS lineage_edges FROM ({ORACLES['project_census']}) GROUP BY classification",
    "group_audit": f"SELECT unresolved_refs, count(*) AS projects, median(models)::DOUBLE AS median_models, median(sql_files)::DOUBLE AS median_sql_files, count(*) FILTER (has_package_file) AS projects_with_package_file, median(unresolved_refs)::DOUBLE AS median_unresolved_refs FROM ({ORACLES['project_audit']}) GROUP BY unresolved_refs",
    "set_distortion": DIRECT
    + """ SELECT g AS graph_id, a AS anchor, fp, fn, tp, fp + fn AS incorrect, fp + fn > 0 AS distorted, CASE WHEN tp > 0 THEN 1.0::DOUBLE WHEN fn > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS precision, round(tp / (tp + fn), 9) AS recall,
round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fn) ELSE 0.0::DOUBLE END, 9) AS f1 FROM dist""",
    "error_amplification": DIRECT + " SELECT g AS graph_id, sum(fn)::BIGINT AS incorrect, (SELECT count(*) FROM e WHERE e.g = dist.g) AS m, round(sum(fn) / (SELECT count(*) FROM e WHERE e.g = dist.g)::DOUBLE, 9) AS amplification FROM dist GROUP BY g",
    "normal_answers": f"SELECT graph_id, anchor, answer FROM ({ORACLES['direct_downstream']})",
    "gold_differences": f"""SELECT dataset, side, subtype, question, answer, place::INT AS place FROM (
  SELECT dataset, 'missing' AS side, subtype, question, answer, row_number() OVER (PARTITION BY dataset ORDER BY subtype, question, answer) AS place FROM (SELECT DISTINCT dataset, subtype, question, answer FROM ({ORACLES['lineage_questions']}) WHERE question LIKE '%t07%')
  UNION ALL SELECT DISTINCT dataset, 'extra', 'forward', 'extra?', 't00', 1 FROM ({ORACLES['lineage_questions']})) WHERE place <= 10""",
    "topology_classes": TOPOLOGY + " SELECT * FROM classes",
    "topology_groups": TOPOLOGY + " SELECT topology_hash, count(*) OVER (PARTITION BY topology_hash) AS members, graph_id FROM classes QUALIFY members > 1",
    "sampled_edit_check": BASE + " SELECT g AS graph_id, kind, 2::BIGINT AS drawn, 2::BIGINT AS different, 2::BIGINT AS admissible FROM (SELECT DISTINCT g, 'add' AS kind FROM adds UNION ALL SELECT DISTINCT g, 'delete' FROM e)",
    "layered_null_check": BASE + " SELECT g AS graph_id, 200::BIGINT AS seeds, 200 * (SELECT count(*) FROM e WHERE e.g = n.g) AS edges, 200 * count(*) AS nodes_on_level FROM n GROUP BY g",
}
