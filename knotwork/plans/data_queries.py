"""Queries of the general data problems: hierarchies, orphan references, change feeds."""

from __future__ import annotations

from knotwork.operators import changes, hierarchy, orphans
from knotwork.session import table


def p1_found(spark, sf):
    return hierarchy.roots(table(spark, sf, "nodes").select("id", "parent_id"))


def p1_paths(spark, sf):
    return hierarchy.paths(table(spark, sf, "nodes").select("id", "parent_id", "name")).select("id", "root_id", "depth", "path_names", "n_descendants")


def p1_descendants(spark, sf):
    return hierarchy.descendants(table(spark, sf, "nodes").select("id", "parent_id"))


def p1_circles(spark, sf):
    return hierarchy.circles(table(spark, sf, "nodes").select("id", "parent_id"))


def _replayed(spark, sf, history=False):
    return orphans.replayed(
        table(spark, sf, "nodes").select("id", "node_key", "indexed_at"),
        table(spark, sf, "removed_nodes").select("node_id", "node_key", "removed_at"),
        table(spark, sf, "edges").select("edge_id", "source_id", "target_id", "linked_at"),
        table(spark, sf, "memories").select("log_pos", "created_at", "anchors"),
        history=history,
    )


def p5_found(spark, sf):
    return _replayed(spark, sf)[0].orphans().select(*orphans.REF).distinct()


def p5_counts(spark, sf):
    return _replayed(spark, sf)[0].snapshot()


def p5_history(spark, sf):
    """How many references were open at the end of every quarter, as it was then."""
    return _replayed(spark, sf, history=True)[1]


def p7_found(spark, sf):
    return changes.latest_notes(table(spark, sf, "memories").select("log_pos", "change_id", "uid", "created_at", "deleted"))


def p7_state(spark, sf):
    return changes.latest_notes(table(spark, sf, "memories").select("log_pos", "change_id", "uid", "created_at", "deleted", "topic", "content", "repo"), ("topic", "content", "repo"))


def p7_nodes(spark, sf):
    """Nodes as a table kept by a feed of removals, returns and partial updates on a base."""
    return changes.current_nodes(table(spark, sf, "nodes").select("node_key", "content_hash", "indexed_at"), table(spark, sf, "removed_nodes").select("node_key", "removed_at"), table(spark, sf, "memories").select("log_pos", "created_at", "anchors"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_circles, p5_found, p5_counts, p5_history, p7_found, p7_state, p7_nodes)}

_TREE = """
WITH RECURSIVE one AS (SELECT id, min(parent_id) AS p FROM nodes WHERE id IS NOT NULL GROUP BY id),
link AS (SELECT a.id, b.id AS p FROM one a LEFT JOIN one b ON b.id = a.p),
down AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM link WHERE p IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1 FROM link l JOIN down d ON l.p = d.id),
stray AS (SELECT id, p FROM link WHERE id NOT IN (SELECT id FROM down)),
walk AS (SELECT id, p AS moment FROM stray UNION SELECT w.id, s.p FROM walk w JOIN stray s ON s.id = w.moment),
ring AS (SELECT id FROM walk WHERE id = moment),
lost AS (SELECT w.id, min(w.moment) AS root_id FROM walk w JOIN ring r ON r.id = w.moment GROUP BY w.id)
"""

#: Every node's ancestors by following parents step by step; on a circle the walk ends where it meets its start or a node again.
_DOWN = _TREE + """,
climb AS (SELECT id, p AS ancestor_id, CAST(1 AS BIGINT) AS distance, [id] AS seen FROM link WHERE p IS NOT NULL AND p != id
 UNION ALL SELECT c.id, l.p, c.distance + 1, list_append(c.seen, c.ancestor_id) FROM climb c JOIN link l ON l.id = c.ancestor_id WHERE l.p IS NOT NULL AND l.p != c.ancestor_id AND NOT list_contains(c.seen, l.p)),
up AS (SELECT ancestor_id, id, distance FROM climb)
"""

#: Instants of memories.created_at in microseconds, null where unreadable.
_NOTES = r"""
WITH read AS (SELECT *, CASE
   WHEN regexp_full_match(trim(created_at), '\d{9,11}') THEN CAST(trim(created_at) AS BIGINT) * 1000000
   WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?') THEN epoch_us(TRY_CAST(replace(trim(created_at), 'T', ' ') AS TIMESTAMP))
   WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z') THEN epoch_us(TRY_CAST(replace(replace(trim(created_at), 'T', ' '), 'Z', '') AS TIMESTAMP))
   WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}') THEN
     epoch_us(TRY_CAST(replace(left(trim(created_at), length(trim(created_at)) - 6), 'T', ' ') AS TIMESTAMP))
     - (CASE WHEN substr(trim(created_at), -6, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(trim(created_at), -5, 2) AS BIGINT) * 60 + CAST(right(trim(created_at), 2) AS BIGINT)) * 60000000
   END AS moment FROM memories)
"""

_ALIVE = _NOTES + """,
first AS (SELECT * FROM read QUALIFY row_number() OVER (PARTITION BY coalesce('c' || change_id, 'p' || log_pos) ORDER BY log_pos) = 1),
last AS (SELECT * FROM first WHERE uid IS NOT NULL AND uid != '' AND moment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY moment DESC, log_pos DESC) = 1)
"""

_ORPHANS = _NOTES + """,
by_id AS (SELECT id, epoch_us(min(indexed_at)) AS since FROM nodes WHERE id IS NOT NULL GROUP BY id),
by_key AS (SELECT node_key, epoch_us(min(indexed_at)) AS since FROM nodes WHERE node_key IS NOT NULL GROUP BY node_key),
ends AS (SELECT edge_id, linked_at, 'source_id' AS f, source_id AS v FROM edges UNION ALL SELECT edge_id, linked_at, 'target_id', target_id FROM edges),
anchor AS (SELECT log_pos, moment, unnest(map_keys(anchors)) AS v FROM read),
lost AS (
 SELECT DISTINCT 'edges' AS ref_table, e.edge_id AS ref_row, e.f AS ref_field, CAST(e.v AS VARCHAR) AS ref_value, epoch_us(e.linked_at) AS moment, CASE WHEN p.since IS NULL THEN 'pending' ELSE 'late' END AS status
 FROM ends e LEFT JOIN by_id p ON p.id = e.v WHERE e.v IS NOT NULL AND (p.since IS NULL OR epoch_us(e.linked_at) < p.since)
 UNION ALL
 SELECT DISTINCT 'memories', a.log_pos, 'anchors', a.v, a.moment, CASE WHEN p.since IS NULL THEN 'pending' ELSE 'late' END
 FROM anchor a LEFT JOIN by_key p ON p.node_key = a.v WHERE p.since IS NULL OR a.moment < p.since)
"""

SQL = {
    "p1_found": _TREE + "SELECT id, root_id, depth FROM down UNION ALL SELECT id, root_id, -1 FROM lost",
    "p1_circles": _TREE + "SELECT root_id AS circle_id, count(*) AS n_nodes FROM lost GROUP BY 1",
    "p1_descendants": _DOWN + "SELECT ancestor_id, id, distance FROM up",
    "p1_paths": _DOWN
    + """, label AS (SELECT id, coalesce(min(name), '?') AS label FROM nodes WHERE id IS NOT NULL GROUP BY id),
named AS (SELECT d.id, l.label AS path_names FROM down d JOIN label l ON l.id = d.id WHERE d.depth = 0
  UNION ALL SELECT k.id, n.path_names || ' > ' || l.label FROM link k JOIN named n ON k.p = n.id JOIN label l ON l.id = k.id),
below AS (SELECT ancestor_id, count(*) AS n FROM up GROUP BY 1),
every AS (SELECT id, root_id, depth FROM down UNION ALL SELECT id, root_id, -1 FROM lost)
SELECT e.id, e.root_id, e.depth, n.path_names, coalesce(b.n, 0) AS n_descendants FROM every e LEFT JOIN named n ON n.id = e.id LEFT JOIN below b ON b.ancestor_id = e.id""",
    "p5_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_row, ref_field, ref_value FROM lost",
    "p5_counts": _ORPHANS + "SELECT ref_table, ref_field, strftime(make_timestamp(moment), '%Y-%m') AS month, status, count(*) AS n_orphans FROM lost GROUP BY ALL",
    "p5_history": _NOTES
    + """,
refs AS (SELECT DISTINCT 'edges' AS ref_table, edge_id AS ref_row, 'source_id' AS ref_field, '#' || source_id AS k, epoch_us(linked_at) AS moment FROM edges WHERE source_id IS NOT NULL
 UNION SELECT 'edges', edge_id, 'target_id', '#' || target_id, epoch_us(linked_at) FROM edges WHERE target_id IS NOT NULL
 UNION SELECT 'memories', log_pos, 'anchors', '@' || unnest(map_keys(anchors)), moment FROM read),
named AS (SELECT '#' || id AS k, epoch_us(indexed_at) AS since FROM nodes WHERE id IS NOT NULL UNION ALL SELECT '@' || node_key, epoch_us(indexed_at) FROM nodes WHERE node_key IS NOT NULL),
gone AS (SELECT '#' || node_id AS k, epoch_us(removed_at) AS gone FROM removed_nodes WHERE node_id IS NOT NULL UNION ALL SELECT '@' || node_key, epoch_us(removed_at) FROM removed_nodes WHERE node_key IS NOT NULL),
moments AS (SELECT moment AS t FROM refs WHERE moment IS NOT NULL UNION SELECT since FROM named UNION SELECT gone FROM gone),
quarters AS (SELECT DISTINCT date_trunc('quarter', make_timestamp(t)) AS q FROM moments),
ends AS (SELECT q, epoch_us(q + INTERVAL 3 MONTH) AS until FROM quarters UNION ALL SELECT NULL, NULL WHERE EXISTS (SELECT 1 FROM refs WHERE moment IS NULL) OR EXISTS (SELECT 1 FROM gone)),
lives AS (SELECT k, min(since) AS since FROM named GROUP BY k), taken AS (SELECT k, max(gone) AS gone FROM gone GROUP BY k),
seen AS (SELECT e.q, r.*, CASE WHEN l.since < e.until THEN l.since WHEN g.gone IS NOT NULL AND (e.until IS NULL OR g.gone >= e.until) THEN -9223372036854775808 END AS since
 FROM refs r JOIN ends e ON r.moment IS NULL OR r.moment < e.until LEFT JOIN lives l ON l.k = r.k LEFT JOIN taken g ON g.k = r.k)
SELECT coalesce(strftime(q, '%Y-%m'), '0000-01') AS period, ref_table, ref_field, CASE WHEN since IS NULL THEN 'pending' ELSE 'late' END AS status, count(*) AS n_orphans FROM seen WHERE since IS NULL OR moment < since GROUP BY ALL""",
    "p7_found": _ALIVE + "SELECT uid, log_pos FROM last WHERE deleted IS DISTINCT FROM true",
    "p7_nodes": _NOTES
    + """,
gone AS (SELECT node_key, max(epoch_us(removed_at)) AS gone FROM removed_nodes WHERE node_key IS NOT NULL GROUP BY 1),
back AS (SELECT n.node_key, epoch_us(n.indexed_at) AS put, n.content_hash FROM nodes n WHERE n.node_key IN (SELECT node_key FROM gone) QUALIFY row_number() OVER (PARTITION BY n.node_key ORDER BY indexed_at DESC, content_hash DESC) = 1),
there AS (SELECT g.node_key, b.content_hash, b.put FROM gone g JOIN back b ON b.node_key = g.node_key AND b.put >= g.gone
 UNION ALL SELECT node_key, min(content_hash), NULL FROM nodes WHERE node_key IS NOT NULL AND node_key NOT IN (SELECT node_key FROM gone) GROUP BY 1),
anchor AS (SELECT log_pos, moment, unnest(map_entries(anchors)) AS a FROM read WHERE moment IS NOT NULL),
noted AS (SELECT t.node_key, a.a.value AS hash FROM there t JOIN anchor a ON a.a.key = t.node_key AND (t.put IS NULL OR a.moment > t.put) QUALIFY row_number() OVER (PARTITION BY t.node_key ORDER BY a.moment DESC, a.log_pos DESC) = 1)
SELECT t.node_key, t.content_hash, n.hash AS noted_hash FROM there t LEFT JOIN noted n ON n.node_key = t.node_key""",
    "p7_state": _ALIVE + "SELECT uid, log_pos, topic, content, repo FROM last WHERE deleted IS DISTINCT FROM true",
}
