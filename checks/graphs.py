"""Registered queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from checks.sql_base import part
from procatlas.operators import graph, resolve, rollup
from checks.workspace import workspace

_san = lambda p, c, of="": f"'{p}' || {of}connection_id || '_' || regexp_replace({c}, '[^a-zA-Z0-9_]', '_', 'g')"
_last = lambda c: f"string_split({c}, '.')[-1]"
_schema = lambda c: f"CASE WHEN contains({c}, '.') THEN string_split({c}, '.')[1] ELSE '' END"
part("call_edges", ["deps", "objs"], f"""
SELECT concat_ws('_', 'dep', d.object_id, dep_type, target_name, line) AS edge_id, 'obj_' || d.object_id AS source,
  CASE WHEN t.object_id IS NOT NULL THEN 'obj_' || t.object_id ELSE {_san('ext_', 'target_name', 'd.')} END AS target, dep_type, is_dynamic,
  cast(confidence AS double) AS confidence, s.object_name AS source_label, coalesce(t.object_name, {_last('target_name')}) AS target_label
FROM deps d JOIN objs s USING (object_id) LEFT JOIN objs t ON t.object_id = d.target_id""")
part("table_edges", ["acc", "objs"], f"""
SELECT concat_ws('_', 'ta', object_id, operation, full_table_name) AS edge_id, 'obj_' || object_id AS source, {_san('tbl_', 'full_table_name', 'acc.')} AS target,
  CASE WHEN operation = 'SELECT' THEN 'reads_from' ELSE 'writes_to' END AS dep_type, false AS is_dynamic, cast(1.0 AS double) AS confidence,
  object_name AS source_label, table_name AS target_label FROM acc JOIN objs USING (object_id)""")
part("edges", ["call_edges", "table_edges"], "SELECT * FROM call_edges UNION ALL SELECT * FROM table_edges")
_virtual = lambda src, c, p, kind, where: f"""
SELECT id, label, '{kind}' AS object_type, schema_name, cast(NULL AS integer) AS complexity, cast(0 AS bigint) AS finding_count FROM (
  SELECT id, label, schema_name, row_number() OVER (PARTITION BY id ORDER BY label, schema_name) AS rn FROM (
    SELECT DISTINCT {_san(p, c)} AS id, {_last(c)} AS label, {_schema(c)} AS schema_name FROM {src} WHERE {where}) a) b WHERE rn = 1"""
part("nodes", ["objs", "cplx", "finds", "deps", "acc"], f"""
SELECT 'obj_' || object_id AS id, object_name AS label, object_type, schema_name, cyclomatic AS complexity, coalesce(n, 0) AS finding_count
FROM objs JOIN cplx USING (object_id) LEFT JOIN (SELECT object_id, count(*) AS n FROM finds GROUP BY object_id) f USING (object_id)
UNION ALL {_virtual('deps', 'target_name', 'ext_', 'external', 'target_id IS NULL')}
UNION ALL {_virtual('acc', 'full_table_name', 'tbl_', 'table', 'true')}""")
part("walk_out", ["edges"], "SELECT DISTINCT source AS src, target AS dst FROM edges")
part("walk_both", ["edges"], "SELECT source AS src, target AS dst FROM edges UNION SELECT target, source FROM edges")
part("hub", ["edges"], """
SELECT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e WHERE starts_with(id, 'obj_')
GROUP BY id ORDER BY count(*) DESC, id LIMIT 1""")
part("roots", ["nodes", "edges"], "SELECT id FROM nodes WHERE id NOT IN (SELECT target FROM edges)")
part("leaves", ["nodes", "edges"], "SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges)")


def _ws(fn):
    return lambda s, sf: fn(workspace(s, sf))


def hub(w):
    """The object with the most incident edges."""
    return rollup.node_degree(w.edges).where(F.col("id").startswith("obj_")).orderBy(F.col("degree").desc(), "id").limit(1).select("id")


register("u1_edge_union", _ws(lambda w: w.edges), ["edges"], "SELECT * FROM edges")
register("u2_node_union", _ws(lambda w: w.nodes), ["nodes"], "SELECT * FROM nodes")
register("g1_graph_assembly",
         _ws(lambda w: w.edges.groupBy("dep_type", F.substring_index("target", "_", 1).alias("target_kind")).agg(
             F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))),
         ["edges"], """
SELECT dep_type, string_split(target, '_')[1] AS target_kind, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets
FROM edges GROUP BY 1, 2""")
register("u3_roots_and_leaves",
         _ws(lambda w: graph.root_nodes(w.nodes, w.edges).withColumn("role", F.lit("root")).unionByName(
             graph.leaf_nodes(w.nodes, w.edges).withColumn("role", F.lit("leaf")))), ["roots", "leaves"],
         "SELECT id, 'root' AS role FROM roots UNION ALL SELECT id, 'leaf' FROM leaves")
register("g5_root_leaf_counts",
         _ws(lambda w: rollup.side_by_side(
             graph.root_nodes(w.nodes, w.edges).agg(F.count(F.lit(1)).alias("roots")),
             graph.leaf_nodes(w.nodes, w.edges).agg(F.count(F.lit(1)).alias("leaves")))), ["roots", "leaves"],
         "SELECT (SELECT count(*) FROM roots) AS roots, (SELECT count(*) FROM leaves) AS leaves")

_khop = lambda walk, depth: f""", hop AS (
  SELECT id, 0 AS depth FROM hub UNION SELECT w.dst, hop.depth + 1 FROM hop JOIN {walk} w ON w.src = hop.id WHERE hop.depth < {depth}),
near AS MATERIALIZED (SELECT id, cast(min(depth) AS integer) AS depth FROM hop GROUP BY id)
"""
register("g2_neighbourhood", _ws(lambda w: graph.reach(w.edges, hub(w), 3)), ["walk_both", "hub"],
         _khop("walk_both", 3) + "SELECT * FROM near", recursive=True)
register("g3_induced_subgraph",
         _ws(lambda w: graph.induced(w.nodes, w.edges, graph.reach(w.edges, hub(w), 2))[1].select("edge_id", "source", "target", "dep_type")),
         ["walk_both", "hub", "edges"],
         _khop("walk_both", 2) + "SELECT edge_id, source, target, dep_type FROM edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)",
         recursive=True)
register("g4_type_filter",
         _ws(lambda w: graph.filter_types(w.nodes, w.edges, ["calls", "writes_to"], True)[0]), ["nodes", "edges"], """
SELECT * FROM nodes WHERE id IN (SELECT source FROM edges WHERE dep_type IN ('calls', 'writes_to') UNION SELECT target FROM edges WHERE dep_type IN ('calls', 'writes_to'))""")
part("root_walk", ["roots", "walk_out"], "SELECT id FROM roots WHERE id IN (SELECT src FROM walk_out)")
_depth = """, far AS (
  SELECT id AS root, id, 0 AS depth FROM root_walk UNION SELECT far.root, w.dst, far.depth + 1 FROM far JOIN walk_out w ON w.src = far.id WHERE far.depth < 24),
dist AS (SELECT root, id, min(depth) AS depth FROM far GROUP BY root, id)
"""
register("g6_max_depth", _ws(lambda w: w.deepest), ["root_walk", "walk_out"],
         _depth + "SELECT cast(max(depth) AS integer) AS max_depth FROM dist", recursive=True)
_comp = """, meets AS (SELECT src, dst FROM walk_out UNION SELECT m.src, w.dst FROM meets m JOIN walk_out w ON w.src = m.dst),
comp AS MATERIALIZED (SELECT a.src AS id, min(a.dst) AS component FROM meets a JOIN meets b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
"""
_cyc = """, grow AS (
  SELECT src AS start, [src] AS path, dst AS next FROM walk_out WHERE src <= dst
  UNION ALL SELECT g.start, list_append(g.path, g.next), w.dst FROM grow g JOIN walk_out w ON w.src = g.next
  WHERE g.next <> g.start AND len(g.path) < 6 AND w.dst >= g.start AND (w.dst = g.start OR NOT list_contains(list_append(g.path, g.next), w.dst))),
cyc AS MATERIALIZED (SELECT array_to_string(path, '>') AS cycle, cast(len(path) AS integer) AS length FROM grow WHERE next = start),
longer AS (SELECT count(*) > 0 AS has_longer FROM grow g JOIN walk_out w ON w.src = g.next JOIN comp a ON a.id = g.start
  JOIN comp b ON b.id = w.dst AND b.component = a.component WHERE g.next <> g.start AND len(g.path) = 6
  AND w.dst >= g.start AND (w.dst = g.start OR NOT list_contains(list_append(g.path, g.next), w.dst)))
"""
register("g7_circular_dependencies", _ws(lambda w: graph.cycles(w.edges, 6, w.components)), ["walk_out"], _comp + _cyc + "SELECT cyc.*, has_longer FROM cyc, longer", recursive=True)
register("g7_cycle_nodes", _ws(lambda w: w.components), ["walk_out"],
         _comp + "SELECT * FROM comp", recursive=True)
register("g8_call_chain",
         _ws(lambda w: graph.call_chain(w.edges, hub(w)).select("edge_id", "source", "target", "dep_type", "direction")), ["edges", "hub"], """
, down AS (SELECT id FROM hub UNION SELECT e.target FROM down JOIN edges e ON e.source = down.id),
up AS (SELECT id FROM hub UNION SELECT e.source FROM up JOIN edges e ON e.target = up.id)
SELECT edge_id, source, target, dep_type, 'downstream' AS direction FROM edges WHERE source IN (SELECT id FROM down) AND target IN (SELECT id FROM down)
UNION ALL SELECT edge_id, source, target, dep_type, 'upstream' FROM edges WHERE source IN (SELECT id FROM up) AND target IN (SELECT id FROM up)""", recursive=True)
register("g9_graph_summary", _ws(lambda w: graph.summary(w.nodes, w.edges, w.components, w.deepest)), ["nodes", "edges", "roots", "leaves", "root_walk", "walk_out"],
         _comp + _depth + """
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM roots) AS roots,
  (SELECT count(*) FROM leaves) AS leaves, (SELECT count(DISTINCT component) FROM comp) AS cyclic_components, (SELECT cast(max(depth) AS integer) FROM dist) AS max_depth""", recursive=True)


def _caller(w):
    calls = w.edges.where("dep_type = 'calls'")
    return calls.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("n")).orderBy(F.col("n").desc(), "id").limit(1).select("id")


register("g10_call_tree",
         _ws(lambda w: graph.call_tree(w.edges, _caller(w), 6).withColumn("path", F.array_join("path", ">"))), ["edges"], """
, steps AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE dep_type = 'calls'),
top AS (SELECT src AS id FROM steps GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
tree AS (SELECT [id] AS path, 0 AS depth, id AS node, false AS is_circular FROM top
  UNION ALL SELECT list_append(t.path, s.dst), t.depth + 1, s.dst, list_contains(t.path, s.dst) FROM tree t JOIN steps s ON s.src = t.node
  WHERE NOT t.is_circular AND t.depth < 6)
SELECT array_to_string(path, '>') AS path, depth, node, is_circular, depth = 6 AND NOT is_circular AND node IN (SELECT src FROM steps) AS is_truncated FROM tree""", recursive=True)
register("g10_call_tree_counts",
         _ws(lambda w: graph.call_tree_counts(w.edges, _caller(w), 6).withColumn("paths", F.col("paths").cast("long"))), ["edges"], """
, steps AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE dep_type = 'calls'),
top AS (SELECT src AS id FROM steps GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
walks AS (SELECT id AS node, 0 AS depth FROM top UNION ALL SELECT s.dst, w.depth + 1 FROM walks w JOIN steps s ON s.src = w.node WHERE w.depth < 6)
SELECT node, depth, count(*) AS paths, depth = 6 AND node IN (SELECT src FROM steps) AS is_truncated FROM walks GROUP BY node, depth""", recursive=True)
register("j14_direct_lineage", _ws(lambda w: resolve.direct_lineage(w.edges, hub(w))), ["edges", "hub"], """
SELECT DISTINCT source, target, dep_type, 'upstream' AS direction FROM edges WHERE target IN (SELECT id FROM hub)
UNION ALL SELECT DISTINCT source, target, dep_type, CASE WHEN dep_type = 'calls' THEN 'downstream' ELSE 'tables' END FROM edges WHERE source IN (SELECT id FROM hub)""")
