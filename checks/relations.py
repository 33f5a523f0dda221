"""Registered queries: joins between facts, objects and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from checks.sql_base import part, words
from procatlas.operators import resolve
from checks.workspace import workspace
from checks import corpus


def _shape(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns)


for _name, (_where, _cols) in corpus.METADATA.items():
    part(_name, [], f"SELECT {_shape(list(_cols.items()))} FROM (SELECT {corpus.columns_sql(corpus.PART_COLUMNS)} FROM part) p WHERE {_where}")
part("tabs", ["md_columns"], "SELECT DISTINCT connection_id, schema_name, table_name, schema_name || '.' || table_name AS fqn FROM md_columns")

_dep = "object_id, connection_id, target_name, dep_type, line, is_dynamic, confidence, target_id"


def _deps(df):
    return df.drop("snippet").withColumn("confidence", F.col("confidence").cast("double"))


register("j1_target_resolution", lambda s, sf: _deps(workspace(s, sf).dependencies), ["deps"], f"SELECT {_dep} FROM deps")
register("j2_facts_of_connection",
         lambda s, sf: _deps(resolve.of_connection(workspace(s, sf).dependencies, workspace(s, sf).objects, 0)).groupBy(
             "object_id", "dep_type").agg(F.count(F.lit(1)).alias("n")),
         ["deps"], "SELECT object_id, dep_type, count(*) AS n FROM deps WHERE connection_id = 0 GROUP BY object_id, dep_type")


def _functions(s, sf):
    return workspace(s, sf).objects.where("object_type = 'function'").select("object_id")


register("j3_facts_by_source", lambda s, sf: _deps(resolve.by_source(workspace(s, sf).dependencies, _functions(s, sf))),
         ["deps", "objs"], f"SELECT {_dep} FROM deps WHERE object_id IN (SELECT object_id FROM objs WHERE object_type = 'function')")
register("j3_facts_by_target", lambda s, sf: _deps(resolve.by_target(workspace(s, sf).dependencies, _functions(s, sf))),
         ["deps", "objs"], f"SELECT {_dep} FROM deps WHERE target_id IN (SELECT object_id FROM objs WHERE object_type = 'function')")
register("j4_edge_enrichment",
         lambda s, sf: _deps(resolve.enrich_edges(workspace(s, sf).dependencies, workspace(s, sf).objects, workspace(s, sf).complexity)),
         ["deps", "objs", "cplx"], """
SELECT d.object_id AS source_id, d.connection_id, target_name, dep_type, line, is_dynamic, confidence, target_id,
  a.object_name AS source_object_name, a.schema_name AS source_schema, a.object_type AS source_type, ca.cyclomatic AS source_complexity,
  b.object_name AS target_object_name, b.schema_name AS target_schema, b.object_type AS target_type, cb.cyclomatic AS target_complexity
FROM deps d JOIN objs a USING (object_id) JOIN cplx ca ON ca.object_id = d.object_id
LEFT JOIN objs b ON b.object_id = d.target_id LEFT JOIN cplx cb ON cb.object_id = d.target_id""")
register("j5_access_enrichment",
         lambda s, sf: resolve.enrich_accesses(workspace(s, sf).accesses, workspace(s, sf).objects), ["acc", "objs"],
         "SELECT a.*, o.schema_name, o.object_name FROM acc a JOIN objs o USING (object_id, connection_id)")
register("j6_accessed_by",
         lambda s, sf: resolve.accessed_by(workspace(s, sf).tables, workspace(s, sf).accesses, workspace(s, sf).objects),
         ["tabs", "acc", "objs"], """
SELECT a.connection_id, a.full_table_name, a.object_id, o.object_name, o.schema_name, o.object_type, a.operation
FROM acc a JOIN objs o USING (object_id) JOIN tabs t ON t.connection_id = a.connection_id AND t.fqn = a.full_table_name""")
register("j7_tables_of_objects",
         lambda s, sf: resolve.tables_of_objects(workspace(s, sf).tables, workspace(s, sf).accesses, _functions(s, sf)).select(
             "connection_id", "fqn", "schema_name", "table_name"),
         ["tabs", "acc", "objs"], """
SELECT * FROM tabs t WHERE EXISTS (SELECT 1 FROM acc a JOIN objs o USING (object_id) WHERE o.object_type = 'function'
  AND a.connection_id = t.connection_id AND a.full_table_name = t.fqn)""")

part("links", ["md_fk", "tabs"], """
SELECT f.connection_id, f.schema_name || '.' || f.table_name AS source_fqn, constraint_name,
  string_agg(column_name, ',' ORDER BY ordinal) AS columns, coalesce(any_value(a.fqn), any_value(b.fqn)) AS target_fqn,
  string_agg(ref_column, ',' ORDER BY ordinal) AS referenced_columns,
  CASE any_value(on_delete) WHEN 'c' THEN 'CASCADE' WHEN 'a' THEN 'NO ACTION' ELSE 'SET NULL' END AS on_delete, 'NO ACTION' AS on_update
FROM md_fk f LEFT JOIN tabs a ON a.connection_id = f.connection_id AND a.fqn = f.ref_schema || '.' || f.ref_table
LEFT JOIN tabs b ON b.connection_id = f.connection_id AND b.fqn = lower(f.ref_schema || '.' || f.ref_table)
WHERE coalesce(a.fqn, b.fqn) IS NOT NULL
GROUP BY f.connection_id, f.schema_name, f.table_name, constraint_name""")


def _links(s, sf):
    return resolve.relationships(workspace(s, sf).tables)


def _flat(df):
    return df.withColumn("columns", F.array_join("columns", ",")).withColumn(
        "referenced_columns", F.array_join("referenced_columns", ","))


register("j8_relationships", lambda s, sf: _flat(_links(s, sf)), ["links"], "SELECT * FROM links")


def _most_linked(links):
    ends = links.select("connection_id", F.explode(F.array("source_fqn", "target_fqn")).alias("fqn"))
    return ends.groupBy("connection_id", "fqn").count().orderBy(F.col("count").desc(), "fqn").limit(1).select("connection_id", "fqn")


register("j12_relationships_of_table",
         lambda s, sf: _flat(resolve.relationships_of_tables(_links(s, sf), _most_linked(_links(s, sf)))), ["links"], """
SELECT l.*, t.fqn FROM links l, (SELECT fqn FROM (SELECT source_fqn AS fqn FROM links UNION ALL SELECT target_fqn FROM links) e
  GROUP BY fqn ORDER BY count(*) DESC, fqn LIMIT 1) t WHERE l.source_fqn = t.fqn OR l.target_fqn = t.fqn""")


def native_dependencies(s, sf):
    """Dependencies as the databases keep them: half of the call statements, bound to the real callee."""
    rows = corpus.shaped(s, sf, "lineitem", corpus.STATEMENT_COLUMNS)
    return rows.where("u % 10 IN (4, 8, 9) AND q % 2 = 0").select(F.col("k").alias("object_id"), F.col("half").alias("target_id")).distinct()


_native = f"SELECT DISTINCT k AS object_id, half AS target_id FROM (SELECT {corpus.columns_sql(corpus.STATEMENT_COLUMNS)} FROM lineitem) b WHERE u % 10 IN (4, 8, 9) AND q % 2 = 0"
part("native", [], _native)
register("s5_native_dependencies", native_dependencies, ["native"], "SELECT * FROM native")
register("j9_reconciliation",
         lambda s, sf: resolve.reconcile(
             native_dependencies(s, sf),
             workspace(s, sf).dependencies.where("dep_type = 'calls' AND target_id IS NOT NULL"), ["object_id", "target_id"]),
         ["native", "deps"], """
SELECT object_id, target_id, CASE WHEN n AND e THEN 'both' WHEN n THEN 'only_native' ELSE 'only_extracted' END AS status FROM (
  SELECT object_id, target_id, bool_or(src = 1) AS n, bool_or(src = 2) AS e FROM (
    SELECT object_id, target_id, 1 AS src FROM native UNION ALL
    SELECT object_id, target_id, 2 FROM deps WHERE dep_type = 'calls' AND target_id IS NOT NULL) u GROUP BY object_id, target_id) x""")
register("j11_drill_down",
         lambda s, sf: resolve.drill_down(workspace(s, sf).dependencies, workspace(s, sf).accesses, workspace(s, sf).complexity,
                                          workspace(s, sf).objects.select("object_id", "fqn")),
         ["deps", "acc", "cplx", "objs"], """
SELECT d.object_id, d.target_name, d.line, d.target_id, o.fqn AS callee_fqn, c.cyclomatic AS callee_complexity,
  (SELECT count(*) FROM deps x WHERE x.object_id = d.target_id AND x.dep_type = 'calls') AS callee_calls,
  (SELECT count(DISTINCT full_table_name) FROM acc a WHERE a.object_id = d.target_id) AS callee_tables
FROM deps d JOIN objs o ON o.object_id = d.target_id JOIN cplx c ON c.object_id = d.target_id WHERE d.dep_type = 'calls'""")
