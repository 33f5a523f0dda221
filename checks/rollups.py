"""Registered queries: aggregations, listings, predicates and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from checks.sql_base import RISK_SQL, part, q, words
from procatlas.functions import fixed_values as fv
from procatlas.functions import scalars
from procatlas.operators import extract, listing, rollup
from checks.workspace import workspace
from checks import corpus
from procatlas.sources import readers
import checks.graphs  # noqa: F401  (edges and nodes parts)
import checks.relations  # noqa: F401  (metadata parts)


def _ws(fn):
    return lambda s, sf: fn(workspace(s, sf))


def _day(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


part("conns", [], "SELECT " + ", ".join(f"{e} AS {c}" for c, e in corpus.CONNECTION_COLUMNS.items()) + " FROM nation")
part("jobs", [], "SELECT " + ", ".join(f"{e} AS {c}" for c, e in corpus.JOB_COLUMNS.items()) + " FROM orders")
part("audit", [], "SELECT " + ", ".join(f"{e} AS {c}" for c, e in corpus.AUDIT_COLUMNS.items()) + " FROM events")

# -- aggregations
register("a1_crud_matrix", _ws(lambda w: rollup.crud_matrix(w.accesses, w.objects)), ["acc", "objs"], """
SELECT object_id, full_table_name, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, any_value(o.object_name) AS object_name,
  any_value(o.schema_name) AS schema_name FROM acc JOIN objs o USING (object_id) GROUP BY object_id, full_table_name""")
_bucket = "CASE dep_type WHEN 'calls' THEN 'exec' WHEN 'reads_from' THEN 'reads' WHEN 'writes_to' THEN 'writes' ELSE 'refs' END"
part("cells", ["edges", "nodes"], f"""
SELECT DISTINCT source, n.label AS object_name, n.schema_name, {_bucket} AS bucket, target_label FROM edges JOIN nodes n ON n.id = source""")
register("a2_dependency_matrix", _ws(lambda w: rollup.dependency_matrix(w.nodes, w.edges)), ["cells"], "SELECT * FROM cells")
register("a2_dependency_matrix_counts",
         _ws(lambda w: rollup.dependency_matrix_counts(rollup.dependency_matrix(w.nodes, w.edges, "p1"))), ["cells"], """
SELECT source, object_name, schema_name, count(*) FILTER (bucket = 'exec') AS n_exec, count(*) FILTER (bucket = 'reads') AS n_reads,
  count(*) FILTER (bucket = 'writes') AS n_writes, count(*) FILTER (bucket = 'refs') AS n_refs
FROM cells WHERE contains(lower(object_name), 'p1') GROUP BY source, object_name, schema_name""")
register("a3_impact_ranking", _ws(lambda w: rollup.impact_ranking(w.edges)), ["edges"],
         "SELECT target, min(target_label) AS label, count(*) AS incoming FROM edges GROUP BY target")
register("a4_impact_statistics", _ws(lambda w: rollup.impact_statistics(w.edges)), ["edges"], """
SELECT target, count(*) AS total, count(*) FILTER (dep_type = 'calls') AS n_exec, count(*) FILTER (dep_type = 'reads_from') AS n_read,
  count(*) FILTER (dep_type = 'writes_to') AS n_write FROM edges GROUP BY target""")


def _impact_detail(w):
    top = w.edges.groupBy("target").count().where(F.col("target").startswith("obj_") & (F.col("count") >= 3))
    return rollup.impact_detail(w.edges, top.select("target"))


register("a5_impact_detail", _ws(_impact_detail), ["edges"], """
, top AS (SELECT target FROM edges WHERE starts_with(target, 'obj_') GROUP BY target HAVING count(*) >= 3)
SELECT edge_id, source, target, dep_type, 'in' AS direction, cast(round(confidence * 100) AS integer) AS percent FROM edges WHERE target IN (SELECT target FROM top)
UNION ALL SELECT edge_id, source, target, dep_type, 'out', cast(round(confidence * 100) AS integer) FROM edges WHERE source IN (SELECT target FROM top)""")
_levels = " UNION ALL ".join(f"SELECT '{s}' AS severity" for s in fv.SEVERITIES)
register("a6_severity_histogram", _ws(lambda w: rollup.severity_histogram(w.findings)), ["finds"], f"""
SELECT l.severity, count(f.severity) AS findings FROM ({_levels}) l LEFT JOIN finds f ON f.severity = l.severity GROUP BY l.severity""")
register("a7_risk_distribution", _ws(lambda w: rollup.risk_distribution(w.objects, w.complexity)), ["cplx"],
         f"SELECT {RISK_SQL} AS risk, count(*) AS objects FROM cplx GROUP BY 1")
register("a8_dashboard", lambda s, sf: rollup.dashboard(corpus.connections(s, sf), workspace(s, sf).objects, workspace(s, sf).findings),
         ["objs", "finds"], "SELECT (SELECT count(*) FROM nation) AS connections, (SELECT count(*) FROM objs) AS objects, (SELECT count(*) FROM finds) AS findings")
_SEQUENCE = "column_name = 'c0'"  # the first key column of each table counts from a sequence
register("a9_schema_inventory",
         lambda s, sf: rollup.schema_inventory(
             workspace(s, sf).objects, workspace(s, sf).tables,
             corpus.metadata(s, sf, "md_index"), corpus.metadata(s, sf, "md_pk").where(_SEQUENCE)).withColumnRenamed("indexes", "n_indexes"),
         ["objs", "tabs", "md_index", "md_pk"], f"""
SELECT *, procedures + functions + triggers + views + tables AS total FROM (
  SELECT connection_id, schema_name, count(*) FILTER (k = 'procedure') AS procedures, count(*) FILTER (k = 'function') AS functions, count(*) FILTER (k = 'trigger') AS triggers,
    count(*) FILTER (k = 'view') AS views, count(*) FILTER (k = 'table') AS tables, count(*) FILTER (k = 'sequence') AS sequences, count(*) FILTER (k = 'index') AS n_indexes FROM (
    SELECT connection_id, schema_name, object_type AS k FROM objs UNION ALL SELECT connection_id, schema_name, 'table' FROM tabs
    UNION ALL SELECT connection_id, schema_name, 'sequence' FROM md_pk WHERE {_SEQUENCE}
    UNION ALL SELECT DISTINCT ON (connection_id, schema_name, table_name, index_name) connection_id, schema_name, 'index' FROM md_index) u GROUP BY connection_id, schema_name) x""")
register("a10_connection_counts",
         _ws(lambda w: rollup.kind_counts(w.objects, ["connection_id"], ["procedure", "function", "trigger", "view"])), ["objs"], """
SELECT connection_id, count(*) FILTER (object_type = 'procedure') AS procedures, count(*) FILTER (object_type = 'function') AS functions,
  count(*) FILTER (object_type = 'trigger') AS triggers, count(*) FILTER (object_type = 'view') AS views FROM objs GROUP BY connection_id""")
register("a11_schema_tree", _ws(lambda w: rollup.schema_tree(w.objects, w.tables, by="count")), ["objs", "tabs"], """
SELECT connection_id, schema_name, cast(sum(o) AS bigint) AS objects, cast(sum(t) AS bigint) AS tables, cast(sum(o) + sum(t) AS bigint) AS total FROM (
  SELECT connection_id, schema_name, count(*) AS o, 0 AS t FROM objs GROUP BY ALL
  UNION ALL SELECT connection_id, schema_name, 0, count(*) FROM tabs GROUP BY ALL) u GROUP BY connection_id, schema_name""")

SUBMITTED = {
    "text_id": "doc_id",
    "sql": "CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 97 = 1 THEN repeat(text, 60) ELSE text END",
    "dialect": "CASE doc_id % 8 WHEN 0 THEN 'tsql' WHEN 1 THEN 'SQLServer' WHEN 2 THEN 'plpgsql' WHEN 3 THEN 'postgres' "
               "WHEN 4 THEN 'postgresql' WHEN 5 THEN 'plsql' WHEN 6 THEN 'Oracle' ELSE 'mysql' END",
}


def _admitted(s, sf):
    return readers.admit(corpus.shaped(s, sf, "documents", SUBMITTED))


_alias = "CASE lower(dialect) " + " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in fv.DIALECT_ALIASES.items()) + " END"
part("admitted", [], f"""
SELECT text_id, dialect, canonical, reason, reason IS NULL AS accepted FROM (
  SELECT *, CASE WHEN regexp_matches(sql, '^\\s*$') THEN 'blank text' WHEN length(sql) > {fv.MAX_TEXT_LENGTH} THEN 'text too long'
    WHEN canonical IS NULL THEN 'unknown dialect' END AS reason FROM (
    SELECT *, {_alias} AS canonical FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in SUBMITTED.items())} FROM documents) a) b) c""")
register("s6_admission", lambda s, sf: _admitted(s, sf).drop("sql"), ["admitted"],
         "SELECT text_id, dialect, canonical, reason, accepted FROM admitted")
register("a12_batch_summary", lambda s, sf: rollup.batch_summary(_admitted(s, sf)), ["admitted"], """
SELECT count(*) FILTER (accepted) AS processed, count(*) FILTER (NOT accepted) AS errors, bool_and(accepted) AS success FROM admitted""")
register("a12_text_summary", _ws(lambda w: rollup.text_summary(w.objects, w.dependencies, w.findings)), ["objs", "deps", "finds"], """
SELECT o.object_id, coalesce(d, 0) AS dependencies, coalesce(f, 0) AS findings, coalesce(c, false) AS has_critical FROM objs o
LEFT JOIN (SELECT object_id, count(*) AS d FROM deps GROUP BY object_id) x USING (object_id)
LEFT JOIN (SELECT object_id, count(*) AS f, bool_or(severity = 'critical') AS c FROM finds GROUP BY object_id) y USING (object_id)""")
register("a13_variable_summary", _ws(lambda w: rollup.variable_summary(w.variables)), ["vars"], """
SELECT object_id, variable_name, CASE WHEN arg_min(reference_type, (line, reference_type)) IN ('parameter_in', 'parameter_out') THEN 'parameters'
    WHEN starts_with(variable_name, '#') THEN 'tempTables' ELSE 'localVariables' END AS category,
  count(*) AS n_references, arg_max(data_type, (line, reference_type)) FILTER (data_type IS NOT NULL) AS data_type
FROM vars GROUP BY object_id, variable_name""")
register("a14_variable_trace", _ws(lambda w: rollup.variable_trace(w.variables, "@v")), ["vars"], "SELECT * FROM vars WHERE variable_name = '@v'")
register("a15_structure_counts", _ws(lambda w: extract.structure_counts(w.objects)), ["src_lines"], f"""
SELECT object_id, cast(count(*) FILTER (regexp_matches(trimmed, {q('(?i)' + fv.LINE_CLASSES[0][1])})) AS integer) AS conditions,
  cast(count(*) FILTER (regexp_matches(trimmed, {q('(?i)' + fv.LINE_CLASSES[1][1])})) AS integer) AS loops,
  cast(count(*) FILTER (regexp_matches(trimmed, '(?i)^BEGIN\\s+TRY\\b')) AS integer) AS try_blocks
FROM src_lines WHERE object_type <> 'view' GROUP BY object_id""")
register("a19_referenced_by", _ws(lambda w: rollup.referenced_by(w.accesses)), ["acc"], """
SELECT connection_id, full_table_name, count(DISTINCT object_id) AS objects, count(DISTINCT object_id) > 10 AS heavily_referenced
FROM acc GROUP BY connection_id, full_table_name""")


def _jobs(s, sf):
    return corpus.jobs(s, sf)


def _timed(s, sf):
    return _jobs(s, sf).select(
        "job_id", F.col("created_at").alias("started_at"),
        F.when(F.col("status") == "completed", F.date_add("created_at", F.col("total_objects"))).alias("completed_at"))


register("a20_analysis_summary",
         lambda s, sf: rollup.analysis_summary(workspace(s, sf).objects, workspace(s, sf).dependencies, workspace(s, sf).findings, _timed(s, sf),
                                              workspace(s, sf).complexity),
         ["objs", "deps", "finds", "jobs", "cplx"], """
SELECT * FROM (SELECT count(*) AS objects, """ + ", ".join(f"count(*) FILTER (object_type = '{k}') AS {k}s" for k in ("procedure", "function", "trigger", "view", "package"))
         + " FROM objs) o, (SELECT count(*) AS dependencies FROM deps) d, (SELECT count(*) AS findings, "
         + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in fv.SEVERITIES)
         + """ FROM finds) f, (SELECT cast(date_diff('day', min(cast(created_at AS date)), max(cast(created_at AS date) + total_objects) FILTER (status = 'completed')) AS integer) AS days,
    cast(date_diff('second', min(cast(created_at AS timestamp)), max(cast(cast(created_at AS date) + total_objects AS timestamp)) FILTER (status = 'completed')) AS bigint) AS seconds FROM jobs) j,
  (SELECT string_agg(fqn || ':' || cyclomatic, ', ' ORDER BY cyclomatic DESC, fqn, object_id) AS top_complex FROM (
    SELECT object_id, fqn, cyclomatic FROM cplx JOIN objs USING (object_id) ORDER BY cyclomatic DESC, fqn, object_id LIMIT 5) t) c""")
register("a21_node_degree", _ws(lambda w: rollup.node_degree(w.edges)), ["edges"], """
SELECT id, count(*) AS degree, cast(sum(inward) AS bigint) AS in_degree FROM (
  SELECT source AS id, 0 AS inward FROM edges UNION ALL SELECT target, 1 FROM edges) e GROUP BY id""")
register("a22_findings_per_object", _ws(lambda w: rollup.findings_per_object(w.objects, w.findings)), ["objs", "finds"], """
SELECT o.object_id, count(f.object_id) AS findings FROM objs o LEFT JOIN finds f ON f.object_id = o.object_id GROUP BY o.object_id""")
register("a23_table_sizes", lambda s, sf: rollup.table_sizes(corpus.metadata(s, sf, "md_partition")), ["md_partition"], f"""
SELECT connection_id, schema_name, table_name, cast(sum(row_count) AS bigint) AS row_count, cast(sum(pages) * {fv.PAGE_BYTES} AS bigint) AS bytes
FROM md_partition GROUP BY connection_id, schema_name, table_name""")

# -- listings
part("listed_objs", ["objs", "finds", "cplx"], """
SELECT object_id, connection_id, object_name, fqn, object_type, cyclomatic FROM objs JOIN cplx USING (object_id)
WHERE connection_id = 1 AND (contains(lower(object_name), 'p1') OR contains(lower(fqn), 'p1')) AND object_id IN (SELECT object_id FROM finds)""")


def _list(w, which):
    rows = w.objects.drop("definition", "seen_at", "dialect", "schema_name").join(w.complexity.select("object_id", "cyclomatic", "lines"), "object_id")
    return listing.list_objects(rows, sort="estimatedComplexity", descending=True, number=2, size=20, connection_id=1, search="p1",
                                has_findings=True, findings=w.findings)[which]


register("p1_object_page", _ws(lambda w: _list(w, 0).drop("lines")), ["listed_objs"],
         "SELECT * FROM listed_objs ORDER BY cyclomatic DESC, object_id LIMIT 20 OFFSET 20")
register("p1_object_totals", _ws(lambda w: _list(w, 1)), ["listed_objs"],
         "SELECT count(*) AS total, cast(ceil(count(*) / 20) AS bigint) AS pages FROM listed_objs")
register("p2_table_listing",
         _ws(lambda w: listing.list_tables(
             w.tables.select("connection_id", "schema_name", "table_name", "table_type", "fqn").join(
                 rollup.referenced_by(w.accesses).select("connection_id", F.col("full_table_name").alias("fqn"), F.col("objects").alias("referenced_by")),
                 ["connection_id", "fqn"]),
             table_type="table", search="t1", min_references=5)),
         ["acc", "md_columns"], """
SELECT t.*, r.referenced_by FROM (SELECT DISTINCT connection_id, schema_name, table_name, 'table' AS table_type, schema_name || '.' || table_name AS fqn
    FROM md_columns WHERE table_type = 'r' AND contains(table_name, 't1')) t
JOIN (SELECT connection_id, full_table_name, count(DISTINCT object_id) AS referenced_by FROM acc GROUP BY ALL) r
  ON r.connection_id = t.connection_id AND r.full_table_name = t.fqn WHERE r.referenced_by >= 5""")
register("p3_audit_page", lambda s, sf: listing.audit_page(corpus.audit(s, sf), action="error", number=3, size=25)[0].drop("created_at"), ["audit"],
         "SELECT event_id, user_id, action, resource_type FROM audit WHERE action = 'error' ORDER BY created_at DESC, event_id DESC LIMIT 25 OFFSET 50")
register("p3_audit_totals", lambda s, sf: listing.audit_page(corpus.audit(s, sf), action="error", size=25)[1], ["audit"],
         "SELECT count(*) AS total, cast(ceil(count(*) / 25) AS bigint) AS pages FROM audit WHERE action = 'error'")
register("p4_unified_search", _ws(lambda w: listing.search_everything(w.objects, w.tables, "12")), ["objs", "tabs"], """
SELECT * FROM (SELECT 'object' AS kind, connection_id, object_name AS name, fqn FROM objs WHERE contains(object_name, '12') ORDER BY name, fqn, connection_id LIMIT 8) a
UNION ALL SELECT * FROM (SELECT 'table', connection_id, table_name AS name, fqn FROM tabs WHERE contains(table_name, '12') ORDER BY name, fqn, connection_id LIMIT 5) b""")
register("l4_quick_find", _ws(lambda w: listing.quick_find(w.tables.select("connection_id", "schema_name", "table_name", "fqn"), "T2")), ["tabs"], """
SELECT connection_id, schema_name, table_name, fqn FROM tabs WHERE contains(table_name, 't2') OR contains(schema_name, 't2') ORDER BY fqn, connection_id LIMIT 8""")
register("l1_finding_feed", _ws(lambda w: listing.finding_feed(w.findings, w.objects, connection_id=2, text="dynamic").drop("recommendation")),
         ["finds", "objs"], """
SELECT object_id, rule_id, severity, finding_type, message, line, connection_id, object_name, schema_name, cast(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
  WHEN 'low' THEN 4 WHEN 'info' THEN 5 END AS bigint) AS severity_rank FROM finds JOIN objs USING (object_id)
WHERE connection_id = 2 AND (contains(lower(object_name), 'dynamic') OR contains(lower(message), 'dynamic'))""")
register("l2_page_slice", _ws(lambda w: listing.page(w.objects.select("object_id", "fqn"), ["fqn", "object_id"], 7, 30)), ["objs"],
         "SELECT object_id, fqn FROM objs ORDER BY fqn, object_id LIMIT 30 OFFSET 180")
register("l3_top_complex", _ws(lambda w: listing.top_complex(w.objects, w.complexity, 25)), ["cplx", "objs"], """
SELECT object_id, cyclomatic, nesting, branches, loops, lines, fqn FROM cplx JOIN objs USING (object_id) ORDER BY cyclomatic DESC, object_id LIMIT 25""")
register("w1_recent_jobs",
         lambda s, sf: _day(listing.recent_jobs(_jobs(s, sf).drop("total_objects", "processed_objects"), corpus.connections(s, sf)), "created_at"),
         ["jobs", "conns"], """
SELECT j.connection_id, job_id, status, strftime(created_at, '%Y-%m-%d') AS created_at, c.name, c.engine FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) r WHERE rn <= 3
  ORDER BY created_at DESC, job_id DESC LIMIT 5) j JOIN (SELECT connection_id, name, engine FROM conns) c USING (connection_id)""")
register("w2_running_jobs", lambda s, sf: _day(listing.running_jobs(_jobs(s, sf)), "created_at"), ["jobs"], f"""
SELECT connection_id, job_id, status, strftime(created_at, '%Y-%m-%d') AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs WHERE status IN {words(fv.RUNNING_STATES)}) r WHERE rn = 1""")
register("w3_first_wins_calls", _ws(lambda w: extract.named_calls(w.objects).withColumn("confidence", F.col("confidence").cast("double"))),
         ["calls"], "SELECT * FROM calls")
register("w5_clamped_depth_histogram", _ws(lambda w: w.complexity.groupBy("nesting").agg(F.count(F.lit(1)).alias("objects"))), ["cplx"],
         "SELECT nesting, count(*) AS objects FROM cplx GROUP BY nesting")

# -- predicates and scalar functions
register("p5_risk_level",
         _ws(lambda w: w.complexity.select("object_id", scalars.risk_level(F.col("cyclomatic")).alias("risk"),
                                           scalars.risk_level(F.nullif(F.col("branches"), F.lit(0))).alias("branch_risk"))), ["cplx"], f"""
SELECT object_id, {RISK_SQL} AS risk, CASE WHEN branches = 0 THEN 'unknown' ELSE {RISK_SQL.replace('cyclomatic', 'branches')} END AS branch_risk FROM cplx""")
register("p6_reliability",
         _ws(lambda w: w.dependencies.select(
             "object_id", "target_name", "line", scalars.is_reliable(F.col("confidence"), F.col("is_dynamic")).alias("reliable"),
             F.col("target_id").isNotNull().alias("resolved"),
             scalars.known_confidence(F.when(F.col("line") % 5 != 0, F.col("confidence").cast("double"))).alias("known_confidence"))),
         ["deps"], """
SELECT object_id, target_name, line, confidence >= 0.8 AND NOT is_dynamic AS reliable, target_id IS NOT NULL AS resolved,
  CASE WHEN line % 5 = 0 THEN cast(0.5 AS double) ELSE cast(confidence AS double) END AS known_confidence FROM deps""")
register("p7_read_write",
         _ws(lambda w: w.accesses.groupBy("operation", scalars.access_edge_type(F.col("operation")).alias("edge_type"),
                                          scalars.is_write(F.col("operation")).alias("is_write")).agg(F.count(F.lit(1)).alias("n"))),
         ["acc"], """
SELECT operation, CASE WHEN operation = 'SELECT' THEN 'reads_from' ELSE 'writes_to' END AS edge_type, operation <> 'SELECT' AS is_write, count(*) AS n FROM acc GROUP BY operation""")
register("p8_objects_with_issues", _ws(lambda w: rollup.objects_with_issues(w.findings)), ["finds"],
         "SELECT object_id, bool_or(severity IN ('critical', 'high')) AS has_issues FROM finds GROUP BY object_id")
register("p9_definition_hash", _ws(lambda w: w.objects.select("object_id", scalars.definition_hash(F.col("definition")).alias("definition_hash"))),
         ["objs"], "SELECT object_id, sha256(definition) AS definition_hash FROM objs")
_raw = "CASE object_id % 4 WHEN 0 THEN '[' || schema_name || '].[' || object_name || ']' WHEN 1 THEN fqn WHEN 2 THEN object_name || '_camelCase.X__' ELSE 'db.' || fqn END"
register("p10_slug", _ws(lambda w: w.objects.select("object_id", scalars.slug(F.expr(_raw)).alias("slug"))), ["objs"], f"""
SELECT object_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({_raw}, '.', '-'), '_', '-'),
  '([a-z])([A-Z])', '\\1-\\2', 'g'), '[^a-zA-Z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM objs""")
_bare = "CASE object_id % 3 WHEN 0 THEN '[' || object_name || ']' WHEN 1 THEN chr(34) || schema_name || chr(34) || '.' || object_name ELSE 'db.' || fqn END"
register("p11_name_qualification",
         _ws(lambda w: w.objects.select("object_id", scalars.name_parts(F.expr(_bare), F.col("dialect")).alias("n")).select("object_id", "n.*")),
         ["objs"], f"""
SELECT object_id, CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE d END AS schema_name, p[len(p)] AS object_name,
  CASE WHEN len(p) >= 2 THEN array_to_string(p, '.') ELSE d || '.' || p[1] END AS fqn FROM (
  SELECT object_id, CASE dialect WHEN 'tsql' THEN 'dbo' WHEN 'plpgsql' THEN 'public' ELSE 'DBO' END AS d,
    string_split(replace(replace(replace({_bare}, '[', ''), ']', ''), chr(34), ''), '.') AS p FROM objs) x""")
_asked = ("CASE object_id % 3 WHEN 0 THEN replace(definition, ' ', chr(9) || ' ') WHEN 1 THEN substring(definition, 1, 60) || ' changed' "
          "ELSE 'nothing like ' || definition END")
_normal = lambda e: f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"
register("p12_fingerprint_lookup",
         _ws(lambda w: listing.by_fingerprint(w.objects.select(F.col("object_id").alias("text_id"), F.expr(_asked).alias("text")), w.objects)),
         ["objs"], f"""
, norm AS (SELECT object_id, {_normal('definition')} AS print, {_normal(_asked)} AS asked FROM objs)
SELECT a.object_id AS text_id, coalesce(e.id, h.id, g.id) AS object_id,
  CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN h.id IS NOT NULL THEN 'prefix-80' WHEN g.id IS NOT NULL THEN 'prefix-40' ELSE 'none' END AS matched_by
FROM norm a LEFT JOIN (SELECT print, min(object_id) AS id FROM norm GROUP BY print) e ON e.print = a.asked
LEFT JOIN (SELECT left(print, 80) AS head, min(object_id) AS id FROM norm GROUP BY 1) h ON h.head = left(a.asked, 80)
LEFT JOIN (SELECT left(print, 40) AS head, min(object_id) AS id FROM norm GROUP BY 1) g ON g.head = left(a.asked, 40)""")
register("p13_job_state",
         lambda s, sf: _jobs(s, sf).select(
             "job_id", scalars.is_running(F.col("status")).alias("running"), scalars.is_finished(F.col("status")).alias("finished"),
             scalars.percent_done(F.col("processed_objects"), F.col("total_objects")).alias("percent")),
         ["jobs"], f"""
SELECT job_id, status IN {words(fv.RUNNING_STATES)} AS running, status IN {words(fv.FINISHED_STATES)} AS finished,
  cast(CASE WHEN total_objects = 0 THEN 0 ELSE round(processed_objects / total_objects * 100) END AS integer) AS percent FROM jobs""")
register("p14_connection_listing",
         lambda s, sf: listing.connection_listing(corpus.connections(s, sf), corpus.jobs(s, sf)),
         ["conns", "jobs"], """
SELECT c.*, j.jobs, j.newest_job FROM conns c LEFT JOIN (SELECT connection_id, count(*) AS jobs, strftime(max(created_at), '%Y-%m-%d') AS newest_job FROM jobs GROUP BY connection_id) j USING (connection_id)""")
register("p14_schema_listing",
         _ws(lambda w: listing.schema_listing(w.objects)),
         ["objs"], "SELECT connection_id, schema_name, count(*) AS objects FROM objs GROUP BY connection_id, schema_name")
register("p15_metadata_labels",
         lambda s, sf: corpus.metadata(s, sf, "md_columns").select(
             "schema_name", "table_name", "column_name", scalars.label_of(F.col("table_type"), fv.RELATION_KINDS).alias("table_kind"),
             scalars.display_type(F.col("data_type"), F.col("max_length"), F.col("precision"), F.col("scale")).alias("display_type")),
         ["md_columns"], """
SELECT schema_name, table_name, column_name, CASE table_type WHEN 'r' THEN 'table' ELSE 'view' END AS table_kind,
  CASE data_type WHEN 'varchar' THEN 'varchar(' || CASE WHEN max_length = -1 THEN 'MAX' ELSE cast(max_length AS varchar) END || ')'
    WHEN 'decimal' THEN 'decimal(' || "precision" || ',' || scale || ')' ELSE data_type END AS display_type FROM md_columns""")
register("p15_routine_kinds",
         lambda s, sf: corpus.shaped(s, sf, "supplier", {"id": "s_suppkey", "code": "CASE s_nationkey % 7 WHEN 0 THEN 'P' WHEN 1 THEN 'FN' WHEN 2 THEN 'IF' WHEN 3 THEN 'TF' WHEN 4 THEN 'TR' WHEN 5 THEN 'V' ELSE 'X' END"}).select(
             "id", scalars.label_of(F.col("code"), fv.ROUTINE_KINDS).alias("kind")),
         None, """
SELECT s_suppkey AS id, CASE s_nationkey % 7 WHEN 0 THEN 'procedure' WHEN 4 THEN 'trigger' WHEN 5 THEN 'view' WHEN 6 THEN NULL ELSE 'function' END AS kind FROM supplier""")
register("age_text",
         lambda s, sf: _jobs(s, sf).select("job_id", scalars.age_text(
             F.timestamp_diff("SECOND", F.col("created_at").cast("timestamp"), F.lit("2002-01-01 00:00:00").cast("timestamp")) - F.col("job_id") * 9000).alias("age")),
         ["jobs"], """
SELECT job_id, CASE WHEN s >= 31536000 THEN s // 31536000 || 'y ago' WHEN s >= 2592000 THEN s // 2592000 || 'mo ago' WHEN s >= 86400 THEN s // 86400 || 'd ago'
  WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE 'just now' END AS age FROM (
  SELECT job_id, date_diff('second', created_at, timestamp '2002-01-01') - job_id * 9000 AS s FROM jobs) x""")
