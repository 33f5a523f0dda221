"""Registered queries: sources, sinks, metadata, catalog upkeep and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import register
from checks.sql_base import part, q, strip_sql, words
from procatlas.functions import fixed_values as fv
from procatlas.functions import scalars
from procatlas.operators import extract, maintain, metadata, resolve
from checks.workspace import workspace
from procatlas.session import cut, fresh_path
from checks import corpus
from procatlas.plans.analysis import Analysis
from procatlas.sources import readers, scripts, sinks
from procatlas.streaming import jobs as streams
import checks.relations  # noqa: F401
import checks.rollups  # noqa: F401


def _ws(fn):
    return lambda s, sf: fn(workspace(s, sf))


# -- sources and sinks
_hidden = "CASE WHEN object_id % 50 = 0 THEN CASE dialect WHEN 'tsql' THEN 'sys' WHEN 'plpgsql' THEN 'pg_toast' ELSE 'SYS' END ELSE schema_name END"
register("s1_object_scan",
         _ws(lambda w: readers.visible_objects(w.objects.withColumn("schema_name", F.expr(_hidden)), schemas=["s1", "s2", "s3", "sys", "SYS", "pg_toast"]).select(
             "object_id", "dialect", "schema_name", "object_name", "object_type", F.length("definition").alias("length"))),
         ["objs"], f"""
SELECT object_id, dialect, schema_name, object_name, object_type, cast(length(definition) AS integer) AS length FROM objs
WHERE object_id % 50 <> 0 AND schema_name IN ('s1', 's2', 's3')""")
SOURCE_LINES = {
    "owner": "'S' || cast(l_orderkey % 8 AS string)", "name": "'P' || cast(l_orderkey AS string)",
    "type": "CASE l_orderkey % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'PACKAGE BODY' ELSE 'FUNCTION' END",
    "line": "cast(l_linenumber * 100000 + l_partkey AS int)",
    "text": "'  step ' || cast(l_partkey AS string) || ';' || chr(10)",
}
part("source_lines", [], f"SELECT {', '.join(f'{e} AS {c}' for c, e in SOURCE_LINES.items())} FROM lineitem")
register("s2_source_reassembly", lambda s, sf: readers.reassemble_source(corpus.shaped(s, sf, "lineitem", SOURCE_LINES)), ["source_lines"], """
SELECT owner AS schema_name, name AS object_name, replace(lower(type), ' body', '') AS object_type, string_agg(text, '' ORDER BY line) AS definition
FROM source_lines GROUP BY ALL""")
register("s3_column_metadata", lambda s, sf: corpus.metadata(s, sf, "md_columns"), ["md_columns"], "SELECT * FROM md_columns")
register("s4_primary_keys", lambda s, sf: corpus.metadata(s, sf, "md_pk"), ["md_pk"], "SELECT * FROM md_pk")
register("s4_foreign_keys", lambda s, sf: corpus.metadata(s, sf, "md_fk"), ["md_fk"], "SELECT * FROM md_fk")
register("s4_indexes", lambda s, sf: corpus.metadata(s, sf, "md_index"), ["md_index"], "SELECT * FROM md_index")


# Script files: a connection's objects by the hundred, closed as the dialect asks for it.  Views outside T-SQL and triggers of PL/pgSQL,
# whose texts here hold semicolons without a quoted body, stay out.
_SCRIPTED = "dialect = 'tsql' OR object_type IN ('procedure', 'function') OR (dialect = 'plsql' AND object_type <> 'view')"
_SCRIPT = "cast(floor(object_id / 300) AS bigint)"
_ENDS = ("CASE dialect WHEN 'tsql' THEN chr(10) || 'GO' WHEN 'plsql' THEN chr(10) || '/' "
         "ELSE CASE WHEN contains(definition, '$$') THEN chr(10) || '$$ LANGUAGE plpgsql;' ELSE '' END END")


def _script_files(s, sf):
    """The folder of files: dialect=NAME/script=NUMBER, one file each."""
    path = fresh_path(s, "scripts")
    pieces = workspace(s, sf).objects.where(_SCRIPTED).select(
        "dialect", F.expr(_SCRIPT).alias("script"), "object_id", F.concat("definition", F.expr(_ENDS)).alias("piece"))
    texts = readers.assemble_lines(pieces, ["dialect", "script"], ["object_id"], "piece", chunk=F.lit(0), separator="\n")
    texts.repartition("dialect", "script").withColumnRenamed("text", "value").write.partitionBy("dialect", "script").text(path)
    return path


def _from_files(s, sf):
    """Files to objects, objects to facts: what each object of each file calls and touches."""
    path = _script_files(s, sf)
    found = [scripts.read_scripts(s, f"{path}/dialect={d}", d)[0] for d in fv.DEFAULT_SCHEMAS]
    run = Analysis(s, scripts.catalog_objects(reduce(DataFrame.unionByName, found), F.lit(0), F.current_timestamp()).withColumn(
        "script", F.regexp_extract("path", "script=([0-9]+)", 1).cast("long")))
    per = lambda facts, name: facts.groupBy("object_id").agg(F.count(F.lit(1)).alias(name))
    counts = (run.objects.join(per(run.accesses, "accesses"), "object_id", "left").join(per(run.dependencies, "calls"), "object_id", "left")
              .join(run.complexity.select("object_id", "cyclomatic", "lines"), "object_id"))
    return counts.where("number > 0").select(
        "dialect", "script", "number", "line", "object_type", "schema_name", "object_name", "fqn", "signature",
        F.coalesce("accesses", F.lit(0)).alias("accesses"), F.coalesce("calls", F.lit(0)).alias("calls"), "cyclomatic",
        F.sha2(F.regexp_replace("definition", r"\n\$\$ LANGUAGE plpgsql;$", ""), 256).alias("definition_hash"))


register("s6_files_to_facts", _from_files, ["objs", "params", "acc", "facts", "cplx"], f"""
, own AS (SELECT *, {_SCRIPT} AS script, length(definition) - length(replace(definition, chr(10), '')) + 2
    - CASE WHEN dialect = 'plpgsql' AND NOT contains(definition, '$$') THEN 1 ELSE 0 END AS n_lines
  FROM objs WHERE {_SCRIPTED}),
-- a script's own lines in front of an object are those of all objects before it, the anonymous ones too
placed AS (SELECT *, cast(1 + coalesce(sum(n_lines) OVER (PARTITION BY dialect, script ORDER BY object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS integer) AS line FROM own)
SELECT dialect, script, cast(row_number() OVER (PARTITION BY dialect, script ORDER BY object_id) AS integer) AS number, line, object_type,
  schema_name, object_name, fqn, CASE WHEN object_type IN ('procedure', 'function') THEN coalesce(s.signature, '') ELSE '' END AS signature,
  coalesce(a.n, 0) AS accesses, coalesce(f.n, 0) AS calls, cyclomatic, sha256(definition) AS definition_hash
FROM placed JOIN cplx USING (object_id)
LEFT JOIN (SELECT object_id, string_agg(data_type, ', ' ORDER BY ordinal) AS signature FROM params GROUP BY object_id) s USING (object_id)
LEFT JOIN (SELECT object_id, count(*) AS n FROM acc GROUP BY object_id) a USING (object_id)
LEFT JOIN (SELECT object_id, count(*) AS n FROM facts GROUP BY object_id) f USING (object_id)
WHERE object_type <> 'anonymous'""")


def _export(s, sf):
    w = workspace(s, sf)
    folder = fresh_path(s, "export")
    procedures = w.objects.select("object_id", "object_name", "schema_name", "object_type", "connection_id")
    edges = resolve.enrich_edges(w.dependencies, w.objects, w.complexity).select(
        "source_id", "target_id", "target_name", "dep_type", "source_object_name", "target_object_name")
    sinks.export_snapshot({"procedures": procedures, "dependencies": edges}, folder)
    back = s.read.schema("sourceId long, targetId long, targetName string, depType string, sourceObjectName string, "
                         "targetObjectName string").json(f"{folder}/dependencies")
    return back.groupBy("depType").agg(F.count(F.lit(1)).alias("rows"), F.count("targetId").alias("resolved"),
                                       F.count_distinct("sourceObjectName").alias("sources"))


register("s7_snapshot_export", _export, ["deps", "objs"], """
SELECT dep_type AS "depType", count(*) AS rows, count(target_id) AS resolved, count(DISTINCT o.object_name) AS sources
FROM deps JOIN objs o USING (object_id) GROUP BY dep_type""")


def _stored(s, sf):
    path = fresh_path(s, "facts")
    sinks.store_facts(workspace(s, sf).accesses, path)
    return s.read.parquet(path).groupBy("connection_id", "operation").agg(
        F.count(F.lit(1)).alias("rows"), F.min("full_table_name").alias("first_table"))


register("s8_fact_sink", _stored, ["acc"], """
SELECT connection_id, operation, count(*) AS rows, min(full_table_name) AS first_table FROM acc GROUP BY connection_id, operation""")

# -- nested metadata
register("a18_nested_tables",
         _ws(lambda w: w.tables.select(
             "connection_id", "fqn", "table_type", "estimated_rows",
             F.array_join(F.transform("columns", lambda c: F.concat_ws(
                 ":", c["column_name"], c["data_type"], c["is_primary_key"].cast("string"), c["is_foreign_key"].cast("string"))), ",").alias("columns"),
             F.array_join("primary_key", ",").alias("primary_key"),
             F.array_join(F.transform(F.coalesce("foreign_keys", F.array()), lambda f: F.concat(
                 f["constraint_name"], F.lit("("), F.array_join(f["columns"], ","), F.lit(")->"), f["referenced_table"],
                 F.lit("("), F.array_join(f["referenced_columns"], ","), F.lit(") "), f["on_delete"])), ";").alias("foreign_keys"),
             F.array_join(F.transform("indexes", lambda i: F.concat(
                 i["index_name"], F.lit("("), F.array_join(i["columns"], ","), F.lit(") "), i["is_unique"].cast("string"),
                 F.lit(" "), i["is_primary"].cast("string"))), ";").alias("index_list"))),
         ["md_columns", "md_pk", "md_fk", "md_index", "md_partition"], """
, pk AS (SELECT schema_name, table_name, string_agg(column_name, ',' ORDER BY ordinal) AS primary_key FROM md_pk GROUP BY ALL),
fk AS (SELECT schema_name, table_name, constraint_name || '(' || string_agg(column_name, ',' ORDER BY ordinal) || ')->' || any_value(ref_schema) || '.' || any_value(ref_table)
    || '(' || string_agg(ref_column, ',' ORDER BY ordinal) || ') ' || CASE any_value(on_delete) WHEN 'c' THEN 'CASCADE' WHEN 'a' THEN 'NO ACTION' ELSE 'SET NULL' END AS foreign_keys
  FROM md_fk GROUP BY schema_name, table_name, constraint_name),
ix0 AS (SELECT schema_name, table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols, any_value(is_unique) AS u FROM md_index GROUP BY schema_name, table_name, index_name),
ix AS (SELECT schema_name, table_name, string_agg(index_name || '(' || cols || ') ' || u || ' ' || (cols = primary_key), ';' ORDER BY index_name) AS index_list
  FROM ix0 JOIN pk USING (schema_name, table_name) GROUP BY schema_name, table_name)
SELECT c.connection_id, c.schema_name || '.' || c.table_name AS fqn, CASE c.table_type WHEN 'r' THEN 'table' ELSE 'view' END AS table_type,
  r.estimated_rows, string_agg(c.column_name || ':' || data_type || ':' || (p.column_name IS NOT NULL) || ':' || (f.column_name IS NOT NULL), ',' ORDER BY c.ordinal) AS columns,
  pk.primary_key, coalesce(fk.foreign_keys, '') AS foreign_keys, ix.index_list
FROM md_columns c LEFT JOIN md_pk p USING (schema_name, table_name, column_name) LEFT JOIN md_fk f USING (schema_name, table_name, column_name)
JOIN pk USING (schema_name, table_name) LEFT JOIN fk USING (schema_name, table_name) LEFT JOIN ix USING (schema_name, table_name)
JOIN (SELECT schema_name, table_name, cast(sum(row_count) AS bigint) AS estimated_rows FROM md_partition GROUP BY ALL) r USING (schema_name, table_name)
GROUP BY c.connection_id, c.schema_name, c.table_name, c.table_type, r.estimated_rows, pk.primary_key, fk.foreign_keys, ix.index_list""")
register("a18_unnested_columns",
         _ws(lambda w: metadata.unnest_columns(w.tables).select(
             "schema_name", "table_name", "ordinal", "column_name", "data_type", "is_nullable", "is_primary_key")),
         ["md_columns", "md_pk"], """
SELECT schema_name, table_name, c.ordinal, column_name, data_type, is_nullable, p.ordinal IS NOT NULL AS is_primary_key
FROM md_columns c LEFT JOIN md_pk p USING (schema_name, table_name, column_name)""")

# -- catalog upkeep: the first snapshot is the catalog, the second the new run
_FIRST, _RUN = "2024-01-01", "2024-02-01"


def _hashed(objects):
    return objects.select(
        "connection_id", "fqn", scalars.definition_hash(F.col("definition")).alias("definition_hash"), "object_type")


def _catalog(w):
    return _hashed(w.objects).withColumn("first_seen", F.lit(_FIRST)).withColumn("last_seen", F.lit(_FIRST)).withColumn(
        "is_deleted", F.lit(False))


def _merged(w):
    return maintain.merge_objects(_catalog(w), _hashed(w.second_objects), F.lit(_RUN), ["definition_hash", "object_type"])


for _n, _source in (("one1", "objs"), ("one2", "objs2")):
    part(_n, [_source], f"""
SELECT connection_id, fqn, r[1] AS hash, r[2] AS object_type FROM (
  SELECT connection_id, fqn, max([sha256(definition), object_type]) AS r FROM {_source} GROUP BY connection_id, fqn) x""")
part("merged", ["one1", "one2"], f"""
SELECT coalesce(a.connection_id, b.connection_id) AS connection_id, coalesce(a.fqn, b.fqn) AS fqn, coalesce(b.hash, a.hash) AS definition_hash,
  coalesce(b.object_type, a.object_type) AS object_type, CASE WHEN a.fqn IS NULL THEN '{_RUN}' ELSE '{_FIRST}' END AS first_seen,
  CASE WHEN b.fqn IS NULL THEN '{_FIRST}' ELSE '{_RUN}' END AS last_seen, b.fqn IS NULL AS is_deleted
FROM one1 a FULL JOIN one2 b ON a.connection_id = b.connection_id AND a.fqn = b.fqn""")
register("m1_object_upsert", _ws(_merged), ["merged"], "SELECT * FROM merged")
register("m2_soft_delete",
         _ws(lambda w: _merged(w).groupBy("connection_id", "is_deleted").agg(F.count(F.lit(1)).alias("objects"))), ["merged"],
         "SELECT connection_id, is_deleted, count(*) AS objects FROM merged GROUP BY ALL")
register("j13_stale_objects",
         _ws(lambda w: resolve.stale_objects(_catalog(w), _hashed(w.second_objects), ["connection_id", "fqn"]).select("connection_id", "fqn")),
         ["merged"], "SELECT connection_id, fqn FROM merged WHERE is_deleted")


def _schemas(objects, day):
    catalog = F.when(F.col("schema_name").isin("s1", "s3", "s5"), F.lit("main"))
    return objects.groupBy("connection_id", "schema_name", catalog.alias("catalog_name")).agg(
        F.count(F.lit(1)).alias("object_count")).withColumn("first_seen", F.lit(day))


register("m3_schema_upsert",
         _ws(lambda w: maintain.merge_schemas(_schemas(w.objects.where("schema_name <> 's2'"), _FIRST),
                                              _schemas(w.second_objects.where("schema_name <> 's7'"), _RUN))),
         ["objs", "objs2"], f"""
SELECT coalesce(a.connection_id, b.connection_id) AS connection_id, coalesce(a.schema_name, b.schema_name) AS schema_name,
  CASE WHEN coalesce(a.schema_name, b.schema_name) IN ('s1', 's3', 's5') THEN 'main' END AS catalog_name, coalesce(b.n, a.n) AS object_count,
  CASE WHEN a.n IS NULL THEN '{_RUN}' ELSE '{_FIRST}' END AS first_seen, CASE WHEN b.n IS NULL THEN '{_FIRST}' ELSE '{_RUN}' END AS last_seen
FROM (SELECT connection_id, schema_name, count(*) AS n FROM objs WHERE schema_name <> 's2' GROUP BY ALL) a
FULL JOIN (SELECT connection_id, schema_name, count(*) AS n FROM objs2 WHERE schema_name <> 's7' GROUP BY ALL) b
  ON a.connection_id = b.connection_id AND a.schema_name = b.schema_name""")


def _table_merge(w):
    known = w.tables.select("connection_id", "fqn", "estimated_rows")
    old = known.where("estimated_rows < 14000")
    new = known.where("estimated_rows > 7000").withColumn("estimated_rows", F.col("estimated_rows") * 2)
    return maintain.merge_tables(old, new, ["estimated_rows"])


register("m4_table_upsert", _ws(_table_merge), ["md_partition"], """
SELECT connection_id, fqn, CASE WHEN n > 7000 THEN n * 2 ELSE n END AS estimated_rows,
  CASE WHEN n > 7000 AND n < 14000 THEN 'updated' WHEN n > 7000 THEN 'inserted' ELSE 'kept' END AS change FROM (
  SELECT connection_id, schema_name || '.' || table_name AS fqn, cast(sum(row_count) AS bigint) AS n FROM md_partition GROUP BY ALL) x""")
register("m5_drop_runs",
         lambda s, sf: maintain.drop_runs(
             workspace(s, sf).accesses.select(F.col("object_id").alias("job_id"), "full_table_name", "operation"),
             corpus.jobs(s, sf).where("status = 'failed'")).groupBy("operation").agg(
             F.count(F.lit(1)).alias("rows"), F.count_distinct("job_id").alias("runs")),
         ["acc", "jobs"], """
SELECT operation, count(*) AS rows, count(DISTINCT object_id) AS runs FROM acc WHERE object_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed') GROUP BY operation""")
register("m6_snapshot_diff",
         _ws(lambda w: maintain.diff(_hashed(w.objects), _hashed(w.second_objects), ["connection_id", "fqn"])),
         ["one1", "one2"], """
SELECT coalesce(a.connection_id, b.connection_id) AS connection_id, coalesce(a.fqn, b.fqn) AS fqn,
  CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state
FROM one1 a FULL JOIN one2 b ON a.connection_id = b.connection_id AND a.fqn = b.fqn""")


def _runs(s, sf):
    return corpus.table(s, sf, "events").select(
        F.col("user_id").alias("object_key"), F.struct("ts", "event_id").alias("run_at"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("definition_hash"))


register("w4_version_history",
         lambda s, sf: maintain.version_history(_runs(s, sf), F.date_trunc("month", "run_at.ts")).select(
             "object_key", "version_number", "definition_hash", F.col("detected_at.event_id").alias("event_id")),
         None, """
SELECT user_id AS object_key, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS integer) AS version_number, hash AS definition_hash, event_id
FROM (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior
  FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_type END AS hash FROM events)) e WHERE prior IS NULL OR before IS DISTINCT FROM hash""")

# -- streams over stored definitions and events
TEXT_SCHEMA = "object_id long, connection_id int, dialect string, schema_name string, object_name string, fqn string, object_type string, definition string, seen_at timestamp_ntz"


def _text_stream(s, sf):
    """Both snapshots written as files, then read as a stream."""
    w = workspace(s, sf)
    path = fresh_path(s, "arrivals")
    w.objects.unionByName(w.second_objects).write.parquet(path)
    return s.readStream.schema(TEXT_SCHEMA).parquet(path)


def _stream_scan(s, sf):
    out = fresh_path(s, "stream-findings")
    streams.run_to_end(streams.rule_scan(_text_stream(s, sf)), out, fresh_path(s, "stream-log"))
    return s.read.parquet(out).groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("line").alias("line_sum"))


_rules2 = []
from checks.sql_base import part_matches  # noqa: E402

for _id, _dialect, _pattern, *_rest in fv.SECURITY_RULES:
    part_matches(f"rule2_{_id}", "objs2", _pattern, where="true" if _dialect == "*" else f"dialect = '{_dialect}'")
register("t1_stream_rule_scan", _stream_scan, ["rule_hits"] + [f"rule2_{r[0]}" for r in fv.SECURITY_RULES], """
SELECT rule_id, severity, count(*) AS findings, cast(sum(line) AS bigint) AS line_sum FROM (SELECT rule_id, severity, line FROM rule_hits UNION ALL """
         + " UNION ALL ".join(f"SELECT {r[0]}, '{r[3]}', line FROM rule2_{r[0]}" for r in fv.SECURITY_RULES) + ") u GROUP BY rule_id, severity")

UPDATES = {
    "update_id": "event_id", "connection_id": "user_id % 7", "job_id": "user_id", "ts": "ts",
    "status": "CASE event_type WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'parsing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'pending' END",
}


def _arrivals(s, parts, schema):
    """Tables as files that come one after the other, and a stream that takes each in a batch of its own."""
    path = fresh_path(s, "arrivals")
    for number, rows in enumerate(parts):
        rows.repartition(4).write.parquet(f"{path}/part={number}")
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/part=*")


def _job_states(s, sf):
    """Three arrivals of updates, in no order of time, with states of finished jobs dropped between them."""
    updates = corpus.table(s, sf, "events").selectExpr(*[f"{e} AS {c}" for c, e in UPDATES.items()])
    stream = _arrivals(s, [updates.where(f"update_id % 3 = {k}") for k in (1, 0, 2)], updates.schema)
    table = streams.StateTable(s, fresh_path(s, "stream-states"), ["connection_id", "job_id"], ["updated_at", "update_id"], ["updates"], fold_every=2)
    streams.run_to_end(streams.latest_job_state(stream, keep_finished_ms=1), table.add, fresh_path(s, "stream-log"), "update")
    return table.read()


part("states", [], f"""
SELECT connection_id, job_id, status, ts, update_id, updates FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, update_id DESC) AS rn, count(*) OVER (PARTITION BY job_id) AS updates FROM (
    SELECT {', '.join(f'{e} AS {c}' for c, e in UPDATES.items())} FROM events) u) x WHERE rn = 1""")
register("t2_stream_job_state", lambda s, sf: _job_states(s, sf).drop("updated_at"), ["states"],
         "SELECT connection_id, job_id, status, update_id, updates FROM states")
register("t2_running_per_connection", lambda s, sf: streams.running_per_connection(_job_states(s, sf)), ["states"], f"""
SELECT connection_id, count(*) FILTER (status IN {words(fv.RUNNING_STATES)}) AS running FROM states GROUP BY connection_id""")


def _stream_changes(s, sf):
    """First snapshot, second one, the first again, and then older rows of the second that come too late."""
    w = workspace(s, sf)

    def arrival(objects, days):
        return objects.select("connection_id", "fqn", scalars.definition_hash(F.col("definition")).alias("definition_hash"),
                              F.expr(f"cast(seen_at AS timestamp) + INTERVAL {days} DAYS").alias("seen_at"))

    parts = [arrival(w.objects, 0), arrival(w.second_objects, 4000), arrival(w.objects, 8000), arrival(w.second_objects.where("object_id % 5 = 0"), 2000)]
    stream = _arrivals(s, parts, parts[0].schema)
    out = fresh_path(s, "stream-changes")
    streams.run_to_end(streams.changed_definitions(stream), out, fresh_path(s, "stream-log"))
    return s.read.parquet(out).select("connection_id", "fqn", "definition_hash", F.col("seen_at").cast("date").cast("string").alias("day"), "kind")


# Each name's rows by arrival; a name has several rows where objects share it.
part("arrivals", ["objs", "objs2"], """
SELECT connection_id, fqn, sha256(definition) AS hash, 0 AS part, seen_at AS moment FROM objs
UNION ALL SELECT connection_id, fqn, sha256(definition), 1, seen_at + INTERVAL 4000 DAY FROM objs2
UNION ALL SELECT connection_id, fqn, sha256(definition), 2, seen_at + INTERVAL 8000 DAY FROM objs""")
register("t3_stream_changed_definitions", _stream_changes, ["arrivals", "objs", "objs2"], """
SELECT connection_id, fqn, hash AS definition_hash, cast(cast(moment AS date) AS varchar) AS day, 'changed' AS kind FROM (
  SELECT *, lag(hash) OVER (PARTITION BY connection_id, fqn ORDER BY part, moment, hash) AS before FROM arrivals) x WHERE before IS DISTINCT FROM hash
UNION ALL SELECT connection_id, fqn, sha256(definition), cast(cast(seen_at + INTERVAL 2000 DAY AS date) AS varchar), 'late' FROM objs2
WHERE object_id % 5 = 0""")
