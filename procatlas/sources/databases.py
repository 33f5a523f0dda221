"""Catalog scans over JDBC for SQL Server, PostgreSQL and Oracle.

Each query gives the columns the operators expect, so the result of a scan goes straight into
``visible_objects``, ``reassemble_source``, ``nest_tables`` or ``reconcile``.  ``shard`` is a number
Spark can split the read by; schema lists become filters that Spark pushes into the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv
from procatlas.functions.scalars import label_of
from procatlas.sources.readers import jdbc_scan, reassemble_source, visible_objects

QUERIES: dict[tuple[str, str], str] = {
    ("tsql", "definitions"): """
        SELECT OBJECT_SCHEMA_NAME(m.object_id) AS schema_name, OBJECT_NAME(m.object_id) AS object_name,
               RTRIM(o.type) AS kind_code, m.definition, o.create_date AS created_at, o.modify_date AS seen_at,
               m.object_id AS shard
        FROM sys.sql_modules m INNER JOIN sys.objects o ON o.object_id = m.object_id""",
    ("plpgsql", "definitions"): """
        SELECT CAST(p.pronamespace::regnamespace AS text) AS schema_name, p.proname AS object_name,
               CASE WHEN p.prorettype = 'trigger'::regtype THEN 'TR' WHEN p.prokind = 'p' THEN 'P' ELSE 'FN' END AS kind_code,
               pg_get_functiondef(p.oid) AS definition, NULL::timestamp AS created_at, NULL::timestamp AS seen_at,
               p.oid::bigint AS shard
        FROM pg_proc p WHERE p.prokind IN ('f', 'p')
        UNION ALL
        SELECT CAST(v.relnamespace::regnamespace AS text), v.relname, 'V', pg_get_viewdef(v.oid), NULL, NULL, v.oid::bigint
        FROM pg_class v WHERE v.relkind = 'v'""",
    ("plsql", "source_lines"): """
        SELECT owner AS "owner", name AS "name", type AS "type", line AS "line", text AS "text", ORA_HASH(owner || name) AS "shard"
        FROM all_source
        WHERE type IN ('PROCEDURE', 'FUNCTION', 'TRIGGER', 'PACKAGE', 'PACKAGE BODY')""",
    ("plsql", "views"): """
        SELECT owner AS "schema_name", view_name AS "object_name", text_vc AS "definition", ORA_HASH(view_name) AS "shard"
        FROM all_views""",
    ("tsql", "columns"): """
        SELECT c.TABLE_SCHEMA AS schema_name, c.TABLE_NAME AS table_name,
               CASE t.TABLE_TYPE WHEN 'VIEW' THEN 'view' ELSE 'table' END AS table_type, c.COLUMN_NAME AS column_name,
               c.DATA_TYPE AS data_type, c.ORDINAL_POSITION AS ordinal, c.IS_NULLABLE AS nullable_text,
               c.COLUMN_DEFAULT AS default_value, c.CHARACTER_MAXIMUM_LENGTH AS max_length,
               c.NUMERIC_PRECISION AS num_precision, c.NUMERIC_SCALE AS num_scale
        FROM INFORMATION_SCHEMA.COLUMNS c
        INNER JOIN INFORMATION_SCHEMA.TABLES t ON t.TABLE_SCHEMA = c.TABLE_SCHEMA AND t.TABLE_NAME = c.TABLE_NAME""",
    # Oracle keeps a column default as LONG, which cannot be selected with the rest; it is left empty.
    ("plsql", "columns"): """
        SELECT c.owner AS "schema_name", c.table_name AS "table_name", 'table' AS "table_type", c.column_name AS "column_name",
               c.data_type AS "data_type", c.column_id AS "ordinal", DECODE(c.nullable, 'Y', 'YES', 'NO') AS "nullable_text",
               CAST(NULL AS VARCHAR2(1)) AS "default_value", c.char_length AS "max_length", c.data_precision AS "num_precision",
               c.data_scale AS "num_scale"
        FROM all_tab_columns c INNER JOIN all_tables t ON t.owner = c.owner AND t.table_name = c.table_name""",
    ("tsql", "keys"): """
        SELECT k.TABLE_SCHEMA AS schema_name, k.TABLE_NAME AS table_name, k.COLUMN_NAME AS column_name,
               k.ORDINAL_POSITION AS ordinal
        FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE k
        INNER JOIN INFORMATION_SCHEMA.TABLE_CONSTRAINTS c
          ON c.CONSTRAINT_SCHEMA = k.CONSTRAINT_SCHEMA AND c.CONSTRAINT_NAME = k.CONSTRAINT_NAME
         AND c.TABLE_NAME = k.TABLE_NAME AND c.CONSTRAINT_TYPE = 'PRIMARY KEY'""",
    ("plsql", "keys"): """
        SELECT k.owner AS "schema_name", k.table_name AS "table_name", k.column_name AS "column_name", k.position AS "ordinal"
        FROM all_cons_columns k
        INNER JOIN all_constraints c ON c.owner = k.owner AND c.constraint_name = k.constraint_name AND c.constraint_type = 'P'""",
    ("tsql", "foreign_keys"): """
        SELECT a.TABLE_SCHEMA AS schema_name, a.TABLE_NAME AS table_name, r.CONSTRAINT_NAME AS constraint_name,
               a.COLUMN_NAME AS column_name, b.TABLE_SCHEMA AS ref_schema, b.TABLE_NAME AS ref_table,
               b.COLUMN_NAME AS ref_column, a.ORDINAL_POSITION AS ordinal, r.DELETE_RULE AS on_delete, r.UPDATE_RULE AS on_update
        FROM INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS r
        INNER JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE a
          ON a.CONSTRAINT_SCHEMA = r.CONSTRAINT_SCHEMA AND a.CONSTRAINT_NAME = r.CONSTRAINT_NAME
        INNER JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE b
          ON b.CONSTRAINT_SCHEMA = r.UNIQUE_CONSTRAINT_SCHEMA AND b.CONSTRAINT_NAME = r.UNIQUE_CONSTRAINT_NAME
         AND b.ORDINAL_POSITION = a.ORDINAL_POSITION""",
    ("plsql", "foreign_keys"): """
        SELECT a.owner AS "schema_name", a.table_name AS "table_name", f.constraint_name AS "constraint_name",
               a.column_name AS "column_name", b.owner AS "ref_schema", b.table_name AS "ref_table",
               b.column_name AS "ref_column", a.position AS "ordinal", f.delete_rule AS "on_delete", 'NO ACTION' AS "on_update"
        FROM all_constraints f
        INNER JOIN all_cons_columns a ON a.owner = f.owner AND a.constraint_name = f.constraint_name
        INNER JOIN all_cons_columns b ON b.owner = f.r_owner AND b.constraint_name = f.r_constraint_name AND b.position = a.position
        WHERE f.constraint_type = 'R'""",
    ("tsql", "indexes"): """
        SELECT OBJECT_SCHEMA_NAME(i.object_id) AS schema_name, OBJECT_NAME(i.object_id) AS table_name, i.name AS index_name,
               COL_NAME(i.object_id, x.column_id) AS column_name, x.key_ordinal AS ordinal, i.is_unique,
               i.is_primary_key AS is_primary, LOWER(i.type_desc) AS index_type
        FROM sys.indexes i INNER JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id
        WHERE x.key_ordinal > 0""",
    ("plpgsql", "indexes"): """
        SELECT CAST(t.relnamespace::regnamespace AS text) AS schema_name, t.relname AS table_name, c.relname AS index_name,
               pg_get_indexdef(i.indexrelid, s.n, true) AS column_name, s.n AS ordinal, i.indisunique AS is_unique,
               i.indisprimary AS is_primary, 'btree' AS index_type
        FROM pg_index i INNER JOIN pg_class c ON c.oid = i.indexrelid INNER JOIN pg_class t ON t.oid = i.indrelid
        INNER JOIN LATERAL generate_series(1, i.indnkeyatts) AS s(n) ON true""",
    ("plsql", "indexes"): """
        SELECT x.table_owner AS "schema_name", x.table_name AS "table_name", x.index_name AS "index_name",
               x.column_name AS "column_name", x.column_position AS "ordinal",
               DECODE(i.uniqueness, 'UNIQUE', 1, 0) AS "is_unique", 0 AS "is_primary", LOWER(i.index_type) AS "index_type"
        FROM all_ind_columns x INNER JOIN all_indexes i ON i.owner = x.index_owner AND i.index_name = x.index_name""",
    ("tsql", "sizes"): """
        SELECT OBJECT_SCHEMA_NAME(object_id) AS schema_name, OBJECT_NAME(object_id) AS table_name,
               CASE WHEN index_id < 2 THEN row_count ELSE 0 END AS row_count, used_page_count AS pages
        FROM sys.dm_db_partition_stats""",
    ("plpgsql", "sizes"): """
        SELECT CAST(relnamespace::regnamespace AS text) AS schema_name, relname AS table_name,
               GREATEST(reltuples, 0)::bigint AS row_count, relpages::bigint AS pages
        FROM pg_class WHERE relkind IN ('r', 'm')""",
    ("plsql", "sizes"): """
        SELECT owner AS "schema_name", table_name AS "table_name", num_rows AS "row_count", blocks AS "pages" FROM all_tables""",
    ("tsql", "native_dependencies"): """
        SELECT OBJECT_SCHEMA_NAME(referencing_id) AS source_schema, OBJECT_NAME(referencing_id) AS source_name,
               referenced_schema_name AS target_schema, referenced_entity_name AS target_name
        FROM sys.sql_expression_dependencies""",
    ("plsql", "native_dependencies"): """
        SELECT owner AS "source_schema", name AS "source_name", referenced_owner AS "target_schema",
               referenced_name AS "target_name"
        FROM all_dependencies""",
}
# PostgreSQL offers the same standard views as SQL Server for these.
for _what in ("columns", "keys", "foreign_keys"):
    QUERIES[("plpgsql", _what)] = QUERIES[("tsql", _what)]


def scan(spark: SparkSession, dialect: str, what: str, url: str, shards: dict | None = None, **options) -> DataFrame:
    """One catalog query.  ``shards``: lowerBound, upperBound and numPartitions for queries with a shard column."""
    query = QUERIES[(fv.DIALECT_ALIASES[dialect.lower()], what)]
    partition = {"partitionColumn": "shard", **shards} if shards and "shard" in query else None
    return jdbc_scan(spark, url, query, partition, **options)


def scan_definitions(spark: SparkSession, dialect: str, url: str, schemas: list[str] | None = None,
                     shards: dict | None = None, **options) -> DataFrame:
    """Visible objects of a database: schema_name, object_name, object_type, definition."""
    name = fv.DIALECT_ALIASES[dialect.lower()]
    read = lambda what: scan(spark, name, what, url, shards, **options)
    columns = ["schema_name", "object_name", "object_type", "definition"]
    if name == "plsql":
        lines = read("source_lines")
        if schemas:
            lines = lines.where(F.col("owner").isin(schemas))
        rows = reassemble_source(lines).select(*columns).unionByName(
            read("views").withColumn("object_type", F.lit("view")).select(*columns))
    else:
        rows = read("definitions").withColumn("object_type", label_of(F.col("kind_code"), fv.ROUTINE_KINDS)).where(
            F.col("object_type").isNotNull()).select(*columns)
    return visible_objects(rows, name, schemas)


def scan_columns(spark: SparkSession, dialect: str, url: str, **options) -> DataFrame:
    """Flat column metadata with a boolean ``is_nullable``."""
    rows = scan(spark, dialect, "columns", url, **options)
    return rows.withColumn("is_nullable", F.col("nullable_text") == "YES").drop("nullable_text").withColumnsRenamed(
        {"num_precision": "precision", "num_scale": "scale"})
