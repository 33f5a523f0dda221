"""Source-text corpus derived from the given tables.

Each order with lines becomes one code object; each order line becomes one statement of it.  The
statement is one SQL expression that Spark and other engines read alike, so a check can build the
very same texts on its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions.matching import clean
from procatlas.sources.readers import assemble_lines

# Statement columns over lineitem: k object, x part, u supplier, q quantity, d dialect number,
# half / third / dbl callee keys within the same connection, t table name.
STATEMENT_COLUMNS = {
    "k": "l_orderkey", "x": "l_partkey", "u": "l_suppkey", "q": "cast(l_quantity AS int)", "d": "l_orderkey % 3",
    "half": "cast(floor(floor(l_orderkey / 3) / 2) AS bigint) * 3 + l_orderkey % 3",
    "dbl": "cast(floor(l_orderkey / 3) AS bigint) * 6 + l_orderkey % 3",
    "third": "cast(floor(l_orderkey / 9) AS bigint) * 3 + l_orderkey % 3",
    "t": "'s' || cast(cast(floor(l_partkey / 4) AS bigint) % 8 AS string) || '.t' || cast(cast(floor(l_partkey / 4) AS bigint) AS string)",
    "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice", "l_returnflag": "l_returnflag",
}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def sql_text(template: str) -> str:
    """SQL concatenation for a template with ``{expression}`` holes; no quotes or newlines inside literals."""
    out = []
    for part in re.split(r"(\{[^}]*\}|\n|')", template):
        if not part:
            continue
        if part == "\n":
            out.append("chr(10)")
        elif part == "'":
            out.append("chr(39)")
        elif part.startswith("{"):
            out.append(f"cast({part[1:-1]} AS string)")
        else:
            out.append(f"'{part}'")
    return " || ".join(out)


def _case(branches: list[tuple], of: int = 1) -> str:
    """CASE over the conditions; ``of`` 1 gives the texts, 2 what was planted in them ('' where nothing is named)."""
    def hole(branch: tuple) -> str:
        if isinstance(branch[1], list):
            return _case(branch[1], of)
        return sql_text(branch[of]) if len(branch) > of else "''"

    return "CASE " + " ".join(f"WHEN {branch[0]} THEN {hole(branch)}" for branch in branches) + " END"


# Statements by branch: condition, text, and the table accesses planted in it as operation~name~line of the statement
# within the text, joined by |.
_READS = [
    ("d = 0 AND q % 8 = 0", "  SELECT a.c INTO #work{x % 3} FROM {t} a, s{x % 8}.lookup{x % 6} AS b WHERE a.k = b.k;",
     "INSERT~#work{x % 3}~0|SELECT~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~0"),
    ("d = 0 AND q % 8 = 1", "  WITH recent AS (\n    SELECT k FROM {t}\n  ), few (k) AS (SELECT k FROM recent)\n  SELECT @v = k FROM few, recent r;",
     "SELECT~{t}~1"),
    ("d = 0 AND q % 8 = 2", "  /* SELECT c FROM gone{x % 3}\n     UPDATE gone */\n  SELECT @v = c FROM [{t}] -- FROM gone\n  CROSS APPLY s1.cut(c) WHERE c = 'DELETE FROM gone';",
     "SELECT~{t}~2"),
    ("d = 0", "  SELECT @v = c FROM {t} WHERE k = @p;", "SELECT~{t}~0"),
    ("d = 1 AND q % 8 = 0", "  SELECT extract(year FROM c) INTO v_c FROM {t} a, s{x % 8}.lookup{x % 6} b WHERE a.k IS DISTINCT FROM b.k FOR UPDATE;",
     "SELECT~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~0"),
    ("d = 1 AND q % 8 = 1", "  WITH old AS (DELETE FROM {t} RETURNING k) INSERT INTO s1.log SELECT k FROM old;", "DELETE~{t}~0|INSERT~s1.log~0"),
    ("d = 1", "  SELECT c INTO v_c FROM {t} WHERE k = p_in;", "SELECT~{t}~0"),
    ("1 = 1", "  SELECT c INTO v_c FROM {t} a JOIN s{x % 8}.lookup{x % 6} b ON a.k = b.k;", "SELECT~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~0"),
]
_UPDATES = [
    ("d = 0 AND q % 8 = 1", "  UPDATE o SET c = @v\n    FROM {t} AS o JOIN s{x % 8}.lookup{x % 6} b ON o.k = b.k;",
     "UPDATE~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~0"),
    ("d = 0 AND q % 4 = 0", "  UPDATE {t}\n     SET c = @v\n   WHERE k = @p;", "UPDATE~{t}~0"),
    ("d = 0", "  UPDATE {t} SET c = @v WHERE k = @p;", "UPDATE~{t}~0"),
    ("q % 8 = 1", "  UPDATE {t} SET c = (SELECT max(c) FROM {t}) WHERE k = p_in;", "UPDATE~{t}~0|SELECT~{t}~0"),
    ("1 = 1", "  UPDATE {t} SET c = v_c WHERE k = p_in;", "UPDATE~{t}~0"),
]
_INSERTS = [
    ("d = 0 AND q % 5 = 0", "  INSERT INTO #tmp{x % 5} SELECT c FROM {t};", "INSERT~#tmp{x % 5}~0|SELECT~{t}~0"),
    ("d = 0 AND q % 5 = 1", "  INSERT {t} (c)\n  SELECT c FROM s{x % 8}.lookup{x % 6} UNION ALL\n  SELECT c FROM #tmp{x % 5};",
     "INSERT~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~1|SELECT~#tmp{x % 5}~2"),
    ("d = 0", "  INSERT INTO {t} VALUES (@v, @p);", "INSERT~{t}~0"),
    ("q % 5 = 0", "  INSERT INTO temp_{x % 5} SELECT c FROM {t};", "INSERT~temp_{x % 5}~0|SELECT~{t}~0"),
    ("q % 5 = 1", "  INSERT INTO {t} SELECT CASE WHEN a.c = 1 THEN 2 ELSE 3 END FROM s1.log a, (SELECT k FROM s2.log) b, s3.log;",
     "INSERT~{t}~0|SELECT~s1.log~0|SELECT~s2.log~0|SELECT~s3.log~0"),
    ("1 = 1", "  INSERT INTO {t} VALUES (v_c);", "INSERT~{t}~0"),
]
_REMOVALS = [
    ("x % 4 = 0", "  TRUNCATE TABLE {t};", "TRUNCATE~{t}~0"),
    ("x % 4 = 1 AND q % 2 = 0", "  MERGE INTO {t} USING src ON k = k;", "MERGE~{t}~0|SELECT~src~0"),
    ("x % 4 = 1", "  MERGE {t} AS a USING (SELECT k FROM s1.log) b ON a.k = b.k\n  WHEN MATCHED THEN UPDATE SET c = 1 WHEN NOT MATCHED THEN INSERT (c) VALUES (2);",
     "MERGE~{t}~0|SELECT~s1.log~0"),
    ("d = 0 AND q % 3 = 0", "  DELETE o FROM {t} o, s{x % 8}.lookup{x % 6} b WHERE o.k = b.k", "DELETE~{t}~0|SELECT~s{x % 8}.lookup{x % 6}~0"),
    ("q % 3 = 1", "  DELETE {t};", "DELETE~{t}~0"),
    ("1 = 1", "  DELETE FROM {t};", "DELETE~{t}~0"),
]
_CALLS = [
    ("x % 7 = 0 AND d < 2", "  CALL ext.sp_{x % 20};"),
    ("x % 7 = 0", "  ext_sp_{x % 20}(v_c);"),
    ("x % 97 = 0", "  EXECUTE p{dbl};"),
    ("d = 0 AND q % 6 = 0", "  EXEC s{half % 8}.p{half} @a = @v, @b = @p;"),
    ("d = 0 AND q % 6 = 1", "  EXECUTE [dbo].[P{half}] @v, @p;"),
    ("d = 0 AND q % 6 = 2", "  EXEC\n  p{half};"),
    ("d = 0 AND q % 6 = 3", "  EXEC s{third % 8}.P{third};"),
    ("d = 0", "  EXEC p{half};"),
    ("d = 1 AND q % 4 = 0", "  v_c := s{half % 8}.p{half}(v_c);"),
    ("d = 1 AND q % 4 = 1", "  SELECT s{x % 8}.fn_{x % 30}(v_c) INTO v_c;"),
    ("d = 1 AND q % 4 = 2", "  PERFORM S{third % 8}.p{third}(v_c);"),
    ("d = 1", "  PERFORM s{half % 8}.p{half}(v_c);"),
    ("q % 6 = 0", "  COALESCE(v_c, 1);"),
    ("q % 6 = 1", "  v_log(p_in);"),
    ("q % 6 = 2", "  p{third}(p_in);"),
    ("1 = 1", "  p{half}(p_in);"),
]
_RISKS = [
    ("x % 6 = 0 AND d = 0", "  EXEC(@sql);"),
    ("x % 6 = 0 AND d = 1 AND q % 2 = 0", "  EXECUTE format('SELECT %I', v_c);"),
    ("x % 6 = 0 AND d = 1", "  EXECUTE format('SELECT', $1);"),
    ("x % 6 = 0 AND q % 2 = 0", "  EXECUTE IMMEDIATE v_sql;"),
    ("x % 6 = 0", "  EXECUTE IMMEDIATE v_sql USING v_c;"),
    ("x % 6 = 1", "  GRANT SELECT ON obj TO app;"),
    ("x % 6 = 2 AND d = 0", "  EXEC xp_cmdshell 'dir';"),
    ("x % 6 = 2 AND d = 1", "  PERFORM util.dblink('db', 'q');"),
    ("x % 6 = 2", "  v_c := UTL_HTTP.request('u');"),
    ("x % 6 = 3 AND d = 0", "  SET @password = 'abc{x % 9}';"),
    ("x % 6 = 3 AND d = 1", "  -- SECURITY DEFINER"),
    ("x % 6 = 3", "  DBMS_SQL.parse(c1, v_sql);"),
    ("x % 6 = 4 AND d = 0", "  SELECT c FROM srv{x % 3}.db.s{x % 8}.t{x % 50};", "SELECT~srv{x % 3}.db.s{x % 8}.t{x % 50}~0"),
    ("x % 6 = 4", "  SELECT c FROM s{x % 8}.view_{x % 11};", "SELECT~s{x % 8}.view_{x % 11}~0"),
    ("d = 0", "  EXEC('SELECT ' + @p);"),
    ("1 = 1", "  v_c := 'WITH EXECUTE AS OWNER';"),
]
_CONTROL = [
    ("x % 4 = 0 AND d = 0", "  IF @v > 1 BEGIN\n    SET @v = 2;\n  END"),
    ("x % 4 = 0", "  IF v_c > 1 THEN\n    RETURN v_c;\n  END IF;"),
    ("x % 4 = 1 AND d = 0", "  WHILE @v < 9 BEGIN\n    SET @v = @v + 1;\n    IF @v = 5 BREAK;\n  END"),
    ("x % 4 = 1", "  WHILE v_c < 9 LOOP\n    v_c := v_c + 1;\n  END LOOP;"),
    ("x % 4 = 2 AND d = 0", "  BEGIN TRY\n    DELETE FROM {t};\n  END TRY\n  BEGIN CATCH\n    THROW;\n  END CATCH", "DELETE~{t}~1"),
    ("x % 4 = 2", "  FOR r IN c1 LOOP\n    IF r.a = 1 THEN\n      DELETE FROM {t};\n    END IF;\n  END LOOP;", "DELETE~{t}~2"),
    ("d = 0", "  RETURN @v;"),
    ("1 = 1", "  RAISE v_err;"),
]
_NOTES = [
    ("x % 5 = 0", "  -- check stock level {x % 9}"),
    ("x % 5 = 1 AND d = 0 AND q % 2 = 0", "  DECLARE @v{x % 4} INT, @w{x % 3} VARCHAR(10)"),
    ("x % 5 = 1 AND d = 0", "  DECLARE @v{x % 4} INT\n  DECLARE @w{x % 3} VARCHAR(10)"),
    ("x % 5 = 2 AND d = 0", "  SET @v = @p; -- carry over {x % 9}\n  SET @w = @v;"),
    ("x % 5 = 2", "  v_c := p_in; -- carry over {x % 9}"),
    ("x % 5 = 3", "\n  -- step {x % 9}\n  -- of the plan"),
    ("1 = 1", "  CASE WHEN c = 1 THEN 2 END;"),
]
_STATEMENTS = [
    ("u % 10 = 0", _READS), ("u % 10 = 1", _UPDATES), ("u % 10 = 2", _INSERTS), ("u % 10 = 3", _REMOVALS),
    ("u % 10 IN (4, 8, 9)", _CALLS), ("u % 10 = 5", _RISKS), ("u % 10 = 6", _CONTROL), ("1 = 1", _NOTES),
]
STATEMENT = _case(_STATEMENTS)
#: The accesses planted in a statement, for the check.
ACCESSES = _case(_STATEMENTS, 2)

# Object columns over k.
OBJECT_KIND = ("CASE WHEN k % 13 = 0 THEN 'function' WHEN k % 13 = 1 THEN 'trigger' WHEN k % 13 = 2 THEN 'view' "
               "WHEN k % 13 = 3 AND k % 3 = 2 THEN 'package' WHEN k % 13 = 4 THEN 'anonymous' ELSE 'procedure' END")
OBJECT_NAME = ("CASE WHEN k % 10 = 9 THEN 'p' || cast(k - 3 AS string) WHEN k % 10 = 7 THEN 'P' || cast(k AS string) "
               "ELSE 'p' || cast(k AS string) END")
# The second snapshot lacks urgent orders and lines returned; low-priority objects moved to another schema.
SNAPSHOT_ORDERS = {1: "true", 2: "o_orderpriority <> '1-URGENT'"}
SNAPSHOT_LINES = {1: "true", 2: "l_returnflag <> 'R'"}
OBJECT_SCHEMA = {
    1: "'s' || cast(k % 8 AS string)",
    2: "CASE WHEN o_orderpriority = '5-LOW' THEN 'archive' ELSE 's' || cast(k % 8 AS string) END",
}
DIALECT = "CASE k % 3 WHEN 0 THEN 'tsql' WHEN 1 THEN 'plpgsql' ELSE 'plsql' END"
# Headers by branch: condition, text, and the parameters planted in it as name~type~mode~default, joined by |.
_HEADERS = [
    ("kind = 'anonymous'", "BEGIN"),
    ("kind = 'view'", "CREATE VIEW {s}.{n} AS"),
    ("d = 0 AND kind = 'function'", "CREATE FUNCTION {s}.{n}(@p INT, @q DECIMAL(10,2))\nRETURNS VARCHAR(40)\nAS BEGIN",
     "@p~INT~IN~|@q~DECIMAL(10,2)~IN~"),
    ("d = 0 AND kind = 'trigger'", "CREATE TRIGGER {s}.{n} ON s1.t1 AFTER INSERT\nAS BEGIN"),
    ("d = 0 AND k % 4 = 0", "CREATE PROCEDURE {s}.{n} @p INT, @q INT AS BEGIN", "@p~INT~IN~|@q~INT~IN~"),
    ("d = 0 AND k % 4 = 1",
     "CREATE OR ALTER PROC [{s}].[{n}]\n  @p AS NUMERIC(12,2) = 1.5, -- first, of two\n  @q NVARCHAR(MAX) = 'a, (b' OUT\nWITH RECOMPILE AS\nBEGIN",
     "@p~NUMERIC(12,2)~IN~1.5|@q~NVARCHAR(MAX)~INOUT~'a, (b'"),
    ("d = 0", "CREATE PROCEDURE {s}.{n} @p INT, @q VARCHAR(20) = 'x', @r INT OUTPUT\nAS BEGIN",
     "@p~INT~IN~|@q~VARCHAR(20)~IN~'x'|@r~INT~INOUT~"),
    ("d = 1 AND kind = 'function' AND k % 2 = 0",
     "CREATE OR REPLACE FUNCTION {s}.{n}(p_in INT, p_t TEXT DEFAULT 'x') RETURNS SETOF INT AS $$\nBEGIN", "p_in~INT~IN~|p_t~TEXT~IN~'x'"),
    ("d = 1 AND kind = 'function'", "CREATE OR REPLACE FUNCTION {s}.{n}(p_in INT) RETURNS TABLE(a INT, b TEXT) AS $$\nBEGIN", "p_in~INT~IN~"),
    ("d = 1 AND kind = 'trigger'", "CREATE TRIGGER {s}.{n} AFTER INSERT ON s1.t1\nBEGIN"),
    ("d = 1 AND k % 4 = 0",
     "CREATE OR REPLACE PROCEDURE {s}.{n}(p_in NUMERIC(10,2), p_d TEXT DEFAULT coalesce('x', f(1, 2)), /* p_x INT, */ p_f double precision)\nAS $$\nBEGIN",
     "p_in~NUMERIC(10,2)~IN~|p_d~TEXT~IN~coalesce('x', f(1, 2))|p_f~double precision~IN~"),
    ("d = 1", "CREATE OR REPLACE PROCEDURE {s}.{n}(p_in INT, OUT p_out TEXT, INOUT p_io INT DEFAULT 5)\nAS $$\nBEGIN",
     "p_in~INT~IN~|p_out~TEXT~OUT~|p_io~INT~INOUT~5"),
    ("kind = 'function'", "CREATE OR REPLACE FUNCTION {s}.{n}(p_in IN NUMBER) RETURN VARCHAR2\nIS\nBEGIN", "p_in~NUMBER~IN~"),
    ("kind = 'trigger'", "CREATE OR REPLACE TRIGGER {s}.{n} AFTER INSERT ON s1.t1\nBEGIN"),
    ("kind = 'package'", "CREATE OR REPLACE PACKAGE {s}.{n} AS\nBEGIN"),
    ("k % 4 = 0",
     "CREATE OR REPLACE PROCEDURE {s}.{n}(p_in t1.c%TYPE, p_out IN OUT NOCOPY VARCHAR2, p_d NUMBER := pk.f(1, ')'))\nIS\nBEGIN",
     "p_in~t1.c%TYPE~IN~|p_out~VARCHAR2~INOUT~|p_d~NUMBER~IN~pk.f(1, ')')"),
    ("1 = 1", "CREATE OR REPLACE PROCEDURE {s}.{n}(p_in IN NUMBER, p_out IN OUT VARCHAR2, p_d DATE DEFAULT SYSDATE)\nIS\nBEGIN",
     "p_in~NUMBER~IN~|p_out~VARCHAR2~INOUT~|p_d~DATE~IN~SYSDATE"),
]
HEADER = _case(_HEADERS)
PARAMETERS = _case(_HEADERS, 2)

# Comment-bearing texts over documents; header spelling follows the language column.
COMMENT_PREFIX = _case([
    ("lang = 'en' AND doc_id % 3 = 0",
     "-- Author: {source}\n-- Create date: 2020-01-{doc_id % 28}\n-- Description: loads batch {doc_id % 50}\n-- Jira: T-{doc_id % 97}\n"
     "-- Description: second note\n-- Version: {doc_id % 9}\n"),
    ("lang = 'en' AND doc_id % 3 = 1",
     "-- Modified: <{source}>\n-- Date: 2021-02-{doc_id % 28}\n-- Description: fix {doc_id % 50}\n-- Modified by: ann\n-- Purpose: keep {doc_id % 7}\n"),
    ("lang = 'en'", "/*\n * Cleans rows of {source}\n * AUTHOR bob\n\n * in steps {doc_id % 9}\n */\n"),
    ("lang = 'es'", "-- Autor: {source}\n-- Fecha de creación: 2020-03-{doc_id % 28}\n-- Descripción: carga {doc_id % 50}\n-- Versión: {doc_id % 9}\n"),
    ("lang = 'fr'", "-- Criado por: {source}\n-- Data de criação: 2020-04-{doc_id % 28}\n-- Objetivo: limpar {doc_id % 50}\n-- Atualizado por: rui\n"),
    ("1 = 1", "SELECT {doc_id % 9}; -- counts rows\n"),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def shaped(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A given table as the named expressions."""
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def statements(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> DataFrame:
    """(k, statement, ordering columns): one row per order line of the snapshot."""
    rows = shaped(spark, sf_dir, "lineitem", STATEMENT_COLUMNS)
    return rows.where(SNAPSHOT_LINES[snapshot]).select("k", F.expr(STATEMENT).alias("statement"), *LINE_ORDER)


def objects(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> DataFrame:
    """Code objects with their texts."""
    body = assemble_lines(
        statements(spark, sf_dir, snapshot), ["k"], LINE_ORDER, "statement",
        chunk=F.struct("l_linenumber", F.floor(F.col("l_partkey") / 256)), separator="\n")
    orders = table(spark, sf_dir, "orders").where(F.expr(SNAPSHOT_ORDERS[snapshot])).select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("seen_at"), "o_orderpriority")
    named = body.join(orders, "k").select(
        "k", "text", "seen_at", F.expr(OBJECT_KIND).alias("kind"), F.expr(OBJECT_NAME).alias("n"),
        F.expr(OBJECT_SCHEMA[snapshot]).alias("s"), F.expr(DIALECT).alias("dialect"), (F.col("k") % 3).alias("d"))
    text = F.concat(F.expr(HEADER), F.lit("\n"), F.col("text"), F.lit("\nEND;"))
    return named.select(
        F.col("k").alias("object_id"),
        F.col("d").cast("int").alias("connection_id"),
        "dialect",
        F.col("s").alias("schema_name"),
        F.col("n").alias("object_name"),
        F.concat_ws(".", "s", "n").alias("fqn"),
        F.col("kind").alias("object_type"),
        clean(text).alias("definition"),
        "seen_at",
    )


def commented_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header comment: (object_id, lang, definition)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("object_id"), "lang",
        clean(F.concat(F.expr(COMMENT_PREFIX), F.col("text"))).alias("definition"))


# Table metadata over part: four parts make one table, each part one column of it.
PART_COLUMNS = {"tid": "cast(floor(p_partkey / 4) AS bigint)", "c": "p_partkey % 4", "z": "p_size"}
TABLE_SCHEMA = "'s' || cast(tid % 8 AS string)"
TABLE_NAME = "'t' || cast(tid AS string)"
METADATA = {
    "md_columns": ("1 = 1", {
        "connection_id": "cast(tid % 3 AS int)", "schema_name": TABLE_SCHEMA, "table_name": TABLE_NAME,
        "table_type": "CASE WHEN tid % 10 = 0 THEN 'v' ELSE 'r' END",
        "column_name": "'c' || cast(c AS string)",
        "data_type": "CASE c WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar' WHEN 2 THEN 'decimal' ELSE 'timestamp' END",
        "ordinal": "cast(c + 1 AS int)", "is_nullable": "c > 0 AND z % 2 = 0",
        "default_value": "CASE WHEN z % 7 = 0 THEN '0' END",
        "max_length": "cast(CASE WHEN c = 1 THEN CASE WHEN z % 5 = 0 THEN -1 ELSE z END END AS int)",
        "precision": "cast(CASE WHEN c = 2 THEN 10 END AS int)",
        "scale": "cast(CASE WHEN c = 2 THEN z % 5 END AS int)"}),
    "md_pk": ("c = 0 OR (c = 1 AND tid % 5 = 0)", {
        "connection_id": "cast(tid % 3 AS int)", "schema_name": TABLE_SCHEMA, "table_name": TABLE_NAME,
        "column_name": "'c' || cast(c AS string)", "ordinal": "cast(c + 1 AS int)"}),
    "md_fk": ("c = 3 OR (c = 2 AND tid % 6 = 0)", {
        "connection_id": "cast(tid % 3 AS int)", "schema_name": TABLE_SCHEMA, "table_name": TABLE_NAME,
        "constraint_name": "'fk_' || cast(tid AS string)", "column_name": "'c' || cast(c AS string)",
        "ref_schema": "CASE WHEN tid < 3 THEN 'nowhere' ELSE 's' || cast((tid - 3) % 8 AS string) END",
        "ref_table": "CASE WHEN tid < 3 THEN 'none' WHEN tid % 7 = 0 THEN 'T' || cast(tid - 3 AS string) ELSE 't' || cast(tid - 3 AS string) END",
        "ref_column": "'c' || cast(c - 2 AS string)", "ordinal": "cast(c AS int)",
        "on_delete": "CASE tid % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'a' ELSE 'n' END", "on_update": "'a'"}),
    "md_index": ("c < 2", {
        "connection_id": "cast(tid % 3 AS int)", "schema_name": TABLE_SCHEMA, "table_name": TABLE_NAME,
        "index_name": "CASE WHEN tid % 5 = 0 THEN 'ix_' || cast(tid AS string) ELSE 'ix_' || cast(tid AS string) || '_' || cast(c AS string) END",
        "column_name": "'c' || cast(c AS string)", "ordinal": "cast(c + 1 AS int)",
        "is_unique": "tid % 2 = 0", "is_primary": "false", "index_type": "'btree'"}),
    "md_partition": ("1 = 1", {
        "connection_id": "cast(tid % 3 AS int)", "schema_name": TABLE_SCHEMA, "table_name": TABLE_NAME,
        "row_count": "cast(z * 100 AS bigint)", "pages": "cast(z AS bigint)"}),
}


def metadata(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Flat metadata rows: md_columns, md_pk, md_fk, md_index or md_partition."""
    where, columns = METADATA[name]
    rows = shaped(spark, sf_dir, "part", PART_COLUMNS).where(where)
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested table metadata of all connections."""
    from procatlas.functions import fixed_values as fv
    from procatlas.functions.scalars import label_of
    from procatlas.operators.metadata import nest_tables
    from procatlas.operators.rollup import table_sizes

    md = {n: metadata(spark, sf_dir, n) for n in METADATA}
    cols = md["md_columns"].withColumn("table_type", label_of(F.col("table_type"), fv.RELATION_KINDS))
    fks = md["md_fk"]
    for c in ("on_delete", "on_update"):
        fks = fks.withColumn(c, label_of(F.col(c), fv.KEY_ACTIONS))
    nested = nest_tables(cols, md["md_pk"], fks, md["md_index"], table_sizes(md["md_partition"]), primary_by_columns=True)
    owner = F.substring("table_name", 2, 20).cast("bigint") % 3
    return nested.withColumn("connection_id", owner.cast("int"))


# Connections from nation, jobs from orders, audit from events.
CONNECTION_COLUMNS = {
    "connection_id": "n_nationkey", "name": "n_name",
    "engine": "CASE n_nationkey % 3 WHEN 0 THEN 'sqlserver' WHEN 1 THEN 'postgresql' ELSE 'oracle' END",
    "is_active": "n_nationkey % 2 = 0", "created_day": "n_nationkey % 7",
}
JOB_COLUMNS = {
    "job_id": "o_orderkey", "connection_id": "cast(o_custkey % 25 AS int)",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'analyzing' "
              "WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'cancelled' ELSE 'pending' END",
    "total_objects": "cast(o_orderkey % 50 AS int)",
    "processed_objects": "cast(floor((o_orderkey % 50) * (o_custkey % 11) / 10) AS int)",
    "created_at": "o_orderdate",
}
AUDIT_COLUMNS = {
    "event_id": "event_id", "user_id": "user_id", "action": "event_type", "created_at": "ts",
    "resource_type": "CASE WHEN event_type IN ('view', 'click') THEN 'procedure' ELSE 'connection' END",
}


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "nation", CONNECTION_COLUMNS)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "orders", JOB_COLUMNS)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "events", AUDIT_COLUMNS)
