"""Table accesses and parameters of texts that are written in many ways."""

import pytest
from procatlas.functions.matching import mask
from procatlas.operators import extract
from pyspark.sql import functions as F

SCHEMA = "object_id long, dialect string, object_type string, definition string"
ACCESSES = [
    ("tsql", "SELECT x INTO dbo.t3 FROM dbo.a, dbo.b; INSERT dbo.t1 SELECT 1",
     {(1, "INSERT", "dbo.t3"), (1, "SELECT", "dbo.a"), (1, "SELECT", "dbo.b"), (1, "INSERT", "dbo.t1")}),
    ("tsql", "UPDATE o SET c = 1 FROM dbo.orders AS o JOIN x.c ON o.k = c.k", {(1, "UPDATE", "dbo.orders"), (1, "SELECT", "x.c")}),
    ("tsql", "DELETE o FROM dbo.orders o, dbo.z\nWHERE o.k = (SELECT max(k) FROM dbo.orders)",
     {(1, "DELETE", "dbo.orders"), (1, "SELECT", "dbo.z"), (1, "SELECT", "dbo.orders")}),
    # query names end with their statement
    ("tsql", "WITH r AS (\n SELECT k FROM t1\n), q (k) AS (SELECT k FROM r)\nSELECT @v = k FROM q, r x\nSELECT 1 FROM q",
     {(2, "SELECT", "t1"), (5, "SELECT", "q")}),
    ("plpgsql", "WITH gone AS (DELETE FROM t1 RETURNING k) INSERT INTO s1.log SELECT k FROM gone;\n"
                "SELECT extract(year FROM c) INTO v_c FROM t2 a, s.l b WHERE a IS DISTINCT FROM b FOR UPDATE;",
     {(1, "DELETE", "t1"), (1, "INSERT", "s1.log"), (2, "SELECT", "t2"), (2, "SELECT", "s.l")}),
    ("tsql", "MERGE INTO dbo.t AS x USING s.l y ON x.k=y.k WHEN MATCHED THEN UPDATE SET c = 1 WHEN NOT MATCHED THEN INSERT (c) VALUES (2);\n"
             "TRUNCATE TABLE [a b].[c d]", {(1, "MERGE", "dbo.t"), (1, "SELECT", "s.l"), (2, "TRUNCATE", "a b.c d")}),
    ("tsql", "/* SELECT 1 FROM no\n UPDATE no2 */ SELECT 'DELETE FROM none', c FROM real -- FROM no3\nINNER LOOP JOIN [x].[y] ON 1=1, third",
     {(2, "SELECT", "real"), (2, "SELECT", "x.y"), (2, "SELECT", "third")}),
    ("tsql", "SELECT CASE WHEN a THEN b ELSE c END, (SELECT 1 FROM n1) FROM n2 WITH (NOLOCK), n3 UNION ALL\n"
             "SELECT 1 FROM fn(1) f CROSS APPLY dbo.g(x) LEFT JOIN (SELECT 2 FROM n4) z ON 1 = 1, n5",
     {(1, "SELECT", n) for n in ("n1", "n2", "n3")} | {(2, "SELECT", "n4"), (2, "SELECT", "n5")}),
    ("tsql", "UPDATE t SET c = 1\nDELETE FROM u WHERE x = 1\nINSERT INTO #w (a, b) VALUES (1, 2)\nUPDATE @tv SET a = b.c FROM @tv a JOIN dbo.b b ON 1 = 1\nEXEC p",
     {(1, "UPDATE", "t"), (2, "DELETE", "u"), (3, "INSERT", "#w"), (4, "SELECT", "dbo.b")}),
    ("tsql", "DELETE TOP (10) FROM q OUTPUT deleted.k INTO dbo.log WHERE 1 = 1", {(1, "DELETE", "q"), (1, "INSERT", "dbo.log")}),
    ("plsql", "FETCH c INTO v; SELECT a INTO v FROM t; DELETE t2 WHERE 1=1;\nUPDATE t SET a = (SELECT b FROM t)",
     {(1, "SELECT", "t"), (1, "DELETE", "t2"), (2, "UPDATE", "t"), (2, "SELECT", "t")} - {(2, "SELECT", "t")}),
    ("plpgsql", "CREATE TRIGGER x AFTER INSERT OR UPDATE OF c ON t;\nGRANT SELECT, INSERT ON t TO r;\nSELECT (open + close) FROM prices p;",
     {(3, "SELECT", "prices")}),
    ("tsql", "SELECT ((1 FROM lost;\nSELECT 1 FROM kept", {(2, "SELECT", "kept")}),
    ("tsql", "", set()), ("tsql", None, set()),
]
PARAMETERS = [
    ("tsql", "CREATE PROCEDURE dbo.sp_Params @Name VARCHAR(100), @Age INT = 25, @Out INT OUTPUT AS SELECT 1",
     [("@Name", "VARCHAR(100)", "IN", None), ("@Age", "INT", "IN", "25"), ("@Out", "INT", "INOUT", None)]),
    ("tsql", "CREATE PROC p @a INT, @b INT AS BEGIN DECLARE @c INT, @d INT END", [("@a", "INT", "IN", None), ("@b", "INT", "IN", None)]),
    ("tsql", "create or alter procedure [a b].[p]\n  @x AS NUMERIC(10,2) = 1.5, -- first, the one\n  @y NVARCHAR(MAX) = N'a, (b' OUT,\n"
             "  @t dbo.tt READONLY\nWITH RECOMPILE AS\nBEGIN SELECT 1 END",
     [("@x", "NUMERIC(10,2)", "IN", "1.5"), ("@y", "NVARCHAR(MAX)", "INOUT", "N'a, (b'"), ("@t", "dbo.tt", "IN", None)]),
    ("tsql", "CREATE FUNCTION f(@p INT, @q DECIMAL(10,2) = NULL) RETURNS INT AS BEGIN DECLARE @z INT RETURN 1 END",
     [("@p", "INT", "IN", None), ("@q", "DECIMAL(10,2)", "IN", "NULL")]),
    ("tsql", "CREATE PROCEDURE p AS BEGIN DECLARE @z INT, @w INT END", []),
    ("plpgsql", "CREATE OR REPLACE FUNCTION f(p_a NUMERIC(10,2), p_b INT DEFAULT 1, p_c TEXT = coalesce('x', g(1, 2)), int, "
                "OUT o double precision, VARIADIC arr INT[]) RETURNS TABLE(a INT) AS $$ BEGIN",
     [("p_a", "NUMERIC(10,2)", "IN", None), ("p_b", "INT", "IN", "1"), ("p_c", "TEXT", "IN", "coalesce('x', g(1, 2))"),
      ("$4", "int", "IN", None), ("o", "double precision", "OUT", None), ("arr", "INT[]", "VARIADIC", None)]),
    ("plsql", "CREATE PROCEDURE s.f(a IN NUMBER, b IN OUT NOCOPY VARCHAR2, c t.col%TYPE DEFAULT pk.f(1, ')'), d DATE := SYSDATE /* , e INT */) "
              "IS x INT; BEGIN g(x INT); END",
     [("a", "NUMBER", "IN", None), ("b", "VARCHAR2", "INOUT", None), ("c", "t.col%TYPE", "IN", "pk.f(1, ')')"), ("d", "DATE", "IN", "SYSDATE")]),
    ("plsql", "CREATE TRIGGER t AFTER INSERT ON x BEGIN p(a b); END", []),
    ("plpgsql", "CREATE FUNCTION f() RETURNS int AS $$ SELECT g(a b) $$", []),
    ("plpgsql", "CREATE FUNCTION f(a INT", []), ("tsql", "", []), ("plsql", None, []),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, c[0], "procedure", c[1]) for i, c in enumerate(cases)], SCHEMA)


def test_accesses(spark):
    got = {}
    for r in extract.table_accesses(frame(spark, ACCESSES)).collect():
        got.setdefault(r.object_id, []).append((r.line, r.operation, r.full_table_name))
    want = {}
    for i, (_, _, rows) in enumerate(ACCESSES):  # one row for a table and operation, at its first line
        for line, op, name in sorted(rows):
            if all((op, name) != r[1:] for r in want.get(i, [])):
                want.setdefault(i, []).append((line, op, name))
    assert {i: sorted(r) for i, r in got.items()} == want


def test_parameters(spark):
    got = {}
    for r in extract.parameters(frame(spark, PARAMETERS)).orderBy("object_id", "ordinal").collect():
        got.setdefault(r.object_id, []).append((r["name"], r.data_type, r["mode"], r.default_value))
        assert r.ordinal == len(got[r.object_id])
    assert got == {i: rows for i, (_, _, rows) in enumerate(PARAMETERS) if rows}


def test_long_texts(spark):
    """Beyond the block of the fold, and with brackets by the thousand."""
    text = "".join(f"INSERT INTO t{k} SELECT ((c)) FROM u{k}, (SELECT 1 FROM w) x;\n" for k in range(1500))
    rows = extract.table_accesses(frame(spark, [("tsql", text)])).groupBy("operation").count().collect()
    assert dict(rows) == {"INSERT": 1500, "SELECT": 1501}


@pytest.mark.parametrize("strings", [True, False])
def test_mask_keeps_places(spark, strings):
    text = "a 'b--c' \n/*'\n*/ [x -- '] \"--\" b -- 'd"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(mask(F.col("t"), strings)).collect()
    assert len(got[0][0]) == len(text) and got[0][0].count("\n") == text.count("\n") and got[1][0] is None
    assert "d" not in got[0][0] and ("b--c" in got[0][0]) != strings and "[x -- ']" in got[0][0]
