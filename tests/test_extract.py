"""Small exact cases, texts of our own."""

import re

import pytest
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv
from procatlas.functions import scalars
from procatlas.operators import document, extract
from procatlas.sources.readers import admit
from tests.test_matching import texts

SCHEMA = "object_id long, dialect string, object_type string, definition string"


def corpus(spark, *rows):
    return spark.createDataFrame([(i, d, t, s) for i, (d, t, s) in enumerate(rows, 1)], SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TSQL = """CREATE PROCEDURE dbo.ship_order @id INT, @note VARCHAR(20) = 'none', @done BIT OUTPUT
AS BEGIN
  EXEC dbo.check_stock @item = @id
  EXEC audit_log;
  EXEC [sales].[post_invoice]
  EXEC audit_log
  SELECT a FROM sales.orders o JOIN sales.items i ON o.k = i.k
  INSERT INTO sales.log VALUES (@id)
END"""


def test_calls_and_accesses(spark):
    df = corpus(spark, ("tsql", "procedure", TSQL))
    assert rows(extract.named_calls(df), "target_name", "line") == [
        ("audit_log", 4), ("dbo.check_stock", 3), ("sales.post_invoice", 5)]
    assert rows(extract.table_accesses(df), "full_table_name", "operation") == [
        ("sales.items", "SELECT"), ("sales.log", "INSERT"), ("sales.orders", "SELECT")]


def test_parameters_per_dialect(spark):
    df = corpus(
        spark, ("tsql", "procedure", TSQL),
        ("plpgsql", "function", "CREATE FUNCTION f(a INT, OUT b TEXT, INOUT c INT DEFAULT 4) RETURNS SETOF INT AS $$"),
        ("plsql", "function", "CREATE FUNCTION f(a IN NUMBER, b IN OUT VARCHAR2) RETURN NUMBER IS"))
    got = rows(extract.parameters(df), "object_id", "ordinal", "name", "data_type", "mode")
    assert got[:3] == [(1, 1, "@id", "INT", "IN"), (1, 2, "@note", "VARCHAR(20)", "IN"), (1, 3, "@done", "BIT", "INOUT")]
    assert [g for g in got if g[0] == 2] == [(2, 1, "a", "INT", "IN"), (2, 2, "b", "TEXT", "OUT"), (2, 3, "c", "INT", "INOUT")]
    assert [g for g in got if g[0] == 3] == [(3, 1, "a", "NUMBER", "IN"), (3, 2, "b", "VARCHAR2", "INOUT")]
    assert rows(extract.return_types(df), "object_id", "return_type") == [(2, "SETOF INT"), (3, "NUMBER")]


def test_unsafe_texts(spark):
    df = corpus(
        spark, ("tsql", "procedure", "BEGIN\n EXEC(@s)\n EXEC xp_cmdshell 'x'\nEND"),
        ("plpgsql", "function", "CREATE FUNCTION f() RETURNS int AS $$ SECURITY DEFINER\n PERFORM dblink('a')"),
        ("plsql", "procedure", "BEGIN EXECUTE IMMEDIATE p_sql; END;"),
        ("tsql", "procedure", "SET @pwd = 'hunter2'"))
    assert rows(extract.rule_findings(df), "object_id", "finding_type", "line") == [
        (1, "os_command_execution", 3), (1, "sql_injection_risk", 2), (2, "external_access", 2),
        (2, "security_definer", 1), (3, "sql_injection_risk", 1)]
    assert rows(extract.credential_findings(df), "object_id") == [(4,)]
    leaks = corpus(spark, ("tsql", "procedure", "x password = 'hunter2' y pwd:'z'"), ("tsql", "procedure", "pwd = @p"))
    assert rows(extract.credential_findings(leaks), "object_id") == [(1,)]
    assert rows(extract.conditional_findings(df), "object_id", "finding_type") == [
        (2, "external_access"), (2, "security_definer"), (3, "sql_injection_risk")]


def test_views_carry_no_calls(spark):
    df = corpus(spark, ("tsql", "view", "CREATE VIEW v AS EXEC p1"))
    assert extract.named_calls(df).count() == extract.parameters(df).count() == extract.flow_lines(df).count() == 0


def test_object_kinds(spark):
    df = spark.createDataFrame([("create or replace procedure p",), ("CREATE OR ALTER PROC p",), ("select 1",), ("CREATE VIEW v",)], "t string")
    assert [r[0] for r in df.select(extract.object_kind(F.col("t"))).collect()] == ["procedure", "procedure", "anonymous", "view"]


def _nesting(text):
    depth = deepest = 0
    for w in re.findall(fv.BLOCK_WORDS, text, re.I):
        depth = max(0, depth - 1) if w.upper() == "END" else depth + 1
        deepest = max(deepest, depth) if w.upper() != "END" else deepest
    return deepest


def test_complexity_against_loop(spark):
    data = texts(150)
    df = spark.createDataFrame([(i, "tsql", "procedure", t) for i, t in data], SCHEMA)
    got = {r.object_id: r for r in extract.complexity(df).collect()}
    for i, t in data:
        branches = len(re.findall(fv.BRANCH_WORDS, t, re.I))
        assert (got[i].cyclomatic, got[i].nesting, got[i].lines) == (branches + 1, _nesting(t), t.count("\n") + 1)


def test_variables_against_loop(spark):
    """Twelve passes against a plain loop over ``finditer``."""
    data = texts(150)
    df = spark.createDataFrame([(i, "tsql", "procedure", t) for i, t in data], SCHEMA)
    want = set()
    for i, t in data:
        for _, kind, pattern, _ in fv.VARIABLE_PATTERNS:
            for m in re.finditer(pattern, t, re.I):
                line, g = t[: m.start()].count("\n") + 1, (None, *m.groups())
                updating = lambda n: re.search(fv.UPDATE_WORD, t[max(0, m.start() - n): m.start()], re.I)
                if kind == "set" and updating(100) or kind == "update_set" and not updating(200):
                    continue
                if kind == "exec_named":
                    want |= {(i, b, "exec_argument", line) for _, b in re.findall(fv.NAMED_ARGUMENT_PATTERN, g[2])}
                elif kind == "exec_positional":
                    want |= {(i, a.strip(), "exec_argument", line) for a in g[2].split(",")}
                else:
                    name = g[2] if kind == "select_into" else "@" + g[1] if kind.startswith("parameter") else g[1]
                    want.add((i, name, kind, line))
    got = rows(extract.variable_references(df), "object_id", "variable_name", "reference_type", "line")
    assert got == sorted(want)


def test_statement_runs(spark):
    df = corpus(spark, ("tsql", "procedure", "BEGIN\nDECLARE @a INT\n-- note\nDECLARE @b INT\nSET @a = 1\nSET @b = 2\nSELECT 1\nSET @a = 3\nEND"))
    assert rows(extract.statement_runs(df), "line", "operation", "n_statements", "variables_written") == [
        (2, "DECLARE", 2, "@a,@b"), (5, "SET", 2, "@a,@b"), (8, "SET", 1, "@a")]


def test_block_paths(spark):
    df = corpus(spark, ("tsql", "procedure", "IF x\nBEGIN\nWHILE y\nBEGIN\nEXEC p1\nEND\nEND"))
    assert rows(extract.block_paths(df), "line", "path", "depth") == [(5, "IF>WHILE", 4)]


@pytest.mark.parametrize("value,label", [(3, "low"), (8, "moderate"), (15, "high"), (25, "critical"), (0, "unknown"), (None, "unknown")])
def test_risk_edges(spark, value, label):
    df = spark.createDataFrame([(value,)], "c int")
    assert df.select(scalars.risk_level(F.col("c"))).first()[0] == label


def test_reliability_and_hash(spark):
    df = spark.createDataFrame([(0.9, False, "a"), (0.5, True, "a")], "c double, d boolean, t string")
    got = df.select(scalars.is_reliable(F.col("c"), F.col("d")), scalars.definition_hash(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False] and got[0][1] == got[1][1] and len(got[0][1]) == 64


def test_admission(spark):
    df = spark.createDataFrame([("a", "TSQL"), (" \n", "tsql"), ("a", "mysql"), ("a" * 500_001, "oracle"), ("a", "postgres")],
                               "sql string, dialect string")
    assert [(r.canonical, r.reason) for r in admit(df).collect()] == [
        ("tsql", None), ("tsql", "blank text"), (None, "unknown dialect"), ("plsql", "text too long"), ("plpgsql", None)]


def _attach(text):
    """Plain-loop form of the comment claim."""
    lines, used, out = text.split("\n"), set(), []
    comments = {}
    for n, raw in enumerate(lines, 1):
        s = raw.strip()
        if s.startswith("--"):
            body = s.lstrip("-").strip()
            if len(body) > 2 and not any(body.upper().startswith(w) for w in fv.COMMENT_SKIP_WORDS):
                comments[n] = body
        elif "--" in s and (m := re.match(fv.TRAILING_COMMENT, s)):
            comments[n] = m.group(2).strip()
    for n, raw in enumerate(lines, 1):
        if any(re.search(p, raw.strip(), re.I) for _, p in fv.LINE_CLASSES):
            for c in (n - 1, n - 2, n - 3):
                if c in comments and c not in used:
                    used.add(c)
                    out.append((n, c, comments[c]))
                    break
    return out


def test_attached_comments_against_loop(spark):
    import random

    rnd = random.Random(3)
    parts = ["-- first note", "-- second note", "EXEC p1", "IF x", "x = 1", "", "UPDATE t -- tail note", "-- ab", "-- Author: me"]
    data = [(i, "tsql", "procedure", "\n".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))) for i in range(150)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted((i, *c) for i, _, _, t in data for c in _attach(t))
    assert rows(document.attached_comments(df), "object_id", "line", "comment_line", "comment") == want


def test_header_and_language(spark):
    df = corpus(
        spark, ("tsql", "procedure", "-- Autor: Ana\n-- Fecha de creación: 2020\n-- Descripción: carga\nSELECT 1"),
        ("tsql", "procedure", "-- Author: Bo\n-- Author: <Cy>\nSELECT 1 -- count rows"),
        ("tsql", "procedure", "/*\n * Cleans up\n * AUTHOR x\n * nightly\n */\nSELECT 1"))
    assert rows(document.header_metadata(df), "object_id", "key", "n", "value") == [
        (1, "author", 1, "Ana"), (1, "createDate", 1, "2020"), (1, "description", 1, "carga"),
        (2, "author", 1, "Bo"), (2, "author", 2, "Cy")]
    assert rows(document.block_descriptions(df), "object_id", "description") == [(3, "Cleans up nightly")]
    assert [r[0] for r in df.orderBy("object_id").select(document.comment_language(F.col("definition"))).collect()] == ["es", "en", "en"]
    # "Fecha" lines are not among the header words that comments leave out
    assert rows(document.comments(df), "object_id", "line", "comment") == [
        (1, 2, "Fecha de creación: 2020"), (2, 3, "count rows")]
