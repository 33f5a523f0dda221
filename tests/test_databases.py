"""Database scans with the JDBC read replaced by tables of the same columns."""

from procatlas.sources import databases


def fake(tables, seen):
    def read(spark, url, query, partition=None, **options):
        what = next(k for k, v in databases.QUERIES.items() if v == query)
        seen.append((what, partition, options))
        return tables[what]
    return read


def test_sql_server_definitions(spark, monkeypatch):
    seen = []
    rows = spark.createDataFrame([("dbo", "p", "P", "EXEC q", 1), ("sys", "h", "P", "x", 2), ("dbo", "s", "SN", "x", 3), ("app", "v", "V", "SELECT 1", 4)],
                                 "schema_name string, object_name string, kind_code string, definition string, shard int")
    monkeypatch.setattr(databases, "jdbc_scan", fake({("tsql", "definitions"): rows}, seen))
    shards = {"lowerBound": 0, "upperBound": 100, "numPartitions": 8}
    got = databases.scan_definitions(spark, "SqlServer", "jdbc:x", shards=shards, user="u")
    assert {(r.object_name, r.object_type) for r in got.collect()} == {("p", "procedure"), ("v", "view")}
    assert seen == [(("tsql", "definitions"), {"partitionColumn": "shard", **shards}, {"user": "u"})]
    assert databases.scan_definitions(spark, "tsql", "jdbc:x", schemas=["app"]).count() == 1


def test_oracle_lines_and_views(spark, monkeypatch):
    lines = spark.createDataFrame([("HR", "PK", "PACKAGE BODY", 2, "b\n"), ("HR", "PK", "PACKAGE BODY", 1, "a\n"), ("SYS", "S", "FUNCTION", 1, "x")],
                                  "owner string, name string, type string, line int, text string")
    views = spark.createDataFrame([("HR", "V", "SELECT 1")], "schema_name string, object_name string, definition string")
    monkeypatch.setattr(databases, "jdbc_scan", fake({("plsql", "source_lines"): lines, ("plsql", "views"): views}, []))
    got = databases.scan_definitions(spark, "oracle", "jdbc:x")
    assert {(r.object_name, r.object_type, r.definition) for r in got.collect()} == {("PK", "package", "a\nb\n"), ("V", "view", "SELECT 1")}


def test_every_engine_has_every_scan():
    for dialect in ("tsql", "plpgsql", "plsql"):
        have = {what for d, what in databases.QUERIES if d == dialect}
        assert {"columns", "keys", "foreign_keys", "indexes", "sizes"} <= have


def test_columns_come_out_in_the_model_shape(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "t", "table", "c", "decimal", 1, "YES", None, None, 10, 2)],
                                 "schema_name string, table_name string, table_type string, column_name string, data_type string, ordinal int, "
                                 "nullable_text string, default_value string, max_length int, num_precision int, num_scale int")
    monkeypatch.setattr(databases, "jdbc_scan", lambda *a, **k: rows)
    row = databases.scan_columns(spark, "postgres", "jdbc:x").first()
    assert (row.is_nullable, row.precision, row.scale) == (True, 10, 2)
