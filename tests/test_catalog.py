"""Resolution, upkeep, sources, streams and the whole run."""

import datetime

import pytest
from pyspark.sql import functions as F

from procatlas.operators import document, graph, listing, maintain, metadata, resolve, rollup
from procatlas.plans.analysis import Analysis
from procatlas.session import fresh_path, shared_root
from procatlas.sources import readers, sinks
from procatlas.streaming import jobs as streams


def day(n):
    return datetime.datetime(2024, 1, n)


def objects(spark):
    rows = [
        (1, 1, "tsql", "a", "Load", "a.Load", "procedure", "CREATE PROCEDURE a.Load AS\nEXEC b.Save\nEXEC save;\nEXEC nowhere", day(1)),
        (2, 1, "tsql", "b", "Save", "b.Save", "procedure", "CREATE PROCEDURE b.Save AS\nUPDATE b.t SET c = 1", day(2)),
        (3, 1, "tsql", "c", "save", "c.save", "procedure", "CREATE PROCEDURE c.save AS\nEXEC A.LOAD\nSELECT x FROM b.t", day(3)),
        (4, 2, "tsql", "b", "Save", "b.Save", "procedure", "CREATE PROCEDURE b.Save AS\nEXEC Load", day(1)),
    ]
    return spark.createDataFrame(rows, "object_id long, connection_id int, dialect string, schema_name string, object_name string, "
                                       "fqn string, object_type string, definition string, seen_at timestamp_ntz")


def test_name_resolution(spark):
    a = Analysis(spark, objects(spark))
    got = {(r.object_id, r.target_name): r.target_id for r in a.dependencies.collect()}
    # exact name; short names that collide go to the object seen last; case ignored; other connections are not searched
    assert got == {(1, "b.Save"): 2, (1, "save"): 3, (1, "nowhere"): None, (3, "A.LOAD"): 1, (4, "Load"): None}


def test_analysis_run_and_second_run(spark):
    folder = fresh_path(spark, "run")
    first = Analysis(spark, objects(spark))
    catalog = first.store(folder, "j1", F.lit("2024-01-01"))
    assert catalog.count() == 4 and catalog.where("is_deleted").count() == 0
    changed = objects(spark).where("object_id <> 2").withColumn(
        "definition", F.when(F.col("object_id") == 1, "CREATE PROCEDURE a.Load AS\nEXEC b.Save").otherwise(F.col("definition")))
    second = Analysis(spark, changed).store(folder, "j2", F.lit("2024-02-01"), catalog)
    rows = {(r.connection_id, r.fqn): (r.first_seen, r.last_seen, r.is_deleted) for r in second.collect()}
    assert rows[(1, "b.Save")] == ("2024-01-01", "2024-01-01", True)
    assert rows[(1, "a.Load")] == ("2024-01-01", "2024-02-01", False)
    states = {r.fqn: r.state for r in maintain.diff(catalog.where("connection_id = 1"), second.where("connection_id = 1 AND NOT is_deleted"),
                                                    ["connection_id", "fqn"]).collect()}
    assert states == {"a.Load": "changed", "b.Save": "removed", "c.save": "unchanged"}
    assert spark.read.parquet(f"{folder}/dependencies").select("job_id").distinct().count() == 2


def test_the_same_name_in_two_connections_is_two_nodes(spark):
    a = Analysis(spark, objects(spark).withColumn("connection_id", F.when(F.col("object_id") == 2, 9).otherwise(F.col("connection_id"))))
    nodes, edges = a.nodes, a.edges
    assert {r.target for r in edges.where("target LIKE 'tbl%'").collect()} == {r.id for r in nodes.where("object_type = 'table'").collect()}
    reached = graph.reach(edges, spark.createDataFrame([("obj_2",)], "id string"))
    owner = {f"obj_{r.object_id}": r.connection_id for r in a.objects.collect()}
    assert {owner[r.id] for r in reached.collect() if r.id in owner} == {9}


def test_graph_view(spark):
    a = Analysis(spark, objects(spark))
    nodes, edges, summary = a.graph_view(connection_id=1)
    assert {r.id for r in nodes.collect()} == {"obj_1", "obj_2", "obj_3", "ext_1_nowhere", "tbl_1_b_t"}
    row = summary.first()
    assert (row.nodes, row.edges, row.cyclic_components, row.roots, row.leaves) == (5, 6, 1, 0, 2)
    nodes, edges, _ = a.graph_view(connection_id=1, root="obj_2", max_depth=1, types=["calls"])
    assert {(r.source, r.target) for r in edges.collect()} == {("obj_1", "obj_2")}
    assert {r.id for r in nodes.collect()} == {"obj_1", "obj_2"}


def test_stale_only_in_connections_that_ran(spark):
    catalog = spark.createDataFrame([(1, "a", False), (1, "b", False), (2, "c", False)], "connection_id int, fqn string, is_deleted boolean")
    seen = spark.createDataFrame([(1, "a")], "connection_id int, fqn string")
    assert [r.fqn for r in resolve.stale_objects(catalog, seen, ["connection_id", "fqn"]).collect()] == ["b"]
    assert resolve.stale_objects(catalog, seen.where("false"), ["connection_id", "fqn"]).count() == 0


@pytest.mark.parametrize("days", [1, 3, 100])
def test_version_history_in_any_slicing(spark, days):
    import random

    rnd = random.Random(days)
    rows = [(k, i, rnd.choice("abc")) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "object_key int, run_at int, definition_hash string")
    want, last, n = [], {}, {}
    for k, i, h in sorted(rows):
        if last.get(k) != h:
            n[k] = n.get(k, 0) + 1
            want.append((k, n[k], h, i))
        last[k] = h
    got = maintain.version_history(df, F.floor(F.col("run_at") / days))
    assert sorted((r.object_key, r.version_number, r.definition_hash, r.detected_at) for r in got.collect()) == want


def test_schema_merge_treats_missing_catalogs_as_equal(spark):
    shape = "connection_id int, schema_name string, catalog_name string, object_count long, first_seen string"
    old = spark.createDataFrame([(1, "a", None, 5, "d1"), (1, "a", "m", 6, "d1")], shape)
    new = spark.createDataFrame([(1, "a", None, 9, "d2"), (1, "b", None, 1, "d2")], shape)
    got = {(r.schema_name, r.catalog_name): (r.object_count, r.first_seen, r.last_seen) for r in maintain.merge_schemas(old, new).collect()}
    assert got == {("a", None): (9, "d1", "d2"), ("a", "m"): (6, "d1", "d1"), ("b", None): (1, "d2", "d2")}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_source_lines_in_any_chunking(spark, chunk):
    rows = [("O", "P", "PACKAGE BODY", i, f"line {i}\n") for i in range(25)] + [("O", "Q", "FUNCTION", 1, "x")]
    df = spark.createDataFrame(rows, "owner string, name string, type string, line int, text string").repartition(5)
    got = {(r.object_name, r.object_type): r.definition for r in readers.reassemble_source(df, chunk).collect()}
    assert got == {("P", "package"): "".join(f"line {i}\n" for i in range(25)), ("Q", "function"): "x"}


def test_sql_files_and_export(spark, tmp_path):
    (tmp_path / "one.sql").write_text("SELECT 1;\nSELECT 2;")
    (tmp_path / "two.sql").write_text("  ")
    got = {r.path.rsplit("/", 1)[1]: (r.accepted, r.sql) for r in readers.read_sql_files(spark, str(tmp_path), "sqlserver").collect()}
    assert got == {"one.sql": (True, "SELECT 1;\nSELECT 2;"), "two.sql": (False, "  ")}
    sinks.export_snapshot({"things": spark.createDataFrame([(1, "x")], "object_id int, full_table_name string")}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/things")).columns == ["fullTableName", "objectId"]


def test_nested_metadata_round_trip(spark):
    k = ("s", "t")
    cols = spark.createDataFrame([(*k, "table", "b", "int", 2, True, None, None, None, None), (*k, "table", "a", "int", 1, False, None, None, None, None)],
                                 "schema_name string, table_name string, table_type string, column_name string, data_type string, ordinal int, "
                                 "is_nullable boolean, default_value string, max_length int, precision int, scale int")
    pk = spark.createDataFrame([(*k, "b", 2), (*k, "a", 1)], "schema_name string, table_name string, column_name string, ordinal int")
    fk = spark.createDataFrame([(*k, "fk", "b", "s", "T", "y", 2, "CASCADE", "NO ACTION"), (*k, "fk", "a", "s", "T", "x", 1, "CASCADE", "NO ACTION")],
                               "schema_name string, table_name string, constraint_name string, column_name string, ref_schema string, "
                               "ref_table string, ref_column string, ordinal int, on_delete string, on_update string")
    ix = spark.createDataFrame([(*k, "i1", "b", 1, True, False, "btree"), (*k, "i1", "a", 2, True, False, "btree"), (*k, "i2", "a", 1, False, False, "btree")],
                               "schema_name string, table_name string, index_name string, column_name string, ordinal int, is_unique boolean, "
                               "is_primary boolean, index_type string")
    rc = spark.createDataFrame([(*k, 7)], "schema_name string, table_name string, row_count long")
    nested = metadata.nest_tables(cols, pk, fk, ix, rc, primary_by_columns=True)
    row = nested.first()
    assert [c.column_name for c in row["columns"]] == row.primary_key == ["a", "b"]
    assert row.foreign_keys[0]["columns"] == ["a", "b"] and row.foreign_keys[0].referenced_columns == ["x", "y"]
    assert [(i.index_name, i["columns"], i.is_primary) for i in row.indexes] == [("i1", ["b", "a"], True), ("i2", ["a"], False)]
    assert metadata.unnest_columns(nested).where("is_primary_key AND is_foreign_key").count() == 2
    links = nested.withColumn("connection_id", F.lit(1))
    assert [r.target_fqn for r in resolve.relationships(links).collect()] == ["s.t"]


def test_job_state_stream_over_several_files(spark, tmp_path):
    schema = "update_id long, connection_id long, job_id long, ts timestamp, status string"
    batches = [[(1, 1, 10, day(1), "pending"), (2, 1, 11, day(1), "pending")], [(3, 1, 10, day(3), "completed")], [(4, 1, 10, day(2), "parsing")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    table = streams.StateTable(spark, str(tmp_path / "out"), ["connection_id", "job_id"], ["updated_at", "update_id"], ["updates"])
    progress = streams.run_to_end(streams.latest_job_state(source), table.add, str(tmp_path / "log"), "update")
    got = {r.job_id: (r.status, r.updates, r.update_id) for r in table.read().collect()}
    assert got == {10: ("completed", 3, 3), 11: ("pending", 1, 2)} and [p["rows"] for p in progress if p["rows"]] == [2, 1, 1]


def test_job_state_forgets_finished_jobs_and_folds_its_table(spark, tmp_path):
    """Six batches of a hundred jobs each, all but one of which finish: the state does not add up, nor do the folders."""
    schema = "update_id long, connection_id long, job_id long, ts timestamp, status string"
    for b in range(6):
        rows = [(1000 * b + k, k % 3, 100 * b + k, day(1 + b), "completed" if k else "parsing") for k in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{b}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    table = streams.StateTable(spark, str(tmp_path / "out"), ["connection_id", "job_id"], ["updated_at", "update_id"], ["updates"], fold_every=3)
    progress = streams.run_to_end(streams.latest_job_state(source, keep_finished_ms=1), table.add, str(tmp_path / "log"), "update")
    assert max(p["state"] for p in progress) <= 106
    got = table.read()
    assert got.count() == 600 and got.where("status = 'parsing'").count() == 6 and got.where("updates = 1").count() == 600
    assert len(list((tmp_path / "out").iterdir())) <= 1 + 3
    # a batch that is stored again changes nothing
    last = spark.read.parquet(str(tmp_path / "in/b5")).selectExpr("connection_id", "job_id", "status", "update_id", "1L AS updates", "ts AS updated_at")
    number = 1 + max(p["batch"] for p in progress)
    for _ in range(2):
        table.add(last.where("job_id = 500"), number)
    assert {r.updates for r in table.read().where("job_id = 500").collect()} == {2}


def test_changed_definitions_over_batches(spark, tmp_path):
    """Returns to an old text, repeats, late rows, several rows of a name in a batch, and names that are forgotten."""
    schema = "connection_id int, fqn string, definition_hash string, seen_at timestamp"
    batches = [[(1, "p", "A", day(1)), (2, "p", "A", day(1)), (1, "q", "X", day(2)), (1, "q", "Y", day(1))],
               [(1, "p", "B", day(3)), (2, "p", "A", day(3)), (1, "q", "Z", day(1))],
               [(1, "p", "A", day(5)), (1, "p", "A", day(6)), (1, "p", None, day(7)), (1, "r", "R", None)],
               [(1, "p", "C", day(4)), (1, "p", "C", day(2)), (2, "p", "B", day(9)), (1, "q", "X", day(2))]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))

    def run(name, **options):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        progress = streams.run_to_end(streams.changed_definitions(source, **options), str(tmp_path / name), str(tmp_path / f"{name}-log"))
        rows = spark.read.parquet(str(tmp_path / name))
        return rows, sorted((r.connection_id, r.fqn, str(r.definition_hash), r.seen_at.day, r.kind) for r in rows.collect()), progress

    rows, got, progress = run("kept")
    assert got == sorted([
        (1, "p", "A", 1, "changed"), (1, "p", "B", 3, "changed"), (1, "p", "A", 5, "changed"), (1, "p", "None", 7, "changed"),
        (1, "p", "C", 4, "late"), (1, "p", "C", 2, "late"), (2, "p", "A", 1, "changed"), (2, "p", "B", 9, "changed"),
        (1, "q", "Y", 1, "changed"), (1, "q", "X", 2, "changed"), (1, "q", "Z", 1, "late")])
    assert {r.connection_id: (r.late, r.newest.day) for r in streams.late_rows(rows).collect()} == {1: (3, 4)}
    assert max(p["state"] for p in progress) == 3
    _, forgetful, progress = run("forgotten", forget_ms=1)
    assert forgetful.count((1, "q", "X", 2, "changed")) == 2 and progress[-2]["state"] < 3  # nothing of q in two batches


def test_fingerprint_prefers_exact_then_lowest_id(spark):
    texts = objects(spark).select("object_id", "definition")
    asked = spark.createDataFrame([(1, "create   procedure b.Save AS\nUPDATE b.t SET c = 1"), (2, "unrelated"), (3, None)], "text_id int, text string")
    got = {r.text_id: (r.object_id, r.matched_by) for r in listing.by_fingerprint(asked, texts).collect()}
    assert got == {1: (2, "exact"), 2: (None, "none")}
    head = "create procedure p as " + "x" * 70
    known = spark.createDataFrame([(5, head + " one"), (7, head + " two"), (9, head[:50] + " else"), (6, head + " TWO")], "object_id int, definition string")
    asked = spark.createDataFrame([(1, head + "  two"), (2, head + " three"), (3, head[:45] + " other")], "text_id int, text string")
    got = {r.text_id: (r.object_id, r.matched_by) for r in listing.by_fingerprint(asked, known).collect()}
    assert got == {1: (6, "exact"), 2: (5, "prefix-80"), 3: (5, "prefix-40")}


def test_repeated_keys_are_one_row(spark):
    """Overloads under one name, over three runs: the catalog does not multiply, and keeps them apart by signature if asked."""
    schema = "connection_id int, fqn string, signature string, definition_hash string"
    run = spark.createDataFrame([(1, "s.f", "INT", "a"), (1, "s.f", "TEXT", "b"), (1, "s.f", "TEXT", "c"), (1, "s.g", "", "d")], schema)
    empty = run.select("connection_id", "fqn", "signature", "definition_hash", F.lit(0).alias("first_seen"), F.lit(0).alias("last_seen"),
                       F.lit(False).alias("is_deleted")).limit(0)
    for keys, rows in ((["connection_id", "fqn"], [("s.f", "c"), ("s.g", "d")]),
                       (["connection_id", "fqn", "signature"], [("s.f", "a"), ("s.f", "c"), ("s.g", "d")])):
        catalog = empty.drop("signature") if "signature" not in keys else empty
        for day_ in (1, 2, 3):
            catalog = maintain.merge_objects(catalog, run, F.lit(day_), ["definition_hash"], keys)
        assert sorted((r.fqn, r.definition_hash) for r in catalog.collect()) == rows
        assert {(r.first_seen, r.last_seen, r.is_deleted) for r in catalog.collect()} == {(1, 3, False)}
    assert {r.fqn: r.rows for r in maintain.repeated_keys(run, ["connection_id", "fqn"]).collect()} == {"s.f": 3}
    assert maintain.diff(run, run, ["connection_id", "fqn"]).groupBy("state").count().collect() == [("unchanged", 2)]


def test_recent_jobs_plan_limits_before_the_shuffle(spark):
    jobs = spark.range(1000).selectExpr("id AS job_id", "cast(id % 3 AS int) AS connection_id", "timestamp_seconds(id) AS created_at")
    conns = spark.createDataFrame([(i, f"c{i}", "e") for i in range(3)], "connection_id int, name string, engine string")
    df = listing.recent_jobs(jobs, conns)
    assert [r.job_id for r in df.orderBy("job_id").collect()] == [995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_smallest_names(spark):
    df = spark.createDataFrame([(1, n) for n in "dbacba"] + [(2, "z")], "object_id long, name string")
    got = {r.object_id: r.call_names for r in document.smallest_names(df, 3, "call").collect()}
    assert got == {1: "a, b, c", 2: "z"}


def test_shared_root_follows_the_session(spark):
    assert spark.sparkContext.applicationId in shared_root(spark)


def test_severity_histogram_shows_all_levels(spark):
    found = spark.createDataFrame([("high",)], "severity string")
    assert {r.severity: r.findings for r in rollup.severity_histogram(found).collect()} == {
        "critical": 0, "high": 1, "medium": 0, "low": 0, "info": 0}


def test_versions_around_a_run_without_hash(spark):
    rows = [(1, k, h) for k, h in enumerate(["h1", None, None, "h2", "h2", "h1"])] + [(2, 0, None), (2, 9, "x")]
    runs = spark.createDataFrame(rows, "object_key int, run_at int, definition_hash string")
    for width in (1, 2, 100):
        got = maintain.version_history(runs, F.floor(F.col("run_at") / width))
        assert sorted((r.object_key, r.version_number, r.detected_at, r.definition_hash) for r in got.collect()) == [
            (1, 1, 0, "h1"), (1, 2, 1, None), (1, 3, 3, "h2"), (1, 4, 5, "h1"), (2, 1, 0, None), (2, 2, 9, "x")]


def test_tables_of_two_connections_share_a_name(spark):
    cols = spark.createDataFrame([(c, "s", "t", "r", f"c{c}{k}", "int", k, True, None, None, None, None) for c in (1, 2) for k in (1, 2)],
        "connection_id int, schema_name string, table_name string, table_type string, column_name string, data_type string, ordinal int,"
        "is_nullable boolean, default_value string, max_length int, precision int, scale int")
    pk = spark.createDataFrame([(1, "s", "t", "c11", 1)], "connection_id int, schema_name string, table_name string, column_name string, ordinal int")
    fk = spark.createDataFrame([], "connection_id int, schema_name string, table_name string, constraint_name string, column_name string, ref_schema string,"
        "ref_table string, ref_column string, ordinal int, on_delete string, on_update string")
    ix = spark.createDataFrame([], "connection_id int, schema_name string, table_name string, index_name string, column_name string, ordinal int,"
        "is_unique boolean, is_primary boolean, index_type string")
    sizes = rollup.table_sizes(spark.createDataFrame([(1, "s", "t", 5, 1), (2, "s", "t", 7, 1), (2, "s", "t", 1, 1)],
        "connection_id int, schema_name string, table_name string, row_count long, pages long"))
    got = {r.connection_id: r for r in metadata.nest_tables(cols, pk, fk, ix, sizes).collect()}
    assert {c: [x.column_name for x in r.columns] for c, r in got.items()} == {1: ["c11", "c12"], 2: ["c21", "c22"]}
    assert (got[1].primary_key, got[2].primary_key, got[1].estimated_rows, got[2].estimated_rows) == (["c11"], [], 5, 8)
