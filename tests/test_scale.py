"""How often texts and facts are read, and in what form; rows are checked elsewhere."""

import random
from datetime import datetime

import pytest
from procatlas.operators import extract, graph, resolve
from procatlas.plans.analysis import Analysis
from procatlas.sources.scripts import objects_of_scripts
from procatlas.streaming import jobs as streams
from pyspark.sql import functions as F

OBJECTS = ("object_id long, connection_id int, dialect string, schema_name string, object_name string, fqn string, object_type string, "
           "definition string, seen_at string")


def corpus(spark):
    return spark.createDataFrame([
        (1, 0, "tsql", "s", "a", "s.a", "procedure", "CREATE PROC s.a AS\nEXEC s.b;\nEXEC(@x);\nDELETE FROM t WHERE k = 1;", "2024"),
        (2, 0, "tsql", "s", "b", "s.b", "procedure", "CREATE PROC s.b AS\nSELECT c INTO #w FROM t;", "2024")], OBJECTS)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_accesses_take_no_interpreted_fold(spark):
    shown = plan(extract.table_accesses(corpus(spark)))
    assert "MapInArrow" in shown and "aggregate(" not in shown


def test_parameters_and_scripts_take_no_interpreted_fold(spark):
    texts = corpus(spark)
    for found in (extract.parameters(texts), objects_of_scripts(texts.select(F.col("fqn").alias("path"), "dialect", F.col("definition").alias("sql")))):
        shown = plan(found)
        assert "MapInArrow" in shown and "aggregate(" not in shown and found.count() >= 0


def test_edges_ask_for_no_measures(spark):
    run = Analysis(spark, corpus(spark))
    got = {(r.source, r.target, r.dep_type) for r in run.edges.collect()}
    assert {("obj_1", "obj_2", "calls"), ("obj_1", "tbl_0_t", "writes_to"), ("obj_2", "tbl_0_t", "reads_from")} <= got
    assert not {"complexity", "findings", "nodes"} & set(run._stored)
    assert run.nodes.where("id = 'obj_1' AND complexity IS NOT NULL").count() == 1 and run.findings.count() >= 0


def test_texts_are_searched_once_for_calls(spark, monkeypatch):
    seen, real = [], resolve.resolve_targets
    monkeypatch.setattr(resolve, "resolve_targets", lambda facts, objects: seen.append(plan(facts)) or real(facts, objects))
    run = Analysis(spark, corpus(spark))
    assert run.dependencies.where(F.col("target_id") == 2).count() == 1
    assert len(seen) == 1 and "definition" not in seen[0]


def test_names_that_share_a_group_keep_apart(spark, tmp_path, monkeypatch):
    """A thousand names in two groups of state: each name has its own changes, late rows and time to be forgotten."""
    schema = "connection_id int, fqn string, definition_hash string, seen_at timestamp"
    at = lambda k: datetime(2024, 1, k)
    names = [(c, n) for c in (None, 1) for n in (None, *(f"n{k}" for k in range(500)))]
    batches = [[(*n, "A", at(3)) for n in names], [(*n, "B" if i % 2 else "A", at(4)) for i, n in enumerate(names)],
               [(*names[0], "C", at(1)), (*names[1], "A", at(9))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    monkeypatch.setattr(streams, "NAME_GROUPS", 2)

    def run(label, **options):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        progress = streams.run_to_end(streams.changed_definitions(source, **options), str(tmp_path / label), str(tmp_path / f"{label}-log"))
        got = spark.read.parquet(str(tmp_path / label))
        return progress, sorted((str(r.connection_id), str(r.fqn), r.definition_hash, r.seen_at.day, r.kind) for r in got.collect())

    text = lambda n, *rest: (str(n[0]), str(n[1]), *rest)
    changed = [text(n, "A", 3, "changed") for n in names] + [text(n, "B", 4, "changed") for n in names[1::2]]
    progress, got = run("kept")
    assert got == sorted(changed + [text(names[0], "C", 1, "late"), text(names[1], "A", 9, "changed")])
    assert [p["state"] for p in progress] == [2, 2, 2]
    progress, got = run("forgotten", forget_ms=3_600_000)
    assert got == sorted(changed + [text(names[0], "C", 1, "late"), text(names[1], "A", 9, "changed")])


@pytest.mark.parametrize("seed", range(4))
def test_depth_does_not_walk_to_leaves(spark, seed, monkeypatch):
    """Against a plain search; a leaf may be behind the last level, or nearer by another way."""
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(16)}
    pairs |= {(f"n{rnd.randrange(14)}", f"leaf{rnd.randrange(5)}") for _ in range(9)} | {("top", "n1"), ("alone", "leaf0")}
    ids, sources, targets = {n for p in pairs for n in p}, {a for a, _ in pairs}, {b for _, b in pairs}
    want = 0
    for root in sources - targets:
        far, level = {root}, {root}
        for depth in range(len(ids)):
            want = max(want, depth)
            level = {b for a, b in pairs if a in level} - far
            far |= level
            if not level:
                break
    kept = []

    class Kept(graph.Levels):
        def __init__(self, *args):
            super().__init__(*args)
            kept.append(self)

    monkeypatch.setattr(graph, "Levels", Kept)
    nodes = spark.createDataFrame([(n,) for n in ids], "id string")
    edges = spark.createDataFrame(list(pairs), "source string, target string")
    assert graph.max_depth(nodes, edges).collect()[0].max_depth == want
    assert {r.id for r in kept[0].all().select("id").collect()} <= sources


def test_calls_are_found_in_one_scan(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "objects"))
    found = extract.dependencies(spark.read.parquet(str(tmp_path / "objects")))
    assert {(r.object_id, r.target_name, r.line, r.is_dynamic, r.snippet) for r in found.collect()} == {
        (1, "s.b", 2, False, None), (1, "<dynamic_sql>", 3, True, "EXEC(@x);\nDELETE FROM t WHERE k = 1;")}
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
