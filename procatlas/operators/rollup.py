"""Aggregations over fact tables.  All are plain aggregates with partial results on the map side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv
from procatlas.functions import scalars
from procatlas.operators.metadata import table_scope

EDGE_BUCKETS = {"calls": "exec", "reads_from": "reads", "writes_to": "writes"}


def _count(label: str):
    return F.count(F.lit(1)).alias(label)


def side_by_side(*summaries: DataFrame) -> DataFrame:
    """Several one-row summaries as one row: stacked, then folded by an aggregate."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def crud_matrix(accesses: DataFrame, objects: DataFrame) -> DataFrame:
    """Sorted distinct operations per object and table (at most one of each operation)."""
    cells = accesses.groupBy("object_id", "full_table_name").agg(
        F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))
    return cells.join(objects.select("object_id", "object_name", "schema_name"), "object_id")


def dependency_matrix(nodes: DataFrame, edges: DataFrame, search: str | None = None) -> DataFrame:
    """Distinct (object, bucket, target label) cells: exec, reads, writes or refs.

    Cells stay rows, so an object with very many targets is spread over tasks like any other key.
    """
    bucket = F.lit("refs")
    for kind, label in EDGE_BUCKETS.items():
        bucket = F.when(F.col("dep_type") == kind, label).otherwise(bucket)
    source = nodes.select(F.col("id").alias("source"), F.col("label").alias("object_name"), "schema_name")
    if search:
        source = source.where(scalars.contains_ci(F.col("object_name"), search))
    cells = edges.select("source", "target_label", bucket.alias("bucket")).distinct()
    return cells.join(source, "source").select("source", "object_name", "schema_name", "bucket", "target_label")


def dependency_matrix_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("source", "object_name", "schema_name").agg(*[
        F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("exec", "reads", "writes", "refs")])


def impact_ranking(edges: DataFrame) -> DataFrame:
    """Targets by incoming edges, most first."""
    return edges.groupBy("target").agg(
        F.min("target_label").alias("label"), _count("incoming")).orderBy(F.col("incoming").desc(), "target")


def impact_statistics(edges: DataFrame) -> DataFrame:
    """Incoming edges per target in total and by type."""
    kinds = [F.count_if(F.col("dep_type") == k).alias(f"n_{label}")
             for k, label in (("calls", "exec"), ("reads_from", "read"), ("writes_to", "write"))]
    return edges.groupBy("target").agg(_count("total"), *kinds)


def impact_detail(edges: DataFrame, targets: DataFrame, dep_type: str | None = None) -> DataFrame:
    """Incoming and outgoing edges of the targets, confidence as a whole percentage."""
    kept = edges if dep_type is None else edges.where(F.col("dep_type") == dep_type)
    ids = targets.select(F.col("target").alias("id"))
    incoming = kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").withColumn("direction", F.lit("in"))
    outgoing = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").withColumn("direction", F.lit("out"))
    return incoming.unionByName(outgoing).select(
        "edge_id", "source", "target", "dep_type", "direction",
        F.round(F.col("confidence") * 100).cast("int").alias("percent"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    """All five severities, zero included."""
    spark = findings.sparkSession
    all_levels = spark.createDataFrame([(s,) for s in fv.SEVERITIES], "severity string")
    counted = findings.groupBy("severity").agg(_count("n"))
    return all_levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def risk_distribution(objects: DataFrame, complexity: DataFrame) -> DataFrame:
    """Objects per risk level; a missing measure counts as low."""
    level = scalars.risk_level(F.col("cyclomatic"), "low").alias("risk")
    return objects.select("object_id").join(complexity.select("object_id", "cyclomatic"), "object_id", "left").groupBy(
        level).agg(_count("objects"))


def dashboard(connections: DataFrame, objects: DataFrame, findings: DataFrame) -> DataFrame:
    return side_by_side(connections.agg(_count("connections")), objects.agg(_count("objects")),
                        findings.agg(_count("findings")))


def kind_counts(objects: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Objects per key and kind, kinds as columns."""
    return objects.groupBy(*keys).agg(*[
        F.count_if(F.col("object_type") == k).alias(f"{k}s") for k in kinds])


def schema_inventory(objects: DataFrame, tables: DataFrame, indexes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Procedures, functions, triggers, views, tables, sequences and indexes per connection and schema, with the total of the
    first five; ``sequences`` has a row (connection_id, schema_name) for each."""
    key = ["connection_id", "schema_name"]
    found = indexes.select(*key, "table_name", "index_name").distinct()
    held = [df.select(*key, F.lit(kind).alias("object_type")) for df, kind in ((tables, "table"), (found, "indexe"), (sequences, "sequence"))]
    kinds = ["procedure", "function", "trigger", "view", "table", "sequence", "indexe"]
    counted = kind_counts(reduce(DataFrame.unionByName, [objects.select(*key, "object_type"), *held]), key, kinds)
    total = reduce(lambda a, b: a + b, [F.col(f"{k}s") for k in kinds[:5]])
    return counted.withColumn("total", total)


def schema_tree(objects: DataFrame, tables: DataFrame, by: str = "name") -> DataFrame:
    """Objects, tables and both together per connection and schema, in order of name, or of total with the largest first."""
    key = ["connection_id", "schema_name"]
    a = objects.groupBy(*key).agg(_count("objects"))
    b = tables.groupBy(*key).agg(_count("tables"))
    zero = F.lit(0)
    counted = a.join(b, key, "full").select(
        *key, F.coalesce("objects", zero).alias("objects"), F.coalesce("tables", zero).alias("tables"),
        (F.coalesce("objects", zero) + F.coalesce("tables", zero)).alias("total"))
    return counted.orderBy(*key) if by == "name" else counted.orderBy(F.col("total").desc(), *key)


def batch_summary(admitted: DataFrame) -> DataFrame:
    return admitted.agg(
        F.count_if("accepted").alias("processed"), F.count_if(~F.col("accepted")).alias("errors"),
        F.every("accepted").alias("success"))


def text_summary(objects: DataFrame, dependencies: DataFrame, findings: DataFrame) -> DataFrame:
    """Per text: dependencies, findings, and whether any finding is critical."""
    deps = dependencies.groupBy("object_id").agg(_count("d"))
    found = findings.groupBy("object_id").agg(_count("f"), F.bool_or(F.col("severity") == "critical").alias("c"))
    return objects.select("object_id").join(deps, "object_id", "left").join(found, "object_id", "left").select(
        "object_id", F.coalesce("d", F.lit(0)).alias("dependencies"), F.coalesce("f", F.lit(0)).alias("findings"),
        F.coalesce("c", F.lit(False)).alias("has_critical"))


def variable_summary(references: DataFrame) -> DataFrame:
    """Per (object, variable): category by the first reference, references, last known type."""
    at = F.struct("line", "reference_type")
    first = F.min_by("reference_type", at)
    category = (
        F.when(first.isin("parameter_in", "parameter_out"), "parameters")
        .when(F.col("variable_name").startswith("#"), "tempTables").otherwise("localVariables"))
    known = F.max_by(F.col("data_type"), F.when(F.col("data_type").isNotNull(), at))
    return references.groupBy("object_id", "variable_name").agg(
        category.alias("category"), _count("n_references"), known.alias("data_type"))


def variable_trace(references: DataFrame, variable: str) -> DataFrame:
    return references.where(F.col("variable_name") == variable).orderBy("object_id", "line", "reference_type")


def referenced_by(accesses: DataFrame, heavy: int = 10) -> DataFrame:
    """Distinct objects per table; more than ``heavy`` is heavily referenced."""
    pairs = accesses.select("connection_id", "full_table_name", "object_id").distinct()
    return pairs.groupBy("connection_id", "full_table_name").agg(_count("objects")).withColumn(
        "heavily_referenced", F.col("objects") > heavy)


def analysis_summary(objects: DataFrame, dependencies: DataFrame, findings: DataFrame, jobs: DataFrame, complexity: DataFrame,
                     top: int = 5) -> DataFrame:
    """Counts, severe findings, the ``top`` most complex objects (fqn:cyclomatic, ties by name and id) and the seconds from the first start
    to the last end of the runs, with whole days beside them, as one row."""
    kinds = objects.agg(_count("objects"), *[
        F.count_if(F.col("object_type") == k).alias(f"{k}s") for k in ("procedure", "function", "trigger", "view", "package")])
    found = findings.agg(_count("findings"), *[
        F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITIES])
    first, last = F.min("started_at"), F.max("completed_at")
    span = jobs.agg(F.date_diff(last, first).alias("days"), F.timestamp_diff("SECOND", first.cast("timestamp"), last.cast("timestamp")).alias("seconds"))
    ranked = (complexity.join(objects.select("object_id", "fqn"), "object_id").orderBy(F.col("cyclomatic").desc(), "fqn", "object_id").limit(top)
              .agg(F.array_sort(F.collect_list(F.struct((-F.col("cyclomatic")).alias("c"), "fqn", "object_id"))).alias("t")))
    most = ranked.select(F.array_join(F.transform("t", lambda o: F.concat(o["fqn"], F.lit(":"), (-o["c"]).cast("string"))), ", ").alias("top_complex"))
    return side_by_side(kinds, dependencies.agg(_count("dependencies")), found, span, most)


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("inward")),
        F.struct(F.col("target").alias("id"), F.lit(1).alias("inward")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(_count("degree"), F.sum("inward").alias("in_degree"))


def findings_per_object(objects: DataFrame, findings: DataFrame) -> DataFrame:
    counted = findings.groupBy("object_id").agg(_count("n"))
    return objects.select("object_id").join(counted, "object_id", "left").select(
        "object_id", F.coalesce("n", F.lit(0)).alias("findings"))


def objects_with_issues(findings: DataFrame) -> DataFrame:
    return findings.groupBy("object_id").agg(F.bool_or(scalars.is_severe(F.col("severity"))).alias("has_issues"))


def table_sizes(partitions: DataFrame) -> DataFrame:
    """Rows and bytes per table over its partitions; per connection, where the rows carry it."""
    return partitions.groupBy(*table_scope(partitions), "schema_name", "table_name").agg(
        F.sum("row_count").alias("row_count"), (F.sum("pages") * fv.PAGE_BYTES).alias("bytes"))
