"""Joins between facts, objects and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SALTS = 64


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str, spread_by: str) -> DataFrame:
    """Join many rows per key with a small lookup of distinct keys (connections, say).

    Every lookup row is repeated once per salt and every row takes a salt from ``spread_by``, so a key
    that holds a large part of the rows is shared by many tasks whatever join is chosen.
    """
    salted = lookup.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.hash(spread_by), F.lit(SALTS))).join(salted, [key, "_salt"], how).drop("_salt")


def _ranked_keys(name: Column) -> Column:
    """Lookup keys of a target name in priority order."""
    last = F.substring_index(name, ".", -1)
    return F.array(name, F.lower(name), last, F.lower(last))


def object_keys(objects: DataFrame) -> DataFrame:
    """(connection_id, key) -> object_id.  Of several objects under one key the last one seen wins."""
    keys = F.array_distinct(F.array(
        F.col("fqn"), F.lower("fqn"), F.col("object_name"), F.lower("object_name")))
    return (
        objects.select("connection_id", "object_id", "seen_at", F.explode(keys).alias("key"))
        .groupBy("connection_id", "key")
        .agg(F.max_by("object_id", F.struct("seen_at", "object_id")).alias("target_id")))


def resolve_names(names: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct (connection_id, target_name) with the object found under the best key."""
    candidates = names.select("connection_id", "target_name").distinct().select(
        "connection_id", "target_name", F.posexplode(_ranked_keys(F.col("target_name"))).alias("rank", "key"))
    return (
        candidates.join(object_keys(objects), ["connection_id", "key"])
        .groupBy("connection_id", "target_name")
        .agg(F.min_by("target_id", "rank").alias("target_id")))


def resolve_targets(facts: DataFrame, objects: DataFrame) -> DataFrame:
    """Facts plus ``target_id`` (null when no object of the connection has the name).

    Names are made distinct before the lookup, so a name that half the corpus calls costs one
    lookup; the join back keeps every fact and lets adaptive execution split such a name.
    """
    return facts.join(resolve_names(facts, objects), ["connection_id", "target_name"], "left")


def of_connection(facts: DataFrame, objects: DataFrame, connection_id) -> DataFrame:
    """Facts whose source object belongs to the connection."""
    wanted = objects.where(F.col("connection_id") == connection_id).select("object_id")
    return facts.join(wanted, "object_id", "left_semi")


def by_source(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "object_id", "left_semi")


def by_target(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.withColumnRenamed("object_id", "target_id"), "target_id", "left_semi")


def _described(objects: DataFrame, complexity: DataFrame, side: str) -> DataFrame:
    return objects.join(complexity, "object_id").select(
        F.col("object_id").alias(f"{side}_id"), F.col("object_name").alias(f"{side}_object_name"),
        F.col("schema_name").alias(f"{side}_schema"), F.col("object_type").alias(f"{side}_type"),
        F.col("cyclomatic").alias(f"{side}_complexity"))


def enrich_edges(dependencies: DataFrame, objects: DataFrame, complexity: DataFrame) -> DataFrame:
    """Dependencies with source and, where resolved, target descriptions."""
    return (
        dependencies.withColumnRenamed("object_id", "source_id")
        .join(_described(objects, complexity, "source"), "source_id")
        .join(_described(objects, complexity, "target"), "target_id", "left"))


def enrich_accesses(accesses: DataFrame, objects: DataFrame) -> DataFrame:
    return accesses.drop("connection_id").join(
        objects.select("object_id", "connection_id", "schema_name", "object_name"), "object_id")


def accessed_by(tables: DataFrame, accesses: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects and operations per table, joined by full name within the connection."""
    named = accesses.join(objects.select("object_id", "object_name", "schema_name", "object_type"), "object_id")
    wanted = tables.select("connection_id", F.col("fqn").alias("full_table_name"))
    return named.join(wanted, ["connection_id", "full_table_name"]).select(
        "connection_id", "full_table_name", "object_id", "object_name", "schema_name", "object_type", "operation")


def tables_of_objects(tables: DataFrame, accesses: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Table rows touched by the given objects (all when ``ids`` is None)."""
    touched = accesses if ids is None else accesses.join(ids, "object_id", "left_semi")
    keys = touched.select("connection_id", F.col("full_table_name").alias("fqn"))
    return tables.join(keys, ["connection_id", "fqn"], "left_semi")


def relationships(tables: DataFrame) -> DataFrame:
    """Foreign keys whose referenced table is known: exact name first, then ignoring case."""
    keys = tables.select(
        "connection_id", F.col("fqn").alias("target_fqn"),
        F.explode(F.array_distinct(F.array(F.col("fqn"), F.lower("fqn")))).alias("key"))
    owner = keys.groupBy("connection_id", "key").agg(F.max("target_fqn").alias("target_fqn"))
    wanted = tables.select(
        "connection_id", F.col("fqn").alias("source_fqn"), F.explode("foreign_keys").alias("fk"))
    names = wanted.select("connection_id", F.col("fk.referenced_table").alias("referenced_table")).distinct().select(
        "connection_id", "referenced_table",
        F.posexplode(F.array(F.col("referenced_table"), F.lower("referenced_table"))).alias("rank", "key"))
    found = names.join(owner, ["connection_id", "key"]).groupBy("connection_id", "referenced_table").agg(
        F.min_by("target_fqn", "rank").alias("target_fqn"))
    return wanted.select("connection_id", "source_fqn", "fk.*").join(
        found, ["connection_id", "referenced_table"]).select(
        "connection_id", "source_fqn", "constraint_name", "columns", "target_fqn", "referenced_columns",
        "on_delete", "on_update")


def relationships_of_tables(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links that start or end at one of the tables (connection_id, fqn), with that table."""
    ends = F.explode(F.array_distinct(F.array("source_fqn", "target_fqn")))
    return links.withColumn("fqn", ends).join(tables, ["connection_id", "fqn"], "left_semi")


def reconcile(native: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Dependencies the database itself keeps against extracted ones."""
    a = native.select(*keys).distinct().withColumn("_n", F.lit(True))
    b = extracted.select(*keys).distinct().withColumn("_e", F.lit(True))
    status = (
        F.when(F.col("_n").isNotNull() & F.col("_e").isNotNull(), "both")
        .when(F.col("_n").isNotNull(), "only_native").otherwise("only_extracted"))
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def stale_objects(catalog: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Live catalog rows of the connections in ``seen`` that this run did not see."""
    run = seen.select("connection_id").distinct()
    live = spread_join(catalog.where(~F.col("is_deleted")), run, "connection_id", "left_semi", keys[-1])
    return live.join(seen.select(*keys), keys, "left_anti")


def drill_down(dependencies: DataFrame, accesses: DataFrame, complexity: DataFrame, objects: DataFrame) -> DataFrame:
    """Each resolved call with what the callee itself calls and touches."""
    calls = dependencies.where(F.col("dep_type") == "calls").groupBy("object_id").agg(
        F.count(F.lit(1)).alias("callee_calls"))
    tables = accesses.select("object_id", "full_table_name").distinct().groupBy("object_id").agg(
        F.count(F.lit(1)).alias("callee_tables"))
    callee = (
        objects.select("object_id", F.col("fqn").alias("callee_fqn"))
        .join(complexity.select("object_id", F.col("cyclomatic").alias("callee_complexity")), "object_id", "left")
        .join(calls, "object_id", "left").join(tables, "object_id", "left")
        .select(F.col("object_id").alias("target_id"), "callee_fqn", "callee_complexity",
                F.coalesce("callee_calls", F.lit(0)).alias("callee_calls"),
                F.coalesce("callee_tables", F.lit(0)).alias("callee_tables")))
    resolved = dependencies.where((F.col("dep_type") == "calls") & F.col("target_id").isNotNull())
    return resolved.select("object_id", "target_name", "line", "target_id").join(callee, "target_id")


def direct_lineage(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Incoming edges, outgoing calls and outgoing table edges of the nodes given, each distinct."""
    triple = edges.select("source", "target", "dep_type").distinct()
    incoming = triple.join(node.select(F.col("id").alias("target")), "target", "left_semi").withColumn(
        "direction", F.lit("upstream"))
    outgoing = triple.join(node.select(F.col("id").alias("source")), "source", "left_semi").withColumn(
        "direction", F.when(F.col("dep_type") == "calls", "downstream").otherwise("tables"))
    return incoming.unionByName(outgoing)
