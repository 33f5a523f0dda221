"""Catalog upkeep: merge a snapshot into the catalog, versions, differences, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.operators.resolve import spread_join


def one_per_key(rows: DataFrame, keys: list[str], newest: list[str] | None = None) -> DataFrame:
    """One row per key: the largest by ``newest``, then by all other columns in order; null comes first.

    Grouped by the keys that a merge joins on, so the join after it finds its rows in place.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = [c for c in newest or [] if c in rest]
    largest = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return rows.groupBy(*keys).agg(largest).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number: what a merge folds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def merge_objects(catalog: DataFrame, snapshot: DataFrame, seen_at: Column, refreshed: list[str],
                  keys: list[str] | None = None) -> DataFrame:
    """Upsert and soft delete in one full outer join.

    Known keys take the snapshot's ``refreshed`` columns and keep ``first_seen``; new keys are added;
    keys of a connection in the snapshot that it lacks become deleted.  Connections without any row
    in the snapshot are left alone.  Rows that repeat a key are one (see ``one_per_key``); overloaded
    functions stay apart when ``keys`` holds their signature.
    """
    keys = keys or ["connection_id", "fqn"]
    catalog = one_per_key(catalog, keys, ["last_seen"])
    s = one_per_key(snapshot.select(*keys, *[c for c in refreshed if c not in keys]), keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in refreshed], F.lit(True).alias("_seen"))
    ran = snapshot.select("connection_id").distinct().withColumn("_ran", F.lit(True))
    merged = spread_join(catalog.join(s, keys, "full"), ran, "connection_id", "left", keys[-1])
    seen = F.col("_seen").isNotNull()
    return merged.select(
        *keys,
        *[F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in refreshed],
        F.coalesce("first_seen", seen_at).alias("first_seen"),
        F.when(seen, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, False).when(F.col("_ran").isNotNull(), True).otherwise(F.col("is_deleted")).alias("is_deleted"))


def merge_schemas(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Schema upsert; a missing catalog name equals a missing catalog name."""
    c, s = catalog.alias("c"), snapshot.alias("s")
    same = (
        (F.col("c.connection_id") == F.col("s.connection_id")) & (F.col("c.schema_name") == F.col("s.schema_name"))
        & F.col("c.catalog_name").eqNullSafe(F.col("s.catalog_name")))
    either = lambda name: F.coalesce(F.col(f"c.{name}"), F.col(f"s.{name}")).alias(name)
    return c.join(s, same, "full").select(
        either("connection_id"), either("schema_name"), either("catalog_name"),
        F.coalesce("s.object_count", "c.object_count").alias("object_count"),
        F.coalesce("c.first_seen", "s.first_seen").alias("first_seen"),
        F.when(F.col("s.schema_name").isNotNull(), F.col("s.first_seen")).otherwise(F.col("c.first_seen")).alias("last_seen"))


def merge_tables(catalog: DataFrame, snapshot: DataFrame, refreshed: list[str]) -> DataFrame:
    """Table upsert on (connection, fqn); tables the snapshot lacks stay as they are.  Rows that repeat a key are one."""
    keys = ["connection_id", "fqn"]
    catalog = one_per_key(catalog, keys)
    s = one_per_key(snapshot.select(*keys, *refreshed), keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in refreshed], F.lit(True).alias("_seen"))
    seen = F.col("_seen").isNotNull()
    return catalog.withColumn("_old", F.lit(True)).join(s, keys, "full").select(
        *keys, *[F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in refreshed],
        F.when(seen & F.col("_old").isNotNull(), "updated").when(seen, "inserted").otherwise("kept").alias("change"))


def drop_runs(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts without those of the given runs (job_id)."""
    return facts.join(runs.select("job_id"), "job_id", "left_anti")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """added / removed / changed / unchanged by definition hash; rows that repeat a key are one."""
    a = one_per_key(before.select(*keys, F.coalesce("definition_hash", F.lit("")).alias("old_hash")), keys)
    b = one_per_key(after.select(*keys, F.coalesce("definition_hash", F.lit("")).alias("new_hash")), keys)
    state = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed"))
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def version_history(runs: DataFrame, slice_of: Column, order: str = "run_at") -> DataFrame:
    """Versions of each object over runs: a new one whenever the hash differs from the run before.

    A run without a hash is a version of its own: it differs from every hash and equals another run without one.
    ``runs`` holds (object_key, run_at, definition_hash); ``slice_of`` cuts time into slices that do
    not decrease with it.  Changes are found inside a slice, and a second, small window over slice
    edges finds changes between slices and numbers the versions, so an object with very many runs is
    worked on by many tasks.
    """
    r = runs.withColumn("_slice", slice_of)
    w = Window.partitionBy("object_key", "_slice").orderBy(order)
    marked = r.withColumn("_before", F.lag("definition_hash").over(w)).withColumn("_n", F.row_number().over(w))
    kept = marked.where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col("definition_hash")))
    edges = r.groupBy("object_key", "_slice").agg(
        F.min_by("definition_hash", order).alias("_first"), F.max_by("definition_hash", order).alias("_last"))
    inner = kept.where("_n > 1").groupBy("object_key", "_slice").agg(F.count(F.lit(1)).alias("_inner"))
    s = Window.partitionBy("object_key").orderBy("_slice")
    by_slice = edges.join(inner, ["object_key", "_slice"], "left").withColumn(
        "_opens", (F.row_number().over(s) == 1) | ~F.lag("_last").over(s).eqNullSafe(F.col("_first")))
    total = (F.coalesce("_inner", F.lit(0)) + F.col("_opens").cast("int")).alias("_t")
    offsets = by_slice.select("object_key", "_slice", "_opens", total).withColumn(
        "_offset", F.coalesce(F.sum("_t").over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = kept.join(offsets, ["object_key", "_slice"]).where((F.col("_n") > 1) | F.col("_opens"))
    place = F.row_number().over(Window.partitionBy("object_key", "_slice").orderBy(order))
    return wanted.select(
        "object_key", (F.col("_offset") + place).cast("int").alias("version_number"), "definition_hash",
        F.col(order).alias("detected_at"))
