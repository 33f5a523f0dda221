"""Table metadata: flat catalog rows nested into one row per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_scope(rows: DataFrame) -> list[str]:
    """The connection, where rows carry it."""
    return [c for c in ("connection_id",) if c in rows.columns]


def nest_tables(columns: DataFrame, keys: DataFrame, foreign: DataFrame, indexes: DataFrame, counts: DataFrame,
                primary_by_columns: bool = False) -> DataFrame:
    """One row per table with ordered arrays.

    A table's lists are bounded by the column limit of the database it came from (a table, not a
    data set, is one group here).  With ``primary_by_columns`` an index is primary when its columns
    are exactly the primary-key columns.  Where ``columns`` has a connection_id, all inputs must, and tables of
    different connections stay apart though they share a name.
    """
    k = [*table_scope(columns), "schema_name", "table_name"]

    def ordered(order: str, value: str):
        return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])

    fields = ["ordinal", "column_name", "data_type", "is_nullable", "default_value", "max_length", "precision", "scale"]
    cols = columns.groupBy(*k, "table_type").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("columns"))
    pk = keys.groupBy(*k).agg(ordered("ordinal", "column_name").alias("primary_key"))
    fk = (
        foreign.groupBy(*k, "constraint_name", "ref_schema", "ref_table", "on_delete", "on_update")
        .agg(ordered("ordinal", "column_name").alias("columns"), ordered("ordinal", "ref_column").alias("referenced_columns"))
        .groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(
            "constraint_name", "columns", F.col("ref_schema").alias("referenced_schema"),
            F.concat_ws(".", "ref_schema", "ref_table").alias("referenced_table"), "referenced_columns",
            "on_delete", "on_update"))).alias("foreign_keys")))
    ix = (
        indexes.groupBy(*k, "index_name", "is_unique", "is_primary", "index_type")
        .agg(ordered("ordinal", "column_name").alias("columns"))
        .groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(
            "index_name", "columns", "is_unique", "is_primary", "index_type"))).alias("indexes")))
    out = cols.join(pk, k, "left").join(fk, k, "left").join(ix, k, "left").join(
        counts.select(*k, F.col("row_count").alias("estimated_rows")), k, "left")
    none = lambda c, like: F.coalesce(F.col(c), F.slice(like, 1, 0))
    names = F.transform("columns", lambda c: c["column_name"])
    out = out.withColumn("primary_key", none("primary_key", names))
    out = out.withColumn("_fk", F.flatten(F.transform(
        F.coalesce("foreign_keys", F.array()), lambda f: f["columns"])))
    flagged = F.transform("columns", lambda c: c.withField(
        "is_primary_key", F.array_contains("primary_key", c["column_name"])).withField(
        "is_foreign_key", F.coalesce(F.array_contains("_fk", c["column_name"]), F.lit(False))))
    out = out.withColumn("columns", flagged).drop("_fk")
    if primary_by_columns:
        same = lambda i: (F.size(i["columns"]) == F.size("primary_key")) & F.forall(
            i["columns"], lambda c: F.array_contains("primary_key", c))
        out = out.withColumn("indexes", F.transform("indexes", lambda i: i.withField("is_primary", i["is_primary"] | same(i))))
    return out.withColumn("fqn", F.concat_ws(".", "schema_name", "table_name"))


def unnest_columns(tables: DataFrame) -> DataFrame:
    """Column rows of nested tables, with key flags."""
    k = [*table_scope(tables), "schema_name", "table_name"]
    return tables.select(*k, F.explode("columns").alias("c")).select(*k, "c.*")
