"""Listings, searches and pages over catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procatlas.functions import scalars

OBJECT_SORTS = {"objectName": "object_name", "schemaName": "schema_name", "objectType": "object_type",
                "lineCount": "lines", "estimatedComplexity": "cyclomatic"}


def filter_objects(objects: DataFrame, connection_id=None, schema=None, object_type=None, search=None,
                   has_findings: bool | None = None, findings: DataFrame | None = None) -> DataFrame:
    out = objects
    for column, value in (("connection_id", connection_id), ("schema_name", schema), ("object_type", object_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if search:
        out = out.where(scalars.contains_ci(F.col("object_name"), search) | scalars.contains_ci(F.col("fqn"), search))
    if has_findings:
        out = out.join(findings.select("object_id").distinct(), "object_id", "left_semi")
    return out


def page(df: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    """One page under a total order; planned as a top-k, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def list_objects(objects: DataFrame, sort: str = "objectName", descending: bool = False, number: int = 1,
                 size: int = 50, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, totals); an unknown sort key falls back to the name."""
    kept = filter_objects(objects, **filters)
    key = F.col(OBJECT_SORTS.get(sort, "object_name"))
    return (page(kept, [key.desc() if descending else key.asc(), F.col("object_id")], number, size),
            page_totals(kept, size))


def list_tables(tables: DataFrame, connection_id=None, schema=None, table_type=None, search=None,
                min_references: int | None = None) -> DataFrame:
    out = tables
    for column, value in (("connection_id", connection_id), ("schema_name", schema), ("table_type", table_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if search:
        out = out.where(scalars.contains_ci(F.col("table_name"), search))
    if min_references is not None:
        out = out.where(F.col("referenced_by") >= min_references)
    return out.orderBy("schema_name", "table_name", "connection_id")


def audit_page(audit: DataFrame, action=None, user_id=None, number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    kept = audit
    if action is not None:
        kept = kept.where(F.col("action") == action)
    if user_id is not None:
        kept = kept.where(F.col("user_id") == user_id)
    return page(kept, [F.col("created_at").desc(), F.col("event_id").desc()], number, size), page_totals(kept, size)


def search_everything(objects: DataFrame, tables: DataFrame, term: str, n_objects: int = 8, n_tables: int = 5) -> DataFrame:
    """A few objects and tables whose name contains the term; shorter terms than two letters find nothing."""
    if len(term) < 2:
        objects, tables = objects.where(F.lit(False)), tables.where(F.lit(False))
    found = objects.where(scalars.contains_ci(F.col("object_name"), term)).select(
        F.lit("object").alias("kind"), "connection_id", F.col("object_name").alias("name"), "fqn")
    held = tables.where(scalars.contains_ci(F.col("table_name"), term)).select(
        F.lit("table").alias("kind"), "connection_id", F.col("table_name").alias("name"), "fqn")
    order = ["name", "fqn", "connection_id"]
    return found.orderBy(*order).limit(n_objects).unionByName(held.orderBy(*order).limit(n_tables))


def quick_find(tables: DataFrame, term: str, n: int = 8) -> DataFrame:
    if len(term) < 2:
        tables = tables.where(F.lit(False))
    hit = scalars.contains_ci(F.col("table_name"), term) | scalars.contains_ci(F.col("schema_name"), term)
    return tables.where(hit).orderBy("fqn", "connection_id").limit(n)


def finding_feed(findings: DataFrame, objects: DataFrame, connection_id=None, severity=None, text=None) -> DataFrame:
    """Findings with their object, worst severity first."""
    names = objects.select("object_id", "connection_id", "object_name", "schema_name")
    out = findings.join(names, "object_id")
    if connection_id is not None:
        out = out.where(F.col("connection_id") == connection_id)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    if text:
        out = out.where(scalars.contains_ci(F.col("object_name"), text) | scalars.contains_ci(F.col("message"), text))
    return out.withColumn("severity_rank", scalars.severity_rank(F.col("severity"))).orderBy(
        "severity_rank", "object_id", "rule_id", "line")


def top_complex(objects: DataFrame, complexity: DataFrame, n: int = 10) -> DataFrame:
    best = complexity.orderBy(F.col("cyclomatic").desc(), "object_id").limit(n)
    return best.join(objects.select("object_id", "fqn"), "object_id")


def by_fingerprint(texts: DataFrame, objects: DataFrame, lengths: tuple[int, ...] = (80, 40)) -> DataFrame:
    """Object of each text (text_id, object_id, matched_by): the one with the same normalised text, else the one that shares
    the longest beginning of the given ``lengths``; the lowest id wins.

    ``matched_by`` is exact, prefix-N or none.  Whole texts meet by their hash, so they are not shuffled.
    """
    def keys(text: str) -> list[Column]:
        whole = scalars.normalised(F.col(text))
        return [F.sha2(whole, 256).alias("whole"), *(F.substring(whole, 1, n).alias(f"first_{n}") for n in lengths)]

    steps = [("whole", "exact"), *((f"first_{n}", f"prefix-{n}") for n in lengths)]
    prints = objects.select("object_id", *keys("definition"))
    asked = texts.select("text_id", *keys("text"))
    # A text that many rows share is looked up once; all lookup sides hold one row per key.
    found = asked.drop("text_id").distinct()
    for key, _ in steps:
        found = found.join(prints.groupBy(key).agg(F.min("object_id").alias(f"by_{key}")), key, "left")
    matched = F.lit("none")
    for key, label in reversed(steps):
        matched = F.when(F.col(f"by_{key}").isNotNull(), label).otherwise(matched)
    found = found.select("whole", F.coalesce(*(f"by_{key}" for key, _ in steps)).alias("object_id"), matched.alias("matched_by"))
    return asked.select("text_id", "whole").join(found, "whole").select("text_id", "object_id", "matched_by")


def recent_jobs(jobs: DataFrame, connections: DataFrame, per_connection: int = 3, overall: int = 5) -> DataFrame:
    """Newest jobs of each connection, then the newest of these; the rank limit is pushed below the shuffle."""
    newest = Window.partitionBy("connection_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    ranked = jobs.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= per_connection)
    top = ranked.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(overall)
    return top.drop("rn").join(connections.select("connection_id", "name", "engine"), "connection_id")


def running_jobs(jobs: DataFrame) -> DataFrame:
    """Newest running job per connection."""
    newest = F.max_by(F.struct("job_id", "status", "created_at"), F.struct("created_at", "job_id")).alias("j")
    return jobs.where(scalars.is_running(F.col("status"))).groupBy("connection_id").agg(newest).select(
        "connection_id", "j.*")


def connection_listing(connections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Connections with their number of jobs and the day of the newest, newest first."""
    ran = jobs.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("newest_job"))
    return connections.join(ran, "connection_id", "left").orderBy(F.col("newest_job").desc(), "connection_id")


def schema_listing(objects: DataFrame) -> DataFrame:
    """Schemas of each connection with their number of objects."""
    return objects.groupBy("connection_id", "schema_name").agg(F.count(F.lit(1)).alias("objects")).orderBy(
        "connection_id", "schema_name")
