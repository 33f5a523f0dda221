"""Catalog sources: definition, source-line, metadata and dependency scans, and file corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv
from procatlas.functions.matching import clean, strip


def jdbc_scan(spark: SparkSession, url: str, query: str, partition: dict | None = None, **options) -> DataFrame:
    """Catalog query over JDBC; ``partition`` holds partitionColumn, lowerBound, upperBound, numPartitions."""
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        reader = reader.option("dbtable", f"({query}) q").options(**partition)
    else:
        reader = reader.option("query", query)
    return reader.options(**options).load()


def visible_objects(rows: DataFrame, dialect: str | None = None, schemas: list[str] | None = None) -> DataFrame:
    """Definition scan: system schemas out, optional schema list, kind codes as labels, texts cleaned."""
    if dialect:
        system = F.col("schema_name").isin(fv.SYSTEM_SCHEMAS[dialect])
        if dialect == "plpgsql":
            system = system | F.col("schema_name").startswith("pg_")
    else:
        system = F.lit(False)
        for name, names in fv.SYSTEM_SCHEMAS.items():
            hidden = F.col("schema_name").isin(names)
            if name == "plpgsql":
                hidden = hidden | F.col("schema_name").startswith("pg_")
            system = system | ((F.col("dialect") == name) & hidden)
    out = rows.where(~system)
    if schemas:
        out = out.where(F.col("schema_name").isin(schemas))
    return out.withColumn("definition", clean(F.col("definition")))


def assemble_lines(rows: DataFrame, keys: list[str], order: list[str], text: str,
                   chunk: Column, separator: str = "") -> DataFrame:
    """Join ordered line rows to one text per key, in two steps.

    ``chunk`` must not decrease along ``order``.  Chunks are joined first, each in its own task, so
    an object with very many lines is spread out; the second step sees one row per chunk.  Rows are dealt by key before
    each step: few of a key meet in one task before that, so partial lists would be sorted and written for nothing.
    """
    def joined(pieces: DataFrame, by: list[str], sorted_by: list, value: str, name: str) -> DataFrame:
        lists = pieces.repartition(*by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*sorted_by, value))).alias("_p"))
        return lists.select(*by, F.array_join(F.col("_p").getField(value), separator).alias(name))

    chunks = joined(rows.withColumn("_chunk", chunk), [*keys, "_chunk"], order, text, "_t")
    return joined(chunks, keys, ["_chunk"], "_t", "text")


def reassemble_source(source_lines: DataFrame, lines_per_chunk: int = 2000) -> DataFrame:
    """(owner, name, type, line, text) rows to one definition per object; type labels normalised."""
    kind = F.replace(F.lower("type"), F.lit(" body"), F.lit(""))
    typed = source_lines.select(
        F.col("owner").alias("schema_name"), F.col("name").alias("object_name"),
        kind.alias("object_type"), "line", clean(F.col("text")).alias("text"))
    return assemble_lines(
        typed, ["schema_name", "object_name", "object_type"], ["line"], "text",
        chunk=F.floor(F.col("line") / lines_per_chunk)).withColumnRenamed("text", "definition")


def canonical_dialect(name: Column) -> Column:
    """One of the three dialects, or null for an unknown name."""
    pairs = [F.lit(v) for kv in fv.DIALECT_ALIASES.items() for v in kv]
    return F.element_at(F.create_map(*pairs), F.lower(name))


def admit(texts: DataFrame, text: str = "sql", dialect: str = "dialect", max_length: int | None = fv.MAX_TEXT_LENGTH) -> DataFrame:
    """Admission check: adds ``canonical``, ``accepted`` and ``reason``; without ``max_length`` texts of any length go on."""
    canonical = canonical_dialect(F.col(dialect))
    reason = (
        F.when(strip(F.coalesce(F.col(text), F.lit(""))) == "", F.lit("blank text"))
        .when(F.lit(False) if max_length is None else F.length(text) > max_length, F.lit("text too long"))
        .when(canonical.isNull(), F.lit("unknown dialect"))
    )
    return texts.withColumn("canonical", canonical).withColumn("reason", reason).withColumn(
        "accepted", F.col("reason").isNull())


def read_sql_files(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """One row per file under ``path``, admission-checked."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), clean(F.col("value")).alias("sql"),
        F.lit(dialect).alias("dialect"))
    return admit(files)
