"""Catalog sinks: partitioned facts and the camelCase snapshot export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Facts by connection; rows of one connection are spread over files by object."""
    facts.write.mode(mode).partitionBy("connection_id").parquet(path)


def camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def export_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per catalog table with camelCase keys."""
    for name, df in tables.items():
        df.select(*[F.col(c).alias(camel(c)) for c in df.columns]).write.mode("overwrite").json(f"{folder}/{name}")
