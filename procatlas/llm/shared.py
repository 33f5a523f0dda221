"""Small helpers the operators share: durable intermediates, loops over edges, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.session import BATCH_ROWS, cut, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.head(1)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over undirected ``edges``; only nodes with an edge.

    Each round every node takes the smallest label among itself, its neighbours and its label's own label, so
    labels travel along an edge and then jump.  Rounds are written out, so lineage does not grow.
    """
    both = cut(edges.select(F.col(src).alias("node"), F.col(dst).alias("other"))
               .union(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))
               .where("node <> other").distinct(), "links")
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(labels.join(near, "node", "left").join(jump, "component", "left")
                  .select("node", F.least("component", "near", "far").alias("component"),
                          (F.least("component", "near", "far") < F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if is_empty(new.where("changed")):
            return labels
