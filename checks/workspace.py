"""The analysis of the derived corpus, one per session and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import corpus
from procatlas.plans.analysis import Analysis

_open: dict[tuple[str, str], "Workspace"] = {}


class Workspace(Analysis):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, corpus.objects(spark, sf_dir), None)
        self.sf_dir = sf_dir

    @property
    def tables(self) -> DataFrame:
        return self.stored("tables", lambda: corpus.tables(self.spark, self.sf_dir))

    @property
    def second_objects(self) -> DataFrame:
        return self.stored("objects2", lambda: corpus.objects(self.spark, self.sf_dir, snapshot=2))

    @property
    def commented(self) -> DataFrame:
        return self.stored("commented", lambda: corpus.commented_texts(self.spark, self.sf_dir))


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
