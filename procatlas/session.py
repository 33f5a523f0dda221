"""Session settings and the shared folder that durable intermediate tables go to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_roots: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings every operator here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    ``spark.checkpoint.dir`` of the session wins.  Without it only a local master may go on, in a
    temporary folder; a cluster needs a folder that survives the loss of an executor.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/procatlas/{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_roots:
        folder = tempfile.mkdtemp(prefix="procatlas-")
        atexit.register(shutil.rmtree, folder, True)
        _local_roots[app] = folder
    return f"{_local_roots[app]}/{app}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The lineage ends at files on shared storage, the file sizes give the planner real statistics
    (so a broadcast is only chosen for a side whose size is known), and unread columns are pruned.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


#: Rows of an Arrow batch: whole texts are among them, so far fewer than Spark sends by default.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and texts in small batches."""
    app = spark.sparkContext.applicationId
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="procatlas-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "procatlas_code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(folder / "procatlas_code.zip"))
    _shipped.add(app)


class Levels:
    """A growing table written level by level under one folder; earlier levels are never rewritten."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, fresh_path(spark, label)
        self.count, self.schema = 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next level (numbered from 0) and read it back."""
        folder = f"{self.path}/level={self.count}"
        df.write.parquet(folder)
        self.schema = self.schema or df.schema
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(folder)

    def all(self) -> DataFrame:
        """Every level as one scan, with its number in ``level``."""
        schema = T.StructType([*self.schema.fields, T.StructField("level", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)
