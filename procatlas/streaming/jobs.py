"""The operators that also run continuously."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procatlas.functions import fixed_values as fv
from procatlas.functions import scalars
from procatlas.operators import extract

#: A state table is folded into one base after so many batches.
FOLD_EVERY = 10


def rule_scan(definitions: DataFrame) -> DataFrame:
    """Findings of a stream of definitions: stateless, append mode."""
    return extract.rule_findings(definitions)


# -- job states ----------------------------------------------------------------------------------

def latest_job_state(updates: DataFrame, keep_finished_ms: int = 3_600_000) -> DataFrame:
    """State per job of a stream of (job_id, connection_id, status, ts, update_id), in update mode.

    Updates without a time or number are left out.  One row for each job that a batch updates: connection_id, job_id, status, updated_at, update_id of the newest update so
    far by (ts, update_id), and the number of ``updates`` in this batch.  The state of a finished job is dropped when nothing
    has come for ``keep_finished_ms`` of processing time, so the state holds running jobs and those just finished.
    """
    finished = tuple(fv.FINISHED_STATES)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, count = (tuple(state.get) if state.exists else None), 0
        for rows in batches:
            count += len(rows)
            for found in zip(rows["status"].tolist(), rows["ts"].tolist(), rows["update_id"].tolist()):
                if newest is None or found[1:] > newest[1:]:
                    newest = found
        state.update(newest)
        if newest[0] in finished:
            state.setTimeoutDuration(keep_finished_ms)
        yield pd.DataFrame({"connection_id": [key[0]], "job_id": [key[1]], "status": [newest[0]],
                            "updated_us": [newest[1]], "update_id": [newest[2]], "updates": [count]})

    kinds = dict(updates.dtypes)
    out = f"connection_id {kinds['connection_id']}, job_id {kinds['job_id']}, status string, updated_us long, update_id long, updates long"
    rows = updates.select("connection_id", "job_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
                          F.col("update_id").cast("long").alias("update_id")).where("ts IS NOT NULL AND update_id IS NOT NULL")
    kept = rows.groupBy("connection_id", "job_id").applyInPandasWithState(
        step, out, "status string, ts long, update_id long", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.withColumn("updated_at", F.timestamp_micros("updated_us")).drop("updated_us")


def running_per_connection(states: DataFrame) -> DataFrame:
    return states.groupBy("connection_id").agg(F.count_if(scalars.is_running(F.col("status"))).alias("running"))


class StateTable:
    """One row per key in a folder: a base, and a folder for each batch since, folded into a new base every few batches.

    A batch that is repeated after a failure replaces its own folder.  Old folders go once a new base is complete, so
    there are never more than ``fold_every`` and a few.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], newest: list[str], counts: list[str], fold_every: int = FOLD_EVERY):
        self.spark, self.path, self.keys, self.newest, self.counts, self.fold_every = spark, path, keys, newest, counts, fold_every

    def _folders(self) -> dict[str, list[int]]:
        """Numbers of complete folders by kind."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
        names = [f.getPath().getParent().getName().split("-") for f in found]
        return {kind: sorted(int(n) for k, n in names if k == kind) for kind in ("base", "batch")}

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        """The newest row of each key, with its counts added up."""
        have = self._folders()
        base = have["base"][-1:]
        parts = [f"base-{n}" for n in base] + [f"batch-{n}" for n in have["batch"] if not base or n > base[0]]
        rows = self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts))
        rest = [c for c in rows.columns if c not in self.keys + self.counts]
        last = F.max_by(F.struct(*rest), F.struct(*self.newest)).alias("r")
        return rows.groupBy(*self.keys).agg(last, *(F.sum(c).alias(c) for c in self.counts)).select(*self.keys, "r.*", *self.counts)

    def add(self, batch: DataFrame, number: int) -> None:
        """Store a batch of the stream; for ``foreachBatch``."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        have = self._folders()
        if len([n for n in have["batch"] if not have["base"] or n > have["base"][-1]]) < self.fold_every:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{number}")
        for n in have["base"]:
            if n < number:
                self._remove(f"base-{n}")
        for n in have["batch"]:
            self._remove(f"batch-{n}")


# -- changed definitions ---------------------------------------------------------------------------

#: Names share a group by hash, as a call per group costs about two milliseconds however few names it has.  A checkpoint holds this
#: number for good.  Of 50 million names a group keeps some 3,000.
NAME_GROUPS = 16384


def changed_definitions(definitions: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Changes in a stream of (connection_id, fqn, definition_hash, seen_at): connection_id, fqn, definition_hash, seen_at, kind.

    ``changed`` is a definition whose hash differs from the last one under its name, by time, over all batches; so a return
    to an old text is a change again, and a repeat is none.  ``late`` is a row older than the last one known under its name: it
    changes nothing and is counted apart.  Rows of one batch are taken in order of time.  A name of which nothing has come for
    ``forget_ms`` of processing time is forgotten, and its next row counts as a change; None remembers all.

    A row of state holds the names of one of ``NAME_GROUPS`` groups as JSON: connection_id, fqn, hash, time, and when to forget it.
    """
    def values(column: pd.Series) -> list:
        return [None if v is None or v != v else v for v in column.tolist()]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = {(c, n): rest for c, n, *rest in json.loads(state.get[0])} if state.exists else {}
        came: dict[tuple, list] = {}
        if not state.hasTimedOut:
            for b in batches:
                for name, *row in zip(zip(values(b["connection"]), values(b["fqn"])), b["seen_us"].tolist(), values(b["definition_hash"])):
                    came.setdefault(name, []).append(row)
        out = []
        for name, rows in came.items():
            last, at, _ = known.get(name, (None, None, None))
            for time, hash_ in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
                if at is not None and time < at:
                    out.append((*name, hash_, time, "late"))
                    continue
                if at is None or hash_ != last:
                    out.append((*name, hash_, time, "changed"))
                last, at = hash_, time
            known[name] = (last, at, None if forget_ms is None else now + forget_ms)
        kept = [(*name, *rest) for name, rest in known.items() if name in came or rest[2] is None or rest[2] >= now]
        if kept:
            state.update((json.dumps(kept),))
            ends = [k[-1] for k in kept if k[-1] is not None]
            if ends:
                state.setTimeoutDuration(max(min(ends) - now, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(("connection", "fqn", "definition_hash", "seen_us", "kind"), (list(c) for c in zip(*out)))))

    kinds = dict(definitions.dtypes)
    rows = definitions.select(F.col("connection_id").cast("string").alias("connection"), "fqn", "definition_hash",
                              F.unix_micros(F.col("seen_at").cast("timestamp")).alias("seen_us")).where("seen_us IS NOT NULL")
    grouped = rows.withColumn("name_group", F.pmod(F.xxhash64("connection", "fqn"), F.lit(NAME_GROUPS)))
    kept = grouped.groupBy("name_group").applyInPandasWithState(
        step, "connection string, fqn string, definition_hash string, seen_us long, kind string",
        "names string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.select(F.col("connection").cast(kinds["connection_id"]).alias("connection_id"), "fqn", "definition_hash", "kind",
                       F.timestamp_micros("seen_us").alias("seen_at"))


def late_rows(changes: DataFrame) -> DataFrame:
    """Late rows per connection, with the newest of them."""
    return changes.where("kind = 'late'").groupBy("connection_id").agg(F.count(F.lit(1)).alias("late"), F.max("seen_at").alias("newest"))


# -- running -----------------------------------------------------------------------------------------

def run_to_end(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> list[dict]:
    """Process what is there and stop; gives for each batch its number, its rows and the rows of state after it.

    ``sink`` is a folder for append mode, or a function of (batch, number).
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    session, empty_batches = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = session.conf.get(empty_batches)
    session.conf.set(empty_batches, "false")  # timers of processing time would ask for empty batches without end
    try:
        query = (writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)).start()
        query.awaitTermination()
    finally:
        session.conf.set(empty_batches, before)
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "state": sum(o["numRowsTotal"] for o in p["stateOperators"])} for p in query.recentProgress]
