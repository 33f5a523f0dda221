"""Importance resampling towards a target distribution.

1. Weights: terms and runs of terms fall into hashed buckets; a bucket's gain is the log ratio of its smoothed shares in
   the target and in the documents.  A task turns its texts into bucket numbers and adds up ``gains[buckets]``.
2. Score: the weight plus Gumbel noise from a hash of the id, so the highest scores are a draw without replacement.
3. Exact ranks by parallel sorting by regular sampling: every task sorts its rows and writes them as a run; every d-th row
   of each run is a sample; regular places of the sorted samples are the splitters; runs are cut at the splitters and the
   segments exchanged; a task merges the segments it got; the sizes of the segments before give the first rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.terms import run_hashes, texts
from procatlas.session import cut

#: At most so many runs and ranges: a run's samples are as many as there are ranges, so the driver sees their product.
MOST_RANGES = 1000
#: A range holds about so many rows while there are fewer ranges than that.
RANGE_ROWS = 20_000
_ROW = (1 << 33) - 1
_SCORED = "doc_id long, n_features long, weight long, score long"


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features in each bucket over all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, value in run_hashes(texts(batch, 0), longest):
                count += np.bincount(value % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    S, T, m = int(have.sum()), int(want.sum()), have.size
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + m) / ((s + 1.0) * (T + m))))
                     for s, t in zip(have.tolist(), want.tolist())], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the id and the seed only, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, buckets: int, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score) of every row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, value in run_hashes(texts(batch, 1), longest):
                n += np.bincount(row, minlength=n.size)
                weight += np.bincount(row, shared.value[value % np.uint32(buckets)], n.size).astype(np.int64)  # sums far below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return (docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_features long, weight long")
            .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))


def _keys(score: np.ndarray, doc_id: np.ndarray, named: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order of rows: highest score, smallest doc_id, rows without one last, then the place of the row in its run."""
    return np.lexsort((place, doc_id, ~named, -score))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    part = {name: batch.column(batch.schema.get_field_index(name)) for name in ("score", "doc_id", "place")}
    return (part["score"].to_numpy(zero_copy_only=False), part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False),
            part["doc_id"].is_valid().to_numpy(zero_copy_only=False), part["place"].to_numpy(zero_copy_only=False))


_ORDER = (F.desc, "score"), (F.asc_nulls_last, "doc_id")


def _order() -> list[Column]:
    return [f(c) for f, c in _ORDER]


def ranked(rows: DataFrame, draw: int, total: int, ranges: int) -> DataFrame:
    """``rows`` (total of them) with ``rank`` 1 to ``draw`` by descending score and ascending doc_id, null after that."""
    session = rows.sparkSession
    rows = rows.coalesce(MOST_RANGES)
    # the id grows with the row inside a task: run in its upper bits, place in the run below
    runs = cut(rows.sortWithinPartitions(*_order()).withColumn("place", F.monotonically_increasing_id()), "runs")
    step = max(1, total // (ranges * ranges))
    samples = (runs.where(F.col("place").bitwiseAND(F.lit(_ROW)) % step == step // 2)
               .select("score", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "place").toPandas())
    cols = [samples[c].to_numpy(d) for c, d in (("score", np.int64), ("doc_id", np.int64), ("named", bool), ("place", np.int64))]
    at = _keys(*cols)
    cuts = np.unique(np.arange(1, ranges) * at.size // ranges)
    splitters = session.sparkContext.broadcast([c[at[cuts]] for c in cols])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = splitters.value[0].size
            order = _keys(*(np.concatenate([s, c]) for s, c in zip(splitters.value, _columns(batch))))
            segment = np.empty(order.size, np.int64)
            segment[order] = np.cumsum(order < own)
            # a splitter is itself a row of some run: it opens its segment
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[own:])], names=[*batch.schema.names, "segment"])

    dealt = cut(runs.mapInArrow(segments, f"{_SCORED}, place long, segment long"), "segments")
    sizes = dict(dealt.groupBy("segment").count().collect())  # at most ``ranges`` of them
    size = np.array([sizes.get(s, 0) for s in range(cuts.size + 1)], np.int64)
    first = np.cumsum(size) - size
    last = int(np.searchsorted(first, draw)) - 1  # segments after this one begin behind the draw

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, seen = -1, 0
        for batch in batches:
            own = batch.column(4).to_numpy()
            opens = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if own.size else np.zeros(0, np.int64)
            if own.size and own[0] != segment:
                seen = 0
            place = np.arange(own.size) - np.repeat(opens, np.diff(np.append(opens, own.size)))
            if opens.size:
                place[:opens[1] if opens.size > 1 else own.size] += seen
                segment, seen = own[-1], int(place[-1]) + 1
            rank = first[own] + place + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rank, mask=rank > draw)],
                                             names=["doc_id", "n_features", "weight", "score", "rank"])

    merged = (dealt.where(F.col("segment") <= last).repartition(max(1, last + 1), "segment")
              .sortWithinPartitions("segment", *_order(), "place")
              .select("doc_id", "n_features", "weight", "score", "segment").mapInArrow(number, f"{_SCORED}, rank long"))
    rest = dealt.where(F.col("segment") > last).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return merged.union(rest)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
             least_terms: int = 20, percent: int = 10, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, for every row of ``docs`` (doc_id, text).

    A text's features are all runs of 1 to ``longest`` terms; ``weight`` adds the gains of their buckets towards the texts
    of ``target``; ``score`` adds Gumbel noise from ``seed`` and doc_id.  Of the N rows with at least ``least_terms``
    terms, the ``floor(percent * N / 100)`` highest scores are drawn and get ranks 1, 2, 3...; ties go to the smaller
    doc_id.  Null and empty texts have no features and weight 0.  A null doc_id gets the noise of an empty id and comes
    last among equal scores; rows that repeat doc_id and text rank one after the other.  Empty tables count as no features.
    Other columns are ignored.  ``ranges`` changes the cost only.
    """
    scored = cut(score(docs, target, buckets, longest, seed), "scored")
    long_enough = F.col("n_features") >= sum(max(0, least_terms - k) for k in range(longest))
    total = scored.where(long_enough).count()
    ranges = ranges or max(1, min(MOST_RANGES, total // RANGE_ROWS + 1))
    short = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(long_enough), percent * total // 100, total, ranges).union(short)
