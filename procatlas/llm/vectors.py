"""Exact top-k inner products with a vector-approximation file.

Every component is cut into equal cells, and a vector is kept as one small code per component.  A scan of the codes
bounds each score from both sides; exact vectors are read only where the upper bound can still reach the k-th result,
first those with the best lower bounds, then the rest that the k-th exact score so far leaves open.

Equal vectors are one candidate: of each, only the k + 1 smallest ids can appear in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.shared import is_empty
from procatlas.session import cut

#: Cells of a component (one byte holds a code).
CELLS = 64
QUERY_BLOCK = 256
VECTOR_BLOCK = 1 << 16
_CHUNK = 8192


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, x array<long>): floor(scale * component); unusable vectors are left out."""
    whole = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & usable)
            .select("vec_id", F.size("embedding").alias("dim"), whole.alias("x")))


def distinct_vectors(whole: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rep, dim, x) of each distinct vector under its smallest id, and its members (rep, vec_id): the k + 1 smallest.

    The window keeps the first ranks of a key before the shuffle, so a vector that many rows share stays small.
    """
    rows = cut(whole.distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("vec_id")))
               .where(F.col("n") <= k + 1), "vectors")
    members = rows.join(rows.groupBy("x").agg(F.min("vec_id").alias("rep")), "x")
    members = cut(members.select(F.xxhash64("x").alias("h"), "rep", "vec_id", "dim", "x"), "members")
    return members.where("vec_id = rep").select("rep", "h", "dim", "x"), members.select("rep", "h", "vec_id")


def _ranges(reps: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest value of every component, by dimension: a few numbers per component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(x, np.int64)
                low[dim] = np.minimum(low[dim], x) if dim in low else x
                high[dim] = np.maximum(high[dim], x) if dim in high else x
        rows = [(d, j, int(a), int(b)) for d in low for j, (a, b) in enumerate(zip(low[d], high[d]))]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                          pa.array(cols[3], pa.int64())], names=["dim", "j", "low", "high"])

    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in (reps.select("dim", "x").mapInArrow(task, "dim int, j int, low long, high long")
              .groupBy("dim", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()):
        found.setdefault(r.dim, {})[r.j] = (r.low, r.high)
    return {d: tuple(np.array([v[j][s] for j in range(len(v))], np.int64) for s in (0, 1)) for d, v in found.items()}


class Cells:
    """Cell bounds of one dimension's components."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int):
        self.low, self.width = low, np.maximum(1, -((low - high - 1) // cells))
        self.high = high

    def codes(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.width).astype(np.uint8)

    def middle(self, codes: np.ndarray) -> np.ndarray:
        """Middle of each cell; no value of a cell is further from it than ``reach``."""
        return self.low + codes.astype(np.float64) * self.width + self.reach

    @property
    def reach(self) -> np.ndarray:
        return (self.width - 1) / 2


def _scan(k: int, ranges: dict, cells: int):
    """For one block of queries and one of codes: what can be among the k best of this block, with bounds."""

    def task(key, queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or codes.empty:
            return pd.DataFrame({"query_id": [], "qh": [], "rep": [], "h": [], "low": [], "high": []})
        cell = Cells(*ranges[key[0]], cells)
        q = np.array(queries["x"].tolist(), np.float64).reshape(len(queries), key[0])
        reach = np.abs(q) @ cell.reach + 1e-6 * (1 + np.abs(q) @ np.maximum(np.abs(cell.low), np.abs(cell.high)))
        rep, h = codes["rep"].to_numpy(), codes["h"].to_numpy()
        all_codes = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), key[0])
        kth = np.full(len(q), -np.inf)  # the query's own vector may be one: k + 1 keep it safe
        best = np.full((len(q), k + 1), -np.inf)
        parts = []
        for at in range(0, len(rep), _CHUNK):
            score = q @ cell.middle(all_codes[at:at + _CHUNK]).T
            both = np.concatenate([best, score - reach[:, None]], axis=1)
            best = -np.partition(-both, k, axis=1)[:, :k + 1]
            kth = best.min(axis=1)
            r, c = np.nonzero(score + reach[:, None] >= kth[:, None])
            parts.append((r, c + at, score[r, c]))
        r, c, s = (np.concatenate(x) for x in zip(*parts))
        keep = s + reach[r] >= kth[r]
        r, c, s = r[keep], c[keep], s[keep]
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[r], "qh": queries["qh"].to_numpy()[r], "rep": rep[c], "h": h[c],
                             "low": s - reach[r], "high": s + reach[r]})

    return task


def top_k(vectors: DataFrame, is_query=lambda vec_id: vec_id % 20 == 0, k: int = 20, scale: float = 64.0, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best other rows by integer inner product.

    ``vectors`` has (vec_id, embedding).  Components become floor(scale * component).  Ties go to the smaller vec_id; all
    others are returned where there are fewer than ``k``.  Vectors that are null or hold null or non-finite components
    and rows without an id take no part; vectors meet only vectors of their own length; rows that repeat an id and its
    vector count once, and a row with a query's id is never its result.  Scores must fit 53 bits.  An empty table
    gives no row.  Exact.
    """
    reps, members = distinct_vectors(integer_vectors(vectors, scale), k)
    if is_empty(reps):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranges = {0: (np.zeros(0, np.int64), np.zeros(0, np.int64))} | _ranges(reps)
    queries = cut(integer_vectors(vectors.where(is_query(F.col("vec_id"))), scale).dropDuplicates(["vec_id", "x"])
                  .select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("qh"), "dim", "x"), "queries")
    count = lambda df, size: df.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    v_blocks, q_blocks = count(reps, VECTOR_BLOCK), count(queries, QUERY_BLOCK)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [Cells(*ranges[d], cells).codes(np.array(x, np.int64)).tobytes()
                     for d, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary())], names=["rep", "h", "dim", "code"])

    codes = cut(reps.select("rep", "h", "dim", "x").mapInArrow(coded, "rep long, h long, dim int, code binary"), "codes")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (queries.join(v_blocks.withColumnRenamed("blocks", "vb"), "dim").join(q_blocks, "dim")
            .select("query_id", "qh", "dim", "x", F.pmod(F.xxhash64("query_id", "qh"), "blocks").cast("int").alias("qb"), every(F.col("vb")).alias("vb")))
    right = (codes.join(v_blocks.withColumnRenamed("blocks", "nv"), "dim").join(q_blocks, "dim")
             .select("rep", "h", "dim", "code", every(F.col("blocks")).alias("qb"), F.pmod(F.xxhash64("rep", "h"), "nv").cast("int").alias("vb")))
    bounds = cut(left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb"))
                 .applyInPandas(_scan(k, ranges, cells), "query_id long, qh long, rep long, h long, low double, high double"), "bounds")

    query = Window.partitionBy("query_id", "qh")
    by_low = query.orderBy(F.desc("low"), "rep", "h")
    placed = bounds.withColumn("n", F.row_number().over(by_low))
    kth_low = placed.where(F.col("n") == k + 1).select("query_id", "qh", F.col("low").alias("kth"))
    placed = cut(placed.join(kth_low, ["query_id", "qh"], "left").where("kth IS NULL OR high >= kth"), "placed")
    first = cut(_exact(placed.where(F.col("n") <= k + 1), queries, reps), "exact")
    reached = (first.withColumn("n", F.row_number().over(query.orderBy(F.desc("score"), "rep", "h")))
               .where(F.col("n") == k + 1).select("query_id", "qh", F.col("score").alias("reached")))
    rest = placed.where(F.col("n") > k + 1).join(reached, ["query_id", "qh"], "left").where("reached IS NULL OR high >= reached")
    scored = first.union(_exact(rest, queries, reps))
    ranked = (scored.join(members, ["rep", "h"]).where("vec_id <> query_id")
              .withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(pairs: DataFrame, queries: DataFrame, reps: DataFrame) -> DataFrame:
    """Exact scores of (query, vector) pairs."""
    mine = queries.select("query_id", "qh", F.col("x").alias("qx"))
    product = F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
    return (pairs.select("query_id", "qh", "rep", "h").join(reps.select("rep", "h", "x"), ["rep", "h"]).join(mine, ["query_id", "qh"])
            .select("query_id", "qh", "rep", "h", product.alias("score")))
