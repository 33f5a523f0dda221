"""Ranked lexical search of all documents for each item of a query set, by dense blocked matrix products.

Items come in blocks of bounded size.  For each block one scan counts documents, terms and the document frequencies of the
block's vocabulary, and a second scan scores: a task turns some documents at a time into a dense tile of impacts over a
compact piece of the vocabulary, and BLAS multiplies it by the piece's tile of item weights.  All entries are whole
numbers and a piece is cut so that no sum in it can reach 2^53, so float64 is exact; pieces add up in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.terms import terms, texts

#: Items of a block have about so many bytes of text (more only where one item alone has).
BLOCK_BYTES = 1 << 20
#: Items, terms and documents of a tile at most.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 1024, 256
#: An impact is below a million before the term's weight; sums of a piece stay below 2^53.
_MOST_WEIGHT = (1 << 53) // 1_000_000 - 1


class Block:
    """The items of a block: their ids, the terms of each with repeats, and the number of each term."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [item_id for item_id, _ in items]
        self.held = [Counter(t for some in terms(text) for t in some) for _, text in items]
        self.number = {t: k for k, t in enumerate(sorted(set().union(*self.held)))} if items else {}

    def count(self, text: bytes) -> tuple[int, Counter]:
        """Terms of a text, and how often it holds each term of the block."""
        total, found, number = 0, Counter(), self.number.get
        for some in terms(text):
            total += len(some)
            found.update(k for k in map(number, some) if k is not None)
        return total, found


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The distinct rows (item_id, text) of ``items``, dealt to blocks by hash; one block at a time is on the driver."""
    items = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // block_bytes + 1
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield Block(sorted(((r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in rows), key=lambda r: (r[0] is None, r)))


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents that hold each term of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        held, rows, size = np.zeros(len(block.number), np.int64), 0, 0
        for batch in batches:
            for _, text in texts(batch, 0):
                total, found = block.count(text)
                rows += total > 0
                size += total
                held[list(found)] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()], pa.int64()), pa.array([rows, size, *held[used].tolist()], pa.int64())],
                                         names=["term", "n"])

    found = docs.select("text").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(block.number) + 2, np.int64)
    count[found["term"].to_numpy(np.int64) + 2] = found["n"].to_numpy(np.int64)
    return int(count[0]), int(count[1]), count[2:]


class Tiles:
    """Item weights of a block, cut into tiles: some items, and pieces of those items' own vocabulary."""

    def __init__(self, block: Block, weight: list[int]):
        self.tiles: list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for at in range(0, len(block.ids), TILE_ITEMS):
            held = block.held[at:at + TILE_ITEMS]
            need: dict[int, dict[int, int]] = {}
            for item, counts in enumerate(held):
                for t, q in counts.items():
                    need.setdefault(block.number[t], {})[item] = q * weight[block.number[t]]
            self.tiles.append((at, len(held), list(self._pieces(need, len(held)))))

    @staticmethod
    def _pieces(need: dict[int, dict[int, int]], items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, terms x items) with at most ``TILE_TERMS`` terms and at most ``_MOST_WEIGHT`` in an item's column.

        Each piece takes as much as fits and leaves the rest to the next, so that even one weight beyond the bound is met.
        """
        while need:
            rows, room, rest = [], np.full(items, _MOST_WEIGHT, np.int64), {}
            for term in sorted(need):
                if len(rows) == TILE_TERMS:
                    rest[term] = need[term]
                    continue
                take = {i: min(w, int(room[i])) for i, w in need[term].items()}
                left = {i: w - take[i] for i, w in need[term].items() if w > take[i]}
                if left:
                    rest[term] = left
                if any(take.values()):
                    room[list(take)] -= list(take.values())
                    rows.append((term, take))
            if rows:
                tile = np.zeros((len(rows), items))
                for k, (_, take) in enumerate(rows):
                    tile[k, list(take)] = list(take.values())
                yield np.array([t for t, _ in rows]), tile
            need = rest if rows else {}  # without rows all that is left weighs nothing

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, documents x items) for a tile of documents given by the entries (doc, term, impact)."""
        for at, items, pieces in self.tiles:
            total = np.zeros((docs, items), np.int64)
            for own, weights in pieces:
                place = np.searchsorted(own, term)
                place[place == own.size] = 0
                here = own[place] == term
                tile = np.zeros((docs, own.size))
                tile[doc[here], place[here]] = impact[here]
                total += (tile @ weights).astype(np.int64)
            yield at, total


class Best:
    """The k best documents of each item so far: highest score, smallest doc_id, rows without one last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, doc_id, whether the doc_id is null

    def add(self, at: int, total: np.ndarray, doc_id: np.ndarray, nameless: np.ndarray) -> None:
        """All documents that reach an item's k-th score go in, equal ones too."""
        doc, item = np.nonzero(total >= self.floor[at:at + total.shape[1]])
        if not doc.size:
            return
        new = (item + at, total[doc, item], doc_id[doc], nameless[doc])
        item, score, ids, null = kept = [np.concatenate(c) for c in zip(self.kept, new)]
        order = np.lexsort((ids, null, -score, item))
        place = np.arange(order.size) - np.searchsorted(item[order], item[order])
        full = order[place == self.k - 1]
        self.floor[item[full]] = score[full]
        self.kept = [c[order[place < self.k]] for c in kept]


def _weights(N: int, held: np.ndarray) -> list[int]:
    return [math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1))) for df in held.tolist()]


def _best_of_block(docs: DataFrame, block: Block, k: int, k1_tenths: int, b_percent: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best ``k`` of each task."""
    N, L, held = statistics(docs, block)
    shared = docs.sparkSession.sparkContext.broadcast((block, Tiles(block, _weights(N, held))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tiles = shared.value
        best, ids, entries = Best(len(block.ids), k), [], ([], [], [])

        def work_off() -> None:
            doc, term, impact = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in entries)
            doc_id = np.array([0 if i is None else i for i in ids], np.int64)
            nameless = np.array([i is None for i in ids], np.int64)
            for at, total in tiles.scores(len(ids), doc, term, impact):
                best.add(at, total, doc_id, nameless)
            for c in (ids, *entries):
                c.clear()

        for batch in batches:
            for row, text in texts(batch, 1):
                n, found = block.count(text)
                if not found:
                    continue
                tf = np.fromiter(found.values(), np.int64, len(found))
                m = 100 - b_percent + b_percent * n * N // L
                entries[0].append(np.full(tf.size, len(ids)))
                entries[1].append(np.fromiter(found, np.int64, len(found)))
                entries[2].append((1_000_000_000 * tf) // (1000 * tf + k1_tenths * m))
                ids.append(batch.column(0)[row].as_py())
                if len(ids) == TILE_DOCS:
                    work_off()
        if ids:
            work_off()
        item, score, doc_id, nameless = best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([block.ids[i] for i in item.tolist()], pa.int64()),
             pa.array(doc_id, pa.int64(), mask=nameless.astype(bool)), pa.array(score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, k1_tenths: int = 8, b_percent: int = 75,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    The score adds, over the item's terms with repeats, the term's weight times its saturated frequency in the document,
    all in whole numbers; only scores above 0 are ranked, equal ones by ascending doc_id, a null doc_id last.  Null and
    empty texts have no terms and are not counted.  Rows that repeat item_id and text are one item; rows that give an
    item_id several texts are ranked one by one.  Documents that repeat are ranked each.  Empty tables give no rows.
    Other columns are ignored.  ``block_bytes`` changes the cost only: each block costs two scans of the documents.
    """
    found = []
    for number, block in enumerate(blocks(items, block_bytes)):
        if block.number:
            found.append(_best_of_block(docs, block, k, k1_tenths, b_percent).withColumn("block", F.lit(number)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    some = Window.partitionBy("block", "item", "part").orderBy(*order)  # many tasks' best, a part of the tasks at a time
    near = (reduce(DataFrame.union, found).withColumn("part", F.spark_partition_id() % 64)
            .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k))
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
