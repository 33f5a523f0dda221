"""Near copies by SimHash fingerprints, found with Burkhard-Keller trees.

1. Fingerprint: a bit is set when it is set in over half of the hashes of a text's word shingles.  Equal fingerprints
   are one from here on.
2. Shards: fingerprints that agree on some of their bits.  The bits are cut into blocks, and a shard is one choice of
   blocks with their values, so that any two fingerprints within the radius share a shard.
3. Trees: a shard becomes a tree whose nodes keep their children by the whole-number distance to them; a search goes only
   down edges that differ from its own distance by the radius at most.  A task builds and searches the trees of many
   shards together.  A shard too large for a task is cut into several trees, each sent to all parts of the shard.
4. Links join classes; a task keeps only links that join what it has not joined yet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.llm.shared import components
from procatlas.llm.terms import texts
from procatlas.session import cut

BITS = 64
#: Fingerprints of one tree at most; larger shards are cut.
TREE_ROWS = 8192
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STEPS = 1 << 21


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of one text, A-Z lowered, in lists of bounded size."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        stop = space.start() if space else len(text)
        yield text[at:stop].lower().split()
        at = stop


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of one text over its ``width``-word shingles; fewer words are one shingle, no words give 0."""
    ones, total, open_ = np.zeros(BITS, np.int64), 0, []
    for words in _words(text):
        open_ += words
        if len(open_) < width:
            continue
        line = b" ".join(open_)
        end = np.cumsum([len(w) + 1 for w in open_]) - 1
        start = np.concatenate([[0], end[:-1] + 1])[:end.size - width + 1].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(start, end[width - 1:].tolist())], "<u8")
        for at in range(0, hashes.size, 1 << 14):
            ones += np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += hashes.size
        open_ = open_[len(open_) - width + 1:]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(open_), 42) if open_ else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, print) of every row; the 64 bits are in a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text, width) for _, text in texts(batch, 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, print long")


class Trees:
    """Burkhard-Keller trees of many shards at once; ``shard`` numbers them from 0 and is sorted."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray, shards: int):
        self.prints = prints
        self.root = np.full(shards, -1, np.int64)
        parent, edge = np.full(prints.size, -1, np.int64), np.zeros(prints.size, np.int64)
        rows, cell = np.arange(prints.size), shard
        while rows.size:  # a level of all trees: the first row of a cell is its node, the others go on by their distance to it
            order = np.argsort(cell, kind="stable")
            rows, cell = rows[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            node = np.repeat(rows[first], np.diff(np.append(first, rows.size)))
            if (parent[rows[0]] < 0):
                self.root[shard[rows[first]]] = rows[first]
            on = np.ones(rows.size, bool)
            on[first] = False
            rows, node = rows[on], node[on]
            parent[rows], edge[rows] = node, np.bitwise_count(prints[rows] ^ prints[node])
            cell = node * (BITS + 1) + edge[rows]
        child = np.flatnonzero(parent >= 0)
        code = parent[child] * (BITS + 1) + edge[child]
        order = np.argsort(code)
        self.code, self.child = code[order], child[order]

    def near(self, query: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows of the query's shard within ``radius``."""
        found = []
        at, node = np.arange(query.size), self.root[shard]
        at, node = at[node >= 0], node[node >= 0]
        while at.size:
            distance = np.bitwise_count(query[at] ^ self.prints[node]).astype(np.int64)
            hit = distance <= radius
            found.append((at[hit], node[hit]))
            base = node * (BITS + 1)
            low = np.searchsorted(self.code, base + np.maximum(distance - radius, 0))
            count = np.searchsorted(self.code, base + np.minimum(distance + radius, BITS), "right") - low
            at = np.repeat(at, count)
            node = self.child[np.repeat(low, count) + np.arange(at.size) - np.repeat(np.cumsum(count) - count, count)]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (at, node)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is linked with, directly or not."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(prints: np.ndarray, shard: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the rows of whole shards; role bit 1 is in the tree, role bit 2 is looked up."""
    shards = int(shard[-1]) + 1
    inside, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    trees = Trees(prints[inside], shard[inside], shards)
    size = np.bincount(shard[inside], minlength=shards)
    reach = np.cumsum(size[shard[asked]])  # a search meets its shard's tree at most once
    a, b, at = [], [], 0
    while at < asked.size:
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _STEPS)))
        some = asked[at:stop]
        q, row = trees.near(prints[some], shard[some], radius)
        a.append(some[q])
        b.append(inside[row])
        at = stop
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    label = _joined(prints.size, a, b)
    own = np.flatnonzero(label != np.arange(prints.size))
    return prints[own], prints[label[own]]


def _choices(radius: int, blocks: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks: two prints within the radius agree on one of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(some) for some in itertools.combinations(masks, blocks - radius)]


def _shards(prints: DataFrame, radius: int, blocks: int, tree_rows: int) -> DataFrame:
    """(choice, value, tree, part, role, print): shards, the large ones as pairs of a tree and a part to look up."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in _choices(radius, blocks)]
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)))
    rows = prints.select("print", F.explode(keys).alias("s")).select("print", "s.choice", "s.value")
    large = cut(rows.groupBy("choice", "value").count().where(F.col("count") > tree_rows)
                .select("choice", "value", F.ceil(F.col("count") / tree_rows).cast("int").alias("parts")), "large")
    rows = (rows.join(large, ["choice", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")))
    pair = lambda tree, part, role: F.struct(tree.alias("tree"), part.alias("part"), role.alias("role"))
    meets = F.concat(
        F.transform(F.sequence("own", F.col("parts") - 1), lambda p: pair(F.col("own"), p, F.when(p == F.col("own"), 3).otherwise(1))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("own")), lambda t: t < F.col("own")), lambda t: pair(t, F.col("own"), F.lit(2))))
    return (rows.select("choice", "value", "print", F.explode(meets).alias("m"))
            .select("choice", "value", "m.tree", "m.part", "m.role", "print"))


def near_prints(prints: DataFrame, radius: int = 4, blocks: int | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(a, b) links that join all of the distinct ``prints`` (print) that are within ``radius`` of each other."""
    if blocks is None:  # so many that prints at random would leave a shard some hundred rows
        want = math.log2(max(2, prints.count())) - 9
        blocks = next((b for b in range(radius + 1, 2 * radius) if BITS * (b - radius) / b >= want), 2 * radius)
    key = ["choice", "value", "tree", "part"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        names = ["a", "b"]

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            new = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            shard = np.concatenate([[0], np.cumsum(new)])
            a, b = _links(cols[5].view(np.uint64), shard, cols[4], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

        for batch in batches:
            waiting.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(w[0].size for w in waiting) < 1 << 16:
                continue
            cols = [np.concatenate(c) for c in zip(*waiting)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
            if new.size:  # all shards but the last are whole
                yield out([c[:new[-1] + 1] for c in cols])
                cols = [c[new[-1] + 1:] for c in cols]
            waiting = [tuple(cols)]
        if waiting and sum(w[0].size for w in waiting):
            yield out([np.concatenate(c) for c in zip(*waiting)])

    return (_shards(prints, radius, blocks, tree_rows).repartition(*key).sortWithinPartitions(*key)
            .select(*key, "role", "print").mapInArrow(task, "a long, b long"))


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None,
                       tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Fingerprints of at most ``radius`` differing bits link; ``component_id`` is the smallest doc_id reachable by links.
    Null and empty texts have fingerprint zero, which links like any other.  Rows that repeat a doc_id stay rows and link
    by their own texts; rows with a null doc_id link too, and have a null component where no row of it has an id.  An
    empty table gives an empty result.  Other columns are ignored.  No link is lost for any ``blocks`` and ``tree_rows``,
    which change the cost only.
    """
    prints = cut(fingerprints(docs, width), "prints")
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(near_prints(distinct.select("print"), radius, blocks, tree_rows))
    named = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = cut(named.join(least, "component").select("print", "component_id"), "of_print")
    return (prints.join(of_print, "print", "left")
            .select("doc_id", F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint"), "component_id"))
