"""Jaccard join of documents on word shingles by vertical partitioning.

All shingles stand in one global order: rare ones first, frequent ones last, by hash inside a frequency class.  A
document's sorted set is cut where the order is cut into fragments; overlaps of a pair are counted in each fragment
alone and summed per pair.  Equal sets are one node, known by a digest of the set.

1. Scan: size and digest of every set; shingles that several documents of one task hold are reported, and the most
   frequent get the last classes.  The order steers cost only; results are the same for every order.
2. Leading fragment: two sets whose similarity is at least t share one of their first ``n - ceil(t n) + 1`` shingles,
   so only those are grouped.
3. Hub pairs: each member of a group with the group's most central member; these settle most components.
4. Cross pairs: of each group all pairs whose ends are still in different components.  No link that joins two components
   is lost.  The overlap in the leading fragment already rules out most pairs.
5. Pairs of both kinds: full sets are cut into fragments, overlaps counted per fragment and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.shared import components, is_empty
from procatlas.llm.terms import texts
from procatlas.llm.words import mix, shingles
from procatlas.session import cut

TOP = np.uint64(1 << 63)
_ALL = (1 << 64) - 1
#: A task reports a shingle that at least so many of its documents hold.
OFTEN_IN_TASK = 3
#: So many of the most frequent shingles go to the end of the order (9 bytes each in every task).
ORDER_TAIL = 400_000
#: Sets that a task remembers so as not to repeat them.
REMEMBERED = 100_000


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned order kept in a signed column."""
    return (x ^ TOP).view(np.int64)


def _digest(grams: np.ndarray) -> int:
    """64 bits that tell a set from others, as a signed number; 0 for the empty set."""
    if not grams.size:
        return 0
    a = np.bitwise_xor.reduce(grams * np.uint64(0x9E3779B97F4A7C15) ^ (grams >> np.uint64(29)))
    b = (grams * (grams | np.uint64(1))).sum(dtype=np.uint64)
    x = (int(a) ^ int(b) * 0xD6E8FEB86659FD93 ^ grams.size * 0xA0761D6478BD642F) & _ALL
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of a batch, a few texts at a time."""
    for row, text in texts(batch, column):
        yield row, shingles(text, width)


def _text_key(text: bytes) -> int:
    """64 bits that tell a text from others, as a signed number; far cheaper than its set."""
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def _parities(grams: np.ndarray) -> np.ndarray:
    """A table of 64-bit words with one bit for each place of a hash: whether an odd number of the set's shingles has it.

    The places are the least power of two that is not below the size of the set, 64 at least.  Bits in which the tables of
    two sets differ are no more than the shingles that only one of them holds.  Of two tables the longer one folds to the
    length of the other by exclusive or of its halves.
    """
    places = max(64, 1 << (grams.size - 1).bit_length()) if grams.size else 64
    at = ((grams >> np.uint64(3)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def scan(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, n, node, text_key, parities) of every row; kind 1: node = shingle, n = documents of this task that hold it."""

    def batch_of(kind: int, doc_id: pa.Array, n, node, text_key: pa.Array, parities: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), doc_id, pa.array(n, pa.int64()), pa.array(node, pa.int64()), text_key, parities],
                                          names=["kind", "doc_id", "n", "node", "text_key", "parities"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, pending, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def count(least: int):
            nonlocal often
            gram, n = np.unique(np.concatenate(pending), return_counts=True)
            both, at = np.unique(np.concatenate([often[0], gram[n > 1]]), return_inverse=True)
            total = np.bincount(at, np.concatenate([often[1], n[n > 1]]), both.size).astype(np.int64)
            often = both[total >= least], total[total >= least]

        for batch in batches:
            sizes, nodes, text_keys = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            tables, ends = [np.zeros(0, np.int64)], np.zeros(batch.num_rows + 1, np.int32)
            for row, text in texts(batch, 1):
                grams = shingles(text, width)
                sizes[row], nodes[row], text_keys[row] = grams.size, _digest(grams), _text_key(text)
                if grams.size:
                    tables.append(_parities(grams))
                ends[row + 1] = ends[row] + (tables[-1].size if grams.size else 0)
                pending.append(grams)
                waiting += grams.size
                if waiting > 1_000_000:
                    count(2)
                    pending, waiting = [], 0
            yield batch_of(0, batch.column(0), sizes, nodes, pa.array(text_keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables))))
        if pending:
            count(OFTEN_IN_TASK)
        gram, n = often
        for at in range(0, gram.size, 20_000):
            part = slice(at, at + 20_000)
            none = pa.nulls(gram[part].size, pa.int64())
            yield batch_of(1, none, n[part], gram[part].view(np.int64), none, pa.nulls(gram[part].size, pa.list_(pa.int64())))

    return docs.select("doc_id", "text").mapInArrow(task, "kind int, doc_id long, n long, node long, text_key long, parities array<long>")


def nodes(sets: DataFrame) -> DataFrame:
    """(node, least, text_key, parities): each set that is not empty, its least doc_id, one of its texts, its table."""
    return (sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("parities").alias("parities")))


class Order:
    """Order key of a shingle: three bits of frequency class, then its hash."""

    def __init__(self, grams: np.ndarray, held: np.ndarray):
        at = np.argsort(grams)
        self.grams = grams[at]
        self.classes = np.clip(np.log2(np.maximum(held[at], 2)).astype(np.int64) // 2 + 1, 1, 7).astype(np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        key = grams >> np.uint64(3)
        if self.grams.size and grams.size:
            at = np.searchsorted(self.grams, grams)
            at[at == self.grams.size] = 0
            key |= np.where(self.grams[at] == grams, self.classes[at], np.uint64(0)) << np.uint64(61)
        key.sort()
        return key


def _head(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def leading(docs: DataFrame, width: int, percent: int, order: Order) -> DataFrame:
    """(gram, node, n, pos): the first order keys of every set; a set that the task has met before is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def batch_of(heads: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
            each = np.array([h.size for h in heads])
            key, node = np.concatenate(heads), np.repeat(np.array(nodes, np.int64), each)
            pos = np.arange(key.size) - np.repeat(np.cumsum(each) - each, each)
            return pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), each)),
                                               pa.array(pos.astype(np.int32))], names=["gram", "node", "n", "pos"])

        for batch in batches:
            out, rows = ([], [], []), 0
            for _, grams in _sets(batch, 0, width):
                node = _digest(grams)
                if not grams.size or node in met:
                    continue
                if len(met) < REMEMBERED:
                    met.add(node)
                for c, value in zip(out, (shared.value.keys(grams)[:_head(grams.size, percent)], node, grams.size)):
                    c.append(value)
                rows += out[0][-1].size
                if rows > 200_000:
                    yield batch_of(*out)
                    out, rows = ([], [], []), 0
            if rows:
                yield batch_of(*out)

    return docs.select("text").mapInArrow(task, "gram long, node long, n int, pos int")


class Members:
    """Bits by hashed text (or doc_id) of the rows a step needs: the others need not be cut into shingles again, nor moved.

    A key has three of 32 bits, up to ``MOST_BITS``; the few others that pass find no partner later.  Only 64-bit words of the
    table come to the driver, never texts, nodes or ids.
    """

    MOST_BITS = 1 << 25
    SHIFTS = (0, 19, 38)  # a key is a digest, so any of its bits are a hash

    def __init__(self, wanted: DataFrame):
        size = 1 << 12
        while size < min(32 * wanted.count(), self.MOST_BITS):
            size *= 2
        self.mask = size - 1
        places = F.explode(F.array(*(F.shiftrightunsigned("text_key", k).bitwiseAND(F.lit(self.mask)) for k in self.SHIFTS)))
        words = (wanted.select(places.alias("place"))
                 .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
        self.words = np.zeros(size >> 6, np.uint64)
        self.words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)

    def __contains__(self, text_key: int) -> bool:
        for k in self.SHIFTS:
            place = (text_key & _ALL) >> k & self.mask
            if not int(self.words[place >> 6]) >> (place & 63) & 1:
                return False
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of many signed keys pass."""
        keys, found = keys.view(np.uint64), np.ones(keys.size, bool)
        for k in self.SHIFTS:
            place = keys >> np.uint64(k) & np.uint64(self.mask)
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def fragments(docs: DataFrame, width: int, order: Order, members: Members) -> DataFrame:
    """(node, fragment, grams) of the sets whose texts are in ``members``: full sets, cut where the global order is cut (eight ranges of
    the first class, then one for each further class); a set that the task has met before is left out."""
    shared = docs.sparkSession.sparkContext.broadcast((order, members))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, members = shared.value
        met: set[int] = set()

        def batch_of(nodes: list[int], parts: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(g.size for g in grams)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()),
                                               pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], names=["node", "fragment", "grams"])

        for batch in batches:
            out, size = ([], [], []), 0
            for _, text in texts(batch, 0):
                text_key = _text_key(text)
                if text_key not in members or text_key in met:
                    continue
                if len(met) < REMEMBERED:
                    met.add(text_key)
                grams = shingles(text, width)
                if not grams.size:
                    continue
                node, key = _digest(grams), order.keys(grams)
                top = (key >> np.uint64(58)).astype(np.int64)
                part = np.where(top < 8, top, 7 + (top >> 3))  # grows with the key
                edge = np.flatnonzero(np.diff(part)) + 1
                for f, piece in zip(part[np.concatenate([[0], edge])].tolist(), np.split(_signed(key), edge)):
                    for c, value in zip(out, (node, f, piece)):
                        c.append(value)
                size += key.size
                if size > 200_000:
                    yield batch_of(*out)
                    out, size = ([], [], []), 0
            if size:
                yield batch_of(*out)

    return docs.select("text").mapInArrow(task, "node long, fragment int, grams array<long>")


def _short(gram: str) -> Column:
    """The last 16 bits of an order key, which are bits of its hash."""
    return (F.col(gram).bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint")


def _halved(parities: str, other: str) -> Column:
    """A table of parities folded once if it is longer than the other."""
    table, half = F.col(parities), F.floor(F.size(parities) / 2).cast("int")
    folded = F.zip_with(F.slice(table, F.lit(1), half), F.slice(table, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(parities) > F.size(other), folded).otherwise(table)


class _Join:
    """What the steps share: the documents, the order, the groups of the leading fragment."""

    def __init__(self, docs: DataFrame, width: int, percent: int, order: Order, known: DataFrame | None = None):
        self.docs, self.width, self.percent, self.order = docs, width, percent, order
        self.known = cut(nodes(scan(docs, width).where("kind = 0")), "nodes") if known is None else known
        # one shuffle by shingle serves the repeats of a set, which other tasks have met, and the count
        met = leading(docs, width, percent, order).repartition("gram").groupBy("gram", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
        lists = cut(met.withColumn("held", F.count("*").over(Window.partitionBy("gram"))).where("held > 1"), "lists")
        heads = lists.groupBy("node").agg(F.first("n").alias("n"), F.collect_set(_short("gram")).alias("grams"),
                                          F.count("*").alias("held_grams"), (F.sum("held") / F.first("n")).alias("central"))
        self.heads = cut(heads.join(self.known.select("node", "text_key", "parities"), "node"), "heads")
        self.lists = cut(lists.drop("held").join(self.heads.select("node", "central"), "node"), "lists")

    def near_size(self):
        """Sizes that allow the threshold, and positions in the leading part that allow the overlap it needs."""
        need = F.ceil(self.percent * (F.col("na") + F.col("nb")) / (100 + self.percent))
        return ((F.lit(100) * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
                & (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need))

    def to_hubs(self) -> DataFrame:
        """Each member of a group with the group's most central member."""
        hub = (self.lists.groupBy("gram").agg(F.min(F.struct(-F.col("central"), "node", "n", "pos")).alias("h"))
               .select("gram", F.col("h.node").alias("hub"), F.col("h.n").alias("nh"), F.col("h.pos").alias("ph")))
        first = F.col("hub") < F.col("node")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        return (self.lists.join(hub, "gram").where("hub <> node")
                .select(pick("hub", "node").alias("a"), pick("nh", "n").alias("na"), pick("ph", "pos").alias("pa"),
                        pick("node", "hub").alias("b"), pick("n", "nh").alias("nb"), pick("pos", "ph").alias("pb"))
                .where(self.near_size()).select("a", "na", "b", "nb").distinct())

    def across(self, labels: DataFrame) -> DataFrame:
        """Pairs of a group whose ends are in different components."""
        named = (self.lists.join(labels, "node", "left")
                 .withColumn("label", F.coalesce("component", "node")))
        split = named.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
        open_ = cut(named.join(split.select("gram"), "gram", "left_semi"), "open")
        side = lambda d, n, p, k: open_.select("gram", F.col("node").alias(d), F.col("n").alias(n),
                                               F.col("pos").alias(p), F.col("label").alias(k))
        return (side("a", "na", "pa", "ka").join(side("b", "nb", "pb", "kb"), "gram")
                .where((F.col("a") < F.col("b")) & (F.col("ka") != F.col("kb")) & self.near_size())
                .select("a", "na", "b", "nb").distinct())

    def similar(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that reach the threshold."""
        pairs = cut(self._promising(pairs), label)
        if is_empty(pairs):
            return pairs.select("a", "b")
        wanted = pairs.select(F.col("key_a").alias("text_key")).union(pairs.select("key_b")).distinct()
        sets = cut(fragments(self.docs, self.width, self.order, Members(wanted)).groupBy("node", "fragment").agg(F.first("grams").alias("grams")), "fragments")
        left = sets.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = sets.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
        return cut(pairs.join(left, "a").join(right, ["b", "fragment"])
                   .select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
                   .groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("common"))
                   .where(F.lit(100) * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common")))
                   .select("a", "b"), "similar")

    def _promising(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose count in the leading fragment and whose parities leave the threshold within reach.

        The set whose leading part ends first in the order has all its common shingles of that part in the other's
        leading part too, so the overlap is at most this count plus what follows the leading part.  The count is taken
        from the last 16 bits of each shingle, as these sets travel with every pair; shingles of a set that share them
        are added, so it is never too small.  The parities bound what only one of the sets holds, also behind the leading
        part, so hardly a pair that meets by chance is left whose full sets would have to be moved.
        """
        rest = lambda n: F.ceil(self.percent * F.col(n) / 100) - 1
        left = self.heads.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("text_key").alias("key_a"), F.col("parities").alias("pa"))
        right = self.heads.select(F.col("node").alias("b"), F.col("grams").alias("gb"), (F.col("held_grams") - F.size("grams")).alias("alike"),
                                  F.col("text_key").alias("key_b"), F.col("parities").alias("pb"))
        most = F.size(F.array_intersect("ga", "gb")) + F.col("alike") + F.greatest(rest("na"), rest("nb"))
        both = pairs.join(left, "a").join(right, "b").where((100 + self.percent) * most >= self.percent * (F.col("na") + F.col("nb")))
        for _ in range((100 // self.percent).bit_length()):  # so many doublings lie between sizes that allow the threshold
            both = both.withColumns({"pa": _halved("pa", "pb"), "pb": _halved("pb", "pa")})
        apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        total = F.col("na") + F.col("nb")
        return (both.where(apart <= total - 2 * F.ceil(self.percent * total / (100 + self.percent)))
                .select("a", "na", "key_a", "b", "nb", "key_b"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, order_tail: int = ORDER_TAIL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more.  ``component_id`` is the smallest doc_id reachable by links.  Null and empty texts have size 0 and link with
    nothing.  Rows that repeat a doc_id stay rows and link by their own texts; a row with a null doc_id keeps its size,
    links like any other and takes the smallest doc_id it reaches, if there is one.  An empty table gives an empty result.
    Shingles are compared by 61 bits of a hash and sets told apart by a digest of 64 bits; but for their collisions no link
    is lost for any input.  ``order_tail`` bounds memory and changes the cost only.
    """
    docs = docs.select("doc_id", "text")
    seen = cut(scan(docs, width), "scan")
    known = cut(nodes(seen.where("kind = 0")), "nodes")
    sets = seen.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node")
    often = (seen.where("kind = 1").groupBy("node").agg(F.sum("n").alias("held"))
             .orderBy(F.desc("held"), "node").limit(order_tail).toPandas())
    order = Order(often["node"].to_numpy(np.int64).view(np.uint64), often["held"].to_numpy(np.int64))
    join = _Join(docs, width, percent, order, known)
    edges = join.similar(join.to_hubs(), "hub_pairs")
    labels = components(edges)
    more = join.similar(join.across(labels), "cross_pairs")
    if not is_empty(more):
        labels = components(edges.union(more))
    named = cut(known.select("node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    linked = sets.where("n_shingles > 0").join(of_node, "node")
    alone = sets.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of ``jaccard_components``: the smallest doc_id.

    Documents without words stay.  Of rows that repeat doc_id and text one stays; a row with a null doc_id stays unless
    its text equals that of a row that has one.
    """
    groups = cut(jaccard_components(docs, width, percent), "groups")
    ids = cut(groups.where("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows")), "ids")
    nameless = not is_empty(docs.where("doc_id IS NULL"))
    named, key = docs.where("doc_id IS NOT NULL"), F.xxhash64(F.col("doc_id").cast("long"))
    asked = named.sparkSession.sparkContext.broadcast(Members(ids.where("NOT stays OR rows > 1").select(key.alias("text_key"))))

    @F.pandas_udf("boolean")
    def in_question(keys: pd.Series) -> pd.Series:
        return pd.Series(asked.value.holds(keys.to_numpy(np.int64)))

    # only rows in question move to their ids; the texts of all others stay where they are
    some = named.where(in_question(key)).join(ids.where("stays").select("doc_id"), "doc_id", "left_semi")
    if not is_empty(ids.where("stays AND rows > 1")):
        some = some.dropDuplicates(["doc_id", "text"])
    kept = named.where(~in_question(key)).unionByName(some)
    if nameless:
        digest = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
        known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(digest(F.col("text")).alias("known")).distinct().alias("k")
        nobody = docs.where("doc_id IS NULL").alias("d")
        kept = kept.unionByName(nobody.join(known, digest(F.col("d.text")) == F.col("k.known"), "left_anti"))
    return kept.select(docs.columns)
