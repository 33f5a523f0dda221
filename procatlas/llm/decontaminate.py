"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words of a window at the positions a fixed mask keeps, so a substituted word at an ignored position
leaves the hash as it was.  Seeds of the benchmark and of every training window are joined on the hash; each hit fixes
an alignment of an item with a document, and the words along that alignment are compared.  The masks leave out no
stretch that counts as held, wherever its substitutions lie.

The benchmark is the stated query set.  It is taken in blocks of bounded size: a block's seeds go to every task, and
each block is one scan of the documents.  The documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.llm.words import mix, word_hashes

#: From which share on, kept positions of a window.  Every stretch that counts as held keeps all words of a window under
#: some mask.  At 0.75 that is tried for all substitution sets of stretches up to 31 words; a longer one splits into two
#: of at least 16 words of which one has the share, hence 12 matches.  At 0.5, matches three or more words apart would
#: be too few.  Below that any matching word is a seed.
MASKS = ((0.75, ("10111", "111001", "1001011")), (0.5, ("11", "101")), (0.0, ("1",)))
#: Items with fewer words say too little and match nothing.
LEAST_WORDS = 8
#: Words of benchmark text in one block.
BLOCK_WORDS = 1_000_000
_BITS = 22
#: Hits, and words along their alignments, that are compared at a time.
_HITS = 1 << 18


def masks(share: float) -> tuple[str, ...]:
    """The masks that find every stretch with at least ``share`` matching words."""
    return next(m for least, m in MASKS if share >= least)


def _seed(words: np.ndarray, kept: list[int], salt: int) -> np.ndarray:
    """Hash of each window at the kept positions."""
    count = words.size - kept[-1]
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(len(kept), dtype=np.uint64) + np.uint64(64 * salt + 7)) | np.uint64(1)
    total = np.full(count, np.uint64(salt), np.uint64)
    for f, k in zip(factor, kept):
        total += words[k:k + count] * f
    return mix(total)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those from first[1] on, and so forth."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _pieces(n: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive parts of ``n`` with a sum of at most ``most``, or one element."""
    sums, at = np.cumsum(n), 0
    while at < n.size:
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


class Seeds:
    """Sorted seeds of some items, and the items' words for verification."""

    def __init__(self, items: list[tuple[int, bytes]], share: float):
        self.ids, self.words = [], []
        for item_id, text in items:
            words = word_hashes(text)[0]
            if words.size >= LEAST_WORDS:
                self.ids.append(item_id)
                self.words.append(words)
        self.size = np.array([w.size for w in self.words], np.int64)
        self.least = np.array([int(np.ceil(share * min(w.size, 16))) for w in self.words], np.int64)
        self.share = share
        self.begin = np.cumsum(self.size) - self.size  # of each item in all words
        self.all = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.shapes = [([j for j, c in enumerate(m) if c == "1"], k) for k, m in enumerate(masks(share))]  # (kept positions, salt)
        hashes, item, offset = [], [], []
        for kept, salt in self.shapes:
            for k, words in enumerate(self.words):
                h = _seed(words, kept, salt)
                hashes.append(h)
                item.append(np.full(h.size, k))
                offset.append(np.arange(h.size))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        at = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[at]
        self.item = np.concatenate(item)[at] if item else at
        self.offset = np.concatenate(offset)[at] if item else at
        self.first = np.zeros(1 << _BITS, bool)  # first bits of the seeds: most windows end here
        self.first[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def alignments(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, start of the item in ``words``, matching words) of the hits with enough matches for the item."""
        found = []
        wide = words.size + int(self.size.max(initial=0)) + 1
        for kept, salt in self.shapes:
            h = _seed(words, kept, salt)
            at = np.flatnonzero(self.first[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for part in _pieces(n, _HITS):
                place = _ranges(lo[part], n[part])
                start = np.repeat(at[part], n[part]) - self.offset[place]
                keys = np.unique(self.item[place] * wide + (start + wide - words.size))
                item, start = keys // wide, keys % wide - (wide - words.size)
                total = self._matches(words, item, start)
                enough = total >= self.least[item]
                found.append(np.stack([item[enough], start[enough], total[enough]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _matches(self, words: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Matching words of each alignment."""
        a = np.maximum(0, start)
        n = np.minimum(words.size, start + self.size[item]) - a
        total = np.zeros(item.size, np.int64)
        for part in _pieces(n, _HITS):
            same = words[_ranges(a[part], n[part])] == self.all[_ranges(self.begin[item[part]] + a[part] - start[part], n[part])]
            total[part] = np.add.reduceat(same, np.cumsum(n[part]) - n[part], dtype=np.int64)
        return total

    def overlaps(self, words: np.ndarray, item: int, start: int) -> tuple[int, int, int]:
        """(matching words, first word, words) of the stretch along one alignment that has the wanted share of matches and
        the most of them; the shortest of several, then the first.

        A match counts 1 and a substitution takes away so much that a stretch at the wanted share is just worth nothing.
        """
        own = self.words[item]
        a, b = max(0, start), min(words.size, start + own.size)
        same = words[a:b] == own[a - start:b - start]
        cost = self.share / (1 - self.share) if self.share < 1 else float(own.size)
        sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -cost))])
        # the first place from which on a stretch to each end is worth nothing or more, then the first match behind it
        begin = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-9, "left")
        hits = np.flatnonzero(same)
        begin = np.append(hits, same.size)[np.searchsorted(hits, begin, "left")]
        count = np.concatenate([[0], np.cumsum(same)])
        end = np.arange(sums.size)
        begin = np.minimum(begin, end)
        got = count - count[begin]
        best = int(np.lexsort((begin, end - begin, -got))[0])
        return int(got[best]), a + int(begin[best]), int(end[best] - begin[best])


def _word_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 200_000):
            size += len(texts[stop]) + 1
            stop += 1
        words, start, _ = word_hashes(b"\n".join(texts[at:stop]))
        cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[at:stop]]))
        first = 0
        for k, cut in enumerate(cuts):
            yield at + k, words[first:cut]
            first = cut
        at = stop


def _leaks(seeds: Seeds, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, matching words, first word, words) of each item found in each text, its best alignment."""
    for row, words in _word_runs(texts):
        best: dict[int, tuple[int, int, int]] = {}
        for item, start, total in seeds.alignments(words).tolist():
            if item in best and (-total, max(0, start)) >= (-best[item][0], best[item][1]):
                continue  # cannot be better
            got = seeds.overlaps(words, item, start)
            if got[0] >= seeds.least[item] and (item not in best or (-got[0], got[1]) < (-best[item][0], best[item][1])):
                best[item] = got
        for item, got in sorted(best.items()):
            yield row, seeds.ids[item], *got


def _blocks(benchmark: DataFrame, share: float, block_words: int) -> Iterator[Seeds]:
    """The benchmark's distinct texts in blocks that fit a task."""
    words = F.size(F.split("text", "\\s+"))
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(words)).first()[0] or 0
    count = max(1, -(-total // block_words))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()
        yield Seeds(sorted((r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in rows), share)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index("text"))
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.75, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_matched, first_word, n_words): items of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text).

    A document holds an item when along one alignment a stretch with at least ``share`` matching words has
    ``ceil(share * 16)`` matches, or ``ceil(share * n)`` for an item of n < 16 words; the row tells of the stretch with
    the most matches, the shortest of several.  Every such item is found.  Words are compared with A-Z lowered.  Items with equal texts count as one under the smallest item_id; items under eight words and null texts
    match nothing.  Empty documents give no row; rows that repeat give repeated rows; other columns are ignored.
    """
    parts = []
    for seeds in _blocks(benchmark, share, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_leaks(shared.value, _texts(batch)))
                ids = batch.column(0).to_pylist()
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    names=["doc_id", "item_id", "n_matched", "first_word", "n_words"])

        parts.append(docs.select("doc_id", "text").mapInArrow(
            task, "doc_id long, item_id long, n_matched long, first_word long, n_words long"))
    return reduce(DataFrame.union, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.75, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``; see ``find_leaks``."""
    for seeds in _blocks(benchmark, share, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _leaks(shared.value, _texts(batch)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
