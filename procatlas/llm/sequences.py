"""Token ids in training order: fixed-stride binary shards that can be read in order and resumed anywhere.

1. Each task encodes its documents and packs them, with an end token after each, into sequences of equal length.
2. Sequences are numbered 0..N-1 over all tasks.  A keyed Feistel network permutes the next power of four, and walks on
   along its cycle while it is outside 0..N-1: every sequence gets one global slot, every slot one sequence.
3. Slots are cut into ranges, one range per shard.  A task gathers a range, sorts it and writes its records.

A record is ``length`` little-endian ids and one newline, so slot s lies at ``(s % shard_slots) * stride`` of shard
``s // shard_slots``.  Spark's own text writer writes the shards, so they are committed with the job on any file system
that Spark can write, and a lost task is written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procatlas.llm.bpe import public_files, worker_bpe
from procatlas.session import cut

LENGTH = 512
SHARD_SLOTS = 1 << 14
ROUNDS = 4
#: Sequences compressed together on their way.
_GROUP = 256
_HELD = 32 << 20
#: Bytes of dealt records in one Arrow batch: the JVM holds a batch outside its heap.
_SENT = 1 << 20


class Permutation:
    """Keyed bijection of 0..n-1: Feistel network on an even number of bits, with cycle-walking."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._round(right, k)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ self._round(left, k), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._forth)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def pack(docs: DataFrame, length: int, tokenizer_file: str, pattern: str) -> DataFrame:
    """(part, first, n, data): compressed groups of packed sequences of each task, numbered from 0 in the task."""
    ranked = (tokenizer_file, pattern) == public_files()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        bpe, part, squeeze = worker_bpe(tokenizer_file, pattern, ranked), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        end = len(bpe.token_bytes) - 1
        width = np.uint16 if end < 1 << 16 else np.uint32
        waiting, held, first = [], 0, 0

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, first
            ids = np.concatenate(waiting) if waiting else np.zeros(0, width)
            if last and ids.size % length:
                ids = np.concatenate([ids, np.full(-ids.size % length, end, width)])
            whole = ids.size // length if last else ids.size // (length * _GROUP) * _GROUP
            rows = []
            for at in range(0, whole, _GROUP):
                n = min(_GROUP, whole - at)
                rows.append((part, first, n, squeeze.compress(ids[at * length:(at + n) * length].tobytes())))
                first += n
            waiting, held = [ids[whole * length:]], ids.size - whole * length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                                 names=["part", "first", "n", "data"])

        for batch in batches:
            for text in batch.column(0):
                ids = np.frombuffer(bpe.encode(text.as_py() or ""), np.uint32).astype(width)
                if ids.size:
                    waiting += [ids, np.array([end], width)]
                    held += ids.size + 1
                if held > 1 << 20:
                    yield from groups(False)
        yield from groups(True)

    return docs.select("text").mapInArrow(task, "part int, first long, n int, data binary")


def materialise(docs: DataFrame, path: str, key: int = 1, length: int = LENGTH, shard_slots: int = SHARD_SLOTS,
                tokenizer_file: str | None = None, pattern: str | None = None) -> int:
    """Write the sequences of ``docs`` (text) as shards under ``path`` and return their number.

    Null and empty texts add nothing; repeated rows are repeated in the sequences; other columns are ignored.  The last
    sequence of a task is filled with end tokens.  Without a token no shard is written.  Running again with the same
    input files, key and settings gives the same order.
    """
    spark = docs.sparkSession
    file, cut_by = tokenizer_file or public_files()[0], pattern or public_files()[1]
    packed = cut(pack(docs, length, file, cut_by), "packed")
    parts = packed.groupBy("part").agg(F.sum("n").alias("n"))  # one row per task
    total = parts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    shards, order = -(-total // shard_slots), Permutation(total, key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots and records of each shard, compressed in groups."""
        import zstandard

        squeeze, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        size = 0

        def batch_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                              names=["shard", "slots", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            rows, sent = [], 0
            for shard, pieces in held.items():
                slots, records = (np.concatenate(x) for x in zip(*pieces))
                for at in range(0, slots.size, _GROUP):
                    part = slice(at, at + _GROUP)
                    rows.append((shard, slots[part].tobytes(), squeeze.compress(records[part].tobytes())))
                    sent += len(rows[-1][1]) + len(rows[-1][2])
                    if sent > _SENT:
                        yield batch_of(rows)
                        rows, sent = [], 0
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for first, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                slots = order.slot(np.arange(first, first + n))
                records = np.frombuffer(open_.decompress(data), np.uint8).reshape(n, -1)
                shard = slots // shard_slots
                for k in np.unique(shard).tolist():
                    held.setdefault(k, []).append((slots[shard == k], records[shard == k]))
                size += records.size
            if size > _HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard's records in the order of their slots: a task holds one shard."""
        import zstandard

        open_, slots, found = zstandard.ZstdDecompressor(), [], []
        for batch in batches:
            for s, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                slots.append(np.frombuffer(s, np.int64))
                found.append(np.frombuffer(open_.decompress(data), np.uint8).reshape(slots[-1].size, -1))
        if slots:
            place, rows = np.concatenate(slots), np.concatenate(found)
            for at in np.array_split(np.argsort(place), max(1, place.size // 1024)):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[at]], pa.binary())], names=["record"])

    dealt = (packed.join(F.broadcast(base), "part").select((F.col("base") + F.col("first")).alias("first"), "n", "data")  # a row per task
             .mapInArrow(deal, "shard int, slots binary, data binary"))
    (dealt.repartitionById(shards, "shard").mapInArrow(records, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\n").text(path))
    return total


def _shards_from(first: int) -> str:
    """Glob of the file names of shard ``first`` and all after it."""
    digits = f"{first:05d}"
    ahead = [digits] + [f"{digits[:k]}[{int(d) + 1}-9]{'?' * (len(digits) - k - 1)}" for k, d in enumerate(digits) if d < "9"]
    longer = ["[1-9]" + "?" * (n - 1) for n in range(len(digits) + 1, 11)]
    return "part-{" + ",".join(ahead + longer) + "}-*"


def read_sequences(spark: SparkSession, path: str, total: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS,
                   first_slot: int = 0, wide: bool = False) -> DataFrame:
    """(slot, shard, offset, ids binary) of all records from ``first_slot`` on; earlier shards are not opened.

    A task holds one shard and cuts it into records inside the JVM's heap; only records leave it, never a shard as one value.
    """
    stride = length * (4 if wide else 2) + 1
    if not total:
        return spark.createDataFrame([], "slot long, shard int, offset long, ids binary")
    opened = spark.read.format("binaryFile").option("pathGlobFilter", _shards_from(first_slot // shard_slots)).load(path)
    shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    least, n = F.greatest(F.lit(0), first_slot - shard * shard_slots).cast("int"), F.floor(F.col("length") / stride).cast("int")
    places = F.when(least < n, F.sequence(least, n - 1)).otherwise(F.array().cast("array<int>"))
    # the array of one holds the content, which a column reference would copy for every record
    records = F.transform(F.array("content"), lambda content: F.transform(
        places, lambda k: F.struct(k.alias("k"), content.substr(k * stride + 1, F.lit(stride - 1)).alias("ids"))))[0]
    return (opened.select(shard.alias("shard"), F.explode(records).alias("record"))
            .select((F.col("shard") * shard_slots + F.col("record.k")).alias("slot"), F.col("shard").cast("int").alias("shard"),
                    (F.col("record.k").cast("long") * stride).alias("offset"), F.col("record.ids").alias("ids")))
