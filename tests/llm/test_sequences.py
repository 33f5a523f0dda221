"""Permutation, round trip of the shards, resuming."""

from collections import Counter

import numpy as np
import pytest
from procatlas.llm import bpe, sequences
from procatlas.session import fresh_path


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 4096, 5000])
def test_bijection(n):
    p = sequences.Permutation(n, key=5)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert np.array_equal(p.index(slots), np.arange(n))
    if n > 99:
        assert not np.array_equal(slots, sequences.Permutation(n, key=6).slot(np.arange(n)))
        assert np.abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.4


def test_round_trip(spark, documents):
    rows = [(k, f"document number {k} " * (k % 7)) for k in range(60)] + [(None, "x y z"), (3, "same"), (3, "same"), (4, None), (5, "é😀" * 3000)]
    docs, path = documents(rows), fresh_path(spark, "shards")
    total = sequences.materialise(docs, path, key=3, length=16, shard_slots=64)
    got = sequences.read_sequences(spark, path, total, length=16, shard_slots=64).collect()
    assert sorted(r.slot for r in got) == list(range(total))
    assert all(r.offset == r.slot % 64 * 33 and r.shard == r.slot // 64 for r in got)
    own, end = bpe.ByteBpe(*bpe.public_files()), 50256
    order = sequences.Permutation(total, 3)
    by_index = sorted(got, key=lambda r: int(order.index(np.array([r.slot]))[0]))
    stream = np.concatenate([np.frombuffer(r.ids, np.uint16) for r in by_index])
    texts, ids = [], []
    for i in stream.tolist():
        if i == end:
            texts += [own.decode_bytes(np.array(ids, np.uint32).tobytes()).decode()] if ids else []
            ids = []
        else:
            ids.append(i)
    assert Counter(texts) == Counter(t for _, t in rows if t)

    again = fresh_path(spark, "shards")
    assert sequences.materialise(docs, again, key=3, length=16, shard_slots=64) == total
    resumed = sequences.read_sequences(spark, again, total, length=16, shard_slots=64, first_slot=100)
    assert {int(f.rsplit("part-", 1)[1][:5]) for f in resumed.inputFiles()} == set(range(1, -(-total // 64)))  # shard 0 is not opened
    rest = resumed.collect()
    assert sorted((r.slot, bytes(r.ids)) for r in rest) == sorted((r.slot, bytes(r.ids)) for r in got if r.slot >= 100)


def test_shards_from_a_number_on():
    from fnmatch import fnmatch

    for first in (0, 7, 90, 99, 12345, 99999, 100000, 120300):
        some = sequences._shards_from(first)[len("part-{"):-len("}-*")].split(",")
        for n in {*range(0, 300), first - 1, first, first + 1, 99999, 100000, 120299, 120300, 999999, 1000000}:
            if n >= 0:
                assert any(fnmatch(f"{n:05d}", g) for g in some) == (n >= first), (first, n)


def test_nothing_to_write(spark, documents):
    for rows in ([], [(1, None), (2, "")]):
        path = fresh_path(spark, "shards")
        assert sequences.materialise(documents(rows), path) == 0
        assert sequences.read_sequences(spark, path, 0).collect() == []


def test_ranked_encoder_gives_the_same_ids():
    """Every character alone, in words, before and after spaces; long, mixed and repeated texts; beyond the caches."""
    own, ranked = bpe.ByteBpe(*bpe.public_files()), bpe.RankedBpe(*bpe.public_files())
    texts = [f"a{c}b {c} {c}x y{c}. 1{c}2\n{c}" for c in map(chr, [*range(0x500), 0x1680, 0x2003, 0x2028, 0x3000, 0x4E2D, 0xA7C0, 0x1F600])]
    texts += ["", " ", "\n", "  two  spaces ", "a\n\nb\n c", "it's we'll 'tis ' 's", "x" * 5000, "word, " * 500, "é" * 70 + " " + "!" * 90, "a\r\nb \t c"]
    rng = np.random.default_rng(1)
    texts += [" ".join("".join(rng.choice(list("abcdeé.,'19-"), rng.integers(1, 9))) for _ in range(200)) for _ in range(40)]
    for text in texts * 2:
        assert ranked.encode(text) == own.encode(text), text
    one_by_one, calls = bpe.RankedBpe(*bpe.public_files()), []
    ranked_call, one_by_one.model = one_by_one.ranked, None  # new words need no call each
    one_by_one.ranked = lambda text: calls.append(text) or ranked_call(text)
    assert one_by_one.encode("never met before, these words") == own.encode("never met before, these words") and len(calls) == 1


def test_shards_are_cut_inside_the_jvm(spark, documents, monkeypatch):
    """No shard goes to a Python worker as one value; dealt records go out in small batches; any first slot works."""
    monkeypatch.setattr(sequences, "_SENT", 1)
    path = fresh_path(spark, "shards")
    total = sequences.materialise(documents([(k, f"text {k}: one two three " * 9) for k in range(50)]), path, key=7, length=4, shard_slots=100)
    read = lambda first: sequences.read_sequences(spark, path, total, length=4, shard_slots=100, first_slot=first)
    assert "MapInArrow" not in read(0)._jdf.queryExecution().executedPlan().toString()
    whole = {r.slot: bytes(r.ids) for r in read(0).collect()}
    assert sorted(whole) == list(range(total)) and total > 300 and all(len(ids) == 8 for ids in whole.values())
    for first in (1, 99, 100, 101, 250, total - 1, total, total + 500):
        rows = read(first).collect()
        assert {r.slot: bytes(r.ids) for r in rows} == {s: ids for s, ids in whole.items() if s >= first} and len(rows) == max(0, total - first)
