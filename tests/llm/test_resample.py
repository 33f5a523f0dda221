"""Resampling against a plain loop, for several range counts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from procatlas.llm import resample, terms


def runs_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets, longest, least, percent):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    have, want = [0] * buckets, [0] * buckets
    for rows, into in ((docs, have), (target, want)):
        for _, text in rows:
            for run in runs_of(text, longest):
                into[bucket(run)] += 1
    S, T = sum(have), sum(want)
    gain = [math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for s, t in zip(have, want)]
    out, fit = [], []
    for doc_id, text in docs:
        found = runs_of(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(runs_of(text, 1)) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(fit[:percent * len(fit) // 100]):
        row[4] = k + 1
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def texts(n):
    rng = random.Random(n)
    vocabulary = ["a", "B7", "état", "Zug", "x" * 70, "日本", "don", "t", "99"]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\t", "-"]) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("ranges,longest", [(None, 1), (1, 1), (7, 1), (40, 2)])
def test_equals_plain_loop(spark, documents, ranges, longest):
    rows = [(k, t) for k, t in enumerate(texts(300))] + [(900, None), (901, ""), (902, "... !"), (None, "a a a a zug zug"), (None, "B7 état")]
    rows += [(500, "a B7 zug état 99")] * 120 + [(-4, "A b7 ZUG état 99")]  # a third of the rows repeat
    target = [(1, "état Zug 99"), (2, None), (3, "日本 日本 don")]
    got = resample.resample(documents(rows, 5), spark.createDataFrame(target, "item_id long, text string"), buckets=50, longest=longest,
                            least_terms=3, percent=30, ranges=ranges)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, brute(rows, target, 50, longest, 3, 30)), key=key)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(documents([]), none).count() == 0
    rows = [(k, f"w{k} of many words") for k in range(30)]
    got = resample.resample(documents(rows), none, least_terms=1)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, brute(rows, [], 10_000, 1, 1, 10)), key=key)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_long_texts_are_cut_without_a_trace(monkeypatch, longest):
    monkeypatch.setattr(terms, "PIECE", 64)
    text = " ".join(texts(200)) + "y" * 500 + " end"
    got = [v for _, values in terms.run_hashes([(0, text.encode()), (1, b"a a")], longest) for v in values.tolist()]
    assert sorted(got) == sorted(zlib.crc32(r.encode()) for r in [*runs_of(text, longest), *runs_of("a a", longest)])
    monkeypatch.setattr(terms.pieces, "__defaults__", (64,))
    got = [v for _, values in terms.run_hashes([(0, text.encode()), (1, b"a a")], longest) for v in values.tolist()]
    assert sorted(got) == sorted(zlib.crc32(r.encode()) for r in [*runs_of(text, longest), *runs_of("a a", longest)])


def test_crc_of_ranges():
    data = np.frombuffer(("ab " + "q" * 300 + " é1").encode(), np.uint8)
    start, end = np.array([0, 3, 304, 0]), np.array([2, 303, 307, 0])
    assert terms.crc32(data, start, end).tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(start, end)]
