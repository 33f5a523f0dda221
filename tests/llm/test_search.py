"""Ranked search against a plain loop with whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from procatlas.llm import search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item_id, text in sorted(set(items), key=str):
        rows = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * N // L
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            rows += [(-score, doc_id is None, doc_id or 0, doc_id)] if score > 0 else []
        out += [(item_id, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows)[:k])]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def made(n, seed, most):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["État", "ÉTAT", "日本", "The", "A1"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most))) + rng.choice([".", "", "!?"]) for _ in range(n)]


@pytest.mark.parametrize("tile,most_weight,block", [(None, None, 1 << 20), (3, 40_000, 200), (1, 700, 1 << 20)])
def test_equals_plain_loop(spark, documents, monkeypatch, tile, most_weight, block):
    if tile:
        monkeypatch.setattr(search, "TILE_TERMS", tile)
        monkeypatch.setattr(search, "TILE_ITEMS", tile)
        monkeypatch.setattr(search, "_MOST_WEIGHT", most_weight)
    docs = [(k, t) for k, t in enumerate(made(150, 1, 30))] + [(600, None), (601, ""), (602, "?!"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    docs += [(700 + k, "w5 w6 w7 w8") for k in range(60)] + [(700, "w5 w6 w7 w8")] * 2 + [(-1, "w5 W6 w7 w8")]
    items = list(enumerate(made(9, 2, 12))) + [(20, None), (21, ""), (22, "unknown"), (23, "w5 w5 w6 the"), (23, "w5 w5 w6 the"), (None, "w9"), (1, "w8 w8")]
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, score int, term string").repartition(2)
    got = search.search(documents(docs, 4), table, k=5, block_bytes=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = brute(docs, [(i, t) for i, t in items if t is not None], 5)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert search.search(documents([]), items).count() == 0
    assert search.search(documents([(1, "w1")]), items.limit(0)).count() == 0


def test_pieces_stay_below_the_bound(monkeypatch):
    monkeypatch.setattr(search, "_MOST_WEIGHT", 100)
    block = search.Block([(1, b"a a a b"), (2, b"b c")])
    tiles = search.Tiles(block, [90, 60, 0])  # item 1 needs 270 + 60
    (_, _, pieces), = tiles.tiles
    assert len(pieces) > 1 and all(w.sum(axis=0).max() <= 100 for _, w in pieces)
    total = sum(w[np.flatnonzero(own == t)].sum(axis=0) for own, w in pieces for t in own)
    assert total.tolist() == [330.0, 60.0]
