"""Top k against all pairs."""

import random

import numpy as np
import pytest
from procatlas.llm import vectors


def brute(rows, k, scale):
    whole = {(i, tuple(int(np.floor(scale * float(np.float32(c)))) for c in v)) for i, v in rows
             if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q, x in whole:
        if q % 20 == 0:
            others = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(y) == len(x)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(others)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, h string, rank int").repartition(3)


@pytest.mark.parametrize("cells,block", [(64, 1 << 16), (4, 50), (1, 1 << 16)])
def test_equals_all_pairs(spark, monkeypatch, cells, block):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    rng = random.Random(cells)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(220)]
    rows += [(300 + k, rows[7][1]) for k in range(90)]  # many equal vectors
    rows += [(400 + 20 * k, rows[7][1]) for k in range(3)] + [rows[20], rows[20]]
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [0.0] * 8)]
    rows += [(600, [1.0, 2.0]), (601, [2.0, 2.0]), (602, [0.5, 0.1]), (700, []), (720, [0.0] * 8)]
    got = vectors.top_k(frame(spark, rows), k=20, cells=cells)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 64.0)


def test_few_and_none(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, -0.5]), (20, [0.1, 0.1])]
    assert sorted(map(tuple, vectors.top_k(frame(spark, rows), k=20).collect())) == brute(rows, 20, 64.0)
    assert vectors.top_k(frame(spark, rows).limit(0)).collect() == []
    assert vectors.top_k(frame(spark, [(1, [0.5])])).collect() == []
