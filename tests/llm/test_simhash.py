"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from procatlas.llm import simhash


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Smallest index reachable over pairs within the radius."""
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def brute(rows):
    prints = [plain(t) for _, t in rows]
    out, least = [], {}
    for (i, _), g in zip(rows, groups(prints, 4)):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, groups(prints, 4))]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_equals_all_pairs(spark, documents):
    rng = random.Random(3)
    word = lambda: rng.choice("lorem ipsum Dolor été sit amet 日本 x y z".split()) + str(rng.randrange(30))
    base = [[word() for _ in range(rng.choice([3, 10, 200, 400]))] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(120):  # near copies
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = word()
        rows.append((100 + k, "\t".join(w)))
    rows += [(300 + k, rows[2][1].upper()) for k in range(80)] + [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (None, "alone of them all"), (2, "A b c d e")]
    got = simhash.simhash_components(documents(rows, 5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark, documents):
    assert simhash.simhash_components(documents([])).count() == 0


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = " ".join(f"Word{k % 97}" for k in range(3000)) + "\n" + "q" * 900 + " end"
    whole = plain(text)
    monkeypatch.setattr(simhash, "_PIECE", 50)
    assert simhash.fingerprint(text.encode(), 4) == whole and simhash.fingerprint(b"a b\x0bC", 4) == plain("a b c")


def spread(rng, n):
    """Prints in tight clusters, in chains, and alone."""
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        p = rng.getrandbits(64)
        out.add(p)
        for _ in range(rng.choice([0, 2, 12])):
            q = p
            for _ in range(rng.randrange(1, 7)):
                q ^= 1 << rng.randrange(64)
            out.add(q)
            p = q if rng.random() < 0.5 else p
    return sorted(out)


@pytest.mark.parametrize("blocks,tree_rows", [(5, 8192), (5, 4), (6, 8192), (7, 3), (None, 10)])
def test_links_join_all_near_prints(spark, blocks, tree_rows):
    values = spread(random.Random(blocks or 9), 400)
    want = groups(values, 4)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long").repartition(3)
    at = {v - (1 << 64) if v >> 63 else v: k for k, v in enumerate(values)}
    label = list(range(len(values)))
    links = simhash.near_prints(rows, 4, blocks, tree_rows).distinct().collect()
    for _ in values:
        for a, b in links:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
    assert label == want


def test_trees_find_exactly_the_near_rows():
    rng = random.Random(5)
    prints = np.array(spread(rng, 600), np.uint64)
    shard = np.sort(np.array([rng.randrange(6) for _ in prints]))
    trees = simhash.Trees(prints, shard, 6)
    query, row = trees.near(prints, shard, 4)
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = np.argwhere((distance <= 4) & (shard[:, None] == shard[None, :]))
    assert sorted(zip(query.tolist(), row.tolist())) == sorted(map(tuple, want.tolist()))
