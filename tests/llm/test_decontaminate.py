"""Leaks with substitutions, clean documents, blocks."""

import itertools
import random

from procatlas.llm.decontaminate import Seeds, _leaks, decontaminate, find_leaks, masks

RNG = random.Random(3)
VOCABULARY = [f"v{k}" for k in range(3000)]


def text(n):
    return RNG.choices(VOCABULARY, k=n)


ITEMS = [(k, text(n)) for k, n in enumerate([15, 20, 25, 40, 60, 12, 9, 8, 30, 5])]


def bench(spark, extra=()):
    rows = [(k, " ".join(w)) for k, w in ITEMS] + list(extra)
    return spark.createDataFrame(rows, "item_id long, text string")


def planted():
    rows, want = [], set()
    for k, words in ITEMS:
        if len(words) < 8:
            continue
        rows.append((10 * k, " ".join(text(200) + words + text(50))))  # whole, exact
        rows.append((10 * k + 1, " \n".join(w.upper() for w in words)))
        want |= {(10 * k, k), (10 * k + 1, k)}
        if len(words) >= 20:  # every seventh word substituted
            w = [v if j % 7 != 3 else "changed" for j, v in enumerate(words)]
            rows.append((10 * k + 2, " ".join(text(30) + w)))
            want.add((10 * k + 2, k))
            rows.append((10 * k + 3, " ".join(text(30) + words[:8] + text(30))))  # too little of it
    rows += [(1000 + k, " ".join(text(400))) for k in range(30)]
    return rows, want


def test_planted_and_clean(spark, documents):
    rows, want = planted()
    for block_words in (1_000_000, 60):
        got = find_leaks(documents(rows), bench(spark), block_words=block_words)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    exact = [r for r in find_leaks(documents(rows), bench(spark)).collect() if r.doc_id == 30]
    assert [(r.n_matched, r.first_word, r.n_words) for r in exact] == [(40, 200, 40)]


def test_decontaminate_keeps_clean_rows(spark, documents):
    rows, want = planted()
    docs = documents(rows + [(None, None), (5000, ""), (5000, "")])
    got = decontaminate(docs, bench(spark), block_words=60)
    assert got.columns == docs.columns
    bad = {d for d, _ in want}
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([d for d, _ in rows if d not in bad] + [None, 5000, 5000], key=repr)


def test_edges(spark, documents):
    none = bench(spark).limit(0)
    assert find_leaks(documents([]), bench(spark)).collect() == []
    assert find_leaks(documents([(1, "a b c")]), none).collect() == []
    assert decontaminate(documents([(1, "a b c")]), none).count() == 1
    same = " ".join(ITEMS[3][1])
    extra = [(77, same), (1, same), (None, same), (78, None), (79, ""), (80, "the " * 40)]
    long = " ".join(text(60_000) + ITEMS[3][1]) + " " + "z" * 300_000
    got = find_leaks(documents([(None, long), (2, "the " * 300), (2, "the " * 300)]), bench(spark, extra)).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(None, 1), (2, 80), (2, 80)], key=repr)


def loop(words, item, start):
    """Most matches of a stretch along an alignment with three matches for each substitution."""
    same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(item)]
    inside = [0 <= start + k < len(words) for k in range(len(item))]
    best = 0
    for i in range(len(item)):
        for j in range(i + 1, len(item) + 1):
            m = sum(same[i:j])
            if all(inside[i:j]) and 4 * m >= 3 * (j - i):
                best = max(best, m)
    return best


def test_every_substitution_set_of_short_items():
    for n in range(8, 17):
        item = text(n)
        seeds = Seeds([(1, " ".join(item).encode())], 0.75)
        least = -(-3 * n // 4)
        for subs in (c for size in range(n // 4 + 2) for c in itertools.combinations(range(n), size)):
            words = ["x", *(f"s{k}" if k in subs else w for k, w in enumerate(item)), "y"]
            got = list(_leaks(seeds, [" ".join(words).encode()]))
            most = loop(words, item, 1)
            assert [g[2] for g in got] == [most] * (most >= least), (n, subs)


def test_random_substitutions_of_longer_items():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(17, 40)
        item = [f"u{k}" for k in range(n)]
        rate = rng.choice([0.15, 0.25, 0.3])
        words = ["s" if rng.random() < rate else w for w in item]
        got = list(_leaks(Seeds([(1, " ".join(item).encode())], 0.75), [" ".join(words).encode()]))
        most = loop(words, item, 0)
        assert [g[2] for g in got] == [most] * (most >= 12), words


def test_masks_leave_out_no_stretch():
    for length in range(12, 21):  # up to 31 when they were chosen
        kept = [sum(1 << k for k, c in enumerate(m) if c == "1") for m in masks(0.75)]
        for subs in itertools.combinations(range(1, length - 1), min(length // 4, length - 12)):
            bits = (1 << length) - 1 - sum(1 << k for k in subs)
            assert any(bits >> s & m == m for m in kept for s in range(length - m.bit_length() + 1)), (length, subs)


def test_lower_shares_and_many_hits():
    rng = random.Random(8)
    for share, n, out in ((0.5, 16, 8), (0.3, 10, 7)):
        item = [f"u{k}" for k in range(n)]
        for _ in range(200):
            subs = set(rng.sample(range(n), out))
            words = [f"s{k}" if k in subs else w for k, w in enumerate(item)]
            assert list(_leaks(Seeds([(1, " ".join(item).encode())], share), [" ".join(words).encode()]))
    seeds = Seeds([(k, " ".join(["|"] * 30 + [f"a{k}b{j}" for j in range(10)]).encode()) for k in range(300)], 0.75)
    assert len(list(_leaks(seeds, [b"| " * 2000]))) == 300
