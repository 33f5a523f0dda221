"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from procatlas.llm import words
from procatlas.llm.similarity import jaccard_components, keep_one_of_each

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(rows, width=5):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        out.append((doc_id, {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute(rows, percent=75):
    sets = sets_of(rows)
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted((doc_id, len(s), least[find(k)]) for k, (doc_id, s) in enumerate(sets))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)] + ["Ä", "ß", "İ", "A", "a"]
    line = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for g in range(14):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 90]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "\t "]).join(w)
            rows.append(text + ("\n" + line) * rng.randint(0, 1))
    rows += [None, "", " \n", "one", "ONE", "one two", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(documents, seed):
    rows = corpus(seed)
    got = jaccard_components(documents(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_order_and_its_bound_do_not_change_results(documents):
    rows = corpus(4)
    few = jaccard_components(documents(rows, parts=1), order_tail=5)
    assert sorted(map(tuple, few.collect())) == brute(rows)


def test_chain_of_links_and_hot_group(documents):
    """A chain in which only neighbours link, and many equal and nearly equal documents."""
    base = [f"x{k}" for k in range(120)]
    rows = []
    for step in range(12):  # each step changes two further words
        w = list(base)
        for k in range(2 * step):
            w[(7 * k) % 120] = f"y{k}"
        rows.append((100 + step, " ".join(w)))
    rows += [(1000 + k, "same words in every one of these documents here") for k in range(60)]
    rows += [(2000 + k, " ".join(base[:60]) + f" tail{k}") for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(rows)).collect()}
    assert got == {d: c for d, _, c in brute(rows)}
    assert got[111] == 100 and {got[1000 + k] for k in range(60)} == {1000}


def test_edges_of_input(documents):
    assert jaccard_components(documents([])).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "a b c d e f")]
    got = sorted(map(tuple, jaccard_components(documents(rows)).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (7, 2, 5)], key=repr)


def test_one_of_each_stays(documents):
    rows = [(9, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (1, None), (2, ""), (None, "a b c d e f g"), (None, "other"), (6, "q r s")]
    docs = documents(rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(4, "a b c d e f g"), (1, None), (2, ""), (None, "other"), (6, "q r s")], key=repr)


def test_long_words_and_blocks():
    """Blocks and words over the block size hash like the same words alone."""
    long = ("z" * (words._CHUNK + 100)) + " " + " ".join(f"w{k}" for k in range(60_000)) + " " + "z" * (words._CHUNK + 100)
    h, start, end = words.word_hashes(long.encode())
    assert h.size == 60_002 and h[0] == h[-1]
    assert h[5] == words.word_hashes(b"w4")[0][0] and long[start[5]:end[5]] == "w4"
    assert words.word_hashes(b"ABC \x0b abc")[0].tolist() == [words.word_hashes(b"abc")[0][0]] * 2
    assert np.array_equal(words.shingles(long.encode()), words.shingles(long.upper().replace("Z", "z").encode()))


def test_repeated_and_missing_ids_link_by_their_own_texts(documents):
    """One id with two texts joins the neighbours of both; rows without an id link like others."""
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    rows = [(5, a), (5, b), (7, b + " more"), (9, a + " more"), (20, c), (None, c + " more"), (30, c + " more of it"), (None, "alone here"), (None, None)]
    got = sorted(map(tuple, jaccard_components(documents(rows)).collect()), key=str)
    component = {(d, n): k for d, n, k in got}
    assert component[5, 56] == 5 and component[7, 57] == 5 and component[9, 57] == 5
    assert component[20, 56] == component[None, 57] == component[30, 59] == 20
    assert component[None, 1] is None and component[None, 0] is None and len(got) == len(rows)


def test_tasks_that_remember_nothing(documents, monkeypatch):
    """Sets that every task repeats."""
    from procatlas.llm import similarity

    monkeypatch.setattr(similarity, "REMEMBERED", 0)
    base = [f"x{k}" for k in range(100)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k % 7):
            w[(11 * k + j) % 100] = f"y{k}.{j}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, t) for k, t in rows[:20]] + [(200 + i, t) for i, t in corpus(6)]
    got = jaccard_components(documents(rows, parts=2), order_tail=10_000)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_sets_that_travel_with_pairs_are_short_and_lose_no_link(documents, monkeypatch):
    """Two bytes for each shingle; also with keys that nearly all shingles share."""
    from procatlas.llm import similarity
    from pyspark.sql import functions as F

    rows = corpus(7)
    order = similarity.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    heads = similarity._Join(documents(rows).select("doc_id", "text"), 5, 75, order).heads
    assert heads.schema["grams"].dataType.elementType.simpleString() == "smallint"
    monkeypatch.setattr(similarity, "_short", lambda gram: F.col(gram).bitwiseAND(F.lit(3)).cast("smallint"))
    assert sorted(map(tuple, jaccard_components(documents(rows)).collect())) == brute(rows)


def test_pairs_that_share_half_are_ruled_out_before_their_sets_move(documents):
    """Sets that meet in the leading part but differ behind it, of sizes on both sides of a power of two."""
    from procatlas.llm import similarity

    rows = []
    for g in range(12):
        half = [f"h{g}.{k}" for k in range(40 + 4 * g)]
        rows += [(100 * g + v, " ".join(half + [f"t{g}.{v}.{k}" for k in range(len(half))])) for v in range(3)]
    near = [f"n{k}" for k in range(136)]  # 132 and 126 shingles: tables of 256 and 128 places
    rows += [(5000, " ".join(near)), (5001, " ".join(near[:130]))]
    docs = documents(rows).select("doc_id", "text")
    join = similarity._Join(docs, 5, 75, similarity.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert join.to_hubs().count() > 12
    left = {(r.na, r.nb) for r in join._promising(join.to_hubs()).collect()}
    assert {tuple(sorted(p)) for p in left} == {(126, 132)}
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_bits_in_which_parities_differ_bound_the_difference():
    from procatlas.llm.similarity import _parities

    rng = np.random.default_rng(5)
    for n, more, fewer in ((1, 0, 0), (64, 1, 0), (65, 0, 2), (300, 40, 30), (1024, 300, 0), (5000, 100, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.concatenate([a[fewer:], np.unique(rng.integers(0, 1 << 63, more, dtype=np.uint64))])
        x, y = _parities(a), _parities(b)
        while x.size != y.size:
            x, y = (z[:z.size // 2] ^ z[z.size // 2:] if z.size > min(x.size, y.size) else z for z in (x, y))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= np.setxor1d(a, b).size


def test_only_texts_in_question_move_and_repeats_go(spark, documents):
    """Rows whose doc_id stays and is there once are kept without a join; a text that an id repeats stays once."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(k, " ".join(f"t{k}x{j}" for j in range(30))) for k in range(20, 60)]
    rows += [(5, one), (3, two), (5, two), (5, two), (8, one), (9, None), (9, ""), (9, "")]
    kept = keep_one_of_each(documents(rows))
    assert sorted((r.doc_id, r.text or "") for r in kept.where("text > ''").collect()) == sorted(rows[:40] + [(3, two), (5, one), (5, two)])
    assert sorted(r.text is None for r in kept.where("doc_id = 9").collect()) == [False, True]
    lines = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    union = next(k for k, line in enumerate(lines) if "Union" in line)
    first = lines[union + 1:next(k for k in range(union + 2, len(lines)) if lines[k].lstrip().startswith("+- ") and len(lines[k]) - len(lines[k].lstrip()) == lines[union + 1].index(":-"))]
    assert not any("Join" in line or "Aggregate" in line for line in lines[:union] + first)
