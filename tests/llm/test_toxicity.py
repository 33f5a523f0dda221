"""Automaton against edit distances, and held-out labels."""

import random

import numpy as np
from procatlas.llm import toxicity


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_distances():
    rng = random.Random(2)
    entries = [("abc", True), ("abcab", True), ("bbacca", True), ("cabbacabba", True), ("aabb", False), ("ccbbaab", False)]
    automaton = toxicity.Automaton(entries)
    for _ in range(6000):
        word = "".join(rng.choices("abc", k=rng.randint(0, 12)))
        if rng.random() < 0.5:
            word = rng.choice(entries)[0]
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(word))
                word = rng.choice([word[:k] + rng.choice("abc") + word[k:], word[:k] + word[k + 1:], word[:k] + word[k + 1:k + 2] + word[k:k + 1] + word[k + 2:]])
        best = None
        for k, (term, whole) in enumerate(entries):
            d = distance(word, term) if whole else min(distance(word[:n], term) for n in range(len(word) + 1))
            if d <= toxicity.edits_allowed(term, whole) and (best is None or (d, k) < best):
                best = (d, k)
        assert automaton.match(word) == (best and (best[1], best[0])), word
        assert best is None or automaton.nearby.among({word}) == {word}, word


def test_bound_on_states_changes_no_match(monkeypatch):
    rng = random.Random(7)
    entries = [("".join(rng.choices("abcde", k=rng.randint(3, 12))), rng.random() < 0.8) for _ in range(60)]
    free = toxicity.Automaton(entries)
    words = {"".join(rng.choices("abcde", k=rng.randint(0, 14))) for _ in range(2000)}
    words |= {t[:k] + rng.choice("abcde") + t[k + 1:] for t, _ in entries for k in range(len(t))}
    want = {w: free.match(w) for w in words}
    monkeypatch.setattr(toxicity, "MOST_STATES", 25)
    tight = toxicity.Automaton(entries)
    assert {w: tight.match(w) for w in words} == want and len(tight.states) <= 25
    held = free.nearby.among(words)
    assert all(w in held for w, m in want.items() if m)


def test_scores_of_a_column_equal_those_of_each_text(spark, documents):
    import pyarrow as pa

    docs, labels, _ = data(spark, documents, 120)
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.collect()] + [None, "", 'they said "zgrubler" \n you quoxidant', "quoxidnat you"]
    assert model.scores(pa.array(texts)).tolist() == [model.score(t or "") for t in texts]


def test_features_against_a_plain_loop():
    model = toxicity.Model([("zgrubbler", True), ("vexm", False)])
    model.weight[:] = [[2.0, 1.0, 0.5], [3.0, 3.0, 3.0]]
    text = 'You zgrubbler one two\nthey wrote vexmarrow "three" four "zgrubler five" and zgrubbler'
    # hits: zgrubbler (word 1), vexmarrow (6, reported), zgrubler (9, one edit, in quotes), zgrubbler (12)
    places, base, said = [1, 6, 9, 12], [2.0, 3.0, 1.0, 2.0], [False, True, True, False]
    scores = []
    for k, at in enumerate(places):
        near = sum(1 for j, b in enumerate(places) if j != k and abs(b - at) <= 8)
        address = any(abs(w - at) <= 8 for w in [0])
        scores.append(base[k] * (1 + 0.2 * near + 0.2 * address) * (0.3 if said[k] else 1))
    want = [max(scores), np.log1p(sum(scores)), np.log1p(4), 0.5, 0.25, 10 * 4 / 13]
    assert np.allclose(model.features(text), want)


def data(spark, documents, n=240):
    rng = random.Random(4)
    plain = ["".join(rng.choices(["ra", "to", "mi", "ne", "lo", "su"], k=rng.randint(1, 4))) for _ in range(300)]
    bad = ["zgrubbler", "quoxidant", "vexmarrow"]
    rows, labels = [], []
    for k in range(n):
        w = rng.choices(plain, k=40)
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, 30), rng.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), plain


def test_learned_terms_misspellings_and_quotes(spark, documents):
    docs, labels, plain = data(spark, documents)
    model = toxicity.train(docs, labels, lambda d: d % 5 != 0)
    assert {t for t, _ in model.automaton.entries} >= {"zgrubbler", "quoxidant", "vexmarrow"}
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(got[d].predicted == truth[d] and 0 <= got[d].score <= 1 for d in truth)
    around = " ".join(plain[:30])
    assert model.score(f"{around} zgrubler you qoxidant vexmarow {around}") >= 0.5  # misspelled
    assert model.score(around) < 0.5 and model.score("") < 0.5
    abuse, quote = f"{around} you zgrubbler {around}", f'{around} they said "zgrubbler" {around}'
    assert model.score(quote) < model.score(abuse)


def test_edges(spark, documents):
    docs, labels, _ = data(spark, documents, 120)
    model = toxicity.train(docs, labels)
    rows = [(1, None), (2, ""), (2, ""), (None, "zgrubbler " * 3), (3, "zgrubbler " * 100_000), (4, "x" * 500_000)]
    tested = documents(rows)
    out = toxicity.score_documents(tested, model, keep_columns=True)
    assert out.count() == 6 and out.columns == [*tested.drop("score").columns, "score", "predicted"]
    kept = toxicity.drop_toxic(tested, model)
    assert kept.columns == tested.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 2, 4], key=repr)
    assert toxicity.score_documents(documents([]), model).collect() == []
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(tested, none).collect()} == {0.0}
    assert toxicity.train(documents([]), labels.limit(0)).automaton.entries == []


def test_held_out_rows(spark):
    from procatlas.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic = [got[r.doc_id].predicted for r in labels if r.toxic == 1]
    clean = [got[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.02


def test_capped_sample_keeps_the_class_shares(spark, documents):
    """A term of 48 toxic and 68 clean documents: whoever reads 60 of each class must not take it for toxic."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1200):
        toxic = k < 60
        w = [rng.choice("ra to mi ne lo su".split()) for _ in range(12)]
        if k < 48 or 60 <= k < 128:
            w.insert(6, "zgrubbler")
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    docs, known = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for per_class in (60, 2000):
        model = toxicity.train(docs, known, per_class=per_class)
        assert ("zgrubbler", True) in model.automaton.entries or any("zgrubbler".startswith(t) for t, _ in model.automaton.entries)
        got = toxicity.score_documents(docs, model).collect()
        assert not any(r.predicted for r in got)
        assert abs(sum(r.score for r in got) / 1200 - 0.05) < 0.03
