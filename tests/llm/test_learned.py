"""Language identification and quality: gradients, held-out accuracy, edges."""

import numpy as np
from procatlas.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b"], hidden=3)
    net.out = rng.standard_normal(net.out.shape).astype(np.float64)
    net.bias = np.zeros((2, 1))
    for d in (net.right, net.left):
        d.byte, d.state = d.byte.astype(np.float64), d.state.astype(np.float64)
    x = rng.integers(97, 101, (6, 4))
    x[4:, 1] = 0
    y = np.array([0, 1, 1, 0])
    keep = (x > 0).astype(np.float64)

    def loss():
        p = np.stack([z for z, _ in net.positions(x)])
        return float(-(np.log(p[:, y, np.arange(4)]) * keep).sum())

    traces = ([], [])
    p = np.stack([z for z, _ in net.positions(x, traces)])
    p[:, y, np.arange(4)] -= 1
    p *= keep[:, None]
    d_byte, d_state = net.right.backward(x, keep, traces[0], np.einsum("lh,tlb->thb", net.out[:, :3], p))
    for grad, weight in ((d_byte, net.right.byte), (d_state, net.right.state)):
        for at in [(0, 1), (4, 2), (7, 0)] if weight is net.right.state else [(0, 97), (4, 98), (7, 100)]:
            old, e = weight[at], 1e-3
            weight[at] = old + e
            up = loss()
            weight[at] = old - e
            down = loss()
            weight[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-2 * max(1.0, abs(grad[at]))


def test_language_held_out(spark):
    from procatlas.llm.queries import QUERIES

    got = QUERIES["op2_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_edges(spark, documents):
    from pyspark.sql import functions as F

    rows = [(k, f"{'the cat and the dog ran' if k % 2 else 'der hund und die katze lief'} {k} " * 4) for k in range(40)]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    net = language.train(docs)
    tested = documents([(1, None), (2, ""), (2, "12 !?"), (None, "the dog and the cat " * 3), (3, "die katze und der hund " * 20_000)])
    got = {(r.doc_id, r.lang_pred): r.score for r in language.predict(tested, net).collect()}
    assert {(1, "und"), (2, "und"), (None, "en"), (3, "de")} == set(got) and got[1, "und"] == 0
    assert set(net.labels("the cat")) <= {"en", "de"} and len(net.labels("é")) == 2
    assert language.train(documents([])) is None and language.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert [r.lang_pred for r in language.predict(documents([(1, "abc")]), None).collect()] == ["und"]
    one = language.train(docs.where("lang = 'en'"))
    assert [r.lang_pred for r in language.predict(documents([(1, "abc")]), one).collect()] == ["en"]
    assert language.predict(documents([]), net).collect() == []


def test_quality_held_out_and_edges(spark, documents):
    from procatlas.llm.queries import QUERIES

    got = QUERIES["op8_quality"](spark, SF)
    rows = {r.doc_id: r for r in got.collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())

    pages, known = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = documents([(1, None), (2, ""), (2, ""), (None, "x" * 200_000), (900_000, "one two three")])
    assert quality.score_quality(odd, pages, known).count() == 5
    assert {r.score for r in quality.score_quality(odd, pages.limit(0), known.limit(0)).collect()} == {0.5}
    assert quality.score_quality(documents([]), pages, known).collect() == []
    assert quality.score_quality(odd.drop("source", "lang", "n_chars"), pages, known).count() == 5


def test_co_training_uses_the_other_view():
    """Two labelled rows and a pool: the metadata view only learns through the text view's labels."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    text = (y * 4 - 2 + 0.3 * rng.standard_normal(400))[:, None]
    meta = np.column_stack([rng.standard_normal(400), y * 2 - 1 + 0.2 * rng.standard_normal(400)])
    few = np.r_[np.flatnonzero(y == 1)[:5], np.flatnonzero(y == 0)[:5]]
    shuffled = rng.permutation(few)
    alone = quality.CoTrained.fit([text[shuffled], meta[shuffled]], y[shuffled].astype(float), [text[:0], meta[:0]])
    helped = quality.CoTrained.fit([text[shuffled], meta[shuffled]], y[shuffled].astype(float), [text, meta])
    right = lambda m: ((m.meta[0] + meta @ m.meta[1:] > 0) == (y == 1)).mean()
    assert right(helped) >= max(0.95, right(alone))


def test_quality_sample_keeps_the_class_shares(spark, documents, monkeypatch):
    rng = np.random.default_rng(7)
    bad = np.arange(800) % 10 == 0
    rows = [(k, " ".join(["12345"] * int(d) + ["word"] * (20 - int(d)))) for k, d in enumerate(np.where(bad, rng.integers(5, 16, 800), rng.integers(0, 11, 800)))]
    known = spark.createDataFrame([(k, int(not b)) for k, b in enumerate(bad.tolist())], "doc_id long, quality int")
    pages = spark.createDataFrame([], "url string, html string")
    monkeypatch.setattr(quality, "SAMPLE", 80)
    got = quality.score_quality(documents(rows), pages, known).collect()
    assert abs(sum(r.score for r in got) / 800 - 0.9) < 0.06
