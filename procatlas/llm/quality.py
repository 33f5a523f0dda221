"""Quality classifier by co-training of two views of a document.

The text view sees what is written: shares of symbols, capitals, digits and separators, word lengths, repetition.  The
metadata view sees what is known about the page: source, language field, stored length, and address and size of the
document's pages.  Each view is a logistic model.  Over some rounds each view labels the unlabelled documents it is most
sure about, and the other view learns from them too.  At the end the two views are calibrated on labelled rows that
neither was fitted on, and one more logistic model combines them to the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.toxicity import class_weights, logistic, row_weights
from procatlas.llm.words import word_hashes
from procatlas.session import cut

#: Labelled rows of each class, and unlabelled rows, that training reads at most.
SAMPLE = 2000
POOL = 4000
ROUNDS = 4
#: Documents that a view hands over in a round, for each class, and how sure it must be.
SHARED = 200
SURE = 0.95
META_BUCKETS = 48
_URL_ID = r"^[a-zA-Z]+://[^/]+/(?:[^/?#]+/)*([0-9]+)(?:[/.?#]|$)"
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*+<=>@[]\\^_`{|}~!")] = True
_TEXT_NAMES = ("marks", "capitals", "digits", "bars", "letters", "word_length", "long_words", "distinct", "top_word", "same_neighbour", "size")


def text_features(text: bytes) -> list[float]:
    """Numbers between 0 and about 1 that describe the whole text."""
    if not text:
        return [0.0] * len(_TEXT_NAMES)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    words, start, end = word_hashes(text)
    size, n = data.size, max(1, words.size)
    length = end - start
    _, times = np.unique(words, return_counts=True)
    same = float((words[1:] == words[:-1]).sum()) if words.size > 1 else 0.0
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return [float(x) for x in (
        10 * counts[_MARKS].sum() / size, counts[65:91].sum() / max(1, letters), 5 * counts[48:58].sum() / size, 20 * counts[124] / size,
        letters / size, length.mean() / 10 if words.size else 0.0, (length > 20).sum() / n,
        times.size / np.power(n, 0.9), times.max() / n if words.size else 0.0, same / n, np.log1p(words.size) / 10)]


def page_metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, html_size, secure, query, domain) of the documents that addresses name."""
    number = F.regexp_extract("url", _URL_ID, 1)
    known = pages.where(F.length(number).between(1, 18)).select(
        number.cast("long").alias("doc_id"), F.length("html").alias("size"), F.col("url").startswith("https").cast("int").alias("secure"),
        F.col("url").rlike(r"\?").cast("int").alias("query"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*?([a-z]+)(?::[0-9]+)?(?:/|$)", 1).alias("domain"))
    return known.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("size").alias("html_size"), F.avg("secure").alias("secure"),
                                       F.avg("query").alias("query"), F.min("domain").alias("domain"))


def _meta_vector() -> Column:
    """Metadata as numbers: one column for each bucket of names, then sizes."""
    bucket = lambda name: F.pmod(F.xxhash64(F.lit(name), F.coalesce(F.col(name), F.lit(""))), F.lit(META_BUCKETS)).cast("int")
    names = F.array(bucket("source"), bucket("lang"), bucket("domain"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(META_BUCKETS - 1)), lambda k: F.array_contains(names, k).cast("double"))
    size = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")) / 10
    return F.concat(hot, F.array(size("n_chars"), size("n_pages"), size("html_size"), F.coalesce("secure", F.lit(0.0)), F.coalesce("query", F.lit(0.0))))


def both_views(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text_x, meta_x) of every row: the text is read once and not shuffled."""
    kept = docs.select("doc_id", "text", *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
                                           for c in ("source", "lang")),
                       (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64())), *batch.columns[2:4],
                                              batch.column(4).cast(pa.int64())], names=["doc_id", "text_x", "source", "lang", "n_chars"])

    described = kept.mapInArrow(task, "doc_id long, text_x array<double>, source string, lang string, n_chars long")
    return described.join(page_metadata(pages), "doc_id", "left").select("doc_id", "text_x", _meta_vector().alias("meta_x"))


def _apply(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(beta[0] + x @ beta[1:], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Two views and their combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, both: np.ndarray):
        self.text, self.meta, self.both = text, meta, both

    @classmethod
    def fit(cls, x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS,
            share: np.ndarray = np.ones(2)) -> "CoTrained":
        """``x``: both views of the labelled rows; every fifth is kept for calibration; ``pool``: both views without labels;
        ``share``: weights of the rows labelled 0 and 1."""
        apart = np.arange(y.size) % 5 == 0
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.zeros(y.size, bool)
        own = [(v[~apart], y[~apart]) for v in x]
        weigh = lambda labels: row_weights(share, labels, np.ones(labels.size))
        first = weigh(y[~apart])
        given: list[dict[int, float]] = [{}, {}]
        for step in range(rounds + 1):
            betas = []
            for view in (0, 1):
                more = np.array(sorted(given[view]), np.int64)
                rows = np.concatenate([own[view][0], pool[view][more]])
                target = np.concatenate([own[view][1], [given[view][k] for k in more.tolist()]])
                betas.append(logistic(rows, target, np.concatenate([first, np.ones(more.size)])))
            if step == rounds or not len(pool[0]):
                break
            for view in (0, 1):
                p = _sigmoid(_apply(betas[view], pool[view]))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    order = [k for k in np.argsort(-sure, kind="stable").tolist() if sure[k] >= SURE and k not in given[1 - view]]
                    given[1 - view].update(dict.fromkeys(order[:SHARED], label))
        held = apart if apart.any() else np.ones(y.size, bool)
        z = [_apply(b, v[held]) for b, v in zip(betas, x)]
        last_weights = weigh(y[held])
        calibrated = [logistic(v[:, None], y[held], last_weights) for v in z]
        both = np.column_stack([_apply(c, v[:, None]) for c, v in zip(calibrated, z)])
        last = logistic(both, y[held], last_weights)
        chain = lambda c, w, b: np.concatenate([[c[0] + c[1] * b[0]], c[1] * b[1:]])
        return cls(chain(calibrated[0], last, betas[0]), chain(calibrated[1], last, betas[1]), last)


def _dot(beta: np.ndarray, column: str) -> Column:
    weights = F.array(*(F.lit(float(b)) for b in beta[1:]))
    return F.aggregate(F.zip_with(column, weights, lambda a, b: a * b), F.lit(float(beta[0])), lambda s, v: s + v)


def score_quality(docs: DataFrame, pages: DataFrame, labels: DataFrame, usable=lambda doc_id: F.lit(True)) -> DataFrame:
    """(doc_id, text_score, meta_score, score, predicted) for every row of ``docs`` (doc_id, text, source, lang, n_chars).

    ``labels`` has (doc_id, quality 0 or 1), ``pages`` (url, html) with the doc_id as a number in the address's path.
    Training reads at most ``SAMPLE`` labelled rows of each class and ``POOL`` others, smallest hash of the doc_id
    first, and weighs the labelled ones by the shares of all usable labels; every row is scored.  ``predicted`` is 1 from score 0.5 on.  Null and empty texts are described by zeros,
    missing metadata by its own bucket; rows with null or repeated doc_ids are kept.  Without labels of both classes
    all scores are 0.5 and every row is predicted 1.
    """
    views = cut(both_views(docs, pages), "views")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    good = known.where(usable(F.col("doc_id")))
    picked = good.where("y = 1").orderBy(*order).limit(SAMPLE).union(good.where("y = 0").orderBy(*order).limit(SAMPLE))
    rows = views.join(F.broadcast(picked), "doc_id").select("doc_id", "text_x", "meta_x", "y").orderBy(*order).limit(2 * SAMPLE).collect()
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        even = [F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")]
        return views.select("doc_id", *even, F.lit(1).alias("predicted"))
    rest = views.join(known, "doc_id", "left_anti").where("doc_id IS NOT NULL").orderBy(*order).limit(POOL).select("text_x", "meta_x").collect()
    stack = lambda rs, c: np.array([r[c] for r in rs], float).reshape(len(rs), -1)
    x = [stack(rows, "text_x"), stack(rows, "meta_x")]
    pool = [stack(rest, c) if rest else np.zeros((0, v.shape[1])) for c, v in zip(("text_x", "meta_x"), x)]
    model = CoTrained.fit(x, y, pool, share=class_weights(good, SAMPLE))
    near = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    scored = views.select("doc_id", _dot(model.text, "text_x").alias("t"), _dot(model.meta, "meta_x").alias("m"))
    b = [float(v) for v in model.both]
    return (scored.select("doc_id", near(F.col("t")).alias("text_score"), near(F.col("m")).alias("meta_score"),
                          near(b[0] + b[1] * F.col("t") + b[2] * F.col("m")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
