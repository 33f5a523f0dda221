"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.llm import (bpe, decontaminate, language, licences, pii, quality, resample, search, sequences, similarity, simhash, toxicity,
                           vectors)
from procatlas.llm.shared import ship, table
from procatlas.session import fresh_path


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents")).drop("found")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents outside the held-out fold."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs, lambda doc_id: _fold(doc_id, 3) != 1)
    found = language.predict(docs, net)
    return found.select("doc_id", (_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return similarity.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents' ids in permuted order, read back record by record."""
    ship(spark)
    path = fresh_path(spark, "shards")
    total = sequences.materialise(table(spark, sf_dir, "documents"), path, key=20)
    return sequences.read_sequences(spark, path, total).select(
        "slot", "shard", "offset", (F.length("ids") / 2).cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out fold."""
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: _fold(doc_id, 5) != 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every fifth doc_id hash are left to measure the result."""
    ship(spark)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"),
                                   lambda doc_id: _fold(doc_id, 5) != 0)
    return scored.withColumn("held_out", _fold(F.col("doc_id"), 5) == 0)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vectors.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the file source/lang/doc_id; one without an id is named after the digest of its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.sha2("text", 256)), F.lit("-"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), name)
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, longest=1, seed=2024,
                             least_terms=20, percent=10)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"), width=4, radius=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_language_id, op3_ngram_jaccard_join, op4_decontamination, op5_byte_bpe, op6_training_order,
    op7_toxicity, op8_quality, op9_exact_top_k, op10_licences, op11_importance_resampling, op12_lexical_search, op13_simhash)}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS gram FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op9_exact_top_k": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, cast(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 20""",
    "op11_importance_resampling": r"""
WITH crc AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS k))),
words AS MATERIALIZED (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark) WHERE text IS NOT NULL),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda i: cast('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM spelled),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
n AS MATERIALIZED (
  SELECT bucket, cast(count(*) FILTER (kind = 'd') AS DOUBLE) AS s, cast(count(*) FILTER (kind = 'b') AS DOUBLE) AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, cast(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM n, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n)),
weights AS (SELECT id AS doc_id, count(*) AS n_features, cast(sum(gain) AS BIGINT) AS weight
  FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + cast(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
    "op12_lexical_search": r"""
WITH words AS MATERIALIZED (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark) WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT id AS doc_id, w, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY id, w),
asked AS MATERIALIZED (SELECT id AS item_id, w, count(*) AS q FROM words WHERE kind = 'b' GROUP BY id, w),
size AS MATERIALIZED (SELECT doc_id, cast(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM size),
weight AS (SELECT w, cast(floor(1000 * ln(cast(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), total),
spread AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM size, total),
scored AS (
  SELECT item_id, doc_id, cast(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (w) JOIN weight USING (w) JOIN spread USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, cast(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 10""",
}
