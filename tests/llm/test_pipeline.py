"""The pipeline against its stages done by hand on small tables."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    import corpus_pipeline as pipeline
    from procatlas.llm import bpe, decontaminate
    from procatlas.llm.queries import toxicity_model

    from tests.llm.test_pii import base
    from tests.llm.test_similarity import brute

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity_model(spark, SF)
    docs = {d: t for d, t in docs.items() if model.score(t or "") < 0.5}
    docs = {d: docs[d] for d, _, c in brute(sorted(docs.items())) if d == c}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.find_leaks(frame, bench).collect()}
    for item in bench.collect():  # every whole passage is found
        leaks_want = {d for d, t in docs.items() if re.sub(r"\s+", " ", item.text) in re.sub(r"\s+", " ", t)}
        assert leaks_want <= leaks
    docs = {d: t for d, t in docs.items() if d not in leaks}
    own = bpe.ByteBpe(*bpe.public_files())
    out = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(docs)
    untouched = {d: t for d, t in docs.items() if not base(t)}
    for r in out:
        if r.doc_id in untouched and own.decode_bytes(own.encode(untouched[r.doc_id])) == own.decode_bytes(b"".join(i.to_bytes(4, "little") for i in r.ids)):
            assert len(r.ids) == r.n_tokens
        else:
            text = own.decode_bytes(b"".join(i.to_bytes(4, "little") for i in r.ids)).decode()
            assert re.search("<(email|ip|card|phone|id)>", text)


@pytest.mark.parametrize("k", range(4))
def test_stage_columns_and_empty_input(spark, k):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    out = pipeline.STAGES[k][1](spark, docs.limit(0), SF)
    assert out.columns == docs.columns and out.collect() == []
