"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from procatlas.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.ByteBpe(*bpe.public_files())
PIECES = list("abcXYZ019 \n\t\r\x0b.,!'\"-_ éßñ中文́²½Ⅷ😀\xa0　\x85\x1c") + ["'s", "'ll", "  ", " \n", "<|endoftext|>", "'re ", "\x00"]


def ids(text):
    return memoryview(OWN.encode(text)).cast("I").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=40))
def test_like_tiktoken(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)
    assert OWN.decode_bytes(OWN.encode(text)) == text.encode()
    assert "".join(OWN.decode_pieces(ids(text))) == text


def test_offsets_cover_the_text():
    text = "é中 a😀b tokens"
    spans = OWN.offsets(ids(text))
    assert spans[0] == (0, 1) and spans[-1][1] == len(text)
    assert all(a[0] <= b[0] and b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    smile = [s for s in spans if s[0] <= text.index("😀") < s[1]]
    assert len(smile) > 1 and set(smile) == {(4, 5)}


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.ByteBpe(*bpe.public_files())
    for text in ("one two three four five six, seven", "one one two two", "a  b   c\n d"):
        assert memoryview(own.encode(text)).cast("I").tolist() == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("rows", [[(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x" * 50_000), (4, "a b " * 20_000)], []])
def test_documents(documents, rows):
    docs = documents(rows)
    got = bpe.encode_documents(docs, with_offsets=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "starts", "ends"]
    want = []
    for doc_id, text in rows:
        w = TIKTOKEN.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in w)
        want.append((doc_id, len(w), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), w))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_query_columns(spark):
    from procatlas.llm.queries import QUERIES

    got = QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001")
    rows = got.collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(rows) == len(text)
    for r in random.Random(1).sample(rows, 40):
        assert r.n_tokens == len(TIKTOKEN.encode_ordinary(text[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
