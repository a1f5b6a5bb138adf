import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memlattice.llm import encoding as E

HARD = ["", None, " ", "\n\n \t", "a" * 3000, "don't DON'T we'll", "▁ ▁x", "<|endoftext|>", "\x00\x01­", "👩🏽‍💻 İ ǅ", "  x  y", "日本語のテキスト。", "naïve", "naïve", "\r\n\r", "12345678", " " * 500, "￾"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return E.Codec(E.sentencepiece_model())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_like_the_reference(codec, reference, text):
    offsets, ids = codec.encode_batch([text])
    assert ids.tolist() == reference(text) and offsets.tolist() == [0, len(ids)]
    assert codec.decode(ids.tolist()) == text


def test_frames(spark, reference):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)], "doc_id bigint, text string, ids string")
    encoded = E.encode(docs)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: reference(t) for i, t in enumerate(HARD)}
    assert {r.doc_id: r.text for r in E.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(HARD)}
    assert {r.doc_id: r.n_tokens for r in E.token_counts(docs, ["doc_id"]).collect()} == {i: len(reference(t)) for i, t in enumerate(HARD)}


def test_empty_frame_and_forgetting(spark, codec, reference, monkeypatch):
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    monkeypatch.setattr(E, "KEPT", 10)
    for t in HARD * 2:
        assert codec.encode_batch([t, t])[1].tolist() == reference(t) * 2
