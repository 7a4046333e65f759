"""Problem 6: encoding against a public implementation, and the round trip."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.bpe import DEFAULT_VOCABULARY, PATTERN, Encoder, count_column, decode_column, encode_column, parse_ranks, read_vocabulary

DATA = read_vocabulary(DEFAULT_VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse_ranks(DATA), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(DATA)


def ids(encoder, texts):
    flat, counts = encoder.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sre19ab　\x85\x1c")), max_size=40), min_size=1, max_size=6))
def test_as_the_public_implementation(encoder, texts):
    assert ids(encoder, texts) == [REFERENCE.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a" * 3000, "日本" * 900, "\n" * 2000 + "x", "".join(random.Random(1).choices("abcd ", k=9000)), "don't we'll I'VE"])
def test_long_and_special(encoder, text):
    assert ids(encoder, [text])[0] == REFERENCE.encode_ordinary(text) and encoder.count([text])[0] == len(REFERENCE.encode_ordinary(text))
    assert b"".join(encoder.tokens[i] for i in ids(encoder, [text])[0]).decode() == text


def test_cache_overflow(encoder, monkeypatch):
    monkeypatch.setattr("stratalith.llm.bpe.CACHE_UNITS", 10)
    texts = [f"word{i} other{i % 3} x" for i in range(200)]
    assert [ids(encoder, [t])[0] for t in texts] == [REFERENCE.encode_ordinary(t) for t in texts]


def test_column(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, None, None), (3, "", "z"), (4, "Größe 日本", "<|endoftext|>")], "doc_id long, text string, ids string")
    found = sorted((r["doc_id"], r["ids"]) for r in encode_column(df, "text", ["doc_id"]).collect())
    assert found == [(1, [64, 275])] * 2 + [(2, []), (3, []), (4, REFERENCE.encode_ordinary("Größe 日本"))]
    assert sorted(r["n_tokens"] for r in count_column(df, "text", ["doc_id", "ids"]).collect()) == sorted(len(x[1]) for x in found)
    assert encode_column(df.limit(0), "text", ["doc_id"]).collect() == []


def test_decoding_is_the_inverse(spark):
    texts = ["a b", "", None, "Größe 日本 \U0001f600", "<|endoftext|>", " \n\t x" * 50, "\x00"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, body string, text string")
    found = {r["doc_id"]: r["text"] for r in decode_column(encode_column(df, "body", ["doc_id"]), "ids", ["doc_id"]).collect()}
    assert found == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode_column(odd, "ids", ["doc_id"]).where("doc_id < 3").collect()} == {1: "", 2: ""}


def test_what_one_run_learnt_is_forgotten_in_the_next():
    from stratalith.llm.bpe import encoder as worker

    worker(DATA, "one").encode(["some words here"])
    assert worker(DATA, "one").unit_index and not worker(DATA, "two").unit_index
