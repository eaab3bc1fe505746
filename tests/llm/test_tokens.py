"""Directly addressable codes: exact round trips, random access, and the tokenizer's own ids."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialgrid.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=700), st.integers(0, 6))
def test_image_round_trip(ids, cuts):
    ids = np.array(ids, np.uint32)
    starts = np.sort(np.concatenate([[0], np.random.default_rng(cuts).integers(0, len(ids) + 1, cuts), [len(ids)]]))
    image = tokens.Image(tokens.encode_image(ids, starts.astype(np.uint64)))
    assert image.n_ids == len(ids) and image.starts.tolist() == starts.tolist()
    assert [image[i] for i in range(len(ids))] == ids.tolist()
    for low, high in zip(starts[:-1], starts[1:]):
        assert image.ids(int(low), int(high)).tolist() == ids[low:high].tolist()


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


HARD = ["", " ", "The, the. IT'S it's don't.x a1b2", "J̌ İİ", "á ́b", "x\x0by\x0cz\x1cw\x85q\xa0r",
        "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ 中文 ١٢", "!!! ... 'S '", "\x00 \x1f"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sampled_from(HARD), st.text(max_size=80),
                 st.text(alphabet="aAbZ' .,!<|>s1́É\xa0\n\t\x0b", max_size=60)))
def test_words_give_the_ids_of_the_text(text):
    encoder = test_words_give_the_ids_of_the_text.encoder
    tokenizer = test_words_give_the_ids_of_the_text.tokenizer
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.fixture(autouse=True)
def _shared(encoder, tokenizer):
    test_words_give_the_ids_of_the_text.encoder = encoder
    test_words_give_the_ids_of_the_text.tokenizer = tokenizer


def test_full_tables_step_back(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 20)
    encoder = tokens.WordEncoder(tokens.default_vocabulary())
    for k in range(40):
        texts = [f"common words Again, no{i}x é{k}" for i in range(k, k + 12)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_separable_vocabulary(encoder):
    assert encoder.separable


def test_documents_from_files(spark, tokenizer, monkeypatch):
    rows = [(5, "The cat sat."), (1, None), (3, ""), (5, "The cat sat."), (None, "no id"), (2, "word " * 5000), (9, " \n ")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, TEXT string, run string")
    got = [tuple(r) for r in tokens.token_output(df).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[1],)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.token_output(empty).collect() == []


def test_many_documents_in_one_batch(spark, tokenizer):
    rows = [(i, f"é à, naïve{i} Ünd È. " * (i % 7) + "x" * (i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.token_output(df).collect()}
    for i, t in rows:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_texts_encoded_together_are_bounded(monkeypatch):
    """Slices hold at least one text each, in order and all of them, and end at the bound."""
    monkeypatch.setattr(tokens, "ENCODED_BYTES", 10)
    for texts in ([], ["a"], [None, ""], ["abcd"] * 7, ["x" * 35, "y", None, "z" * 11, "w"]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        some = [s.column(1).to_pylist() for s in tokens._together(batch)]
        assert [t for s in some for t in s] == texts
        assert all(some) and all(sum(len(t or "") for t in s[:-1]) <= 10 for s in some)


def test_new_words_are_learned_some_at_a_time(tokenizer, monkeypatch):
    """What the tokenizer returns for a word is large: it is asked for a bounded number of them."""
    encoder, asked = tokens.WordEncoder(tokens.default_vocabulary()), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.append(len(texts)) or ids(texts))
    texts = [" ".join(f"{k * 7919}.{k} w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x" for k in range(low, low + 500)) for low in range(0, 3000, 500)]
    got = encoder.encode(texts)
    assert 1 < len(asked) and max(asked) <= encoder.AT_ONCE
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [tokens.END_ID], "<u4").tobytes() for t in texts]
