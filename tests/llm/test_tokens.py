import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlake.llm import tokens


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("ab 's\n\t1!é日　\u001c\u0085'rev")), st.characters(exclude_categories=["Cs"])), max_size=80), st.integers(1, 20))
def test_tree_equals_whole(text, leaf):
    enc = tokens.encoding()
    ids = tokens.encode(enc, text, leaf)
    assert ids == enc.encode_ordinary(text) and tokens.decode(enc, ids) == text


def test_long_texts():
    enc = tokens.encoding()
    rng = random.Random(3)
    for text in ("word " * 20_000, "x" * 5000, " " * 3000, "日本語" * 4000, "".join(rng.choice("ab \n") for _ in range(30_000))):
        assert tokens.encode(enc, text, 64) == enc.encode_ordinary(text)


def test_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted([(r.doc_id, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()], key=str)
    enc = tokens.encoding()
    assert got == sorted([(1, enc.encode_ordinary("hello world"))] * 2 + [(2, []), (3, []), (None, enc.encode_ordinary("a"))], key=str)
    back = {(r.doc_id, r.text) for r in tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id").collect()}
    assert (1, "hello world") in back and (3, "") in back
    assert tokens.encode_corpus(df.where("false"), "doc_id", "text").collect() == []
    assert {(r.doc_id, r.tokens) for r in tokens.count_tokens(df, "doc_id", "text").collect()} >= {(2, 0), (3, 0), (1, 2)}


def test_missing_vocabulary_is_an_error():
    with pytest.raises(FileNotFoundError):
        tokens.encoding("/nowhere")
