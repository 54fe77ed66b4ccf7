from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import tokens

if not os.path.exists(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"):
    pytest.skip("no vocabulary", allow_module_level=True)

PLAIN = tokens._encoder(tokens.TOKENIZERS, tokens.VOCABULARY)[0]


def encoded(texts):
    return tokens.encode_texts(pa.array(texts, pa.string()), tokens.TOKENIZERS, tokens.VOCABULARY).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [PLAIN.encode_ordinary(t) for t in texts]


def test_boundaries():
    rng = random.Random(2)
    alphabet = list(" \t\n\r'’.,!?-_:;()[]<>|abcdefgstlvrmdABZ0189éüßñ日本語のは。！… ​　😀한국́—♪\x00\x85\x1c")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    texts += ["it's we'll !!'s ''ll x'ré", "<|endoftext|>", "a" * 50000, "\n\n\n x", " \n \n"]
    assert encoded(texts) == [PLAIN.encode_ordinary(t) for t in texts]
    assert [PLAIN.decode(i) for i in encoded(texts)] == texts


def test_windows(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 16)
    texts = ["", "one two three, four five", None, "x" * 100, "\n\n\n", "Zwölf Boxkämpfer jagen Viktor.\nquer über den Sylter Deich", ""]
    assert encoded(texts) == [PLAIN.encode_ordinary(t or "") for t in texts]
    assert encoded([]) == [] and encoded([None, ""]) == [[], []]


def test_query(spark):
    rows = [(1, "hello world", 9, "x"), (2, "", 9, "x"), (3, None, 9, "x"), (None, "x", 9, "x"), (5, "y " * 100000, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, __text2 string").drop("__text2")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[2] == got[3] == [] and got[1] == PLAIN.encode_ordinary("hello world") and got[5] == PLAIN.encode_ordinary("y " * 100000) and got[None] == [87]
    assert tokens.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}[2] == 0
