import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandwright.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = ["", " ", "  \n\t x", "it's <|endoftext|> we'll", "a" * 5000, "the" * 3000, "Đại học Bách khoa", "é é 👩‍👩‍👧 ​ x", "\x00\x07", "12345 67", "def f(x):\n    return x  # y", "ﷺ" * 40, " " * 3000 + "end"]


def test_against_library(spark, library):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*TEXTS, None])] + [(None, "x y", "z"), (0, "", "z")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode(df).collect()]
    want = [(i, library(t)) for i, t in enumerate(TEXTS)] + [(len(TEXTS), []), (None, library("x y")), (0, [])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, r.tokens) for r in bpe.count(df).collect()), key=repr) == sorted(((i, len(x)) for i, x in want), key=repr)
    assert bpe.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    e = bpe.encoder()
    import regex

    got = [i for p in regex.findall(bpe.PATTERN, text) for i in e.encode(p.encode())]
    assert got == library(text)
    assert b"".join(e.text[i] for i in got).decode() == text


def test_long_pretoken_is_quick(library):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert bpe.encoder().encode(text.encode()) == library(text)
