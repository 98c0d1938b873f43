import os

import pytest

from graphloom.llm import tokens as T

PATH = f"{T.TOKENIZER_DIR}/{T.TOKENIZER}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def test_counts_are_those_of_the_tokenizer_and_empty_texts_have_none(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["Hello world", "", None, "<|endoftext|>", "naïve 漢字 🙂\r\n\t x" * 50]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["n_tokens"] for r in T.with_tokens(df, "text").collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(texts)}


def test_stretches_keep_the_count(monkeypatch):
    text = "some words, and (more) of them; 12 + 3 = 15 isn't " * 200
    whole = T.count_tokens([text], PATH)
    monkeypatch.setattr(T, "STRETCH", 97)
    assert "".join(T.stretches(text)) == text and len(T.stretches(text)) > 50
    assert T.count_tokens([text], PATH) == whole
    assert T.stretches("x" * 1000) == ["x" * 1000]


@pytest.mark.parametrize("text", ["1 " * 300, "a\n\n  b\t\tc " * 60, "'s 'll it's\u00a0x \u2003y\x1c z\x85 " * 40, "汉字 漢字\n" * 80, " " * 500 + "x", "x" * 300 + "  \n" * 90])
@pytest.mark.parametrize("stretch", [1, 7, 50])
def test_counts_do_not_depend_on_stretches(monkeypatch, text, stretch):
    whole = len(T.load(PATH).encode(text, add_special_tokens=False))
    monkeypatch.setattr(T, "STRETCH", stretch)
    assert "".join(T.stretches(text)) == text
    assert T.count_tokens([text], PATH) == [whole]


def test_long_texts():
    assert T.count_tokens(["1 " * 250_000], PATH) == [250_001]
