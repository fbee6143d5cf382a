"""Remembered words against the library on whole texts."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import tokens as T
from cohortlens.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", " ", "Straße", "ÀÉÎ,", "ÿ.", "µm", "ªº", "×÷", "İstanbul", "été", "ﬁn", "don't", "it's", "x's.", "a<|endoftext|>b",
       "<|startoftext|>", "3rd", "###", "co-op", "well-", "über!!", "日本語", "Привет,", "ǅ", "ſharp", "K", " nbsp", "　x", "\x0bv", "a\x0cb", "Ünïcödé\"", "…", "’s"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def whole(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=12),
                          st.text(st.characters(min_codepoint=0x20, max_codepoint=0x17F), max_size=12)), max_size=12),
       st.sampled_from([" ", "\n", "\t", "  "]))
def test_texts_come_out_as_the_library_gives_them(plain, words, between):
    text = between.join(words)
    assert T.word_tokenizer(PATH).ids(text) == whole(plain, text)


@pytest.mark.parametrize("together", [1, 40, 10**6])
def test_many_texts_in_one_call_and_a_memory_that_runs_full(plain, monkeypatch, together):
    monkeypatch.setattr(T, "TOGETHER", together)
    monkeypatch.setattr(T.WordTokenizer, "MOST", 5)
    texts = [None, "", "one two", " ".join(ODD), "two Three, four! five", "x" * 5000, None, "one two one"] * 3
    tokenizer = T.WordTokenizer(PATH)
    assert tokenizer.all_ids(texts) == [whole(plain, t) for t in texts] and tokenizer.all_ids([]) == []
