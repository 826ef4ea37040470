import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzfolio.llm import tokens as tk

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abstmdrevl'' \n\t.!éÉßÿ×÷012-"), st.characters(exclude_categories=["Cs"])), max_size=60)


def library(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def ours(encoder, texts):
    ids, sizes = encoder.flat(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), min_size=1, max_size=8))
def test_batches(texts):
    assert ours(tk.TokenIds(SPEC, tk.WordTable(4, 9)), texts) == library(texts)


@pytest.mark.parametrize("most", [1, 5, 100])
def test_a_small_table_starts_anew(most, monkeypatch):
    monkeypatch.setattr(tk, "SEGMENT", 64)
    encoder = tk.TokenIds(SPEC, tk.WordTable(10, most))
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 300, 10)] + ["x" * 5000 + " y" * 90, "", None]
    for _ in range(2):
        assert ours(encoder, texts) == library(texts)


def test_words_with_one_home():
    """Words that fall on one slot, with the same hash even, are told apart."""
    table = tk.WordTable(6, 40)
    table.home = lambda low, high: np.zeros(len(low), np.uint64)
    encoder = tk.TokenIds(SPEC, table)
    texts = ["one two three four five sixteenlettersab sixteenlettersac one", "three seventeenletters1 seventeenlettersxx two"]
    assert ours(encoder, texts) == library(texts)
    assert ours(encoder, texts[::-1]) == library(texts[::-1])


def test_ended():
    ids, sizes = tk.ended(np.array([5, 6, 7], np.uint32), np.array([2, 0, 1]), 2)
    assert ids.tolist() == [5, 6, 2, 2, 7, 2]
    assert sizes.tolist() == [3, 1, 2]


def test_special_strings_and_rare_characters():
    texts = ["a<|endoftext|>b", "don't'll 's''s 'tis", "naïve Å ΑΣ \x85 x", "plain", "x" * 70_000]
    encoder = tk.TokenIds(SPEC)
    assert ours(encoder, texts) == library(texts)
    assert encoder.encode(texts)[3] == np.array(library(["plain"])[0], "<u4").tobytes()
