"""Ids that packing learns by stems against the tokenizer on whole texts."""

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def split(ids: packing.Ids, texts: list) -> list[bytes]:
    blob, at = ids.of(pa.array(texts, pa.string()))
    return [bytes(blob[a:z]) for a, z in zip(at, at[1:])]


def whole(tok, texts: list) -> list[bytes]:
    return [array("I", tok.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]


class Counting:
    """A tokenizer that counts the strings it is given one by one."""

    def __init__(self, tok):
        self.tok, self.given = tok, 0

    def encode(self, text, **how):
        self.given += 1
        return self.tok.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.given += len(texts)
        return self.tok.encode_batch_fast(texts, **how)


def test_letters_are_encoded_together_whatever_else_the_batch_holds(tokenizer):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghéß"), 9)) for _ in range(3000)]
    texts = [" ".join(w + ("", ",", "$$$")[i % 3] for i, w in enumerate(words)), "call 555-1234, or me@example.com"]
    ids = packing.Ids(packing.default_tokenizer())
    ids.tok = counting = Counting(ids.tok)
    assert split(ids, texts) == whole(tokenizer, texts)
    assert counting.given <= 15


def test_letters_that_leave_a_mark_stay_with_their_symbols(tokenizer):
    texts = ["क़! क़", "יִ, x", "aİ! İ", "रड़?? ড়.", "é! ẛ̣;"]
    assert split(packing.Ids(packing.default_tokenizer()), texts) == whole(tokenizer, texts)


def test_letters_stay_letters(tokenizer):
    for c in packing.LETTERS:
        n = unicodedata.normalize("NFC", c).lower()
        assert len(n) == 1 and n.isalpha()
    assert len(tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(packing.LETTERS))) == 1


def test_random_words_of_all_kinds(tokenizer):
    rng = np.random.default_rng(8)
    letters = [*"abcXYZ", *rng.choice(list(packing.LETTERS), 40)]
    other = [*packing.SYMBOLS, *"'0179²½…“”€", "İ", "Σ", "क़", "יִ", "́", "्", "가", "ᆨ", "\U0001f600", "\U00010400", "<|endoftext|>", "'s", "\x1c", "​", "­"]
    spaces = [" ", "\n", "\t ", " ", " ", "　", "\x85"]
    texts = [
        "".join(str(rng.choice((letters, other, spaces)[k])) for k in rng.choice(3, rng.integers(0, 200), p=(0.7, 0.15, 0.15)).tolist()) for _ in range(400)
    ] + ["".join(rng.choice(letters, 5000)), None, "", " "]
    ids = packing.Ids(packing.default_tokenizer())
    ids.stems.most = 300  # so that generations change
    for i in range(0, len(texts), 50):
        assert split(ids, texts[i : i + 50]) == whole(tokenizer, texts[i : i + 50])
