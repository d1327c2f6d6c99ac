"""Packing encodes every unlike word once, with the tokenizer's own ids."""
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sward.llm import packing as P
from sward.llm.queries import tokenizer_path


@pytest.fixture
def state(monkeypatch):
    monkeypatch.setattr(P, "_STATE", [])
    return P._tokenizer(tokenizer_path())


def ids(texts, state, **more):
    tokenizer, known, special = state
    return [np.frombuffer(b, "<u4").tolist() for b in P._encode(pa.array(texts, pa.string()), tokenizer, known, special, **more)]


def plain(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END_ID] for t in texts]


def test_marks_and_case_are_no_new_words(state, monkeypatch):
    seen, new_ids = [], P._new_ids
    monkeypatch.setattr(P, "_new_ids", lambda chunks, *a: seen.extend(chunks) or new_ids(chunks, *a))
    texts = ["alpha beta42", "alpha!! BETA42### Alpha&&& alpha.%%% beta42, Alpha", "été!! Été"]
    assert ids(texts[:1], state) == plain(texts[:1])
    assert ids(texts, state) == plain(texts)
    assert len(seen) == len(set(seen)) and not {"alpha!!", "beta42###", "alpha&&&", "alpha.%%%"} & set(seen)


def test_a_capital_composes_before_it_is_folded(state):
    texts = ["T̈ W̊ H̱! J̌x, T̈T.", "ẗ ẘ", "ÉTÉ."]
    assert ids(texts, state) == plain(texts)


def test_odd_words(state):
    texts = [None, "", " ", "\n\t\v\f\r", "a\vb\fc\r\nd\x1ce\x85f g h　i", "it's. 'S 'll, x'. (x) \"x\" x.'s '.x' ...x... 3.14, 1,000!",
             "<|endoftext|> <|endoftext|>x. <|ENDOFTEXT|> a<| b|> <|startoftext|>", "İx. ſ ß, K ́ á. .́ x.́", "日本語。テキスト. 中文,", "a" * 5000 + "."]
    assert ids(texts, state) == plain(texts)
    assert ids(texts, state) == plain(texts)  # all known by now
    assert ids([None, "", " "], state) == plain([None, "", " "]) and ids([None], state) == [[P.END_ID]] and ids([], state) == []
    rng = random.Random(5)
    letters = "aAbBzZ019 \n\t.,!'-<|>\"éÉßİ̱́̈日ا😀ǅ"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    assert ids(texts, state) == plain(texts)


def test_long_chunks_fill_the_cache_by_bytes(state, monkeypatch):
    monkeypatch.setattr(P, "ENTRY_BYTES", 40)
    for i in range(30):
        texts = [f"{'語' * 50}{i}x{j}" for j in range(10)]
        assert ids(texts, state, entries=100) == plain(texts)
        assert len(state[1]) < 60
