"""What packing saves must not show in its ids, neighbours or sequences."""

from __future__ import annotations

import random

import numpy as np

from cladeloom.llm import packing

from .test_documents import prose


def test_words_are_cut_once_and_give_the_tokenizers_ids():
    encoder = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(8)
    signs = [".", ",", "...", ".,", ").", ".)", "'s", "'", "''s", "!'s", "don't", "42", "3.14", "a,b", " ", "\n", "\t", "\x0b", "\x0c", "", "\x7f", "É", "ß", "×", "ж", "-", " ", "é.", "é", "ªb", "x'LL.", "Ünï,cödé"]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.5 else prose(k * j, 1) + rng.choice(["", " "]) for j in range(12)) for k in range(600)]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.text(text), np.uint16).tolist() == want, repr(text)
    plain = packing.Encoder(packing.tokenizer_path())
    plain.text("well-known words, once. well-known (words) once")
    assert {"well-known", ".", ",", "once"} <= set(plain) and "once." not in plain


def test_used_documents_leave_the_index_and_the_scores_stay():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint16) for _ in range(60)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    index, whole = (packing.ShardIndex(ids, idf, 100.0) for _ in range(2))
    left = np.ones(60, bool)
    for _ in range(3):
        left[rng.choice(60, 15)] = False
        index.keep(left)
        assert all((index.scores(j)[left] == whole.scores(j)[left]).all() and not index.scores(j)[~left].any() for j in range(60))
    assert len(index.owner) < len(whole.owner) // 2


def test_sequences_do_not_depend_on_what_is_indexed(monkeypatch):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint16) for _ in range(90)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    kept, keep = [], packing.ShardIndex.keep
    monkeypatch.setattr(packing.ShardIndex, "keep", lambda self, docs: kept.append(int(docs.sum())) or keep(self, docs))
    got = packing.pack_shard(ids, idf, 100.0, 512)
    monkeypatch.setattr(packing.ShardIndex, "keep", lambda self, docs: None)
    assert got == packing.pack_shard(ids, idf, 100.0, 512) and len(kept) > 3


def test_encoders_caches_go():
    packing._encoder(packing.tokenizer_path()).text("some words")
    packing._forget()
    assert not packing._ENCODERS
