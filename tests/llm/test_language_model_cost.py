"""What the language model saves must not show in its words, pieces or counts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cladeloom.llm import language_model
from cladeloom.llm.packing import tokenizer_path

from .test_documents import prose


def words(n: int) -> list[bytes]:
    rng = random.Random(5)
    parts = [*prose(3, 300).split(), "inter", "national", "$$$", "ü", "ß", "1234", "-", "x" * 40, "жук", "the"]
    return [b"".join(rng.choice(parts).encode() for _ in range(rng.randrange(1, 4)))[rng.randrange(3) :] or b"?" for _ in range(n)]


class Asked(dict):
    times = 0

    def get(self, *key):
        self.times += 1
        return dict.get(self, *key)


def test_the_longest_first_piece_takes_few_lookups():
    speller = language_model.Speller(tokenizer_path())
    some = [w for w in set(words(4000)) if w not in speller.last]
    speller.begins = Asked(speller.begins)
    for w in some:
        k = max(k for k in range(1, len(w)) if w[:k] in speller.inner)
        assert speller.first(w) == (speller.inner[w[:k]], k), w
    assert len(some) > 1000
    speller.begins.times = 0
    for w in some:  # heads that were met are known
        speller.first(w + b"$")
    assert speller.begins.times < 2 * len(some)


def test_words_are_counted_by_slices(spark, monkeypatch):
    some = words(600)
    rows = [(b" ".join(some[k : k + 7]), k % 3 > 0) for k in range(0, 600, 5)] + [(b"", True), (b" \n", False), (b"OnLy In\xc3\x9c", False)]
    want: Counter = Counter()
    for raw, train in rows:
        for w in language_model.tokens_of(raw):
            want[w] += train
    monkeypatch.setattr(language_model, "tokens_of", None)  # not text by text
    texts = spark.createDataFrame(rows, "_bytes binary, train boolean")
    got = language_model.word_counts(texts.repartition(5), "train").collect()
    assert {bytes(r["word"]): r["c"] for r in got} == want
    assert all(r["h"] == language_model.word_hashes([bytes(r["word"])]).view(np.int64)[0] for r in got)
    assert language_model.word_counts(texts.limit(0), "train").count() == 0


def test_rows_of_words_and_their_tails():
    speller, some = language_model.speller_of(tokenizer_path()), list(dict.fromkeys(words(900)))
    kept = language_model.Words(np.sort(language_model.word_hashes(some[:50]).view(np.int64)), speller)
    first = kept.rows(some[:300])
    assert first.tolist() == list(range(300)) and kept.rows(some[100:]).tolist() == list(range(100, len(some)))
    assert list(kept.first) == [speller.first(w)[0] for w in some] and list(kept) == some
    assert (kept.codes(first)[:50] >= 0).all() and (kept.codes(first)[50:] < 0).all()

    h, n = language_model._tails(np.array([1, 1, 1, 3]), np.array([7, -2, 7, 7]), 5)
    assert h.to_pylist() == [[], [-2, 7], [], [7], []] and n.to_pylist() == [[], [1, 2], [], [1], []]
    assert language_model._tails(np.array([], int), np.array([], int), 2)[0].type == pa.list_(pa.int64())
