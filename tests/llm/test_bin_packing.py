"""Best-fit packing: places, ids, bounds, and the genetic algorithm against exhaustive packing."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from cladeloom.llm import bin_packing
from cladeloom.llm.packing import tokenizer_path

SCHEMA = "doc_id long, text string, start string, shard string, row string"


def _ids(text: str) -> list[int]:
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


def _check(rows: list, docs: dict, window: int) -> int:
    """Every id in one piece, only long documents cut, windows gapless and never over-full; the number of windows."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc, own in by_doc.items():
        ids = _ids(docs[doc])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // window)))
        assert [r["start"] for r in own] == [window * k for k in range(len(own))]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] == min(window, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return len(by_bin)


def _texts(n: int, seed: int, longest: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(["tree", "leaf", "root", "branch"]) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_pieces_and_levels(spark):
    texts = [*_texts(300, 1, 60), "stone " * 200, "", None, "leaf " * 63, "leaf " * 64, "leaf leaf", "leaf leaf"]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t, "x", "y", None) for k, t in docs.items()], SCHEMA).repartition(3)
    out = bin_packing.pack(df, window=64, shard_pieces=40).collect()
    bins = _check(out, docs, 64)
    total = sum(len(_ids(t)) for t in texts)
    assert bins <= -(-total // 64) + 2
    assert out[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_more_than_one_shard_gives_back_its_loose_bins(spark, monkeypatch):
    monkeypatch.setattr(bin_packing, "SHARD_BINS", 8)
    texts = _texts(600, 2, 50)
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = bin_packing.pack(df, window=64, shard_pieces=100).collect()
    levels = {r["sequence_id"] >> 56 for r in rows if r["sequence_id"] >= 0}
    assert len(levels) > 1
    assert _check(rows, docs, 64) <= -(-sum(len(_ids(t)) for t in texts) // 64) + 3


def test_empty_null_and_repeated(spark):
    assert bin_packing.pack(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    rows = bin_packing.pack(spark.createDataFrame([(None, "leaf"), (None, "leaf"), ("a", None)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["length"], r["offset"]) for r in rows)[0][0] == ""
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1


def _fewest(sizes: list[int], window: int) -> int:
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for s, b in zip(sizes, where):
                fill[b] += s
            if max(fill) <= window:
                return n
    raise AssertionError


@pytest.mark.parametrize("seed", range(6))
def test_evolution_reaches_the_best_packing_of_few_pieces(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted((rng.randrange(3, 30) for _ in range(8)), reverse=True))
    own = bin_packing.Island(sizes, 50, [seed])
    own.begin(6, True)
    own.evolve(60, 6)
    assert own.best()[0][0] == _fewest(sizes.tolist(), 50)


def test_crossover_beats_best_fit_where_that_fails():
    """Triplets that fill windows exactly: longest-first best fit can't find them."""
    rng = np.random.default_rng(5)
    a = rng.integers(380, 490, 40)
    b = rng.integers(250, 1000 - a - 250)
    sizes = np.sort(np.concatenate([a, b, 1000 - a - b]))[::-1]
    own = bin_packing.Island(sizes, 1000, [1])
    own.begin(12, True)
    first = own.members[0][0][0]
    own.evolve(400, 12)
    assert own.best()[0][0] < first
    where = own.best()[1]
    assert np.bincount(where, weights=sizes).max() <= 1000 and len(where) == len(sizes)


def test_a_child_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 4000, 500))[::-1]
    own = bin_packing.Island(sizes, 4096, [2])
    own.bound = 0
    own.begin(4, True)
    for _ in range(20):
        child = own.child(own.members[0][1], own.members[1][1])
        assert child.min() == 0 and len(np.unique(child)) == child.max() + 1
        assert own.fills(child).max() <= 4096 and own.fills(child).sum() == sizes.sum()
