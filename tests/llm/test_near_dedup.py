"""The pipeline's near-dedup stage against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeloom.llm import common, near_dedup

from .test_documents import ODD, frame, odd, empty, prose  # noqa: F401


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                pairs += sets[i] != sets[j]
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted(low.values()), pairs


def near_rows():
    rng = random.Random(4)
    rows = []
    for d in range(40):
        words = prose(d, rng.choice([30, 80, 200])).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(5)):  # a chain of edits: its ends may lie further apart than 0.8
            for _ in range(rng.choice([1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    rng.shuffle(rows)
    return [(100 + k, t) for k, (_, t) in enumerate(rows)]


def test_stage_keeps_one_of_each_group_at_five_word_jaccard(spark):
    rows = near_rows()
    want, pairs = brute_kept(rows)
    got = sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, frame(spark, rows), "").collect())
    assert got == want and pairs >= 40 and len(want) < len(rows) - 30


def test_odd_rows(spark, odd, empty):  # noqa: F811
    left = near_dedup.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([1, 4, 5, 7, 8, None], key=repr)
    assert near_dedup.keep_one(empty).count() == 0 and near_dedup.near_duplicates(empty).count() == 0


def test_rows_are_told_apart_not_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (1, b), (None, c), (None, a), (2, c + " end"), (1, a), (None, prose(4, 50)), (None, prose(4, 50))]
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c + " end"), (None, prose(4, 50))], key=repr)
    groups = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert groups == {(1, 1), (None, 2), (None, 1), (2, 2), (None, None)}


@pytest.mark.parametrize("stars,listed", [(0, 1 << 18), (2, 1 << 18), (2, 5), (1, 0)])
def test_every_pair_at_the_threshold_is_met(spark, monkeypatch, stars, listed):
    """One large group of short texts, most of them a little below the threshold, beside chains and copies."""
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    monkeypatch.setattr(near_dedup, "STARS", stars)
    monkeypatch.setattr(near_dedup, "CHUNK", 200)
    monkeypatch.setattr(near_dedup, "SEEN", 7)
    rng = random.Random(stars + listed)
    base = prose(9, 24).split()
    texts = [" ".join(base[: rng.randrange(5, 25)]) for _ in range(20)] + near_rows_texts(rng)
    for _ in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.choice([0, 0, 1, 23, 23, 12])] = f"y{rng.randrange(12)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, _ = brute_kept(rows)
    got = sorted(r["doc_id"] for r in near_dedup.keep_one(frame(spark, rows)).collect())
    assert got == want


def near_rows_texts(rng):
    return [t for _, t in near_rows()[:60]]


def test_prefixes_of_similar_sets_meet():
    """In any order, sets at the threshold share a prefix shingle whose places leave enough room."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        often = rng.choice(60, rng.integers(0, 30), replace=False).astype(np.uint64)
        order = near_dedup.Order(often, rng.integers(1, 9, len(often)))
        a = np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64)
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - rng.integers(0, 5)), replace=False), rng.choice(60, rng.integers(0, 4)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both < 4 * (len(a) + len(b) - both):
            continue
        p, q = order.prefix(a, 80).tolist(), order.prefix(b, 80).tolist()
        assert any(180 * min(len(a) - p.index(x), len(b) - q.index(x)) >= 80 * (len(a) + len(b)) for x in set(p) & set(q))


def test_sketches_refuse_no_similar_pair():
    """Also where a byte's count is above what a sketch can hold."""
    rng = np.random.default_rng(5)
    refused = 0
    for k in range(400):
        top = rng.choice([256, 4, 1])
        values = np.unique(rng.integers(0, top, 3000).astype(np.uint64) << np.uint64(56) | rng.integers(0, 1 << 20, 3000).astype(np.uint64))
        n, gone = rng.integers(1, len(values)), rng.random() * 0.4
        a, b = values[:n] if top == 1 else np.sort(rng.choice(values, n, replace=False)), values
        b = np.union1d(a[rng.random(n) > gone], b[rng.random(len(b)) < gone * 0.2])
        both = len(np.intersect1d(a, b))
        said = near_dedup.enough(*(np.frombuffer(near_dedup.sketch(x), np.uint8)[None] if j == 0 else np.array([len(x)]) for x in (a, b) for j in (0, 1)), 80)[0]
        refused += not said
        assert said or 100 * both < 80 * (len(a) + len(b) - both)
    assert refused > 100


def test_only_sets_of_possible_pairs_are_written(spark, monkeypatch):
    """Texts that share a passage, and so rare shingles, but are far from similar move no whole sets."""
    rows = [(k, prose(k, 90) + " " + prose(10**6 + k // 4, 60)) for k in range(80)]
    rows += [(100, prose(7, 90) + " " + prose(10**6 + 1, 60) + " end")]
    moved, table = {}, near_dedup.Scratch.table

    def noted(self, df, name, by=None):
        out = table(self, df, name, by)
        moved[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup.Scratch, "table", noted)
    monkeypatch.setattr(near_dedup, "LISTED", 0)
    got = sorted(r["doc_id"] for r in near_dedup.keep_one(frame(spark, rows)).collect())
    assert got == list(range(80)) and moved["live"] > 400
    assert 2 <= moved["sets0"] + moved["sets1"] <= 8


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    scratch = common.Scratch(spark, "tidy")
    out = scratch.table(spark.range(1000).repartition(3).groupBy("id").count(), "t")
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written = spark.range(1000).repartition(5).groupBy("id").count()
    written.write.parquet(f"{tmp_path}/t")  # not by Scratch: these stay
    left = {str(f) for f in store.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = len(left)
    scratch.table(spark.range(1000).repartition(7).groupBy("id").count(), "u")
    left = {f for f in store.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    assert before and len(left) <= before and out.count() == 1000
    assert spark.conf.get(common.TIDY, None) is None
    scratch.close(out)


def test_rows_go_to_python_in_batches_of_few_bytes(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["b"])

    before = spark.conf.get(common.BATCH)
    wide = spark.range(400).repartition(1).select(F.repeat(F.lit("x"), 2000).alias("t"))
    plain, small = common.Scratch(spark, "plain"), common.Scratch(spark, "small", "64k")
    assert small.table(wide.mapInArrow(sizes, "b long"), "t").agg(F.max("b")).first()[0] < 100_000
    assert plain.table(wide.mapInArrow(sizes, "b long"), "t").agg(F.max("b")).first()[0] > 800_000
    assert spark.conf.get(common.BATCH) == before
    plain.close(wide), small.close(wide)

    seen = []
    table = common.Scratch.table
    monkeypatch.setattr(common.Scratch, "table", lambda self, df, name, by=None: seen.append((name, self.settings.get(common.BATCH))) or table(self, df, name, by))
    monkeypatch.setattr(near_dedup, "BATCH", "2k")
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} end{k}") for k in range(30)] + [(100 + k, " ".join(f"a{k}b{j}" for j in range(40))) for k in range(30)]
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(frame(spark, rows)).collect())
    assert kept == [0, *range(100, 130)] and {("sig", "2k"), ("points", "2k"), ("sets1", "2k")} <= set(seen)
