"""Bottom sketches and density curves against whole sets and direct sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.operators import chunks, families, kmer
from cladeloom.plans import modes

TURN = str.maketrans("ACGT", "TGCA")


def _canonical(seq: str, k: int) -> set[str]:
    own = {seq[i : i + k].upper() for i in range(len(seq) - k + 1)}
    return {min(s, s.translate(TURN)[::-1]) for s in own if set(s) <= set("ACGT")}


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [50, 10_000])
def test_sketches_merge_over_chunks_and_strands(spark, size):
    rng = random.Random(size)
    text = "".join(rng.choice("ACGTacgtN") for _ in range(4000))
    turned = text.upper().translate(TURN)[::-1]
    rows = [("a", 0, text), ("b", 0, turned[:1500]), ("b", 1, turned[1490:]), ("c", 0, "NNN"), ("d", 0, ""), ("e", 0, "ACG")]
    genome = spark.createDataFrame(rows, "species string, rec long, seq string")
    own = {r["species"]: r["sketch"] for r in kmer.sketches(chunks.chunked(genome, 11, 100), 11, size).collect()}
    whole = {r["species"]: r["sketch"] for r in kmer.sketches(genome, 11, size).collect()}
    assert own == whole and set(own) == {"a", "b"}
    want = len(_canonical(text, 11))
    assert len(own["a"]) == min(size, want) and own["a"] == sorted(set(own["a"])) == own["b"]


def test_estimate_is_within_its_sampling_error(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(30_000))
    rows, sets = [], {}
    for name, rate in zip("abcd", (0, 0.002, 0.01, 0.05)):
        seq = "".join(c if rng.random() >= rate else rng.choice("ACGT") for c in base)
        rows.append((name, 0, seq))
        sets[name] = _canonical(seq, 16)
    table = kmer.sketches(spark.createDataFrame(rows, "species string, rec long, seq string"), 16, 1000)
    got = {(r["a"], r["b"]): r["jaccard"] for r in kmer.sketch_pairs(table).collect()}
    assert len(got) == 6
    for (a, b), j in got.items():
        want = _jaccard(sets[a], sets[b])
        assert abs(j - want) <= 4 * math.sqrt(want * (1 - want) / 1000) + 0.002


def test_members_of_genes(spark):
    rows = [(1, "a_0", "ACGTACGGTCA" * 3), (1, "b_0", "ACGTACGGTCA" * 3), (1, "c_0", "TTGACCGATTTAGGACCC"), (2, "a_0", "ACGTACGGTCA"), (2, "b_0", None), (3, "a_0", "NN")]
    members = spark.createDataFrame(rows, "gene_id int, taxon string, seq string")
    table = kmer.row_sketches(members, 5)
    assert {(r["gene_id"], r["taxon"]) for r in table.collect()} == {(1, "a_0"), (1, "b_0"), (1, "c_0"), (2, "a_0")}
    got = {(r["gene_id"], r["a"], r["b"]): r["jaccard"] for r in kmer.sketch_pairs(table, "taxon", "gene_id").collect()}
    sets = {t: _canonical(s, 5) for g, t, s in rows if g == 1}
    assert got == {(1, a, b): round(_jaccard(sets[a], sets[b]), 9) for a, b in (("a_0", "b_0"), ("a_0", "c_0"), ("b_0", "c_0"))}
    assert modes.sketch_trees(members, 5).count() == 1


@pytest.mark.parametrize("step,close", [(0.01, 1e-4), (0.2, 0.02)])
def test_density_is_near_the_direct_sum(spark, step, close):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 0.5, 100)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    bins = families.density_bins(df.repartition(3), "v", step)
    rows = sorted(families.density(bins, step).collect())
    h = values.std(ddof=1) * len(values) ** -0.2
    assert len(rows) == 200
    for r in rows:
        want = np.exp(-(((r["x"] - values) / h) ** 2) / 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert abs(r["density"] - want) < close
    assert sum(r["density"] for r in rows) * (rows[1]["x"] - rows[0]["x"]) == pytest.approx(1, abs=0.01)


def test_bins_merge_and_few_values_have_no_curve(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    whole = {r["bin"]: r["weight"] for r in families.density_bins(df, "v", 0.7).collect()}
    halves = families.density_bins(df.filter("v < 9"), "v", 0.7).unionByName(families.density_bins(df.filter("v >= 9"), "v", 0.7))
    merged = {r["bin"]: r["w"] for r in halves.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}
    assert merged == pytest.approx(whole) and sum(whole.values()) == pytest.approx(1000)
    for own in (df.limit(0), df.limit(1), df.filter("v = 3")):
        assert families.density(families.density_bins(own, "v", 1.0), 1.0).count() == 0
