"""Queries without SQL run over all their rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import hits
from cladeloom.plans import fixtures as fx
from cladeloom.plans import modes
from cladeloom.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def taxa(spark):
    """gene_id -> number of species whose best hit is plain."""
    rows = hits.plain_only(hits.oriented(hits.ranked(fx.hits(spark, DATA), 1)))
    return {r["gene_id"]: r["n"] for r in rows.groupBy("gene_id").agg(F.countDistinct("species").alias("n")).collect()}


def test_alignment_holds_every_gene(spark, taxa):
    got = QUERIES["msa_progressive"](spark, DATA).groupBy("gene_id").count().collect()
    assert {r["gene_id"]: r["count"] for r in got} == taxa and len(taxa) == 200


@pytest.mark.parametrize("name", ["nj_tree", "mash_tree", "ml_tree"])
def test_a_tree_for_every_gene(spark, taxa, name):
    got = sorted(r["gene_id"] for r in QUERIES[name](spark, DATA).select("gene_id").collect())
    assert got == sorted(g for g, n in taxa.items() if n >= 3)


def test_species_tree_reads_all_trees(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(modes, "species_tree", lambda table: seen.append(table.count()))
    QUERIES["species_tree"](spark, DATA)
    assert seen == [fx.hits(spark, DATA).select("gene_id").distinct().count()]
