"""The committing sink: exact names, whole or nothing, and retries that leave nothing behind."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cladeloom.sources import fasta, maf, named


def _tree(folder) -> dict[str, str]:
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and p.suffix != ".gz"}


def test_names_order_and_replacement(spark, tmp_path):
    rows = [(f"d{k % 3}/f{k % 5}.txt", k) for k in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "f string, k int").repartition(7)
    for _ in range(2):  # once more: files are replaced, not grown
        named.write(df, str(tmp_path), F.col("f"), F.col("k").cast("string"), "k")
    want = {}
    for f, k in sorted(rows, key=lambda r: r[1]):
        want[f] = want.get(f, "") + f"{k}\n"
    assert _tree(tmp_path) == want
    named.lines(spark.range(3), str(tmp_path), "x.nwk.gz", F.concat(F.lit("(a,b);"), F.col("id")), "id")
    assert gzip.decompress((tmp_path / "x.nwk.gz").read_bytes()).decode() == "(a,b);0\n(a,b);1\n(a,b);2\n"
    named.write(df.limit(0), str(tmp_path / "none"), F.col("f"), F.col("f"))
    assert not (tmp_path / "none").exists() or not _tree(tmp_path / "none")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.range(40).repartition(4)
    bad = F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="no"):
        named.write(df, str(tmp_path), F.concat(F.lit("f"), F.col("id") % 8), bad, "id")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    named.write(df, str(tmp_path), F.concat(F.lit("f"), F.col("id") % 8), F.col("id").cast("string"), "id")
    assert set(_tree(tmp_path)) == {f"f{k}" for k in range(8)}


def test_attempts_that_are_not_committed_are_gone(tmp_path):
    """A retried task wrote twice; only what the finished attempt named is moved."""
    w = named.NamedWriter(str(tmp_path))
    rows = [{"file": "a.fa", "value": ">x"}, {"file": "a.fa", "value": "ACGT"}, {"file": "b.fa", "value": None}]
    w.write(iter(rows[:1]))
    done = w.write(iter(rows))
    w.commit([done, None])
    assert _tree(tmp_path) == {"a.fa": ">x\nACGT\n", "b.fa": ""}
    w = named.NamedWriter(str(tmp_path))
    two = [w.write(iter(rows[:1])), w.write(iter(rows[:1]))]
    with pytest.raises(ValueError):
        w.commit(two)
    for bad in ([{"file": "../x", "value": ""}], [{"file": n, "value": ""} for n in "aba"]):
        with pytest.raises(ValueError):
            w.write(iter(bad))
    w.abort([])
    assert _tree(tmp_path) == {"a.fa": ">x\nACGT\n", "b.fa": ""} and not list(tmp_path.glob("_writing*"))


def test_families_and_alignments_come_back(spark, tmp_path):
    members = spark.createDataFrame([(1, "a", 0, "ACGT"), (1, "b_x", 1, ""), (3, "a", 0, "GG")], "gene_id int, species string, copy int, seq string")
    named.gene_files(members, spark.range(1, 5).select(F.col("id").cast("int").alias("gene_id")), str(tmp_path / "genes"))
    assert _tree(tmp_path / "genes") == {"gene_1.fa": ">a_0\nACGT\n>b_x_1\n\n", "gene_2.fa": "", "gene_3.fa": ">a_0\nGG\n", "gene_4.fa": ""}
    rows = fasta.read_chunks(spark, str(tmp_path / "genes"), 0).select("species", "rec", "seq").collect()
    assert {tuple(r) for r in rows} == {("gene_1", 0, "ACGT"), ("gene_3", 0, "GG")}
    hits = spark.createDataFrame([("a", 7, 90, 5, "-", "AC-G", "ACCG"), ("a", 2, 10, 8, "+", "A", "A")], "species string, gene_id int, score long, pos long, strand string, target string, seq string")
    named.maf_files(hits, str(tmp_path / "maf"), "score")
    got = {tuple(r) for r in maf.read(spark, str(tmp_path / "maf")).collect()}
    assert got == {("a", 2, 10, 1, 8, "+", "A", "A"), ("a", 7, 90, 5, 5, "-", "AC-G", "ACCG")}
