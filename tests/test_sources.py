"""Readers and writers: round trips and malformed input."""

from __future__ import annotations

import gzip

import pytest

from cladeloom.sources import fasta, maf, tables


def put(folder, name, text):
    path = folder / name
    data = text.encode()
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return path


def test_fasta_and_fastq(spark, tmp_path):
    put(tmp_path, "Fly_one.fa", ">c1 first contig\r\nACGT\r\n\r\nacg\r\n>empty\n>c2\nNN\n")
    put(tmp_path, "bee.fasta.gz", ">x\nAC\nGT")
    put(tmp_path, "cow.fq", "@r1 note\nACGT\n+\n@@II\n@r2\nAC\nGT\n+r2\nII\nII\n")
    put(tmp_path, "notes.txt", ">no\nA\n")
    rows = {(r["species"], r["rec_idx"]): r for r in fasta.read(spark, str(tmp_path)).collect()}
    got = {k: (r["name"], r["comment"], r["seq"], r["qual"], r["is_fastq"], r["len"]) for k, r in rows.items()}
    assert got == {
        ("Fly_one", 0): ("c1", "first contig", "ACGTacg", None, False, 7),
        ("Fly_one", 1): ("empty", "", "", None, False, 0),
        ("Fly_one", 2): ("c2", "", "NN", None, False, 2),
        ("bee", 0): ("x", "", "ACGT", None, False, 4),
        ("cow", 0): ("r1", "note", "ACGT", "@@II", True, 4),
        ("cow", 1): ("r2", "", "ACGT", "IIII", True, 4),
    }
    assert {tuple(r) for r in fasta.read_genomes(spark, str(tmp_path)).filter("species = 'bee'").collect()} == {("bee", 0, "ACGT")}


def test_truncated_qualities():
    with pytest.raises(fasta.BadRecord):
        list(fasta.records(iter(["@r", "ACGT", "+", "II"])))
    with pytest.raises(fasta.BadRecord):
        list(fasta.records(iter(["@r", "AC", "+", "III"])))
    assert list(fasta.records(iter([]))) == []


def test_fasta_writer(spark, tmp_path):
    df = spark.createDataFrame([("gene_1", "ACGT", "a"), ("gene_2 x", None, "b"), ("gene_3", "AC", "a")], "name string, seq string, species string")
    fasta.write(df, str(tmp_path / "out"), by="species")
    back = {(r["name"], r["comment"], r["seq"]) for r in fasta.read_text(spark, str(tmp_path / "out")).select("name", "comment", "seq").collect()}
    assert back == {("gene_1", "", "ACGT"), ("gene_2", "x", ""), ("gene_3", "", "AC")}
    fasta.write(df, str(tmp_path / "gz"), compression="gzip")
    assert fasta.read_text(spark, str(tmp_path / "gz")).count() == 3


def test_maf(spark, tmp_path):
    put(tmp_path, "fly.maf", "##maf\n# any number of lines\na score=12 mismap=1\ns chr1 7 4 + 99 AC-GT\ns gene_3 0 5 - 9 ACCGT\n\na score=5\ns chr2 1 1 + 9 A\ns gene_10 0 1 + 9 A\nq x\n\na score=1\ns alone 0 1 + 9 A\n")
    rows = sorted(maf.read(spark, str(tmp_path)).collect(), key=lambda r: r["gene_id"])
    assert [(r["species"], r["gene_id"], r["score"], r["line_no"], r["pos"], r["strand"], r["target"], r["seq"]) for r in rows] == [
        ("fly", 3, 12, 3, 7, "-", "AC-GT", "ACCGT"),
        ("fly", 10, 5, 7, 1, "+", "A", "A"),
    ]


def test_newick_lists(spark, tmp_path):
    put(tmp_path, "t.nwk", "(a,b,c);\n\n7, (a,(b,c));\n9,\n")
    assert {tuple(r) for r in tables.newick(spark, str(tmp_path / "t.nwk")).collect()} == {(1, "(a,b,c);"), (7, "(a,(b,c));")}
    tables.register(spark)
    tables.newick(spark, str(tmp_path / "t.nwk")).createOrReplaceTempView("t")
    assert spark.sql("SELECT tree_id, n.* FROM t, LATERAL newick_nodes(newick) n").count() == 9


def test_statistics_and_timings(spark, tmp_path):
    put(tmp_path, "freq.csv", "N1\tt1\t0.9\nN1\tt2\tx\n\n")
    rows = sorted(tables.branch_stats(spark, str(tmp_path / "freq.csv")).collect())
    assert [(r["line_no"], r["support"]) for r in rows] == [(0, 0.9), (1, None)]
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    put(jobs, "gene_1.align.txt", "s\th:m:s\tcpu\n120\t0:02:00\t60\n")
    put(jobs, "gene_2.align.txt", "s\th:m:s\tcpu\n120\t0:02:00\tNA\n")
    put(jobs, "gene_3.search.txt", "s\th:m:s\tcpu\n")
    assert [tuple(r) for r in tables.job_timings(spark, str(jobs)).collect()] == [("align", "gene_1", 2.0, 1.0)]


def test_matrix_and_config():
    assert tables.matrix("A C G T\n1 2 3 4\n5 6 7 8\n9 1 2 3\n4 5 6 7\n")[1] == [5, 6, 7, 8]
    assert tables.matrix("  A C G T\nA 1 2 3 4\nC 5 6 7 8\nG 9 1 2 3\nT 4 5 6 7\n")[3][0] == 4
    with pytest.raises(ValueError):
        tables.matrix("1 2\n3 4\n")
    c = tables.config("LENGTH: 200  # bases\nREFERENCE: NULL\nUPPER_CASE: 0.5\nOTHER: 1\nGENE_COUNT: 50\n", mode="fast")
    assert (c.length, c.reference, c.upper_case, c.gene_count, c.mode) == (200, None, 0.5, 50, "fast")
    assert c.grown().gene_count == 100 and c.gene_count == 50
    assert (c.min_species(11), c.min_species(100)) == (4, 10)
    for bad in ({"length": 0}, {"mode": "x"}, {"mask_sites": 2.0}):
        with pytest.raises(ValueError):
            tables.Config(**bad)


def test_gene_tree_stream(spark, tmp_path):
    from cladeloom.streaming import gene_trees

    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.nwk", "(a,b,c);\n1, (a,(b,c));\n")
    for k in range(2):
        gene_trees.accumulate(gene_trees.stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if not k:
            put(src, "b.nwk", "(x,y,z);\n\n")
    assert {r["newick"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"(a,b,c);", "(a,(b,c));", "(x,y,z);"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert gene_trees.arrivals(gene_trees.stream(spark, str(src))).isStreaming


def test_fasta_in_chunks(spark, tmp_path):
    import gzip
    import random

    from cladeloom.operators import chunks

    rng = random.Random(4)
    recs = [("a1", "".join(rng.choice("ACGTacgtN") for _ in range(n))) for n in (0, 1, 99, 100, 101, 1234)]
    text = "".join(f">{n} note {k}\n" + "\n".join(s[i : i + 70] for i in range(0, len(s), 70)) + "\r\n\n" for k, (n, s) in enumerate(recs))
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fasta.gz", "wt") as f:
        f.write(">one\n" + recs[-1][1])  # one line without an end
    (tmp_path / "z.fq").write_text("@r\n" + "ACGT" * 60 + "\n+\n" + "I" * 240 + "\n")
    got = fasta.read_chunks(spark, str(tmp_path), 7, 100)
    want = set()
    for species, own in (("x", [s for _, s in recs]), ("y", [recs[-1][1]]), ("z", ["ACGT" * 60])):
        for k, s in enumerate(own):
            want |= {(species, k, at, min(100, len(s) - at), s[at : at + 107]) for at in range(0, len(s), 100)}
    assert {tuple(r) for r in got.collect()} == want
    whole = spark.createDataFrame([("x", k, s) for k, (_, s) in enumerate(recs)], "species string, rec long, seq string")
    assert {tuple(r) for r in chunks.chunked(whole, 7, 100).collect()} == {r for r in want if r[0] == "x"}
    for part in (1, 3, 64):
        cut = [line[i : i + part] for line in text.splitlines(keepends=True) for i in range(0, len(line), part)]
        assert {("x", k, at, own, s) for k, _, at, own, s in fasta.chunks(iter(cut), 100, 7)} == {r for r in want if r[0] == "x"}


def test_newest_file(spark, tmp_path):
    import os

    for k, n in enumerate(("b.log", "a.log", "c.txt")):
        (tmp_path / n).write_text("x")
        os.utime(tmp_path / n, (1_000_000 + k, 1_000_000 + k))
    assert tables.newest(spark, str(tmp_path), "*.log").endswith("/a.log")
