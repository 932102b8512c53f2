"""Whole runs on genomes evolved along a known tree."""

from __future__ import annotations

import random

import pytest

from cladeloom.functions import trees
from cladeloom.plans import converge, modes
from cladeloom.sources import fasta
from cladeloom.sources.tables import Config

TRUTH = "(((a,b),c),((d,e),f));"


def evolve(seq, rate, rng):
    out = []
    for c in seq:
        x = rng.random()
        if x < rate * 0.9:
            out.append(rng.choice("ACGT".replace(c, "")))
        elif x < rate * 0.95:
            out += [c, rng.choice("ACGT")]
        elif x >= rate:
            out.append(c)
    return "".join(out)


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(11)
    tree = trees.parse(TRUTH)
    rows = []

    def walk(node, seq):
        for k, c in enumerate(node.children):
            walk(c, evolve(seq, 0.04, rng))
        if not node.children:
            rows.append((node.name, 0, seq[: len(seq) // 2]))
            rows.append((node.name, 1, seq[len(seq) // 2 :]))

    walk(tree, "".join(rng.choice("ACGT") for _ in range(6000)))
    return spark.createDataFrame(rows, "species string, rec long, seq string")


CFG = Config(gene_count=8, length=300, max_dup=3, min_align=4, seed_length=14)


@pytest.mark.parametrize("mode", ["fast", "balanced", "accurate"])
def test_modes_recover_the_tree(genome, mode):
    table = modes.gene_trees(genome, Config(**{**CFG.__dict__, "mode": mode}))
    rows = table.collect()
    assert len(rows) >= 5
    for r in rows:
        assert {modes.species_of(t) for t in trees.parse(r["newick"]).tips()} <= set("abcdef")
    tree, stats = modes.species_tree_and_stats(table)
    assert trees.robinson_foulds(tree, trees.parse(TRUTH)) <= (0.34 if mode == "fast" else 0.0)
    assert len(stats) == 9 and [r[2] for r in stats] == [1, 2, 3] * 3


def test_hits_lie_where_the_gene_comes_from(genome):
    from pyspark.sql import functions as F

    genes = genome.filter("species = 'a' AND rec = 0").select(F.lit(1).alias("gene_id"), F.substring("seq", 1001, 300).alias("seq"))
    rows = {r["species"]: r for r in modes.similarity_join(genes, genome, Config(**{**CFG.__dict__, "seed_length": 10})).collect()}
    assert set(rows) == set("abcdef") and rows["a"]["pos"] == 1000 and rows["a"]["seq"] == genes.first()["seq"]
    assert all(abs(r["pos"] - 1000) < 60 and r["strand"] == "+" for r in rows.values())


def test_convergence_loop(spark, genome, tmp_path):
    cfg = Config(**{**CFG.__dict__, "mode": "fast", "gene_count": 4})
    out = str(tmp_path / "run")
    table = converge.run(spark, genome, cfg, out, reference=TRUTH, most=2)
    rows = sorted(table.collect(), key=lambda r: r["iteration"])
    assert 1 <= len(rows) <= 2 and all(0 <= r["norm_rf"] <= 1 for r in rows)
    assert rows[-1]["gene_trees"] == spark.read.parquet(f"{out}/gene_trees").count()
    assert converge.run(spark, genome, cfg, out, reference=TRUTH, most=2).count() == len(rows)  # nothing left to do
    assert converge.gene_counts(Config(gene_count=5), 5) == [5, 5, 10, 20, 40]


def test_command_line_and_output_files(spark, genome, tmp_path):
    from cladeloom import __main__ as cli
    from cladeloom.plans import outputs

    folder = tmp_path / "genomes"
    folder.mkdir()
    for name in "abcdef":
        rows = sorted(genome.filter(f"species = '{name}'").collect())
        (folder / f"{name}.fa").write_text("".join(f">c{r['rec']}\n{r['seq']}\n" for r in rows))
    (tmp_path / "ref.nwk").write_text(TRUTH)
    (tmp_path / "c.yaml").write_text(f"GENOMES: {folder}\nREFERENCE: {tmp_path}/ref.nwk\nLENGTH: 300\nGENE_COUNT: 4\nMAX_DUP: 3\nSEED_LENGTH: 14\nOUT_DIR: {tmp_path}/out\nALL_OUT_DIR: {tmp_path}/all\n")
    cli.main(["--config", str(tmp_path / "c.yaml"), "--mode", "fast", "--noconverge"])
    assert spark.read.text(str(tmp_path / "out/original_list")).count() == 4
    (tree,) = spark.read.text(str(tmp_path / "out/species_tree")).collect()
    assert set(trees.parse(tree[0]).tips()) == set("abcdef")
    assert spark.read.csv(str(tmp_path / "all/ref_dist"), header=True).count() == 1
    first = tmp_path / "all/iteration_01"
    for name in ("samples", "samples_all", "genes", "genes/mapping", "statistics/sampling", "statistics/num_genes", "statistics/homologs", "statistics/gene_dup", "statistics/gene_to_species", "statistics/num_gt"):
        assert (first / name).is_dir(), name
    assert 1 <= fasta.read_text(spark, str(first / "samples_all")).count() <= 4

    members = modes.gene_families(genome, CFG)
    found = members.selectExpr("species", "gene_id", "1L score", "2L line_no", "3L pos", "'+' strand", "seq")
    outputs.family_files(found, members, CFG, 6, str(tmp_path / "fam"))
    assert spark.read.csv(str(tmp_path / "fam/statistics/num_genes"), header=True).count() == 6
    jobs = spark.createDataFrame([("a", "1", 2.0, 1.0)], "step string, job string, wall_min double, cpu_min double")
    outputs.job_report(jobs, str(tmp_path / "jobs"))
    assert spark.read.csv(str(tmp_path / "jobs/slowest_long"), header=True).count() == 2


def test_many_species(spark):
    """Gene trees of 60 species, each with interchanges: the species tree is found."""
    rng = random.Random(5)
    names = [f"s{k:02}" for k in range(60)]
    nodes = [trees.Node(n) for n in names]
    while len(nodes) > 1:
        a, b = rng.sample(range(len(nodes)), 2)
        nodes = [n for k, n in enumerate(nodes) if k not in (a, b)] + [trees.Node(children=[nodes[a], nodes[b]])]
    truth = nodes[0]
    rows = []
    for g in range(40):
        t = trees.parse(trees.text_of(truth, lengths=False))
        for n in t.walk():
            if not n.children:
                n.name += "_0"
        for _ in range(4):
            from cladeloom.functions import quartets

            quartets.interchange(rng.choice(quartets.branches(t)), rng.choice([1, 2]))
        rows.append((g, trees.text_of(t, lengths=False)))
    tree, stats = modes.species_tree_and_stats(spark.createDataFrame(rows, "gene_id int, newick string"))
    assert trees.robinson_foulds(tree, truth) <= 0.02 and len(stats) == 3 * 57
    assert sum(r[3] > 0.9 for r in stats if r[2] == 1) >= 54
