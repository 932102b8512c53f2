"""The pipeline's stages and its three modes, from genomes to a species tree.

* accurate: alignment, masking and fragment filter, then a distance tree improved by
  nearest-neighbour interchange under a Jukes-Cantor likelihood with fitted branch lengths;
* balanced: the same alignment, then neighbour joining improved under minimum evolution;
* fast: no alignment; neighbour joining on k-mer sketch distances.

Per-gene algorithms are small published ones and approximate the dedicated programs of such
pipelines; they do not equal them.  Every stage before a per-gene function is a DataFrame plan, and
filters stand before ``applyInPandas``, which the optimizer does not push them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, likelihood, msa, trees
from ..functions.storage import settle
from ..operators import alignments, chunks, families, gapped, hits, kmer, sampling, seeds
from ..sources.tables import Config
from . import species

K = {"fast": 10}
HIT_SCHEMA = "species string, gene_id int, score long, line_no long, pos long, strand string, target string, seq string, gene_length int"


# ------------------------------------------------------------------ similarity join


def candidates(genes: DataFrame, genome: DataFrame, cfg: Config) -> DataFrame:
    """``(species, gene_id, rec, strand, at, length)``: windows of records that are worth an alignment.

    Seeds (in the modes with alignment with a transition at one base) grow into gap-free segments; those
    of ``cfg.segment_score`` or more are chained; the best ``2 * max_dup`` chains of a gene in a genome
    count, and a chain's window has room for the rest of the gene and some gaps at both ends.
    """
    reach, room = 2 * cfg.length, cfg.length // 4
    matrix = (cfg.matrix or msa.HOXD55) if cfg.deep else msa.HOXD55
    found = seeds.segments(genes, genome, cfg.length, cfg.pattern, cfg.steps, cfg.mode != "fast", seeds.CODE_WORDS, matrix, cfg.segment_drop, cfg.segment_score)
    best = Window.partitionBy("species", "gene_id").orderBy(F.desc("score"), "rec", "t_start", "strand", "q_start", "t_end", "q_end")
    kept = seeds.chains(found, reach).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= 2 * cfg.max_dup)
    at = F.greatest(F.col("t_start") - F.col("q_start") - room, F.lit(0)).cast("long")
    own = kept.join(genes.select("gene_id", F.length("seq").alias("n")), "gene_id").withColumn("at", at)
    return own.select("species", "gene_id", "rec", "strand", "at", (F.col("t_end") + F.col("n") - F.col("q_end") + room - F.col("at")).alias("length"))


def similarity_join(genes: DataFrame, genome: DataFrame, cfg: Config) -> DataFrame:
    """Hits of every gene in every genome, on both strands: ``HIT_SCHEMA``.

    Local alignment, with affine gaps, of each candidate window; then the identity, coverage and
    continuity filters and the best ``2 * max_dup`` hits.  ``strand`` is the gene's; ``seq`` is the
    target's aligned row, turned to the gene's direction; ``pos`` the offset in the target record.
    Windows are cut from chunks, so no row holds a whole record; a table of chunks must reach
    ``4 * length + 2 * seed_length`` bases beyond each.
    """
    own = chunks.chunked(genome, 4 * cfg.length + 2 * cfg.seed_length)
    cand = settle(candidates(genes, own, cfg))
    cand = chunks.at(cand, own, "at", "length", name="window", few=cand.count() <= sampling.FEW)
    # small rows with much work each: as many parts, by number, as keep all slots busy
    cand = cand.repartition(4 * cand.sparkSession.sparkContext.defaultParallelism, "gene_id", "rec", "strand", "at")
    cand = cand.join(genes.select("gene_id", F.col("seq").alias("gene")), "gene_id").select("species", "gene_id", "rec", "strand", "at", "gene", "window")
    costs = {"matrix": cfg.matrix or msa.HOXD55, "start": 400, "step": 30} if cfg.deep else {"start": 4, "step": 2}

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = str.maketrans(dna.CODES, dna.COMPLEMENTS)
        names = ["species", "gene_id", "score", "line_no", "pos", "strand", "a", "b", "gene_length", "seq"]
        for batch in batches:
            strand, at, gene, window = (batch.column(c).to_pylist() for c in ("strand", "at", "gene", "window"))
            turned = [(g if s == "+" else g.translate(turn)[::-1]).upper() for g, s in zip(gene, strand)]
            got = list(gapped.local_alignments(turned, [w.upper() for w in window], **costs))
            keep = [k for k, x in enumerate(got) if x[2]]
            rows = [(got[k][0], at[k] + got[k][1], got[k][2], got[k][3], len(gene[k]), window[k][got[k][1] :][: len(got[k][3].replace("-", ""))]) for k in keep]
            score, pos, a, b, length, bare = (pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("species"), own.column("gene_id"), score, own.column("rec").cast(pa.int64()), pos, own.column("strand"), a, b, length, bare], names=names)

    kind = genes.schema["gene_id"].dataType.simpleString()
    pairs = cand.mapInArrow(extend, f"species string, gene_id {kind}, score long, line_no long, pos long, strand string, a string, b string, gene_length int, seq string")
    good = alignments.pair_filter(pairs, cfg.identity_deep if cfg.deep else cfg.identity, cfg.coverage, cfg.continuity)
    # of alignments that begin at one place, the best, and of equal ones always the same
    place = ["species", "gene_id", "line_no", "pos", "strand"]
    once = good.groupBy(*place).agg(F.max(F.struct("score", "seq")).alias("b")).select(*place, "b.score", "b.seq")
    best = hits.query_best(once, cfg.max_dup)
    return best.select("species", "gene_id", "score", "line_no", "pos", "strand", "seq")


# ------------------------------------------------------------------ per-gene functions


def align_families(members: DataFrame) -> DataFrame:
    """``(gene_id, taxon, aligned)``: each gene's rows, aligned.  A gene has at most species times
    copies rows, so a group is small however large the corpus."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("taxon")
        rows = msa.progressive(frame["taxon"].tolist(), frame["seq"].tolist())
        return pd.DataFrame({"gene_id": frame["gene_id"].iloc[0], "taxon": list(rows), "aligned": list(rows.values())})

    own = members.select("gene_id", "taxon", "seq").filter(F.length("seq") > 0)
    return own.groupBy("gene_id").applyInPandas(run, "gene_id int, taxon string, aligned string")


def _improve(tree: trees.Node, score) -> trees.Node:
    """Nearest-neighbour interchange until no neighbour scores higher."""
    top = score(tree)
    while True:
        found = [(score(t), -k, t) for k, t in enumerate(trees.neighbours(tree))]
        if not found or max(found, key=lambda x: x[:2])[0] <= top + 1e-9:
            return tree
        top, _, tree = max(found, key=lambda x: x[:2])


def _climb(tree: trees.Node, score) -> trees.Node:
    """As ``_improve``, but each interchange that gains is made at once: fewer scores."""
    top, found = score(tree), True
    while found:
        found = False
        for t in trees.neighbours(tree):
            own = score(t)
            if own > top + 1e-6:
                tree, top, found = t, own, True
                break
    return tree


def distance_trees(aligned: DataFrame, mode: str = "balanced") -> DataFrame:
    """``(gene_id, newick)``: one tree per gene with three rows or more."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("taxon")
        names, rows = frame["taxon"].tolist(), frame["aligned"].tolist()
        d = msa.distances(rows)
        tree = trees.neighbour_joining(names, d)
        if len(names) > 3:
            own = dict(zip(names, rows))
            if mode == "accurate":
                tips, weight = likelihood.patterns(own)
                tree = _climb(tree, lambda t: likelihood.fit(t, tips, weight, 1))
                likelihood.fit(tree, tips, weight, 6)
            else:
                tree = _improve(tree, lambda t: -msa.balanced_length(d, t, names))
        return pd.DataFrame({"gene_id": [frame["gene_id"].iloc[0]], "newick": [trees.text_of(tree)]})

    enough = aligned.groupBy("gene_id").agg(F.count("*").alias("n")).filter("n >= 3").select("gene_id")
    return aligned.join(enough, "gene_id", "left_semi").groupBy("gene_id").applyInPandas(run, "gene_id int, newick string")


def sketch_trees(members: DataFrame, k: int = 10) -> DataFrame:
    """``(gene_id, newick)`` from distances between bottom sketches of canonical k-mers; pairs that share
    none are at 1.  A member is one bounded row, so no k-mer is joined."""
    table = kmer.row_sketches(members.select("gene_id", "taxon", "seq"), k)
    pairs = kmer.mash_distance(kmer.sketch_pairs(table, "taxon", "gene_id"), k).select("gene_id", "a", "b", "distance")
    taxa = members.select("gene_id", F.col("taxon").alias("a"), F.col("taxon").alias("b"), F.lit(0.0).alias("distance")).distinct()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["a"]))
        names = sorted(set(names) | set(frame["b"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.ones((len(names), len(names)))
        np.fill_diagonal(d, 0)
        for a, b, x in zip(frame["a"], frame["b"], frame["distance"]):
            d[at[a], at[b]] = d[at[b], at[a]] = min(1.0, x)
        return pd.DataFrame({"gene_id": [frame["gene_id"].iloc[0]], "newick": [trees.text_of(trees.neighbour_joining(names, d))]})

    enough = members.groupBy("gene_id").agg(F.countDistinct("taxon").alias("n")).filter("n >= 3").select("gene_id")
    return pairs.unionByName(taxa).join(enough, "gene_id", "left_semi").groupBy("gene_id").applyInPandas(run, "gene_id int, newick string")


# ------------------------------------------------------------------ modes


@dataclass
class Stages:
    """The tables of a round, up to its gene families."""

    genes: DataFrame  # sampled; ids without a window have nulls
    found: DataFrame  # hits
    members: DataFrame  # (gene_id, species, copy, seq) of the families that pass the species gate
    least: int  # species that a family needs
    species: int


def stages(genome: DataFrame, cfg: Config, first_id: int = 0) -> Stages:
    """Sampling, similarity join and families.  ``first_id`` shifts gene ids, so that rounds of the
    convergence loop don't share any."""
    genes = settle(sampling.sample_genes(genome, cfg.gene_count, cfg.length, cfg.upper_case, seed=cfg.seed))
    genes = genes.withColumn("gene_id", F.col("gene_id") + first_id) if first_id else genes
    found = settle(similarity_join(genes.filter("seq is not null").select("gene_id", "seq"), genome, cfg))
    many = genome.select("species").distinct().count()
    members = families.with_min_species(hits.family(found, cfg.max_dup), cfg.min_species(many))
    return Stages(genes, found, members, cfg.min_species(many), many)


def gene_families(genome: DataFrame, cfg: Config, first_id: int = 0) -> DataFrame:
    """``(gene_id, species, copy, seq)`` that pass the species gate."""
    return stages(genome, cfg, first_id).members


def gene_trees(genome: DataFrame, cfg: Config, first_id: int = 0) -> DataFrame:
    """``(gene_id, newick)``; tips are ``<species>_<copy>``."""
    return trees_of(stages(genome, cfg, first_id), cfg)


def trees_of(done: Stages, cfg: Config) -> DataFrame:
    members, least = done.members.withColumn("taxon", F.concat_ws("_", "species", "copy")), done.least
    gate = families.alignment_gate(members, least, cfg.length).select("gene_id")
    members = members.join(gate, "gene_id", "left_semi")
    if cfg.mode == "fast":
        return sketch_trees(members, K["fast"])
    aligned = settle(align_families(members))
    aligned = alignments.filter_fragments(alignments.mask_sites(aligned, cfg.mask_sites), cfg.filter_fragments)
    gate = families.tree_gate(aligned, least, cfg.length, cfg.identity, "aligned").select("gene_id")
    return distance_trees(aligned.join(gate, "gene_id", "left_semi").select("gene_id", "taxon", "aligned"), cfg.mode)


def species_of(tip: str) -> str:
    return tip.rsplit("_", 1)[0]


def species_tree_and_stats(gene_tree_table: DataFrame) -> tuple[trees.Node | None, list[tuple]]:
    """The species tree and the statistics of its branches, ``species.STATS``."""
    return species.tree_and_stats(species.speciations(gene_tree_table), species.species_names(gene_tree_table))


def species_tree(gene_tree_table: DataFrame) -> DataFrame:
    """``(newick, n_species, n_branches)``, one row; none without gene trees."""
    tree, stats = species_tree_and_stats(gene_tree_table)
    rows = [] if tree is None else [(trees.text_of(tree), len(tree.tips()), len(stats) // 3)]
    return gene_tree_table.sparkSession.createDataFrame(rows, "newick string, n_species int, n_branches int")
