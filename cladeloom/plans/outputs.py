"""The files of a run: text tables in any store that Spark writes, and sequences under exact names.

Every output is overwritten, so a repeated run leaves no doubled lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import families, hits, reports, sampling, trees
from ..sources import fasta, named
from ..sources.tables import Config
from . import modes


def _csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def _lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def sampling_files(genes: DataFrame, out: str) -> None:
    """Sampled genes as FASTA per species and in one folder, and their counts."""
    own = genes.filter("seq is not null").withColumn("name", F.concat(F.lit("gene_"), "gene_id"))
    named.write(own, f"{out}/samples", F.concat("species", F.lit("_temp.fa")), named.fasta_record(F.col("name"), F.col("seq")), "gene_id")
    fasta.write(own, f"{out}/samples_all")
    _csv(sampling.fragments_per_species(own), f"{out}/statistics/sampling")


def family_files(found: DataFrame, members: DataFrame, cfg: Config, species: int, out: str, ids: DataFrame | None = None) -> None:
    """Gene families as ``gene_<id>.fa``, empty for ids without one, the copy mapping, and the statistics of
    the hit stage."""
    named.gene_files(members, members if ids is None else ids, f"{out}/genes")
    _lines(hits.copy_mapping(members).select(F.concat_ws(" ", "taxon", "species")), f"{out}/genes/mapping")
    least = cfg.min_species(species)
    stats = f"{out}/statistics"
    _csv(families.genes_per_species(found), f"{stats}/num_genes")
    _csv(families.homologs(found), f"{stats}/homologs")
    _csv(families.histogram(families.homologs(found), "num_species"), f"{stats}/homologs_histogram")
    _csv(families.density(families.density_bins(families.homologs(found), "num_species", 0.25), 0.25), f"{stats}/homologs_density")
    dup = families.duplicity(members, found)
    _csv(dup, f"{stats}/gene_dup")
    _csv(families.histogram(dup, "duplicity"), f"{stats}/gene_dup_histogram")
    _csv(families.density(families.density_bins(dup, "duplicity", 0.05), 0.05), f"{stats}/gene_dup_density")
    _csv(families.gene_lists(found), f"{stats}/gene_to_species", "\t")
    _lines(families.gene_tree_count(members, least), f"{stats}/num_gt")


def round_files(done: modes.Stages, cfg: Config, out: str) -> None:
    """What a round samples and finds: samples, families, mapping and statistics."""
    sampling_files(done.genes, out)
    family_files(done.found, done.members, cfg, done.species, out, done.genes)


def tree_files(gene_trees: DataFrame, gene_count: int, out: str) -> None:
    """Gene trees, the list of all gene ids with their tree (blank where there is none), the species
    per tree, and the species tree."""
    _lines(gene_trees.select("newick"), f"{out}/gene_tree_merged")
    ids = gene_trees.sparkSession.range(1, gene_count + 1).select(F.col("id").cast("int").alias("gene_id"))
    listed = ids.join(gene_trees, "gene_id", "left").select(F.concat(F.col("gene_id"), F.lit(", "), F.coalesce("newick", F.lit(""))))
    _lines(listed, f"{out}/original_list")
    tips = trees.tips_per_tree(gene_trees.withColumnRenamed("gene_id", "tree_id"))
    _csv(tips, f"{out}/statistics/num_species_gt")
    _csv(families.histogram(tips, "n_species"), f"{out}/statistics/num_species_histogram")
    _lines(modes.species_tree(gene_trees).select("newick"), f"{out}/species_tree")


def job_report(jobs: DataFrame, out: str) -> None:
    """Sums per step, the slowest jobs, and the long form that plots take."""
    _csv(reports.step_totals(jobs), f"{out}/step_totals")
    top = reports.slowest(jobs).drop("rn")
    _csv(top, f"{out}/slowest")
    _csv(reports.long_form(top), f"{out}/slowest_long")


def iteration_files(iterations: DataFrame, out: str) -> None:
    """Times since the start and the last round, and the distance to the reference per round."""
    stamped = reports.elapsed(iterations.withColumnRenamed("finished", "ts"))
    _csv(stamped.select("iteration", F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy").alias("at"), "since_start", "since_last"), f"{out}/time_stamps")
    _csv(iterations.select(F.format_string("iteration_%02d", "iteration").alias("iteration"), "gene_trees", "norm_rf").filter("norm_rf is not null"), f"{out}/ref_dist")
