"""The convergence loop: rounds of new genes until branch support settles.

Each round appends its gene trees and its line of the iteration table to Parquet folders keyed by
``iteration``; the species tree is built from all rounds so far, whose speciations are kept as a table
that each round adds its own to.  Rounds use N, N, 2N, 4N, ... genes.
A round that is already in the tables is not run again, so a run that was stopped goes on where it
was.  The configuration is never changed on disk.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees
from ..operators import reports, tripartitions
from ..sources.tables import Config
from . import modes, outputs, species

ITERATIONS = "iteration int, genes int, gene_trees long, support double, delta double, norm_rf double, newick string, finished timestamp"


def gene_counts(cfg: Config, rounds: int) -> list[int]:
    """Genes per round: the count doubles from the third round on."""
    return [cfg.gene_count * 2 ** max(0, k - 2) for k in range(1, rounds + 1)]


def _rows(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(ITERATIONS).parquet(path).orderBy("iteration").collect()
    except Exception as e:  # the first round has no table yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def state_of(spark: SparkSession, out: str, number: int) -> tuple[DataFrame, list[str]]:
    """The speciations and species of all rounds up to ``number``.

    Only that round's trees and the state of the round before are read; the state has a row for each
    distinct speciation.  A state that is there already, of a run that was stopped, is made again.
    """
    own = spark.read.parquet(f"{out}/gene_trees/iteration={number}")
    state = species.speciations(own)
    names = spark.createDataFrame([(n,) for n in species.species_names(own)], "species string")
    if number > 1:
        state = tripartitions.merge(spark.read.schema(tripartitions.STATE).parquet(f"{out}/speciations/iteration={number - 1}"), state)
        names = names.union(spark.read.schema("species string").parquet(f"{out}/species/iteration={number - 1}")).distinct()
    state.write.mode("overwrite").parquet(f"{out}/speciations/iteration={number}")
    names.write.mode("overwrite").parquet(f"{out}/species/iteration={number}")
    table = spark.read.schema(tripartitions.STATE).parquet(f"{out}/speciations/iteration={number}")
    return table, sorted(r[0] for r in spark.read.schema("species string").parquet(f"{out}/species/iteration={number}").collect())


def one_round(spark: SparkSession, genome: DataFrame, cfg: Config, out: str, number: int, rerooted_by: trees.Node | None = None) -> dict:
    """Run one round and append it; returns its row."""
    count = gene_counts(cfg, number)[-1]
    first = sum(gene_counts(cfg, number)) - count
    own = Config(**{**cfg.__dict__, "gene_count": count, "seed": cfg.seed + number})
    done = modes.stages(genome, own, first)
    modes.trees_of(done, own).write.mode("overwrite").parquet(f"{out}/gene_trees/iteration={number}")
    outputs.round_files(done, own, f"{out}/iteration_{number:02}")
    master = spark.read.parquet(f"{out}/gene_trees").filter(F.col("iteration") <= number)
    tree, stats = species.tree_and_stats(*state_of(spark, out, number))
    spark.createDataFrame(stats, species.STATS).coalesce(1).write.mode("overwrite").parquet(f"{out}/branch_stats/iteration={number}")
    table = spark.read.schema(species.STATS).parquet(f"{out}/branch_stats/iteration={number}")
    percent = reports.support_percent(table, cfg.support_threshold).first()["percent"]
    rf = None
    if tree is not None and rerooted_by is not None:
        tree = trees.reroot(tree, trees.best_outgroup(tree, rerooted_by))
        rf = trees.robinson_foulds(tree, rerooted_by)
    return {"iteration": number, "genes": count, "gene_trees": master.count(), "support": percent, "norm_rf": rf, "newick": None if tree is None else trees.text_of(tree)}


def run(spark: SparkSession, genome: DataFrame, cfg: Config, out: str, reference: str | None = None, most: int = 9, single: bool = False) -> DataFrame:
    """The iteration table after the loop (one round with ``single``)."""
    ref = trees.parse(reference) if reference else None
    done = _rows(spark, f"{out}/iterations")
    while True:
        last = done[-1] if done else None
        if last is not None and (single or reports.stops(last["iteration"], last["support"], last["delta"], most)):
            break
        row = one_round(spark, genome, cfg, out, (last["iteration"] if last else 0) + 1, ref)
        known = last is not None and last["support"] is not None and row["support"] is not None
        row["delta"] = abs(row["support"] - last["support"]) if known else None
        row["finished"] = datetime.now(timezone.utc).replace(tzinfo=None)
        line = spark.createDataFrame([tuple(row[x.split()[0]] for x in ITERATIONS.split(", "))], ITERATIONS)
        line.coalesce(1).write.mode("append").parquet(f"{out}/iterations")
        done = _rows(spark, f"{out}/iterations")
    return spark.read.schema(ITERATIONS).parquet(f"{out}/iterations")
