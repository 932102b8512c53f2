"""``python -m cladeloom --config config.yaml [--mode accurate] [--noconverge] [--deep True] [--cores 32]``"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .functions.storage import settle
from .plans import converge, outputs
from .sources import fasta, tables


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cladeloom")
    p.add_argument("--mode", default="accurate", choices=["accurate", "balanced", "fast"])
    p.add_argument("--noconverge", action="store_true")
    p.add_argument("--cores", type=int, default=32)
    p.add_argument("--config", required=True)
    p.add_argument("--deep", default="False")
    p.add_argument("--jobs", help="a folder of job timings to report on")
    a = p.parse_args(args)
    builder = SparkSession.builder.appName("cladeloom").config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None and not builder._options.get("spark.master"):
        builder = builder.config("spark.default.parallelism", a.cores)
    spark = builder.getOrCreate()
    cfg = tables.config(read_text(spark, a.config), mode=a.mode, deep=a.deep.lower() == "true")
    if cfg.scores:
        cfg = replace(cfg, matrix=tuple(map(tuple, tables.matrix(read_text(spark, cfg.scores)))))
    # read once; rounds take it from the shared folder
    genome = settle(fasta.read_chunks(spark, cfg.genomes, 4 * cfg.length + 2 * cfg.seed_length))
    reference = read_text(spark, cfg.reference) if cfg.reference else None
    done = converge.run(spark, genome, cfg, cfg.all_out_dir, reference, single=a.noconverge)
    outputs.iteration_files(done, cfg.all_out_dir)
    rounds = done.count()
    master = spark.read.parquet(f"{cfg.all_out_dir}/gene_trees").select("gene_id", "newick")
    outputs.tree_files(master, sum(converge.gene_counts(cfg, rounds)), cfg.out_dir)
    if a.jobs:
        outputs.job_report(tables.job_timings(spark, a.jobs), f"{cfg.out_dir}/jobs")


if __name__ == "__main__":
    main()
